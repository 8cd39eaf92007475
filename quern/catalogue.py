"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.conditions import blocker_id, compose_path, sanitised_id
from quern.operators import closure as C
from quern.operators import facts, findings, resolve
from quern.plans.materialise import cut
from quern.plans.projection import NAMESPACES, Graph

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMESPACES.items())
_GRAPH = f"""
    nodes AS (
        SELECT 'region:' || r_regionkey AS id, 'region' AS kind FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier
        UNION ALL SELECT 'part:' || p_partkey, 'part' FROM part UNION ALL SELECT 'orders:' || o_orderkey, 'orders' FROM orders),
    edges AS (
        SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, true AS exact FROM customer
        UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, true FROM orders
        UNION ALL SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, bool_or(l_returnflag = 'N') FROM lineitem GROUP BY l_orderkey, l_partkey
        UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, bool_or(l_linestatus = 'F') FROM lineitem GROUP BY l_partkey, l_suppkey
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, true FROM supplier
        UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, true FROM nation
        UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || ((n_nationkey + 1) % 25), n_nationkey % 5 <> 0 FROM nation),
    roots AS (SELECT DISTINCT c_mktsegment AS context, 'orders:' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'),
    contexts AS (SELECT DISTINCT c_mktsegment AS context FROM customer),
    protected AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0),
    blockers AS (SELECT DISTINCT event_type AS producer, 'customer:' || user_id AS source, CASE event_type {_CASES} END AS space FROM events),
    proven AS (SELECT context, id FROM roots UNION SELECT p.context, e.dst FROM proven p JOIN edges e ON e.src = p.id WHERE e.exact)"""
_REACHED = """,
    reached AS (SELECT context, id FROM roots UNION SELECT p.context, e.dst FROM reached p JOIN edges e ON e.src = p.id)"""
_RETAINED = """,
    all_edges AS (
        SELECT src, dst FROM edges UNION SELECT source, 'scope:' || space FROM blockers
        UNION SELECT 'scope:' || space, id FROM (SELECT DISTINCT space FROM blockers) JOIN nodes ON starts_with(id, space)),
    seeds AS (
        SELECT context, id FROM roots UNION SELECT context, id FROM contexts, protected
        UNION SELECT context, 'scope:' || space FROM contexts, blockers WHERE source NOT IN (SELECT id FROM nodes)),
    kept AS (SELECT context, id FROM seeds UNION SELECT p.context, e.dst FROM kept p JOIN all_edges e ON e.src = p.id),
    retained AS (SELECT context, id FROM kept WHERE NOT starts_with(id, 'scope:'))"""


@query(f"""WITH RECURSIVE {_GRAPH}{_REACHED}
    SELECT id, coalesce(string_agg(DISTINCT context, ',' ORDER BY context), '') AS retained_in
    FROM nodes LEFT JOIN reached USING (id) WHERE kind = 'part' AND id NOT IN (SELECT id FROM proven) GROUP BY id""")
def unproven_parts(spark, sf_dir):
    g = Graph(spark, sf_dir)
    edges, parts = g.edges(repeats=True), g.nodes().where("kind = 'part'").select("id")
    roots = cut(g.roots())
    found = C.closures({"proven": (roots, F.col("exact")), "reached": (roots, None)}, edges)
    reached = found.where("run = 'reached'").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("context")), ",").alias("retained_in"))
    open_ = C.unreachable(parts, found.where("run = 'proven'"))
    return open_.join(reached, "id", "left").select("id", F.coalesce("retained_in", F.lit("")).alias("retained_in"))


@query(f"WITH RECURSIVE {_GRAPH} SELECT context, id FROM proven")
def proven_closure(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return C.proven(g.roots(), g.edges(repeats=True))


def _retained(g: Graph, edges: DataFrame) -> DataFrame:
    return C.retained(g.roots(), edges, g.protected(), g.blockers(), g.nodes(), g.contexts())


@query(f"WITH RECURSIVE {_GRAPH}{_RETAINED} SELECT context, id FROM retained")
def retained_closure(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return _retained(g, g.edges(repeats=True))


@query(f"WITH RECURSIVE {_GRAPH} SELECT id, kind FROM nodes WHERE id NOT IN (SELECT id FROM proven)")
def unreachable_across_all(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return C.unreachable(g.nodes(), C.proven(g.roots(), g.edges(repeats=True)))


def _findings(spark, sf_dir):
    g = Graph(spark, sf_dir)
    edges = g.edges(repeats=True)
    blockers = cut(g.blockers())
    found = C.proven_and_retained(cut(g.roots()), edges, g.protected(), blockers, g.nodes(), g.contexts())
    active = blockers.join(found.where("retained").select(F.col("id").alias("source_node_id")), "source_node_id", "left_semi")
    free = C.sourceless(blockers, g.nodes())
    blocked = C.addressed(active.unionByName(free.select(*active.columns)), g.nodes()).select("id")
    rows = findings.marked(g.nodes(), found, g.protected(), blocked)
    return findings.classified(rows, F.col("kind") != "region", F.col("kind") == "customer", F.lit(True), F.lit(True))


_FOUND = f"""WITH RECURSIVE {_GRAPH}{_RETAINED},
    active AS (SELECT DISTINCT space FROM blockers WHERE source IN (SELECT id FROM retained) OR source NOT IN (SELECT id FROM nodes)),
    flags AS (
        SELECT id, kind, id IN (SELECT id FROM retained) AS kept, id IN (SELECT id FROM protected) AS is_protected,
            EXISTS (SELECT 1 FROM active WHERE starts_with(nodes.id, space)) AS has_blockers, kind <> 'region' AS supported, kind = 'customer' AS external
        FROM nodes WHERE id NOT IN (SELECT id FROM proven)),
    found AS (
        SELECT id, kind, CASE WHEN is_protected THEN 'protected' WHEN kept OR has_blockers OR NOT supported THEN 'review' WHEN external THEN 'high' ELSE 'safe' END AS tier,
            list_filter([CASE WHEN kept THEN 'retainedOnly' END, CASE WHEN has_blockers THEN 'dynamicReference' END, CASE WHEN NOT supported THEN 'unsupportedAction' END,
                CASE WHEN external THEN 'externalConsumersNotScanned' END], lambda x: x IS NOT NULL) AS reasons
        FROM flags)"""


@query(f"{_FOUND} SELECT id, kind, tier, array_to_string(reasons, ',') AS reasons FROM found")
def classified_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("id", "kind", "tier", F.array_join("reasons", ",").alias("reasons"))


@query(f"""{_FOUND}
    SELECT 'tier' AS dimension, t AS value, (SELECT count(*) FROM found WHERE tier = t) AS n FROM unnest(['protected', 'review', 'high', 'safe']) AS x(t)
    UNION ALL SELECT 'kind', kind, count(*) FROM found GROUP BY kind
    UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(reasons) AS r FROM found) GROUP BY r""")
def finding_statistics(spark, sf_dir):
    return findings.statistics(_findings(spark, sf_dir))


@query("""SELECT 'orders:' || l_orderkey AS src, 'part:' || (l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END) AS dst
    FROM lineitem WHERE l_linenumber = 7 OR l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY ALL""")
def dangling_edges(spark, sf_dir):
    g = Graph(spark, sf_dir)
    far = F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, F.lit(10**9)).otherwise(F.lit(0))
    edges = g.table("lineitem").withColumn("far", far).select(g.ids("orders", "l_orderkey", "src"), g.ids("part", "far", "dst"))
    return C.dangling(edges, g.nodes())


@query("""SELECT p_brand AS id, min_by(p_type, length(p_type) || ':' || p_type) AS type, min_by(p_name, p_partkey) AS owner, count(DISTINCT p_type) > 1 AS conflict FROM part GROUP BY p_brand""")
def node_conflicts(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("producer"), F.col("p_partkey").alias("seq"))
    kept, conflicts = facts.nodes(rows, ["type"])
    conflicts = conflicts.select(F.element_at("affected_node_ids", 1).alias("id"), F.lit(True).alias("conflict"))
    return kept.join(conflicts, "id", "left").select("id", "type", "owner", F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query("""SELECT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, bool_or(l_linestatus = 'F') AS exact,
    min_by(l_returnflag, (CASE WHEN l_linestatus = 'F' THEN '0' ELSE '1' END) || l_returnflag) AS evidence FROM lineitem GROUP BY l_partkey, l_suppkey""")
def edge_identity(spark, sf_dir):
    g = Graph(spark, sf_dir)
    rows = g.table("lineitem").select(g.ids("part", "l_partkey", "src"), g.ids("supplier", "l_suppkey", "dst"), F.lit("uses").alias("kind"), F.lit("").alias("condition_key"), (F.col("l_linestatus") == "F").alias("exact"), F.col("l_returnflag").alias("evidence"))
    return facts.edges(rows).select("src", "dst", "exact", "evidence")


@query(f"""WITH b AS (SELECT event_type AS producer, 'customer:' || user_id AS source, CASE event_type {_CASES} END AS space, count(*) AS recorded FROM events GROUP BY ALL)
    SELECT 'blocker-' || substr(sha256(producer || chr(0) || 'unresolved' || chr(0) || chr(0) || source || chr(0) || space || chr(0)), 1, 16) AS blocker_id, producer, recorded FROM b""")
def blocker_registry(spark, sf_dir):
    space = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    g = Graph(spark, sf_dir)
    none = F.lit(None).cast("string")
    rows = g.table("events").select(F.col("event_type").alias("producer"), F.lit("unresolved").alias("reason"), none.alias("location"), g.ids("customer", "user_id", "source_node_id"), F.element_at(space, F.col("event_type")).alias("affected_namespace"), F.array().cast("array<string>").alias("affected_node_ids"))
    b = facts.blockers(rows)
    return b.select(blocker_id(*[F.col(c) for c in ("producer", "reason", "location", "source_node_id", "affected_namespace", "affected_node_ids")]).alias("blocker_id"), "producer", "recorded")


@query("""SELECT sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size, count(*) AS copies, CAST((count(*) - 1) * strlen(text) AS BIGINT) AS waste, min(doc_id) AS first_path
    FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_content(spark, sf_dir):
    return resolve.duplicate_content(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("""SELECT page_id, '/' || array_to_string(list_filter(string_split('app//' || split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]*', ''), '?', 1), '#', 1), '/'), lambda x: x <> ''), '/') AS path FROM pages""")
def route_composition(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    return _read(spark, sf_dir, "pages").select("page_id", compose_path(F.lit("app/"), path).alias("path"))


@query("""WITH held AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first_id FROM part WHERE p_size <= 10 GROUP BY ALL)
    SELECT p_partkey, p_brand, p_type, coalesce(n, 0) AS candidates, CASE coalesce(n, 0) WHEN 0 THEN 'namespace_blocker' WHEN 1 THEN 'edge' ELSE 'id_blocker' END AS outcome,
        CASE WHEN n = 1 THEN first_id END AS target FROM part LEFT JOIN held USING (p_brand, p_type)""")
def registration_lookup(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return resolve.lookups(part.select("p_partkey", "p_brand", "p_type"), part.where("p_size <= 10").select("p_brand", "p_type", F.col("p_partkey").alias("id")), ["p_brand", "p_type"])


@query("""WITH m AS (SELECT DISTINCT CAST(doc_id % 97 AS VARCHAR) || source AS key, lang AS locale FROM documents)
    SELECT key, string_agg(locale, ',' ORDER BY locale) AS missing FROM (SELECT k.key, l.locale FROM (SELECT DISTINCT key FROM m) k, (SELECT DISTINCT locale FROM m) l
    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.key = k.key AND m.locale = l.locale)) GROUP BY key""")
def locale_gaps(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return resolve.missing_locales(docs.select(F.concat((F.col("doc_id") % 97).cast("string"), "source").alias("key"), F.col("lang").alias("locale")))


@query("""WITH i AS (SELECT event_id AS id, user_id, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + 3600 AS e, event_type FROM events)
    SELECT a.id AS left_id, b.id AS right_id FROM i a JOIN i b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'error' AND b.event_type = 'purchase'""")
def interval_overlap(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("start"), (F.unix_timestamp("ts") + 3600).alias("end"), "event_type")
    return resolve.overlapping(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", 3600)


@query("""SELECT k AS key, a - coalesce(b, 0) AS more FROM (SELECT l_returnflag || l_linestatus || l_linenumber AS k, count(*) AS a FROM lineitem WHERE l_shipdate >= '1996-01-01' GROUP BY 1)
    LEFT JOIN (SELECT l_returnflag || l_linestatus || l_linenumber AS k, count(*) AS b FROM lineitem WHERE l_shipdate < '1996-01-01' GROUP BY 1) USING (k) WHERE a > coalesce(b, 0)""")
def failure_regression(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("key"), "l_shipdate")
    return resolve.multiset_difference(line.where("l_shipdate >= '1996-01-01'"), line.where("l_shipdate < '1996-01-01'"), "key")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY user_id")
def ledger_state(spark, sf_dir):
    return resolve.latest_state(_read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels")
def grading(spark, sf_dir):
    return resolve.grading(_read(spark, sf_dir, "labels"), "quality", "toxic")


@query("""SELECT page_id, CASE WHEN regexp_replace(url, '[^A-Za-z0-9._/-]', '_', 'g') = url THEN url ELSE regexp_replace(url, '[^A-Za-z0-9._/-]', '_', 'g') || '~' || substr(sha256(url), 1, 16) END AS id FROM pages""")
def stable_ids(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", sanitised_id(F.col("url")).alias("id"))
