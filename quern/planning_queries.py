"""Registered queries of plans, surfaces, inventories, ledgers and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalogue import _FOUND, _GRAPH, _RETAINED, QUERIES, _findings, _read, _retained, query
from quern.functions.conditions import CONDITION
from quern.operators import catalogues, facts, ledger, planner, rounds, surface
from quern.operators.closure import sourceless
from quern.plans.model import Model
from quern.plans.projection import NAMESPACES, Graph

__all__ = ["QUERIES"]


def _on_platform(column: str):
    """The condition that holds on the platform of a column, everywhere where that is null."""
    return F.expr(f"named_struct('platforms', CASE WHEN {column} IS NULL THEN array() ELSE array({column}) END, 'flavors', array(), 'entrypoints', array(), 'dart_defines', map(), 'exact_targets', array(), 'exact_aux_targets', array())").cast(CONDITION)


def _model(spark, nodes, edges, roots) -> Model:
    """A graph over one context on ios and one on android, with nothing protected or blocked."""
    targets = spark.createDataFrame([("one", "ios", "main", None, {}), ("two", "android", "main", None, {})], "name string, platform string, entrypoint string, flavor string, dart_defines map<string,string>")
    empty = lambda schema: spark.createDataFrame([], schema)
    blockers = empty("producer string, reason string, location string, source_node_id string, affected_namespace string, affected_node_ids array<string>")
    return Model(nodes, edges, roots, targets, empty("id string, environment_complete boolean"), empty("id string, reason string"), blockers)


_STEPS = """
    n AS (SELECT p_partkey, p_brand || '-' || (p_size % 8) AS id, p_brand, p_size % 8 AS p_size, p_size AS whole FROM part),
    links AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1 WHERE b.whole > a.whole)"""


def _steps(spark, sf_dir):
    """Brand and size class of each part as a node, with an edge to those of the part with the next key if that is larger."""
    n = _read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_brand", (F.col("p_size") % 8).cast("string")).alias("id"), "p_brand", (F.col("p_size") % 8).alias("p_size"), F.col("p_size").alias("whole"))
    following = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("id").alias("dst"), F.col("whole").alias("next_size"))
    links = n.select("p_partkey", F.col("id").alias("src"), "whole").join(following, "p_partkey").where("next_size > whole")
    return n, links.select("src", "dst").distinct()


@query(f"""WITH RECURSIVE {_STEPS}, reach AS (SELECT DISTINCT id AS a, id AS b FROM n UNION SELECT r.a, l.dst FROM reach r JOIN links l ON l.src = r.b)
    SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def strong_components(spark, sf_dir):
    n, links = _steps(spark, sf_dir)
    return planner.strong_components(n, links)


_PLAN = f"""{_STEPS}, chosen AS (SELECT DISTINCT id, p_brand FROM n WHERE p_brand <> 'Brand#1'), folded AS (SELECT DISTINCT id, p_brand FROM n WHERE p_size > 5 AND p_brand <> 'Brand#1'),
    heads AS (SELECT p_brand, min(id) AS head FROM folded GROUP BY p_brand), star AS (SELECT id, head FROM folded JOIN heads USING (p_brand) WHERE id <> head),
    deps AS (SELECT src, dst FROM links WHERE src IN (SELECT id FROM chosen) AND dst IN (SELECT id FROM chosen) AND src <> dst UNION SELECT id, head FROM star UNION SELECT head, id FROM star),
    outside AS (SELECT dst AS id, min(src) AS consumer FROM links WHERE dst IN (SELECT id FROM chosen) AND src NOT IN (SELECT id FROM chosen) GROUP BY dst),
    held AS (SELECT id FROM outside UNION SELECT d.dst FROM held h JOIN deps d ON d.src = h.id)"""


def _plan(spark, sf_dir):
    n, links = _steps(spark, sf_dir)
    chosen = n.where("p_brand <> 'Brand#1'").select("id", F.when(F.col("p_size") > 5, F.col("p_brand")).alias("path")).distinct()
    return planner.dependencies(chosen, links)


@query(f"""WITH RECURSIVE {_PLAN} SELECT h.id, CASE WHEN o.id IS NOT NULL THEN 'retainedConsumer' ELSE 'blockedByRetainedDependency' END AS reason,
    CASE WHEN o.id IS NOT NULL THEN min(consumer) ELSE min(p.id) END AS blocked_by
    FROM held h LEFT JOIN outside o ON o.id = h.id LEFT JOIN deps d ON d.dst = h.id LEFT JOIN held p ON p.id = d.src GROUP BY h.id, o.id""")
def plan_blocked(spark, sf_dir):
    return planner.blocked(*_plan(spark, sf_dir))


@query(f"""WITH RECURSIVE {_STEPS}, reach AS (SELECT DISTINCT id AS a, id AS b FROM n UNION SELECT r.a, l.dst FROM reach r JOIN links l ON l.src = r.b),
    c AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
    SELECT component, 'unit:' || substr(sha256(string_agg(id, chr(0) ORDER BY id)), 1, 16) AS unit_id, count(*) AS members FROM c GROUP BY component""")
def plan_units(spark, sf_dir):
    n, links = _steps(spark, sf_dir)
    rows = planner.units(planner.strong_components(n, links), links)
    return rows.select("component", "unit_id", F.size("members").cast("bigint").alias("members"))


@query("""WITH RECURSIVE own AS (SELECT DISTINCT p_partkey % 25 AS library, p_brand AS name FROM part WHERE p_size <= 3),
    seen AS (SELECT library, name, true AS exact FROM own UNION
        SELECT n_nationkey, name, exact AND n_nationkey % 5 <> 0 FROM seen JOIN nation ON library = (n_nationkey + 1) % 25 WHERE name <> 'Brand#' || (n_nationkey % 5 + 1))
    SELECT library, name, bool_or(exact) AS exact FROM seen GROUP BY library, name""")
def public_surface(spark, sf_dir):
    own = _read(spark, sf_dir, "part").where("p_size <= 3").select((F.col("p_partkey") % 25).alias("library"), F.col("p_brand").alias("name"))
    k = F.col("n_nationkey").cast("bigint")
    hide = F.array(F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string")))
    ways = _read(spark, sf_dir, "nation").select(k.alias("library"), ((k + 1) % 25).alias("target"), (k % 5 != 0).alias("exact"), F.lit(None).cast("array<string>").alias("show"), hide.alias("hide"))
    return surface.exported_names(own, ways)


_OUTCOME = "CASE l_returnflag WHEN 'N' THEN 'true' WHEN 'A' THEN 'false' ELSE 'unknown' END"


@query(f"""WITH a AS (SELECT l_orderkey AS directive, l_linenumber AS position, {_OUTCOME} AS outcome, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice) AS n FROM lineitem)
    SELECT directive, CAST(n AS INT) AS position, outcome = 'true' AND NOT EXISTS (SELECT 1 FROM a b WHERE b.directive = a.directive AND b.n < a.n AND b.outcome = 'unknown') AS exact
    FROM a WHERE outcome <> 'false' AND NOT EXISTS (SELECT 1 FROM a b WHERE b.directive = a.directive AND b.n < a.n AND b.outcome = 'true')""")
def directive_selection(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS directive", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice) AS position", f"{_OUTCOME} AS outcome")
    return surface.selected_alternatives(lines, ["directive"]).select("directive", "position", "exact")


@query("""WITH p AS (SELECT DISTINCT split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '#', 1) AS path FROM pages),
    r AS (SELECT DISTINCT split_part(path, '/', 1) AS name, split_part(path, '/', 1) AS root FROM p UNION SELECT 'english', split_part(path, '/', 1) || '/en' FROM p),
    hits AS (SELECT path, arg_max(name, length(root)) AS owner FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY path)
    SELECT path, coalesce(owner, 'external') AS owner FROM p LEFT JOIN hits USING (path)""")
def path_owners(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    p = _read(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    host = F.substring_index("path", "/", 1)
    return surface.owners(p, p.select(host.alias("name"), host.alias("root")).unionByName(p.select(F.lit("english").alias("name"), F.concat(host, F.lit("/en")).alias("root"))).distinct())


@query("""WITH names AS (SELECT p_name || p_size AS name, 'part:' || p_partkey AS owner FROM part WHERE p_size <= 10 UNION ALL SELECT 'noSuchMethod', 'brand:' || p_brand FROM part WHERE p_size = 50),
    refs AS (SELECT p_partkey AS ref_id, CASE WHEN p_size % 10 <> 0 THEN p_name || p_size END AS name, p_size % 7 = 0 AS can_dispatch FROM part),
    c AS (SELECT ref_id, owner FROM refs JOIN names USING (name) UNION SELECT ref_id, owner FROM refs, names WHERE refs.name IS NOT NULL AND can_dispatch AND names.name = 'noSuchMethod'),
    g AS (SELECT ref_id, string_agg(owner, ',' ORDER BY owner) AS candidates FROM c GROUP BY ref_id)
    SELECT ref_id, coalesce(candidates, '') AS candidates, CASE WHEN name IS NULL THEN 'namespace_blocker' WHEN candidates IS NULL THEN 'none' ELSE 'id_blocker' END AS outcome FROM refs LEFT JOIN g USING (ref_id)""")
def reference_candidates(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    name = F.concat("p_name", F.col("p_size").cast("string"))
    held = part.where("p_size <= 10").select(name.alias("name"), F.concat(F.lit("part:"), "p_partkey").alias("owner_id")).unionByName(part.where("p_size = 50").select(F.lit("noSuchMethod").alias("name"), F.concat(F.lit("brand:"), "p_brand").alias("owner_id")))
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.when(F.col("p_size") % 10 != 0, name).alias("name"), (F.col("p_size") % 7 == 0).alias("can_dispatch"))
    return surface.reference_candidates(refs, held).withColumn("candidates", F.array_join("candidates", ","))


_STATE = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'applied' WHEN 'click' THEN 'verified' WHEN 'purchase' THEN 'committed' ELSE 'recoveryRequired' END"


@query(f"""WITH e AS (SELECT event_id, user_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, state, before FROM e WHERE NOT coalesce(CASE state WHEN 'pending' THEN before IS NULL WHEN 'applied' THEN before = 'pending' WHEN 'verified' THEN before = 'applied'
        WHEN 'committed' THEN before = 'verified' ELSE before IN ('pending', 'applied', 'verified') END, false)""")
def ledger_violations(spark, sf_dir):
    events = _read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", f"{_STATE} AS state")
    return ledger.violations(events, "user_id", ["ts", "event_id"]).select("event_id", "state", "before")


@query(f"SELECT user_id, max_by({_STATE}, (ts, event_id)) AS state FROM events GROUP BY user_id HAVING max_by({_STATE}, (ts, event_id)) <> 'committed'")
def blocking_runs(spark, sf_dir):
    return ledger.blocking_runs(_read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", f"{_STATE} AS state"), "user_id", ["ts", "event_id"])


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_writes(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return ledger.last_writes(e, "user_id", "event_id")


@query("""SELECT event_type AS member, count(DISTINCT user_id) AS claims FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1""")
def shared_members(spark, sf_dir):
    return ledger.shared_members(_read(spark, sf_dir, "events").withColumnRenamed("event_type", "member"), "user_id", "member")


@query("""SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) FILTER (o_orderpriority <> '1-URGENT') AS reported, count(*) AS counted FROM orders GROUP BY o_orderstatus HAVING reported <> counted
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FILTER (o_orderpriority <> '1-URGENT'), count(*) FROM orders GROUP BY o_orderpriority HAVING count(*) FILTER (o_orderpriority <> '1-URGENT') <> count(*)""")
def report_mismatches(spark, sf_dir):
    orders, dims = _read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]
    seen = orders.where("o_orderpriority <> '1-URGENT'")
    reported = seen.groupBy(F.lit(dims[0]).alias("dimension"), F.col(dims[0]).alias("value")).agg(F.count("*").alias("n")).unionByName(seen.groupBy(F.lit(dims[1]).alias("dimension"), F.col(dims[1]).alias("value")).agg(F.count("*").alias("n")))
    return ledger.count_mismatches(orders, reported, dims)


@query(f"""{_FOUND} SELECT tier, kind, id, 'application' AS mode FROM found WHERE tier = 'safe' UNION ALL SELECT tier, kind, id, 'packageInternal' FROM found WHERE tier IN ('safe', 'high')""")
def applicable_findings(spark, sf_dir):
    from quern.operators.findings import allowed
    from quern.plans.materialise import cut

    rows = cut(_findings(spark, sf_dir))
    one = lambda mode: rows.where(allowed(mode)).select("tier", "kind", "id", F.lit(mode).alias("mode"))
    return one("application").unionByName(one("packageInternal"))


@query(f"{_FOUND} SELECT id, to_json({{'id': id, 'kind': kind, 'confidence': tier, 'classificationReasons': reasons}})::VARCHAR AS payload FROM found")
def finding_report(spark, sf_dir):
    from quern.sinks import finding_json

    return _findings(spark, sf_dir).select("id", finding_json().alias("payload"))


@query("""SELECT p_type AS kind, count(*) FILTER (p_size % 5 <> 0) AS known, count(*) FILTER (p_size % 5 = 0) AS unknown, CAST(sum(p_size) FILTER (p_size % 5 <> 0) AS BIGINT) AS total FROM part GROUP BY p_type""")
def measurements(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"))
    return catalogues.measurements(part, "kind", "size")


@query("""SELECT 'directory:' || d AS reason, count(DISTINCT url) AS paths FROM (SELECT url, CASE WHEN list_contains(s, 'en') AND list_contains(s, 'de') THEN '?' WHEN list_contains(s, 'en') THEN 'en' ELSE 'de' END AS d
    FROM (SELECT url, string_split(url, '/') AS s FROM pages) WHERE list_contains(s, 'en') OR list_contains(s, 'de')) GROUP BY 1""")
def path_exclusions(spark, sf_dir):
    return catalogues.exclusions(_read(spark, sf_dir, "pages").select(F.col("url").alias("path")), directories=("en", "de"))


@query("""WITH f AS (SELECT p_name AS name, p_size AS size, p_size % 3 AS ratio FROM part)
    SELECT 'images/' || name AS base, count(*) FILTER (ratio > 0) AS variants, CAST(sum(size) AS BIGINT) AS size_bytes FROM f GROUP BY name HAVING count(*) FILTER (ratio = 0) > 0""")
def variant_families(spark, sf_dir):
    ratio = (F.col("p_size") % 3).cast("string")
    path = F.when(ratio == "0", F.concat(F.lit("images/"), "p_name")).otherwise(F.concat(F.lit("images/"), ratio, F.lit(".0x/"), "p_name"))
    return catalogues.variant_families(_read(spark, sf_dir, "part").select(path.alias("path"), F.col("p_size").alias("size_bytes")))


@query("""WITH keys AS (SELECT DISTINCT 'icons/' || replace(p_name, ' ', '_') AS key FROM part WHERE p_size > 5),
    u AS (SELECT p_partkey AS use_id, p_size, 'icons/' || replace(p_name, ' ', '_') AS own, 'icons/' || split_part(p_name, ' ', 1) AS head FROM part),
    e AS (SELECT DISTINCT use_id, CASE WHEN p_size % 2 = 0 THEN 'constString' ELSE 'finiteStringSet' END AS kind, key FROM u JOIN keys ON key = own OR (p_size % 2 = 1 AND key = 'icons/small_ring') WHERE p_size <= 30)
    SELECT use_id, 'edge' AS outcome, max(kind) AS kind, string_agg(key, ',' ORDER BY key) AS targets FROM e GROUP BY use_id
    UNION ALL SELECT use_id, 'id_blocker', 'pattern', string_agg(key, ',' ORDER BY key) FROM u JOIN keys ON starts_with(key, head || '_') WHERE p_size BETWEEN 31 AND 45 GROUP BY use_id
    UNION ALL SELECT use_id, 'namespace_blocker', 'icons/', '' FROM u WHERE p_size > 45""")
def asset_references(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    own = F.concat(F.lit("icons/"), F.replace("p_name", F.lit(" "), F.lit("_")))
    exact = F.when(F.col("p_size") <= 30, F.when(F.col("p_size") % 2 == 0, F.array(own)).otherwise(F.array(own, F.lit("icons/small_ring"), F.lit("icons/none"))))
    pattern = F.when(F.col("p_size").between(31, 45), F.concat(F.lit("^icons/"), F.substring_index("p_name", " ", 1), F.lit("_.*$")))
    uses = part.select(F.col("p_partkey").alias("use_id"), exact.alias("exact_values"), pattern.alias("pattern"))
    return catalogues.asset_references(uses, part.where("p_size > 5").select(own.alias("key")), "icons/").withColumn("targets", F.array_join("targets", ","))


@query("""WITH r AS (SELECT page_id AS node_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS full_path, CASE WHEN page_id % 3 <> 0 THEN 'page' || (page_id % 50) END AS name FROM pages)
    SELECT node_id, count(*) OVER (PARTITION BY full_path) = 1 AS path_usable, name IS NOT NULL AND count(*) OVER (PARTITION BY name) = 1 AS name_usable FROM r""")
def route_conflicts(spark, sf_dir):
    return catalogues.route_conflicts(_routes(spark, sf_dir))


def _routes(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    name = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("page"), (F.col("page_id") % 50).cast("string")))
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("node_id"), path.alias("full_path"), name.alias("name"))


@query("""WITH r AS (SELECT 'page' || (p_partkey % 70) AS name, min(p_partkey) AS first_id, count(*) AS n FROM part WHERE p_size < 10 GROUP BY 1),
    q AS (SELECT page_id AS nav_id, CASE WHEN page_id % 3 <> 0 THEN 'page' || (page_id % 50) END AS name FROM pages)
    SELECT nav_id, CASE WHEN name IS NULL THEN 'namespace_blocker' WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'edge' ELSE 'id_blocker' END AS outcome, CASE WHEN n = 1 THEN first_id END AS target FROM q LEFT JOIN r USING (name)""")
def named_navigations(spark, sf_dir):
    held = _read(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("page"), (F.col("p_partkey") % 70).cast("string")).alias("name"), F.col("p_partkey").alias("node_id"))
    return catalogues.named_navigations(_routes(spark, sf_dir).select(F.col("node_id").alias("nav_id"), "name"), held)


@query("""WITH h AS (SELECT p_brand, count(*) AS candidates, bool_or(p_size = 10) AS doubt FROM part WHERE p_size <= 10 GROUP BY p_brand)
    SELECT p_partkey AS request_id, coalesce(candidates, 0) AS candidates, CASE WHEN candidates IS NULL THEN 'namespace_blocker' WHEN doubt THEN 'id_blocker' ELSE 'edges' END AS outcome FROM part LEFT JOIN h USING (p_brand)""")
def registration_lookup_all(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return catalogues.lookups_all(part.select(F.col("p_partkey").alias("request_id"), "p_brand"), part.where("p_size <= 10").select("p_brand", (F.col("p_size") == 10).alias("uncertain")), "p_brand")


@query("""SELECT p_partkey AS key, 'de' AS locale FROM part WHERE p_size % 4 = 0""")
def placeholder_mismatches(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    template = part.select(F.col("p_partkey").alias("key"), F.lit("en").alias("locale"), F.lit(True).alias("is_template"), F.concat(F.lit("{count} of "), "p_name", F.lit(" {name}")).alias("message"))
    text = F.when(F.col("p_size") % 4 == 0, F.lit("{name}")).otherwise(F.lit("{name}: {count, plural, other{viele}}"))
    other = part.select(F.col("p_partkey").alias("key"), F.lit("de").alias("locale"), F.lit(False).alias("is_template"), text.alias("message"))
    return catalogues.placeholder_mismatches(template.unionByName(other))


@query("""SELECT DISTINCT lang || '-' || source AS tag, CASE WHEN regexp_matches(upper(source), '^([A-Z]{2}|[0-9]{3})$') THEN lang || '_' || upper(source) END AS locale FROM documents""")
def normal_locales(spark, sf_dir):
    tag = F.concat_ws("-", "lang", "source")
    return _read(spark, sf_dir, "documents").select(tag.alias("tag")).distinct().select("tag", catalogues.normal_locale(F.col("tag")).alias("locale"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'k' ELSE '' END AS repeated FROM events")
def repeated_json_keys(spark, sf_dir):
    text = F.when(F.col("event_type") == "click", F.concat(F.lit('{"k": 0, '), F.expr("substring(props, 2)"))).otherwise(F.col("props"))
    return _read(spark, sf_dir, "events").select("event_id", F.array_join(catalogues.repeated_json_keys(text), ",").alias("repeated"))


@query("""WITH RECURSIVE t(context, platform) AS (VALUES ('app:one', 'ios'), ('app:two', 'android')),
    e AS (SELECT 'orders:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, NULL AS platform FROM orders
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'ios' WHEN 'AUTOMOBILE' THEN 'android' END FROM customer
        UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || ((n_nationkey + 1) % 25), CASE WHEN n_nationkey % 2 = 0 THEN 'ios' END FROM nation WHERE n_nationkey % 5 <> 0),
    p AS (SELECT context, platform, 'orders:' || o_orderkey AS id FROM orders, t WHERE o_orderpriority = '1-URGENT'
        UNION SELECT p.context, p.platform, e.dst FROM p JOIN e ON e.src = p.id AND coalesce(e.platform, p.platform) = p.platform)
    SELECT context, id FROM p""")
def conditional_closure(spark, sf_dir):
    nation, orders, customer = (_read(spark, sf_dir, t) for t in ("nation", "orders", "customer"))
    ids = lambda t, c: F.concat(F.lit(f"{t}:"), c.cast("string"))
    none = F.lit(None).cast("string")
    raw = orders.select(ids("orders", F.col("o_orderkey")).alias("src"), ids("customer", F.col("o_custkey")).alias("dst"), none.alias("only"))
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "ios").when(F.col("c_mktsegment") == "AUTOMOBILE", "android")
    raw = raw.unionByName(customer.select(ids("customer", F.col("c_custkey")).alias("src"), ids("nation", F.col("c_nationkey")).alias("dst"), segment.alias("only")))
    k = F.col("n_nationkey")
    raw = raw.unionByName(nation.where("n_nationkey % 5 <> 0").select(ids("nation", k).alias("src"), ids("nation", (k + 1) % 25).alias("dst"), F.when(k % 2 == 0, "ios").alias("only")))
    edges = raw.select("src", "dst", F.lit("uses").alias("kind"), F.lit(True).alias("exact"), F.lit("").alias("evidence"), _on_platform("only").alias("condition"))
    nodes = raw.select(F.col("src").alias("id"), F.lit("node").alias("kind"))
    roots = orders.where("o_orderpriority = '1-URGENT'").select(ids("orders", F.col("o_orderkey")).alias("id"), F.lit(None).cast(CONDITION).alias("condition"), none.alias("aux_id"))
    return _model(spark, nodes, edges, roots).proven


_SPACES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMESPACES.items())


@query(f"""WITH RECURSIVE {_GRAPH}{_RETAINED},
    b AS (SELECT event_type AS producer, 'customer:' || user_id AS source, CASE event_type {_SPACES} END AS space, count(*) AS recorded FROM events GROUP BY ALL)
    SELECT producer, CAST(sum(recorded) AS BIGINT) AS recorded, count(*) AS distinct_blockers, count(*) FILTER (source IN (SELECT id FROM retained) OR source NOT IN (SELECT id FROM nodes)) AS active,
        count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes WHERE starts_with(id, space))) AS unbound FROM b GROUP BY producer""")
def blocker_statistics(spark, sf_dir):
    g = Graph(spark, sf_dir)
    space = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    rows = g.table("events").select(F.col("event_type").alias("producer"), F.lit("unresolved").alias("reason"), F.lit(None).cast("string").alias("location"), g.ids("customer", "user_id", "source_node_id"), F.element_at(space, F.col("event_type")).alias("affected_namespace"), F.array().cast("array<string>").alias("affected_node_ids"))
    recorded = facts.blockers(rows)
    kept = _retained(g, g.edges(repeats=True)).select(F.col("id").alias("source_node_id")).distinct()
    active = recorded.join(kept, "source_node_id", "left_semi").select(*recorded.columns).unionByName(sourceless(recorded, g.nodes()))
    return catalogues.blocker_counts(recorded, active, g.nodes())


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'ios' WHEN 'R' THEN 'web' END AS platform FROM lineitem WHERE l_linenumber = 7),
    r AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P'), t(context, platform) AS (VALUES ('app:one', 'ios'), ('app:two', 'android')),
    c AS (SELECT context, (SELECT count(*) FROM e WHERE coalesce(e.platform, t.platform) = t.platform) AS dangling_edges, (SELECT count(*) FROM r) AS dangling_roots FROM t
        UNION ALL SELECT 'unattributed', (SELECT count(*) FROM e WHERE platform = 'web'), 0)
    SELECT context, dangling_edges, dangling_roots, CAST(0 AS BIGINT) AS unknown_edges, dangling_edges + dangling_roots = 0 AS complete FROM c""")
def context_integrity(spark, sf_dir):
    g = Graph(spark, sf_dir)
    far = F.when(F.col("l_linenumber") == 7, F.col("l_partkey") + 10**9).otherwise(F.col("l_partkey"))
    only = F.when(F.col("l_returnflag") == "A", "ios").when(F.col("l_returnflag") == "R", "web")
    raw = g.table("lineitem").withColumn("far", far).select(g.ids("orders", "l_orderkey", "src"), g.ids("part", "far", "dst"), only.alias("only")).distinct()
    edges = raw.select("src", "dst", F.lit("uses").alias("kind"), F.lit(True).alias("exact"), F.lit("").alias("evidence"), _on_platform("only").alias("condition"))
    lost = g.table("orders").withColumn("far", F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "P", 10**9).otherwise(0))
    roots = lost.select(g.ids("orders", "far"), F.lit(None).cast(CONDITION).alias("condition"), F.lit(None).cast("string").alias("aux_id"))
    return _model(spark, g.nodes(), edges, roots).integrity


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, (p_partkey * p_partkey + 7 * p_size) % (SELECT count(*) FROM part) AS next FROM part),
    reach AS (SELECT id AS a, next AS b FROM n UNION SELECT r.a, n.next FROM reach r JOIN n ON n.id = r.b)
    SELECT 'part:' || n.id AS id, coalesce((SELECT min('part:' || x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = n.id), 'part:' || n.id) AS component FROM n""")
def unfolded_components(spark, sf_dir):
    """Strong components of a graph with a node for each part, which grows with the table."""
    part = _read(spark, sf_dir, "part")
    n = part.count()
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("part:"), c.cast("string"))
    return planner.strong_components(part.select(name(k).alias("id")), part.select(name(k).alias("src"), name((k * k + 7 * F.col("p_size")) % n).alias("dst")))


@query("""WITH e AS (SELECT 'f' || l_partkey AS dst, 'u' || l_suppkey AS src, l_linenumber <= 3 AS import_, l_returnflag = 'N' AS exact, l_linestatus = 'F' AS unconditional, ['import directive', 'part directive', 'export directive'][l_partkey % 3 + 1] AS description FROM lineitem),
    held AS (SELECT dst, src FROM e WHERE dst IN (SELECT 'f' || p_partkey FROM part WHERE p_size > 20) AND NOT (import_ AND exact AND unconditional AND description <> 'part directive' AND dst IN (SELECT 'f' || p_partkey FROM part WHERE p_size % 2 = 0)))
    SELECT dst AS id, min(src) AS consumer FROM held GROUP BY dst""")
def plan_consumers(spark, sf_dir):
    part, line = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "lineitem")
    f = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    words = F.element_at(F.array(*map(F.lit, ("import directive", "part directive", "export directive"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    edges = line.select(F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("src"), f("l_partkey").alias("dst"), F.when(F.col("l_linenumber") <= 3, "imports").otherwise("uses").alias("kind"), (F.col("l_returnflag") == "N").alias("exact"), (F.col("l_linestatus") == "F").alias("unconditional"), words.alias("description"))
    marked = planner.neutralised(edges, part.where("p_size % 2 = 0").select(f("p_partkey").alias("id")))
    return planner.dependencies(part.where("p_size > 20").select(f("p_partkey").alias("id"), F.lit(None).cast("string").alias("path")), marked)[1]


@query("""WITH p AS (SELECT DISTINCT 'pk' || (p_partkey % 20) || '/' || p_brand || '/' || p_size AS path, 'pk' || (p_partkey % 20) AS root, p_brand, p_size, p_partkey % 20 AS k FROM part),
    o AS (SELECT path, k, CASE WHEN k % 5 = 0 THEN 'unknown' WHEN k % 5 = 1 THEN 'unknown' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'unknown' WHEN k = 2 THEN 'selected' ELSE 'external' END AS ownership FROM p)
    SELECT path, ownership, CASE WHEN ownership <> 'unknown' THEN 'n' || k END AS package FROM o""")
def package_owners(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 20
    root = F.concat(F.lit("pk"), k.cast("string"))
    paths = part.select(F.concat_ws("/", root, "p_brand", F.col("p_size").cast("string")).alias("path"))
    listed = part.where(k % 5 != 1).select(F.concat(F.lit("n"), k.cast("string"), F.when((k % 5 == 0) & (F.col("p_size") > 20), "b").otherwise("")).alias("name"), F.concat(root, F.lit("/")).alias("root")).distinct()
    nested = part.where("p_brand IN ('Brand#1', 'Brand#2')").select(F.concat_ws("/", root, "p_brand").alias("root")).unionByName(part.select(root.alias("root"))).distinct()
    return surface.package_owners(paths, listed, nested, "n2")


@query(f"""WITH a AS (SELECT l_orderkey AS directive, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice) AS n, {_OUTCOME} AS outcome FROM lineitem),
    f AS (SELECT directive, min(n) FILTER (outcome = 'true') AS yes, min(n) FILTER (outcome = 'unknown') AS maybe FROM a GROUP BY directive)
    SELECT directive, CASE WHEN maybe IS NOT NULL AND (yes IS NULL OR maybe < yes) THEN 'condition is not known' ELSE 'no alternative holds' END AS reason FROM f WHERE yes IS NULL OR maybe < yes""")
def directive_issues(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS directive", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice) AS position", f"{_OUTCOME} AS outcome")
    return surface.directive_issues(lines, ["directive"])


@query("SELECT p_partkey % 25 AS library, p_brand AS name FROM part WHERE p_size <= 3 GROUP BY ALL HAVING count(*) > 1")
def repeated_names(spark, sf_dir):
    return surface.repeated_names(_read(spark, sf_dir, "part").where("p_size <= 3").select((F.col("p_partkey") % 25).alias("library"), F.col("p_brand").alias("name")))


@query("""WITH s AS (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS names, list_sort(list(DISTINCT p_type)) AS types FROM part WHERE p_size < 15 GROUP BY 1)
    SELECT p_brand, CASE WHEN len(v) <= 64 THEN array_to_string(v, ',') END AS joined FROM (SELECT p_brand, list_sort(list_distinct(flatten(list_transform(names, lambda a: list_transform(types, lambda b: a || b))))) AS v FROM s)""")
def string_values(spark, sf_dir):
    s = _read(spark, sf_dir, "part").where("p_size < 15").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"), F.collect_set("p_type").alias("types"))
    return s.select("p_brand", F.array_join(catalogues.string_products(F.col("names"), F.col("types")), ",").alias("joined"))


@query(f"{_FOUND} SELECT id, tier, CAST(list_position(['protected', 'review', 'high', 'safe'], tier) AS BIGINT) AS tier_rank FROM found")
def ordered_findings(spark, sf_dir):
    from quern.operators.findings import ordered

    return ordered(_findings(spark, sf_dir)).select("id", "tier", "tier_rank")


@query(f"""{_FOUND}, asked AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'orders:' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'Region:' || r_regionkey FROM region)
    SELECT asked.id, CASE WHEN tier IS NULL THEN 'unknown' WHEN tier IN ('safe', 'high') THEN 'selected' ELSE 'not_actionable' END AS state FROM asked LEFT JOIN found USING (id)""")
def exact_selection(spark, sf_dir):
    """Parts, orders and ids in another case are asked for: some are reachable, so no findings, some are not to be touched."""
    from quern.operators.findings import selection

    g = Graph(spark, sf_dir)
    asked = g.table("part").where("p_partkey % 3 = 0").select(g.ids("part", "p_partkey")).unionByName(g.table("orders").where("o_orderkey % 5 = 0").select(g.ids("orders", "o_orderkey"))).unionByName(g.table("region").select(g.ids("Region", "r_regionkey")))
    return selection(_findings(spark, sf_dir), asked, "packageInternal")


@query("""WITH RECURSIVE u AS (SELECT 's:' || s_suppkey AS id FROM supplier),
    e AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 's:' || s_suppkey ELSE 's:' || (s_suppkey + 3) END AS src, CASE WHEN s_suppkey % 2 = 0 THEN 's:' || (s_suppkey + 3) ELSE 's:' || s_suppkey END AS dst FROM supplier
        WHERE s_suppkey % 11 <> 0 AND s_suppkey + 3 IN (SELECT s_suppkey FROM supplier)),
    steps AS (SELECT 0 AS n, CAST([] AS VARCHAR[]) AS done UNION ALL
        SELECT n + 1, list_append(done, (SELECT min(id) FROM u WHERE NOT list_contains(done, id) AND id NOT IN (SELECT dst FROM e WHERE NOT list_contains(done, src)))) FROM steps WHERE n < (SELECT count(*) FROM u)),
    last AS (SELECT unnest(done) AS id, generate_subscripts(done, 1) - 1 AS place FROM steps WHERE n = (SELECT count(*) FROM u)),
    named AS (SELECT id, 'unit:' || substr(sha256(id), 1, 16) AS unit_id FROM u)
    SELECT unit_id, place, coalesce((SELECT string_agg(x.unit_id, ',' ORDER BY x.unit_id) FROM e JOIN named x ON x.id = e.dst WHERE e.src = named.id), '') AS needs FROM last JOIN named USING (id)""")
def plan_order(spark, sf_dir):
    """Suppliers as units that need the third next one or are needed by it, in the order in which they would go."""
    from quern.operators.numbered import numbered

    key, name = F.col("s_suppkey"), lambda c: F.concat(F.lit("s:"), c.cast("string"))
    s = _read(spark, sf_dir, "supplier").select("s_suppkey")
    far = s.select((key - 3).alias("s_suppkey"))
    pairs = s.where(key % 11 != 0).join(far, "s_suppkey").select(name(key).alias("a"), name(key + 3).alias("b"), (key % 2 == 0).alias("down"))
    edges = pairs.select(F.when(F.col("down"), F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("down"), F.col("b")).otherwise(F.col("a")).alias("dst")).distinct()
    nodes = s.select(name(key).alias("id"))
    units = planner.units(planner.strong_components(nodes, edges), edges).cache()
    places = numbered(planner.ordered(units).select("unit_id", "lead", "step"), ["lead", "step"], "place")
    return units.join(places, "unit_id").select("unit_id", "place", F.array_join("needs", ",").alias("needs"))


#: Rounds that the oracle of apply_loop unrolls: more than it takes.
_ROUNDS = 6


def _loop() -> str:
    out, gone = [], "(SELECT CAST(NULL AS VARCHAR) AS id WHERE false)"
    for r in range(1, _ROUNDS + 1):
        out.append(f"""
    kept{r} AS (SELECT id FROM seeds WHERE id NOT IN (SELECT id FROM {gone} g) UNION SELECT e.dst FROM kept{r} k JOIN all_edges e ON e.src = k.id WHERE e.dst NOT IN (SELECT id FROM {gone} g)),
    chosen{r} AS (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM proven) AND id NOT IN (SELECT id FROM protected) AND id NOT IN (SELECT id FROM {gone} g) AND kind NOT IN ('region', 'nation') AND (kind = 'orders' OR id NOT IN (SELECT id FROM kept{r}))),
    outside{r} AS (SELECT DISTINCT dst AS id FROM edges WHERE dst IN (SELECT id FROM chosen{r}) AND src NOT IN (SELECT id FROM chosen{r}) AND src NOT IN (SELECT id FROM {gone} g)),
    held{r} AS (SELECT id FROM outside{r} UNION SELECT e.dst FROM held{r} h JOIN edges e ON e.src = h.id WHERE e.dst IN (SELECT id FROM chosen{r})),
    done{r} AS (SELECT id FROM chosen{r} WHERE id NOT IN (SELECT id FROM held{r})),
    gone{r} AS (SELECT id FROM {gone} g UNION ALL SELECT id FROM done{r})""")
        gone = f"gone{r}"
    rows = " UNION ALL ".join([f"SELECT id, {r} AS round, 'committed' AS outcome FROM done{r}" for r in range(1, _ROUNDS + 1)])
    ends = " UNION ALL ".join([f"SELECT id, {r} AS round, 'blocked' AS outcome FROM held{r}" for r in range(1, _ROUNDS + 1)])
    counts = " UNION ALL ".join([f"SELECT {r} AS r, count(*) AS n FROM done{r}" for r in range(1, _ROUNDS + 1)])
    return f"WITH RECURSIVE {_GRAPH}{_RETAINED},{','.join(out)} SELECT * FROM ({rows}) UNION ALL SELECT * FROM ({ends}) WHERE round = (SELECT min(r) FROM ({counts}) WHERE n = 0)"


@query(_loop())
def apply_loop(spark, sf_dir):
    """Unproven nodes go round by round: orders even if they are retained, which frees what only they retain."""
    g = Graph(spark, sf_dir)

    def select(rows):
        return rows.where("kind NOT IN ('region', 'nation') AND (kind = 'orders' OR NOT retained)").withColumn("path", F.lit(None).cast("string"))

    return rounds.apply((g.nodes(), g.edges(repeats=True), g.roots(), g.protected(), g.blockers()), g.contexts(), select)
