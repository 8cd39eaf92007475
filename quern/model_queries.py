"""Registered queries over a graph with auxiliary contexts, undecided conditions and blockers of every scope, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalogue import QUERIES, _read, query
from quern.functions.conditions import CONDITION
from quern.plans.model import Model

__all__ = ["QUERIES"]

#: Two configured contexts, a complete auxiliary one and an incomplete one.
_CONTEXTS = "ctx(context, platform, complete) AS (VALUES ('app:one', 'ios', true), ('app:two', 'android', true), ('aux:test:1', NULL, true), ('aux:runtime:2', NULL, false))"
_FACTS = f"""{_CONTEXTS},
    nodes AS (SELECT 'part:' || p_partkey AS id, 'declaration' AS kind FROM part UNION ALL SELECT 'supplier:' || s_suppkey, 'asset' FROM supplier UNION ALL SELECT 'nation:' || n_regionkey || '/' || n_nationkey, 'route' FROM nation),
    nat AS (SELECT n_nationkey AS k, 'nation:' || n_regionkey || '/' || n_nationkey AS id FROM nation),
    e AS (SELECT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, l_returnflag AS f, bool_or(l_linestatus = 'F') AS exact FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 35 GROUP BY 1, 2, 3
        UNION ALL SELECT 'supplier:' || s_suppkey, id, 'N', true FROM supplier JOIN nat ON k = s_nationkey UNION ALL SELECT a.id, b.id, CASE WHEN a.k % 4 = 0 THEN 'A' ELSE 'N' END, a.k % 5 > 0 FROM nat a JOIN nat b ON b.k = a.k + 1
        UNION ALL SELECT id, 'lost:' || k, 'N', true FROM nat WHERE k = 24),
    ec AS (SELECT context, src, dst, exact, f, CASE WHEN f = 'N' OR (f = 'A' AND platform = 'ios') OR (f = 'R' AND context = 'aux:test:1') THEN 'applies' WHEN f = 'A' AND platform IS NULL THEN 'unknown' END AS app FROM e, ctx),
    used AS (SELECT * FROM ec WHERE app IS NOT NULL),
    roots AS (SELECT context, 'part:' || p_partkey AS id FROM part, ctx WHERE p_size = 1 AND platform IS NOT NULL UNION ALL SELECT 'aux:test:1', 'part:' || p_partkey FROM part WHERE p_size = 2 UNION ALL SELECT 'aux:runtime:2', 'part:' || p_partkey FROM part WHERE p_size = 3 UNION ALL SELECT 'aux:test:1', 'part:none'),
    protected AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < -500),
    bound AS (SELECT 'supplier:' || s_suppkey AS src, 'part:' || (s_suppkey * x) AS dst FROM supplier, (VALUES (3), (7)) v(x) WHERE s_suppkey % 10 = 0 UNION ALL SELECT 'supplier:5', id FROM nat WHERE contains(id, '/1') UNION ALL SELECT (SELECT 'part:' || min(p_partkey) FROM part WHERE p_size = 3), id FROM nodes),
    free AS (SELECT 'part:' || x AS id FROM (VALUES (4), (9)) v(x) UNION ALL SELECT DISTINCT dst FROM used WHERE app = 'unknown'),
    proven AS (SELECT context, id FROM roots WHERE context <> 'aux:runtime:2' UNION SELECT p.context, u.dst FROM proven p JOIN used u ON u.context = p.context AND u.src = p.id WHERE u.exact AND u.app = 'applies'),
    step AS (SELECT context, src, dst FROM used UNION SELECT context, src, dst FROM bound, ctx WHERE dst IN (SELECT id FROM nodes)),
    seeds AS (SELECT context, id FROM roots UNION SELECT context, id FROM protected, ctx UNION SELECT context, id FROM free, ctx WHERE id IN (SELECT id FROM nodes)),
    retained AS (SELECT context, id FROM seeds UNION SELECT r.context, s.dst FROM retained r JOIN step s ON s.context = r.context AND s.src = r.id)"""
_AFTER = """,
    app AS (SELECT context FROM ctx WHERE platform IS NOT NULL), may AS (SELECT DISTINCT src, dst FROM used WHERE starts_with(context, 'aux:')),
    ways AS (SELECT context, src, dst FROM used WHERE starts_with(context, 'app:') UNION SELECT context, src, dst FROM may, app),
    held AS (SELECT context, id FROM retained WHERE starts_with(context, 'app:') UNION SELECT app.context, id FROM app, (SELECT id FROM retained WHERE starts_with(context, 'aux:')) r),
    start AS (SELECT context, id FROM roots WHERE starts_with(context, 'app:') UNION SELECT app.context, id FROM app, (SELECT id FROM roots WHERE starts_with(context, 'aux:')) a UNION SELECT w.context, w.dst FROM held h JOIN ways w ON w.context = h.context AND w.src = h.id),
    reachable AS (SELECT context, id FROM start UNION SELECT r.context, w.dst FROM reachable r JOIN ways w ON w.context = r.context AND w.src = r.id)"""


def _condition(flag):
    """N everywhere, A on ios only, R in the first auxiliary context only."""
    return F.expr(
        f"named_struct('platforms', CASE WHEN {flag} = 'A' THEN array('ios') ELSE array() END, 'flavors', array(), 'entrypoints', array(), 'dart_defines', map(), 'exact_targets', array(), 'exact_aux_targets', CASE WHEN {flag} = 'R' THEN array('aux:test:1') ELSE array() END)"
    ).cast(CONDITION)


def _model(spark, sf_dir) -> Model:
    part, supplier, nation, line = (_read(spark, sf_dir, t) for t in ("part", "supplier", "nation", "lineitem"))
    of = lambda t, c: F.concat(F.lit(f"{t}:"), c.cast("string"))
    n = F.col("n_nationkey")
    nat = nation.select(n.alias("k"), F.concat(F.lit("nation:"), F.col("n_regionkey").cast("string"), F.lit("/"), n.cast("string")).alias("id"))
    kind = lambda df, name: df.withColumn("kind", F.lit(name))
    nodes = kind(part.select(of("part", F.col("p_partkey")).alias("id")), "declaration").unionByName(kind(supplier.select(of("supplier", F.col("s_suppkey")).alias("id")), "asset")).unionByName(kind(nat.select("id"), "route"))
    first = line.where("l_linenumber = 1 AND l_quantity > 35").groupBy(of("part", F.col("l_partkey")).alias("src"), of("supplier", F.col("l_suppkey")).alias("dst"), F.col("l_returnflag").alias("f")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("exact"))
    yes = F.lit(True).alias("exact")
    edges = first.unionByName(supplier.join(nat, F.col("s_nationkey") == F.col("k")).select(of("supplier", F.col("s_suppkey")).alias("src"), F.col("id").alias("dst"), F.lit("N").alias("f"), yes))
    following = nat.select((F.col("k") - 1).alias("k"), F.col("id").alias("dst"))
    edges = edges.unionByName(nat.join(following, "k").select(F.col("id").alias("src"), "dst", F.when(F.col("k") % 4 == 0, "A").otherwise("N").alias("f"), (F.col("k") % 5 > 0).alias("exact")))
    edges = edges.unionByName(nat.where("k = 24").select(F.col("id").alias("src"), F.lit("lost:24").alias("dst"), F.lit("N").alias("f"), yes))
    edges = edges.select("src", "dst", F.lit("uses").alias("kind"), "exact", F.lit("").alias("evidence"), _condition("f").alias("condition"))
    none = F.lit(None)
    root = lambda size, aux: part.where(f"p_size = {size}").select(of("part", F.col("p_partkey")).alias("id"), none.cast(CONDITION).alias("condition"), F.lit(aux).cast("string").alias("aux_id"))
    lost = spark.range(1).select(F.lit("part:none").alias("id"), none.cast(CONDITION).alias("condition"), F.lit("aux:test:1").alias("aux_id"))
    roots = root(1, None).unionByName(root(2, "aux:test:1")).unionByName(root(3, "aux:runtime:2")).unionByName(lost)
    targets = spark.createDataFrame([("one", "ios", "main", None, {}), ("two", "android", "main", None, {})], "name string, platform string, entrypoint string, flavor string, dart_defines map<string,string>")
    aux = spark.createDataFrame([("aux:test:1", True), ("aux:runtime:2", False)], "id string, environment_complete boolean")
    kept = supplier.where("s_acctbal < -500").select(of("supplier", F.col("s_suppkey")).alias("id"), F.lit("negative").alias("reason"))
    s = F.col("s_suppkey")
    text = none.cast("string")
    shape = lambda df, source, space, ids: df.select(F.lit("x").alias("producer"), F.lit("dynamic").alias("reason"), text.alias("location"), source.alias("source_node_id"), space.alias("affected_namespace"), ids.alias("affected_node_ids"))
    one, empty = spark.range(1), F.array().cast("array<string>")
    blockers = shape(supplier.where("s_suppkey % 10 = 0"), of("supplier", s), text, F.array(of("part", s * 3), of("part", s * 7)))
    blockers = blockers.unionByName(shape(one, F.lit("supplier:5"), F.lit("1"), empty)).unionByName(shape(part.where("p_size = 3").agg(F.min("p_partkey").alias("k")), of("part", F.col("k")), text, empty)).unionByName(shape(one, F.lit("ghost:1"), text, F.array(F.lit("part:4"), F.lit("part:9"))))
    return Model(nodes, edges, roots, targets, aux, kept, blockers)


@query(f"WITH RECURSIVE {_FACTS} SELECT context, id FROM proven")
def auxiliary_proven(spark, sf_dir):
    return _model(spark, sf_dir).proven


@query(f"WITH RECURSIVE {_FACTS} SELECT context, id FROM retained")
def auxiliary_retained(spark, sf_dir):
    return _model(spark, sf_dir).retained


@query(f"WITH RECURSIVE {_FACTS}{_AFTER} SELECT context, id FROM reachable")
def compatible_reachable(spark, sf_dir):
    return _model(spark, sf_dir).reachable


@query(f"""WITH RECURSIVE {_FACTS} SELECT context, (SELECT count(*) FROM used u WHERE u.context = c.context AND dst NOT IN (SELECT id FROM nodes)) AS dangling_edges, (SELECT count(DISTINCT id) FROM roots r WHERE r.context = c.context AND id NOT IN (SELECT id FROM nodes)) AS dangling_roots,
    (SELECT count(*) FROM used u WHERE u.context = c.context AND app = 'unknown') AS unknown_edges, false AS complete FROM ctx c UNION ALL SELECT 'unattributed', 0, 0, 0, true""")
def auxiliary_integrity(spark, sf_dir):
    return _model(spark, sf_dir).integrity


@query(f"""WITH RECURSIVE {_FACTS} SELECT context, dst AS id, count(*) AS edges FROM used WHERE app = 'unknown' GROUP BY ALL""")
def undecided_conditions(spark, sf_dir):
    m = _model(spark, sf_dir)
    made = m.blockers.where("producer = 'graph'").select(F.substring_index("reason", " ", -1).alias("context"), F.element_at("affected_node_ids", 1).alias("id"), "recorded")
    return made.select("context", "id", F.col("recorded").alias("edges"))


@query(f"""WITH RECURSIVE {_FACTS}, cand AS (SELECT id, kind FROM nodes WHERE id NOT IN (SELECT id FROM proven)),
    active AS (SELECT dst FROM bound WHERE src IN (SELECT id FROM retained) UNION SELECT id FROM free)
    SELECT id, kind, CASE WHEN id IN (SELECT id FROM protected) THEN 'protected' ELSE 'review' END AS tier, id IN (SELECT dst FROM active) AS has_blockers,
        array_to_string(list_filter(['incompleteGraphIntegrity', CASE WHEN id IN (SELECT id FROM retained) THEN 'retainedOnly' END, CASE WHEN id IN (SELECT dst FROM active) THEN 'dynamicReference' END, CASE WHEN kind = 'route' THEN 'unsupportedAction' END], lambda x: x IS NOT NULL), ',') AS reasons FROM cand""")
def gated_findings(spark, sf_dir):
    rows = _model(spark, sf_dir).findings(F.col("kind") != "route", F.lit(False))
    return rows.select("id", "kind", "tier", "has_blockers", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH RECURSIVE {_FACTS}{_AFTER} SELECT context, id, 'proven, not retained' AS problem FROM proven WHERE (context, id) NOT IN (SELECT (context, id) FROM retained) UNION ALL SELECT context, id, 'proven, not reachable' FROM proven WHERE starts_with(context, 'app:') AND (context, id) NOT IN (SELECT (context, id) FROM reachable)")
def snapshot_violations(spark, sf_dir):
    return _model(spark, sf_dir).violations()
