"""Queries over keys and groups that small tables don't have."""

import time

from pyspark.sql import functions as F

from quern import adapter_queries
from quern.operators import adapters, closure, planner
from quern.operators.catalogues import repeated_json_keys


def test_assets_of_large_keys(spark, tmp_path):
    part = spark.createDataFrame([(5, 1), (1_000_005, 2)], "p_partkey long, p_size int")
    line = spark.createDataFrame([(5, 1, 1, 9.0, 0.06), (5, 2, 1, 9.0, 0.01), (1_000_005, 3, 2, 41.0, 0.06)], "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double")
    supplier = spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string")
    for name, rows in (("part", part), ("lineitem", line), ("supplier", supplier)):
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {tuple(r) for r in adapter_queries.asset_edges(spark, str(tmp_path)).collect()}
    assert got == {("dart:2", "asset:quern/img/5.png", "loadsAsset"), ("asset:quern/img/1000005.png", "asset:quern/img/2.0x/1000005.png", "bundlesVariant")}


def test_keys_of_a_large_message_file(spark):
    body = ",".join(f'"m{k}":"x"' for k in range(60_000))
    rows = spark.createDataFrame([("{" + body + "}",), ("{" + body + ',"m7":1,"m9":2,"m7":3}',), ("[1]",), (None,)], "text string")
    start = time.monotonic()
    assert [r[0] or [] for r in rows.select(repeated_json_keys(F.col("text"))).collect()] == [[], ["m7", "m9"], [], []]
    # Each key beside each other one took minutes.
    assert time.monotonic() - start < 30


def test_components_behind_long_ways(spark):
    """Ways of 300 nodes into a ring, into an end and into nodes with several ways, against two walks in one task."""
    nodes, edges = [], []

    def way(name, end):
        names = [f"{name}{k}" for k in range(300)]
        nodes.extend(names)
        edges.extend(zip(names, [*names[1:], end]))

    way("a", "r0"), way("b", "r70"), way("c", "end"), way("d", "x"), way("e", "e150")
    ring = [f"r{k}" for k in range(100)]
    nodes.extend([*ring, "end", "x", "y", "z", "s"])
    edges.extend([*zip(ring, [*ring[1:], ring[0]]), ("x", "y"), ("x", "z"), ("y", "x"), ("z", "d290"), ("s", "s"), ("s", "d0"), ("x", "end")])
    one, two = spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")
    calls, old = [], planner.cut
    planner.cut = lambda df: calls.append(1) or old(df)
    try:
        got = {tuple(r) for r in planner.strong_components(one, two, local_edges=0).collect()}
    finally:
        planner.cut = old
    assert got == {tuple(r) for r in planner.strong_components(one, two).collect()}
    # A round for each node of the way took some 600.
    assert len(calls) < 100


def test_closures_of_many_edges(spark, monkeypatch):
    """Steps one by one, with small frontiers broadcast, over repeated edges of which some are exact; edges are cut once."""
    edges = [(f"n{k}", f"n{(k * 7 + j) % 41}", k % 3 > 0) for k in range(41) for j in (1, 2)] + [(f"w{k}", f"w{k + 1}", True) for k in range(3)] + [("n5", "w0", False), ("n5", "w0", True)]
    e = spark.createDataFrame(edges + edges[::2], "src string, dst string, exact boolean")
    roots, more = spark.createDataFrame([("a", "n1"), (None, "w3")], "context string, id string"), spark.createDataFrame([("a", "n4"), ("b", "w2")], "context string, id string")
    runs = {"x": (roots, F.col("exact")), "y": (more, None)}
    expected = {tuple(r) for r in closure.closures(runs, e).collect()}
    monkeypatch.setattr(closure, "LONG_READ", 0)
    monkeypatch.setattr(closure, "BROADCAST_EDGES", 0)
    read, old = [], closure.cut
    monkeypatch.setattr(closure, "cut", lambda df: read.append(df.columns) or old(df))
    assert {tuple(r) for r in closure.closures(runs, e, local_edges=0).collect()} == expected
    # The edges were written twice before, as they are and folded.
    assert sum("dst" in c for c in read[:4]) == 1


def test_beginnings_of_routes(spark):
    """Prefixes with and without patterns, against every pair."""
    routes = [(f"r{k}", f"/en/{k % 7}/{k}") for k in range(40)] + [("p", "/en/:page"), ("q", "/en/:page"), ("any", "/:lang/:page/more"), ("s", "/:lang/3/:x"), ("bare", "en/4")]
    asked = ["/en/", "/en/3", "/en/3/", "/en/3/10", "/de/3/", "/de/9/more", "/", "", "en", "en/", "/en//", "/en/:page", "/en/3/10?tab=", "/fr?x"]
    expected = {}
    for prefix in asked:
        parts = prefix.split("/")
        parts = parts[:-1] if parts[-1] == "" else parts
        same = sorted(n for n, p in routes if "?" in prefix and prefix.startswith("/") and p == prefix.split("?")[0])
        fits = sorted(n for n, p in routes if prefix and 0 < len(parts) <= len(p.split("/")) and all(a.startswith(":") or a == b for a, b in zip(p.split("/"), parts)))
        expected[prefix] = (bool(same), same or fits)
    got = adapters.prefix_candidates(spark.createDataFrame([(a,) for a in asked], "prefix string"), spark.createDataFrame(routes, "node_id string, full_path string"))
    assert {r.prefix: (r.exact, r.candidates) for r in got.collect()} == expected


def test_dangling_edges_are_made_distinct_at_the_end(spark):
    """Edges are not dealt out to be distinct before their ends are looked up: only dangling ones are, once."""
    import __spark_entry__ as entry

    rows = entry.queries()["dangling_edges"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(set(got)) > 0
