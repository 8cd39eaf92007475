"""Closures keep only the ways that something can reach, and give sets of contexts without a row a context."""

from pyspark.sql import functions as F

from quern.operators import closure as C


def _graph(spark):
    # 300 nodes that nothing reaches lead to a, which leads to b and c.
    dead = spark.range(300).select(F.concat(F.lit("dead:"), F.col("id").cast("string")).alias("src"), F.lit("a").alias("dst"), F.lit(True).alias("exact"))
    return dead.unionByName(spark.createDataFrame([("a", "b", True), ("a", "b", False), ("b", "c", False), ("c", "a", True)], "src string, dst string, exact boolean"))


def test_only_live_ways_are_kept(spark, monkeypatch):
    held, spread = [], C._spread
    monkeypatch.setattr(C, "_spread", lambda seeds, ways: held.append(ways.count()) or spread(seeds, ways))
    seeds = spark.createDataFrame([("one", "a"), ("two", "b")], "context string, id string")
    found = C.closure(seeds, _graph(spark), local_edges=0)
    assert {tuple(r) for r in found.collect()} == {(c, i) for c in ("one", "two") for i in "abc"}
    assert held[0] <= 4  # 304 before


def test_memberships(spark, monkeypatch):
    seeds = spark.createDataFrame([("two", "b"), ("one", "a"), (None, "lone")], "context string, id string")
    roots = spark.createDataFrame([("one", "a")], "context string, id string")
    runs = {"proven": (roots, F.col("exact")), "retained": (seeds, None)}
    both = [C.memberships(runs, _graph(spark), n).collect() for n in (0, C.LOCAL_EDGES)]
    monkeypatch.setattr(C, "WORD", 2)
    both.append(C.memberships(runs, _graph(spark), 0).collect())
    want = {("a", True, True, ("one",), ("one", "two")), ("b", True, True, ("one",), ("one", "two")), ("c", False, True, (), ("one", "two")), ("lone", False, True, (), ())}
    for rows in both:
        assert {(r.id, r.proven, r.retained, tuple(r.proven_in), tuple(r.retained_in)) for r in rows} == want


def test_small_steps_read_a_range(spark, monkeypatch):
    monkeypatch.setattr(C, "LONG_READ", 0)
    monkeypatch.setattr(C, "BROADCAST_EDGES", 0)
    seeds = spark.createDataFrame([("one", "n:0"), ("two", "m:9"), ("two", "n:4")], "context string, id string")
    ways = [(f"n:{k}", f"n:{k + 1}") for k in range(9)] + [("m:9", "z:1"), ("z:1", "a:1"), ("a:1", "n:2"), ("n:7", "m:9")]
    found = C.closure(seeds, spark.createDataFrame(ways, "src string, dst string"), local_edges=0)
    n = lambda k: {f"n:{j}" for j in range(k, 10)}
    rest = {"m:9", "z:1", "a:1"}
    assert {tuple(r) for r in found.collect()} == {("one", i) for i in n(0) | rest} | {("two", i) for i in n(2) | rest}


def test_few_and_many_namespaces_cover_alike(spark, monkeypatch):
    nodes = spark.createDataFrame([("a:1/b",), ("a:2/b:3",), ("b",), ("x/bc",), ("",), ("a.1",), (None,)], "id string")
    spaces = spark.createDataFrame([("a:",), ("b",), ("a:2",), ("b:",), ("/",), ("",), (None,)], "affected_namespace string")
    few = sorted(map(tuple, C.addressed(spaces, nodes).collect()))
    monkeypatch.setattr(C, "FEW_SPACES", 0)
    assert few == sorted(map(tuple, C.addressed(spaces, nodes).collect())) and few
