"""Engine operators on small graphs and against the registered SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quern import adapter_queries, catalogue, expression_queries, finding_queries, model_queries, planning_queries, source_queries  # noqa: F401
from quern.functions import conditions as cond
from quern.operators import closure as C
from quern.operators import facts, findings, resolve

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    rows = lambda dicts: sorted(tuple(str(d[c]) for c in columns) for d in dicts)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(want.columns, r)) for r in want.fetchall())


def test_closure_cycles_self_loops_and_dangling_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "nowhere")], "src string, dst string")
    seeds = spark.createDataFrame([("x", "a"), ("y", "d")], "context string, id string")
    assert {tuple(r) for r in C.closure(seeds, edges).collect()} == {("x", "a"), ("x", "b"), ("x", "c"), ("x", "nowhere"), ("y", "d")}
    assert C.closure(seeds.limit(0), edges).count() == 0


def test_source_activated_blockers(spark):
    nodes = spark.createDataFrame([(f"n:{k}", "k") for k in "abcd"] + [("assets/icons/x", "k"), ("old_assets/icons/x", "k")], "id string, kind string")
    rows = [("p", "r", None, "n:a", None, ["n:b"]), ("p", "r", None, "n:b", None, ["n:c"]), ("p", "r", None, "n:d", None, ["n:d"]), ("p", "r", None, None, "assets/", None)]
    blockers = facts.blockers(spark.createDataFrame(rows, "producer string, reason string, location string, source_node_id string, affected_namespace string, affected_node_ids array<string>")).drop("recorded")
    contexts = spark.createDataFrame([("x",)], "context string")
    roots = spark.createDataFrame([("x", "n:a")], "context string, id string")
    none = spark.createDataFrame([], "src string, dst string, exact boolean")
    got = {r.id for r in C.retained(roots, none, nodes.limit(0), blockers, nodes, contexts).collect()}
    assert got == {"n:a", "n:b", "n:c", "assets/icons/x"}


def test_conditions(spark):
    c = "platforms array<string>, flavors array<string>, entrypoints array<string>, dart_defines map<string,string>, exact_targets array<string>, exact_aux_targets array<string>"
    rows = [(([], [], [], {}, [], []),), ((["ios"], [], [], {}, [], []),), (([], ["f"], [], {}, [], []),), (([], [], [], {"k": "v"}, [], []),), (([], [], [], {}, ["t"], []),), (([], [], [], {}, [], ["aux"]),), (None,)]
    df = spark.createDataFrame(rows, f"c struct<{c}>")
    lit = F.lit
    got = df.select(cond.applies_to(F.col("c"), lit("t"), lit("android"), lit("main"), lit(None).cast("string"), F.create_map(lit("k"), lit("v"))).alias("a"), cond.applies_to_auxiliary(F.col("c"), lit("aux")).alias("x")).collect()
    assert [r.a for r in got] == [True, False, False, True, True, False, True]
    assert [r.x for r in got] == ["applies", "unknown", "unknown", "unknown", "does_not_apply", "applies", "applies"]


def test_tiers(spark):
    rows = [(True, "part", True, []), (False, "duplicateGroup", True, []), (False, "part", False, []), (False, "part", True, []), (False, "part", True, ["externalConsumersNotScanned"]), (False, "part", True, list(findings.RISKS))]
    df = spark.createDataFrame(rows, "p boolean, k string, g boolean, r array<string>")
    got = [r[0] for r in df.select(findings.tier(F.col("p"), F.col("k"), F.col("g"), F.col("r"))).collect()]
    assert got == ["protected", "review", "review", "safe", "high", "review"]


def test_edges_keep_exact_evidence_in_any_order(spark):
    rows = [("a", "b", "k", "", False, "one"), ("a", "b", "k", "", True, "two"), ("a", "b", "k", "", True, "longer")]
    for some in (rows, rows[::-1]):
        got = facts.edges(spark.createDataFrame(some, "src string, dst string, kind string, condition_key string, exact boolean, evidence string")).collect()
        assert [(r.exact, r.evidence) for r in got] == [(True, "two")]


def test_intervals_across_buckets(spark):
    a = spark.createDataFrame([("k", 1, 0, 250)], "key string, id int, start int, end int")
    b = spark.createDataFrame([("k", 2, 100, 260), ("k", 3, 250, 260), ("j", 4, 0, 9)], "key string, id int, start int, end int")
    assert [tuple(r) for r in resolve.overlapping(a, b, "key", 100).collect()] == [(1, 2)]
