"""Rounds of removal write only what they need and leave only their rows on disk."""

import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from quern.operators import closure, planner, rounds
from quern.plans import materialise

BLOCKERS = "producer string, reason string, location string, source_node_id string, affected_namespace string, affected_node_ids array<string>"
HARD = lambda rows: rows.where("kind = 'soft' OR NOT retained")


def _graph(spark):
    """300 soft nodes lead to a proven and to a protected node; a, which a blocker of the root retains, alone retains b and c; the protected node needs z."""
    many = spark.range(300).select(F.concat(F.lit("many:"), F.col("id").cast("string")).alias("id"))
    few = [("root", "hard"), ("proven", "hard"), ("kept", "hard"), ("a", "soft"), ("b", "hard"), ("c", "hard"), ("z", "soft"), ("y", "hard")]
    nodes = many.select("id", F.lit("soft").alias("kind")).unionByName(spark.createDataFrame(few, "id string, kind string")).withColumn("path", F.lit(None).cast("string"))
    edges = [("root", "proven", True), ("a", "b", True), ("b", "c", True), ("kept", "z", True), ("z", "y", True), ("y", "kept", True)]
    edges = spark.createDataFrame(edges, "src string, dst string, exact boolean")
    for end in ("proven", "kept"):
        edges = edges.unionByName(many.select(F.col("id").alias("src"), F.lit(end).alias("dst"), F.lit(True).alias("exact")))
    roots = spark.createDataFrame([("x", "root"), ("y", "root")], "context string, id string")
    blockers = spark.createDataFrame([("p", "r", None, "root", None, ["a"])], BLOCKERS)
    return (nodes, edges, roots, spark.createDataFrame([("kept",)], "id string"), blockers), spark.createDataFrame([("x",), ("y",)], "context string")


WANT = {(f"many:{k}", 1, "committed") for k in range(300)} | {("a", 1, "committed"), ("b", 2, "committed"), ("c", 2, "committed"), ("z", 3, "blocked")}


def _rows(found):
    return sorted((r.id, r.round, r.outcome) for r in found.collect())


def test_only_results_stay(spark):
    graph, contexts = _graph(spark)
    materialise.cut(spark.range(1))
    folder = urlparse(spark.sparkContext.getCheckpointDir()).path
    before = set(os.listdir(folder))
    found = rounds.apply(graph, contexts, HARD)
    # Every table of every round stayed before.
    assert len(set(os.listdir(folder)) - before) == 3
    assert _rows(found) == sorted(WANT)
    assert spark.conf.get(materialise._CLEANUP) == "false"


def test_ways_to_fixed_nodes_are_not_written(spark, monkeypatch):
    graph, contexts = _graph(spark)
    sizes = []

    def counted(old):
        def run(df):
            out = old(df)
            if "dst" in out.columns:
                sizes.append(out.count())
            return out

        return run

    for module in (closure, planner, rounds):
        for name in ("cut", "stored"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, counted(getattr(module, name)))
    assert _rows(rounds.apply(graph, contexts, HARD)) == sorted(WANT)
    assert sizes and max(sizes) <= 10  # 606 before


def test_edges_without_an_end_hold_nothing(spark):
    (nodes, edges, *rest), contexts = _graph(spark)
    open_ = spark.createDataFrame([(None, "a", True), ("a", None, True)], edges.schema)
    # As in SQL, where NULL NOT IN (...) does not hold; an edge without a source blocked a before.
    assert _rows(rounds.apply((nodes, edges.unionByName(open_), *rest), contexts, HARD)) == sorted(WANT)


@pytest.mark.parametrize("failing,last", [("none", None), ("b", 2)])
def test_rounds_with_units(spark, failing, last):
    graph, contexts = _graph(spark)
    got = _rows(rounds.apply(graph, contexts, HARD, spark.createDataFrame([(failing,)], "id string")))
    want = WANT if last is None else {x for x in WANT if x[1] == 1} | {("b", 2, "rejectedRecovered"), ("c", 2, "skippedDependency")}
    assert got == sorted(want)


def test_kept_tables_outlive_their_block(spark):
    with materialise.passing(spark) as (keep, _):
        with materialise.passing(spark) as (hold, drop):
            one, two, three = (hold(materialise.stored(spark.range(n))) for n in (1, 2, 3))
            gone = materialise.cut(spark.range(4))
            drop(two)
        keep(one)
        assert one.count() == 1 and three.count() == 3
    assert one.count() == 1
    for lost in (two, three, gone):
        with pytest.raises(Exception):
            lost.collect()
