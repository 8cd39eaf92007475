"""Expressions are evaluated with one written table a level; nothing is told to nobody."""

from pyspark.sql import functions as F

from quern.operators import expressions

_SUM = lambda args: F.aggregate(args, F.lit(0), lambda s, x: s + x["value"])


def _counted(monkeypatch):
    calls, cut = [], expressions.cut
    monkeypatch.setattr(expressions, "cut", lambda df: calls.append(df.columns) or cut(df))
    return calls


def test_one_table_a_level(spark, monkeypatch):
    calls = _counted(monkeypatch)
    rows = [("a", None, 0, "interface", "dart:core", "A", "nullable"), ("b", "a", 0, "interface", "dart:core", "B", "nullable"), ("c", "b", 0, "interface", "dart:core", "C", "nullable"), ("d", None, 0, "dynamic", None, None, "nullable")]
    got = {r.id: r.type_key for r in expressions.type_keys(spark.createDataFrame(rows, "id string, parent string, position int, kind string, library string, name string, nullability string")).collect()}
    assert got["c"] and got["b"].count("|") == got["a"].count("|") and got["d"] is None
    # The rows and two levels above the leaves.
    assert len(calls) == 3


def test_ring_needs_no_more_rounds(spark, monkeypatch):
    calls = _counted(monkeypatch)
    nodes = spark.createDataFrame([("x",), ("y",), ("top",), ("ring",), ("over",)], "id string")
    links = spark.createDataFrame([("top", 0, "x"), ("top", 1, "y"), ("top", 1, "x"), ("top", 1, "y"), ("ring", 0, "ring"), ("over", 0, "ring"), ("over", 1, "x")], "id string, position int, operand string")
    value = F.when(F.col("id") == "x", 1).otherwise(2)
    assert {r.id: r.value for r in expressions.bottom_up(nodes, links, value, _SUM, rest=True).collect()} == {"x": 1, "y": 2, "top": 4, "ring": None, "over": None}
    assert len(calls) == 3
    assert {r.id: r.value for r in expressions.bottom_up(nodes, links, value, _SUM, holds=F.col("id") != "ring").collect()} == {"x": 1, "y": 2, "top": 4, "ring": 2, "over": 3}
