"""Links against a plain walk, and what a selection of findings accepts."""

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import findings
from quern.sources import links


def follow(path, table):
    """The way of a file system, one link at a time; None after forty."""
    at = posixpath.normpath(path)
    for _ in range(41):
        parts = at.split("/")
        hit = next((x for k in range(2, len(parts) + 1) if (x := "/".join(parts[:k])) in table), None)
        if hit is None:
            return at
        target = table[hit]
        whole = target if target.startswith("/") else posixpath.join(posixpath.dirname(hit), target)
        at = posixpath.normpath(posixpath.normpath(whole) + at[len(hit) :])
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_a_plain_walk(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "c"]
    some = lambda n: "/" + "/".join(r.choice(names) for _ in range(r.randrange(1, n)))
    table = {some(4): r.choice([some(4), "../" + r.choice(names), r.choice(names) + "/b", "./c//"]) for _ in range(7)} | {"/ring": "ring/x", "/one": "/two", "/two": "one"}
    asked = sorted({some(6) for _ in range(60)} | {"/ring/y", "/one/z", "/a/../b", "/", "/plain"})
    got = {x.path: x.canonical for x in links.canonical(spark.createDataFrame([(p,) for p in asked], "path string"), spark.createDataFrame(list(table.items()), "path string, target string")).collect()}
    assert got == {p: follow(p, table) for p in asked}


def test_exact_selection_refuses(spark):
    schema = "id string, tier string, kind string, not_retained boolean, no_blockers boolean, is_protected boolean, action_supported boolean, external boolean"
    rows = spark.createDataFrame([("a", "safe", "k", True, True, False, True, False), ("b", "review", "k", False, True, False, True, False)], schema)
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert [x.id for x in findings.exactly(rows, ask("a"), "application").collect()] == ["a"]
    assert {tuple(x) for x in findings.selection(rows, ask("a", "b", "A"), "application").collect()} == {("a", "selected"), ("b", "not_actionable"), ("A", "unknown")}
    for bad in (ask("a", "a"), ask(""), ask(None), ask("A"), ask("b")):
        with pytest.raises(ValueError):
            findings.exactly(rows, bad, "application")
