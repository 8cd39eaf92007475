"""Graphs over configured and auxiliary contexts."""

import pytest

from quern.functions.conditions import CONDITION
from quern.plans.model import Model

ANY = ([], [], [], {}, [], [])
IOS = (["ios"], [], [], {}, [], [])
SCHEMAS = {
    "nodes": "id string, kind string",
    "edges": f"src string, dst string, kind string, exact boolean, evidence string, condition {CONDITION}",
    "roots": f"id string, condition {CONDITION}, aux_id string",
    "targets": "name string, platform string, entrypoint string, flavor string, dart_defines map<string,string>",
    "aux_targets": "id string, environment_complete boolean",
    "protections": "id string, reason string",
    "blockers": "producer string, reason string, location string, source_node_id string, affected_namespace string, affected_node_ids array<string>",
}
TARGETS = [("one", "ios", "main", None, {}), ("two", "android", "main", None, {})]


def model(spark, nodes, edges=(), roots=(), aux=(), protections=(), blockers=(), targets=TARGETS):
    rows = {
        "nodes": [(n, "part") for n in nodes],
        "edges": [(a, b, "uses", exact, "e", c) for a, b, exact, c in edges],
        "roots": list(roots),
        "targets": targets,
        "aux_targets": list(aux),
        "protections": [(p, "why") for p in protections],
        "blockers": list(blockers),
    }
    return Model(*[spark.createDataFrame(rows[k], SCHEMAS[k]) for k in ("nodes", "edges", "roots", "targets", "aux_targets", "protections", "blockers")])


def pairs(df):
    return {(r.context, r.id) for r in df.collect()}


def test_conditions_separate_contexts(spark):
    m = model(spark, "abc", [("a", "b", True, IOS), ("b", "c", False, ANY)], [("a", ANY, None)])
    assert pairs(m.proven) == {("app:one", "a"), ("app:one", "b"), ("app:two", "a")}
    assert pairs(m.retained) == {("app:one", "a"), ("app:one", "b"), ("app:one", "c"), ("app:two", "a")}


def test_undecided_conditions_block_their_target_everywhere(spark):
    m = model(spark, "abc", [("a", "b", True, IOS)], [("a", None, "aux:test:t")], [("aux:test:t", True)])
    assert pairs(m.proven) == {("aux:test:t", "a")}
    assert pairs(m.retained) == {("aux:test:t", "a"), ("aux:test:t", "b"), ("app:one", "b"), ("app:two", "b")}
    by = {r.context: r for r in m.integrity.collect()}
    assert by["aux:test:t"].unknown_edges == 1 and not by["aux:test:t"].complete and by["app:one"].complete


def test_an_incomplete_environment_proves_nothing(spark):
    m = model(spark, "ab", [("a", "b", True, ANY)], [("a", None, "aux:test:t")], [("aux:test:t", False)])
    assert pairs(m.proven) == set()
    assert ("aux:test:t", "b") in pairs(m.retained)
    assert {("app:one", "a"), ("app:one", "b")} <= pairs(m.reachable)


def test_integrity_counts_dangling_facts(spark):
    nowhere = (["web"], [], [], {}, [], [])
    m = model(spark, "a", [("a", "x", True, IOS), ("a", "y", True, nowhere)], [("a", ANY, None), ("lost", IOS, None), ("astray", nowhere, None), ("gone", None, "aux:test:none")])
    got = {r.context: (r.dangling_edges, r.dangling_roots, r.complete) for r in m.integrity.collect()}
    assert got == {"app:one": (1, 1, False), "app:two": (0, 0, True), "unattributed": (1, 2, False)}


def test_unscoped_blockers_keep_everything(spark):
    m = model(spark, ["a:1", "b:2"], [], [], blockers=[("p", "r", None, None, None, [])])
    assert pairs(m.retained) == {(c, n) for c in ("app:one", "app:two") for n in ("a:1", "b:2")}
    off = model(spark, ["a:1", "b:2"], [], [], blockers=[("p", "r", None, "b:2", None, [])])
    assert pairs(off.retained) == set()


def test_one_flaw_takes_safe_from_all(spark):
    from pyspark.sql import functions as F

    clean = model(spark, "ab", [], [("a", ANY, None)])
    flawed = model(spark, "ab", [("a", "x", True, ANY)], [("a", ANY, None)])
    tiers = [[r.tier for r in m.findings(F.lit(True), F.lit(False)).collect()] for m in (clean, flawed)]
    assert tiers == [["safe"], ["review"]]
    assert [r.tier for r in clean.findings(F.lit(True), F.lit(False), package_mode=True).collect()] == ["review"]


def test_targets_must_be_unique(spark):
    with pytest.raises(ValueError):
        model(spark, "a", targets=[TARGETS[0], TARGETS[0]])
    with pytest.raises(ValueError):
        model(spark, "a", targets=[])
