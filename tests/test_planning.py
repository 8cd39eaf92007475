"""Plans, surfaces, ledgers and reports against plain Python on small and random inputs."""

import random

import pytest

from quern import sinks
from quern.operators import catalogues, ledger, planner, surface
from pyspark.sql import functions as F


def reach(start, links):
    seen, todo = {start}, [start]
    while todo:
        for b in links.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_and_order(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(24)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(30)})
    links = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
    nodes, edges = spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(pairs, "src string, dst string")
    far = {n: reach(n, links) for n in names}
    want = {n: min(m for m in far[n] if n in far[m]) for n in names}
    rows = planner.strong_components(nodes, edges).cache()
    assert {r.id: r.component for r in rows.collect()} == want
    units = planner.units(rows, edges).cache()
    by_unit = {r.unit_id: r.component for r in units.collect()}
    ordered = [by_unit[u] for u in planner.order(units)]
    between = {(want[a], want[b]) for a, b in pairs if want[a] != want[b]}
    left, expected = set(want.values()), []
    while left:
        nxt = min(u for u in left if not any(b == u and a in left for a, b in between))
        expected.append(nxt)
        left.remove(nxt)
    assert ordered == expected
    rows.unpersist()


def test_blocked_and_shared_paths(spark):
    chosen = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", None)], "id string, path string")
    edges = spark.createDataFrame([("out", "a"), ("b", "c"), ("d", "d")], "src string, dst string")
    units, stopped = planner.plan(chosen, edges)
    assert {tuple(r) for r in stopped.collect()} == {("a", "retainedConsumer", "out"), ("b", "blockedByRetainedDependency", "a"), ("c", "blockedByRetainedDependency", "b")}
    assert [r.members for r in units.collect()] == [["d"]]
    assert planner.fingerprint(units, stopped, planner.order(units)) == planner.fingerprint(units.repartition(3), stopped.repartition(2), planner.order(units))


def test_a_plan_of_nothing(spark):
    none = spark.createDataFrame([], "id string, path string")
    units, stopped = planner.plan(none, spark.createDataFrame([("a", "b")], "src string, dst string"))
    assert units.count() == stopped.count() == 0 and planner.order(units) == []


def test_surface_show_hide_and_upgrades(spark):
    own = spark.createDataFrame([("c", "X"), ("c", "Y")], "library string, name string")
    exports = [("b", "c", False, None, []), ("a", "b", True, ["X"], None), ("a", "c", True, None, ["Y"]), ("c", "a", True, None, None)]
    ways = spark.createDataFrame(exports, "library string, target string, exact boolean, show array<string>, hide array<string>")
    got = {tuple(r) for r in surface.exported_names(own, ways).collect()}
    assert got == {("c", "X", True), ("c", "Y", True), ("b", "X", False), ("b", "Y", False), ("a", "X", True)}


def test_owners(spark):
    paths = spark.createDataFrame([("/p/a/x",), ("/p/ab",), ("/q",), ("/two/x",)], "path string")
    roots = spark.createDataFrame([("p", "/p"), ("a", "/p/a/"), ("one", "/two"), ("other", "/two")], "name string, root string")
    assert {tuple(r) for r in surface.owners(paths, roots).collect()} == {("/p/a/x", "a"), ("/p/ab", "p"), ("/q", "external"), ("/two/x", "unknown")}


def test_ledger_steps(spark):
    steps = [("t", i, s) for i, s in enumerate(["pending", "applied", "verified", "committed"])] + [("u", 0, "applied"), ("v", 0, "pending"), ("v", 1, "committed"), ("w", 0, "pending"), ("w", 1, "recoveryRequired"), ("w", 2, "rolledBackVerified")]
    events = spark.createDataFrame(steps, "tx string, seq int, state string")
    assert {(r.tx, r.seq) for r in ledger.violations(events, "tx", ["seq"]).collect()} == {("u", 0), ("v", 1)}
    assert {r.tx for r in ledger.blocking_runs(events, "tx", ["seq"]).collect()} == {"u"}


def test_scans(spark):
    rows = [("lib/a.dart",), ("build/x",), ("x/.git/y",), ("a/.DS_Store",), ("",), (None,)]
    got = {r.reason: r.paths for r in catalogues.exclusions(spark.createDataFrame(rows, "path string")).collect()}
    assert got == {"directory:build": 1, "directory:.git": 1, "file:.DS_Store": 1}
    files = spark.createDataFrame([("i/a.png", 5), ("i/2.0x/a.png", 7), ("i/3x/b.png", 9)], "path string, size_bytes long")
    assert [tuple(r) for r in catalogues.variant_families(files).collect()] == [("i/a.png", 1, 12)]


def test_scalars(spark):
    df = spark.createDataFrame([("en-us",), ("ZH_hans-cn",), ("en_latn",), ("e",), ("en_US_x",), (None,)], "t string")
    assert [r[0] for r in df.select(catalogues.normal_locale(F.col("t"))).collect()] == ["en_US", "zh_Hans_CN", "en_Latn", None, None, None]
    many = F.array(*[F.lit(str(i)) for i in range(9)])
    got = spark.range(1).select(catalogues.string_products(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"))).alias("few"), catalogues.string_products(many, many).alias("many")).first()
    assert got.few == ["ax", "bx"] and got.many is None
    keys = spark.createDataFrame([('{"a": 1, "b": {"a": 2}, "a": 3}',), ("{}",), ("no",)], "t string")
    assert [r[0] or [] for r in keys.select(catalogues.repeated_json_keys(F.col("t"))).collect()] == [["a"], [], []]


def test_reports_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("b", "k", "safe", ["x"]), ("a", "k", "review", [])], "id string, kind string, tier string, reasons array<string>")
    target = sinks.write_report(rows, str(tmp_path), "run-1")
    assert sinks.committed(spark, target)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_report(rows, str(tmp_path), "run-1")
    with pytest.raises(ValueError):
        sinks.check_limits(spark.createDataFrame([(["b"], [100_001])], "blocker_ids array<string>, affected array<bigint>"))
