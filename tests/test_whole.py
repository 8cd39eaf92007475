"""What has no SQL: both ways of walking graphs, configuration, report stores, canonical forms."""

import random

import pytest
from pyspark.sql import functions as F

from quern import sinks
from quern.operators import assembly, closure, facts, planner
from quern.sources import project


def _edges(spark, n, seed, context=False):
    r = random.Random(seed)
    rows = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", f"c{r.randrange(3)}") for _ in range(2 * n)] + [(f"n{k}", f"n{k + 1}", "c0") for k in range(n)] + [("n1", None, "c1"), ("n2", "n2", "c2")]
    return spark.createDataFrame(rows, "src string, dst string, context string"), rows


@pytest.mark.parametrize("per_context", [False, True])
def test_joins_and_walks_reach_the_same(spark, per_context, monkeypatch):
    monkeypatch.setattr(closure, "HUB", 3)
    monkeypatch.setattr(closure, "PIECES", 2)
    edges, rows = _edges(spark, 40, 1)
    seeds = spark.createDataFrame([("c0", "n0"), ("c1", "n5"), ("c2", "n2"), ("c1", None)], "context string, id string")
    want = set()
    todo = [(c, i) for c, i in (("c0", "n0"), ("c1", "n5"), ("c2", "n2"))]
    while todo:
        c, i = todo.pop()
        if (c, i) not in want:
            want.add((c, i))
            todo += [(c, b) for a, b, x in rows if a == i and b is not None and (x == c or not per_context)]
    for local in (10**6, 0):
        got = [tuple(r) for r in closure.closure(seeds, edges, per_context, local_edges=local).collect()]
        assert len(got) == len(want) and set(got) == want


def test_long_chains_keep_their_partitions(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(40)], "src string, dst string")
    out = closure.closure(spark.createDataFrame([("x", "n0")], "context string, id string"), edges, local_edges=0)
    assert out.count() == 41 and out.rdd.getNumPartitions() <= 40
    walked = closure.closure(spark.createDataFrame([("x", "n0")], "context string, id string"), spark.range(5_000).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst")))
    assert walked.count() == 5_001


def test_components_by_walks_and_by_colours(spark):
    edges, rows = _edges(spark, 30, 7)
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(31)], "id string")
    edges = edges.where("dst is not null").select("src", "dst")
    one, two = ({r.id: r.component for r in planner.strong_components(nodes, edges, local_edges=k).collect()} for k in (10**6, 0))
    assert one == two and len(one) == 31


CONFIG = """
version: 1            # the only one
analysis:
  mode: package
  public_entrypoints:
  - lib/a.dart
target_matrix:
  complete: true
  targets:
    - name: "one"
      platform: ios
      entrypoint: lib/main.dart
      dart_defines:
        KEY: 'v: 1'
    - name: two
      platform: web
      entrypoint: lib/main.dart
verification:
  steps:
    - id: test
      arguments: [test, --fast]
"""


def test_configuration():
    c = project.config(CONFIG)
    assert c["target_matrix"]["targets"][0] == {"name": "one", "platform": "ios", "entrypoint": "lib/main.dart", "dart_defines": {"KEY": "v: 1"}}
    assert c["verification"]["steps"] == [{"id": "test", "arguments": ["test", "--fast"]}]
    for old, new in (("version: 1", "version: 2"), ("mode: package", "mode: application"), ("platform: web", "platform: tv"), ("name: two", "name: one"), ("complete: true", "complete: maybe"), ("  mode: package", "  odd: 1\n  mode: package"), ("  - lib/a.dart", "  - lib/a.dart\n  - lib/a.dart")):
        with pytest.raises(ValueError):
            project.config(CONFIG.replace(old, new))
    for bad in ("a: 1\na: 2", "a: 1\n   b: 2", "- 1\nb: 2", "what"):
        with pytest.raises(ValueError):
            project.read_yaml(bad)


def test_message_configuration():
    assert project.message_config(None) is None
    assert project.message_config(None, generates=True)["output-class"] == "AppLocalizations"
    assert project.message_config("arb-dir: lib/text\nnullable-getter: false")["output-dir"] == "lib/text"
    for bad in ("arb-dir: ../x", "arb-dir: /x", "synthetic-package: true", "output-class: 1", "nullable-getter: 1"):
        with pytest.raises(ValueError):
            project.message_config(bad)


def test_adapter_order():
    needs = {"routes": ["dart"], "dart": [], "messages": ["dart", "routes"]}
    assert project.adapter_order(needs) == ["dart", "routes", "messages"]
    assert project.with_dependencies(["messages"], needs) == set(needs)
    for bad in ({"a": ["b"], "b": ["a"]}, {"a": ["x"]}):
        with pytest.raises(ValueError):
            project.adapter_order(bad)


def test_metadata_forms():
    form = facts.metadata_form
    assert form('{"b": 1, "a": [true, {"x": null}]}') == form('{"a": [true, {"x": null}], "b": 1}')
    assert len({form(x) for x in ('{"a": 1}', '{"a": 1.0}', '{"a": "1"}', '{"a": true}', '{"a": null}', '{"a": [1]}', '{"a": {"1": 1}}', "{}")}) == 8
    assert form(None) is form("[1]") is form("no") is None
    # Two units of UTF-16 for one letter beyond the first plane.
    assert form('{"a": "🙂"}') == "20:1:a|13:6:string|2:🙂"


def test_null_and_empty_conflict(spark):
    rows = spark.createDataFrame([("n", None, "p", 1), ("n", "", "q", 2), ("m", "x", "p", 3), ("m", "x", "q", 4)], "id string, sha string, producer string, seq int")
    kept, conflicts = facts.nodes(rows, ["sha"])
    assert [r.affected_node_ids for r in conflicts.collect()] == [["n"]]
    assert {r.id: (r.sha, r.owner, r.contributors) for r in kept.collect()} == {"n": ("", "p", ["p", "q"]), "m": ("x", "p", ["p", "q"])}


def test_fact_builders(spark):
    b = facts.FactBuilder("dart").add("nodes", spark.createDataFrame([("a",)], "id string")).add("nodes", spark.createDataFrame([("b",)], "id string"))
    assert {(r.id, r.producer) for r in b.stamped("nodes", ["id"]).collect()} == {("a", "dart"), ("b", "dart")}


def test_report_stores(spark, tmp_path):
    rows = spark.createDataFrame([("b", "k", "safe", ["x"]), ("a", "k", "review", []), ("a", "k", "review", [])], "id string, kind string, tier string, reasons array<string>")
    one, two = sinks.write_reports({"one": rows, "two": rows.limit(0)}, str(tmp_path))
    assert sinks.recovery_state(spark, one) == sinks.recovery_state(spark, two) == "complete"
    assert sinks.recovery_state(spark, str(tmp_path / "none")) == "absent"
    rows.select(sinks.finding_json().alias("value")).distinct().write.mode("overwrite").text(f"{one}/findings")
    assert sinks.recovery_state(spark, one) == "altered" and not sinks.committed(spark, one)
    rows.select(sinks.finding_json().alias("value")).write.text(str(tmp_path / "three" / "findings"))
    assert sinks.recovery_state(spark, str(tmp_path / "three")) == "uncommitted"
    old = rows.select("id", "kind", "tier", F.array(F.lit("x")).alias("blockers"), F.lit("why").alias("why_not_safe"), F.array(F.lit("b")).alias("blocker_ids"), F.array(F.lit(1).cast("bigint")).alias("affected"))
    sinks.write_v2(old, str(tmp_path / "v2"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v2")).collect()][0].startswith('{"id":"a"')


def test_mirrored_contexts(spark):
    contexts = spark.createDataFrame([("app:a", "configured"), ("aux:test:x", "auxiliary")], "id string, domain string")
    roots = spark.createDataFrame([("app:a", "n1", "r"), ("aux:test:gone", "n2", "r")], "context string, node_id string, reason string")
    issues = spark.createDataFrame([("code", "why", "n9"), ("code", "why", None)], "code string, reason string, node_id string")
    kept, stops = assembly.mirrored(contexts, roots, issues, spark.createDataFrame([("a",)], "name string"))
    assert [r.node_id for r in kept.collect()] == ["n1"]
    assert sorted(r.affected_node_ids for r in stops.collect()) == [[], ["n9"]]
    with pytest.raises(ValueError):
        assembly.mirrored(contexts, roots, issues, spark.createDataFrame([("b",)], "name string"))


def test_plan_fingerprints(spark):
    plans = [spark.createDataFrame(rows, "id string, component string") for rows in ([("a", "x"), ("b", "x")], [("b", "x"), ("a", "x")], [("a", "x"), ("a", "x")])]
    prints = [planner.fingerprint(p, plans[0], ["u"]) for p in plans]
    assert prints[0] == prints[1] != prints[2] and planner.fingerprint(plans[0], plans[0], []) != prints[0]
