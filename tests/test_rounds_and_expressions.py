"""Expressions, chains, upkeep of closures, rounds of removal and strict sources against plain Python."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import conditions as cond
from quern.operators import closure, expressions, facts, planner, rounds
from quern.operators.numbered import numbered
from quern.sources import project


def reach(seeds, edges):
    seen, todo = set(), list(seeds)
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [(x[0], b) for a, b in edges if a == x[1]]
    return seen


def test_chains_are_contracted(spark, monkeypatch):
    monkeypatch.setattr(closure, "PATIENCE", 1)
    monkeypatch.setattr(closure, "HOPS", 2)
    edges = [(f"n{k}", f"n{k + 1}") for k in range(60)] + [("n20", "m0")] + [(f"m{k}", f"m{k + 1}") for k in range(30)] + [("m30", "n40"), ("r0", "r1"), ("r1", "r0"), ("n59", "n58")]
    seeds = [("x", "n0"), ("y", "m10"), ("z", "r0")]
    got = closure.closure(spark.createDataFrame(seeds, "context string, id string"), spark.createDataFrame(edges, "src string, dst string"), local_edges=0)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == reach(seeds, edges)


def test_several_closures_in_one_pass_and_many_contexts(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}", r.random() < 0.5) for _ in range(110)]
    seeds = [(f"c{k}", f"n{r.randrange(60)}") for k in range(70)] + [(None, "n1")]
    e, s = spark.createDataFrame(edges, "src string, dst string, exact boolean"), spark.createDataFrame(seeds, "context string, id string")
    for local in (0, 10**6):
        found = closure.closures({"all": (s, None), "exact": (s.where("context < 'c3'"), F.col("exact"))}, e, local).collect()
        assert {(x.context, x.id) for x in found if x.run == "all"} == reach(seeds, [(a, b) for a, b, _ in edges])
        assert {(x.context, x.id) for x in found if x.run == "exact"} == reach([x for x in seeds if x[0] and x[0] < "c3"], [(a, b) for a, b, x in edges if x])
    # More contexts than a mask has bits, each with edges of its own.
    own = [(f"n{r.randrange(9)}", f"n{r.randrange(9)}", f"c{k % 70}") for k in range(300)]
    want = {x for s_ in seeds if s_[0] for x in reach([s_], [(a, b) for a, b, c in own if c == s_[0]])} | {(None, "n1")}
    got = closure.closure(s, spark.createDataFrame(own, "src string, dst string, context string"), per_context=True, local_edges=0)
    assert {tuple(x) for x in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_upkeep_equals_a_closure_of_the_rest(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(60)]
    seeds = [(c, f"n{r.randrange(40)}") for c in "xy" for _ in range(4)]
    e, s = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "context string, id string").distinct()
    gone = {f"n{k}" for k in r.sample(range(40), 6)}
    kept = closure.closure(s, e)
    got = closure.without(kept, s.where(~F.col("id").isin(*gone)), e, spark.createDataFrame([(g,) for g in gone], "id string"))
    rows = [tuple(x) for x in got.collect()]
    want = reach([x for x in seeds if x[1] not in gone], [(a, b) for a, b in edges if a not in gone and b not in gone])
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_rounds_free_what_only_they_retain(spark):
    nodes = spark.createDataFrame([(x, k, None) for x, k in (("root", "r"), ("a", "soft"), ("b", "hard"), ("c", "hard"), ("d", "hard"), ("e", "soft"), ("lonely", "hard"))], "id string, kind string, path string")
    # a is retained by a blocker of the root and alone retains b, which retains c; d is also used by a kept node.
    edges = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("b", "d", True), ("keep", "d", True), ("root", "keep", False)], "src string, dst string, exact boolean")
    nodes = nodes.unionByName(spark.createDataFrame([("keep", "hard", None)], nodes.schema))
    roots = spark.createDataFrame([("x", "root")], "context string, id string")
    none = spark.createDataFrame([], "id string")
    blockers = spark.createDataFrame([("p", "r", None, "root", None, ["a"])], "producer string, reason string, location string, source_node_id string, affected_namespace string, affected_node_ids array<string>")
    contexts = spark.createDataFrame([("x",)], "context string")
    select = lambda rows: rows.where("kind = 'soft' OR NOT retained")
    graph = (nodes, edges, roots, none, blockers)
    got = {(r.id, r.round, r.outcome) for r in rounds.apply(graph, contexts, select).collect()}
    assert got == {("a", 1, "committed"), ("e", 1, "committed"), ("lonely", 1, "committed"), ("b", 2, "committed"), ("c", 2, "committed")}
    failing = spark.createDataFrame([("e",)], "id string")
    got = {(r.id, r.round, r.outcome) for r in rounds.apply(graph, contexts, select, failing).collect()}
    assert got == {("a", 1, "committed"), ("e", 1, "rejectedRecovered"), ("lonely", 1, "notAttempted")}


def test_rounds_take_no_pass_for_a_context(spark, monkeypatch):
    nodes = spark.createDataFrame([("root", "r", None), ("a", "soft", None), ("b", "hard", None), ("c", "hard", None)], "id string, kind string, path string")
    edges = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("root", "a", False)], "src string, dst string, exact boolean")
    none, blockers = spark.createDataFrame([], "id string"), spark.createDataFrame([], "producer string, reason string, location string, source_node_id string, affected_namespace string, affected_node_ids array<string>")
    select = lambda rows: rows.where("kind = 'soft' OR NOT retained")
    calls, old = [], closure.cut
    monkeypatch.setattr(closure, "cut", lambda df: calls.append(df.columns) or old(df))
    names = [(f"c{k}",) for k in range(70)]
    roots = spark.createDataFrame([(c, "root") for c, in names], "context string, id string")
    got = rounds.apply((nodes, edges, roots, none, blockers), spark.createDataFrame(names, "context string"), select).collect()
    assert {(r.id, r.round, r.outcome) for r in got} == {("a", 1, "blocked")}
    # Seventy contexts and two closures are more than a mask holds: the edges were folded three times, once for each pass.
    assert calls.count(["key", "dst", "mask"]) == 2


def test_orders_of_groups_merge(spark):
    r = random.Random(4)
    names = [f"u{k:02}" for k in range(40)]
    needs = {u: sorted({v for v in r.sample(names, 2) if v != u and int(v[1:]) * 7 % 41 > int(u[1:]) * 7 % 41 and r.random() < 0.5}) for u in names}
    rows = spark.createDataFrame([(u, u, needs[u]) for u in names], "component string, unit_id string, needs array<string>").repartition(5)
    left, want = set(names), []
    while left:
        want.append(min(u for u in left if not any(u in needs[v] for v in left)))
        left.remove(want[-1])
    assert planner.order(rows) == want
    places = numbered(planner.ordered(rows), ["lead", "step"], "place").collect()
    assert [x.unit_id for x in sorted(places, key=lambda x: x.place)] == want and sorted(x.place for x in places) == list(range(40))


def exact_brute(nodes, operands, e, on=()):
    kind, text = nodes[e]
    ops = [o for _, o in sorted(operands.get(e, []))]
    if kind == "literal":
        return None if text is None else {text}
    if kind == "reference" and e in on or not ops:
        return None
    values = [exact_brute(nodes, operands, o, on + (e,)) for o in ops]
    if any(v is None for v in values):
        return None
    if kind == "parens":
        return values[0]
    out = set() if kind in ("reference", "conditional") else {""}
    for v in values:
        if kind == "reference" and len(out) + len(v) > 64 or kind in expressions.SEQUENCES and len(out) * len(v) > 64:
            return None
        out = out | v if kind in ("reference", "conditional") else {a + b for a in out for b in v}
    return out


def pattern_brute(nodes, operands, e):
    exact = exact_brute(nodes, operands, e)
    if exact is not None and len(exact) == 1:
        return re.sub(r"([$()*+.?\[\\\]^{|}])", r"\\\1", min(exact))
    ops = [o for _, o in sorted(operands.get(e, []))]
    if nodes[e][0] == "parens":
        return pattern_brute(nodes, operands, ops[0])
    if nodes[e][0] in ("plus", "interpolation"):
        return "".join(p if (p := pattern_brute(nodes, operands, o)) is not None else ".*" for o in ops)
    return None


def test_values_and_patterns_equal_recursion(spark):
    r = random.Random(7)
    nodes, operands = {}, {}
    for k in range(70):
        kind = r.choice(["literal", "literal", "plus", "interpolation", "conditional", "reference", "parens", "adjacent", "call"])
        nodes[f"e{k}"] = (kind, r.choice(["a", "b.c", "+", "", None]) if kind == "literal" else None)
        if kind not in ("literal", "call"):
            pool = [f"e{j}" for j in range(max(0, k - 12), k)] or ["e0"]
            n = {"plus": 2, "parens": 1, "conditional": 2}.get(kind, r.randrange(1, 5))
            operands[f"e{k}"] = [(j, r.choice(pool)) for j in range(n)]
    nodes["v"] = nodes["w"] = nodes["many"] = ("reference", None)
    operands |= {"v": [(0, "w")], "w": [(0, "e0"), (1, "v")], "many": [(j, f"l{j % 64}") for j in range(200)]}
    nodes |= {f"l{j}": ("literal", f"t{j}") for j in range(64)} | {"fits": ("reference", None), "twice": ("plus", None)}
    operands |= {"fits": [(j, f"l{j % 63}") for j in range(126)], "twice": [(0, "fits"), (1, "fits")]}
    n = spark.createDataFrame([(i, *x) for i, x in nodes.items()], "id string, kind string, text string")
    o = spark.createDataFrame([(i, *x) for i, xs in operands.items() for x in xs], "id string, position int, operand string")
    exact = expressions.exact_values(n, o).cache()
    got = {x.id: x.exact for x in exact.collect()}
    want = {e: exact_brute(nodes, operands, e) for e in nodes}
    assert got == {e: None if v is None else sorted(v) for e, v in want.items()}
    assert want["many"] is None and len(want["fits"]) == 63 and want["twice"] is None
    patterns = {x.id: x.pattern for x in expressions.patterns(n, o, exact).collect() if x.pattern}
    brute = {e: pattern_brute(nodes, operands, e) for e in nodes}
    assert patterns == {e: f"^{p}$" for e, p in brute.items() if p not in (None, ".*")}


def test_static_strings_bind_arguments_and_stop(spark):
    n = [("call1", "call", "f"), ("call2", "call", "f"), ("body", "plus", None), ("arg1", "literal", "x"), ("arg2", "reference", "unknown"), ("p", "reference", "p"), ("tail", "literal", "/t"), ("self", "reference", "g"), ("gbody", "interpolation", None), ("ga", "literal", "g:"), ("gself", "reference", "g"), ("odd", "other", None), ("oplus", "plus", None)]
    o = [("body", 0, "p"), ("body", 1, "tail"), ("gbody", 0, "ga"), ("gbody", 1, "gself"), ("gbody", 2, "tail"), ("oplus", 0, "odd"), ("oplus", 1, "tail")]
    elements = spark.createDataFrame([("f", None, "body"), ("g", None, "gbody"), ("unknown", None, None)], "element string, constant string, source string")
    arguments = spark.createDataFrame([("call1", "p", "arg1"), ("call2", "p", "arg2")], "call string, parameter string, argument string")
    uses = spark.createDataFrame([(u, u) for u in ("call1", "call2", "self", "odd", "oplus", "tail", "absent")], "use_id string, expr string")
    got = {r.use_id: (r.exact, r.prefix) for r in expressions.static_strings(uses, spark.createDataFrame(n, "id string, kind string, text string"), spark.createDataFrame(o, "id string, position int, operand string"), elements, arguments, depth=8).collect()}
    assert got == {"call1": ("x/t", "x/t"), "call2": (None, None), "self": (None, "g:"), "odd": (None, None), "oplus": (None, None), "tail": ("/t", "/t"), "absent": (None, None)}


def test_type_keys(spark):
    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode()
    rows = [("a", None, 0, "interface", "dart:core", "List", "nullable"), ("b", "a", 0, "interface", "package:p/p.dart", "T", "nonNullable"), ("c", None, 0, "interface", "file:///x.dart", "T", "nonNullable"), ("d", None, 0, "interface", "dart:core", "List", "nonNullable"), ("e", "d", 0, "dynamic", None, None, "nonNullable"), ("f", None, 0, "interface", "lib/a.dart", "T", "legacy"), ("g", "g", 0, "interface", "dart:core", "T", "legacy")]
    got = {r.id: r.type_key for r in expressions.type_keys(spark.createDataFrame(rows, "id string, parent string, position int, kind string, library string, name string, nullability string")).collect()}
    b = f"interface|{enc('package:p/p.dart')}|{enc('T')}|nonNullable|0"
    assert got == {"b": b, "a": f"interface|{enc('dart:core')}|{enc('List')}|nullable|1|{enc(b)}", "c": None, "d": None, "e": None, "f": None, "g": None}


def test_strict_yaml():
    read = project.read_yaml
    assert read('name: "a #b"\nitems: [a, "b, c"]  # end\n"q: r": \'it\'\'s\'\nurl: http://a.b/c') == {"name": "a #b", "items": ["a", "b, c"], "q: r": "it's", "url": "http://a.b/c"}
    for bad in ("a: &x 1", "b: *x", "c: |\n  text", "d: {e: 1}", 'e: "open', "f: !tag 1", "g: [a, [b]]", 'h: "a" b', "a: b: c", "a:\n\t- b"):
        with pytest.raises(ValueError):
            read(bad)


def test_components_and_metadata(spark):
    df = spark.createDataFrame([("a b!~'()*-_.é/",)], "t string")
    assert df.select(cond.encode_component(F.col("t"))).first()[0] == "a%20b!~'()*-_.%C3%A9%2F"
    rows = [("n", '{"a":1,"b":2}', "p", 1), ("n", '{"b":2,"a":1}', "q", 10), ("m", '{"a":1}', "p", 3), ("m", '{"a":"1"}', "q", 2), ("o", None, "p", 4)]
    kept, conflicts = facts.nodes(spark.createDataFrame(rows, "id string, meta string, producer string, seq int"), [], "meta")
    assert {(r.id, r.owner) for r in kept.collect()} == {("n", "p"), ("m", "q"), ("o", "p")} and [r.affected_node_ids for r in conflicts.collect()] == [["m"]]
    stamped = facts.FactBuilder("x").add("t", spark.createDataFrame([(k,) for k in (10, 9, 100)], "k int")).stamped("t", ["k"]).collect()
    assert sorted((r.seq, r.k) for r in stamped) == [(0, 9), (1, 10), (2, 100)]


def test_message_files(spark):
    docs = [("l/app_en.arb", '{"@@locale":"en","a":"x","@a":{"placeholders":{"n":{"type":"int"}}},"b":3,"@c":{}}'), ("l/app_zz.arb", '{"a":"x"}'), ("l/app_es.arb", '{"a":"1","a":"2"}'), ("l/app_fr.arb", '{"a":'), ("l/app_it.arb", "[1]"), ("l/app_sv.arb", '{"@@locale":"de","a":"1"}'),
        ("l/app_de.arb", '{"a":"y","@a":{"placeholders":{"n":{"optionalParameters":{"k":[null]}}}},"f":"q","@f":{"placeholders":{"n":{"isCustomDateFormat":"true","example":"a null, b"}}}}')]
    said, issues = project.messages(spark.createDataFrame(docs, "path string, text string"), "l/app_en.arb")
    assert {tuple(r) for r in said.collect()} == {("a", "en", True, "x"), ("a", "de", False, "y"), ("f", "de", False, "q")}
    assert {(r.path[6:8], r.key) for r in issues.collect()} == {("zz", None), ("es", None), ("fr", None), ("it", None), ("sv", None), ("en", "b"), ("en", "c"), ("de", "a")}
