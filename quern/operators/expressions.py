"""Values of expressions that are given as rows: bounded sets of strings, patterns, static strings, keys of types.

An expression is a row of nodes(id, kind, text); operands(id, position, operand) says what
it is made of. All expressions are evaluated at once, level by level: a level is a
join of what is newly known with the operands that wait for it, so the number of joins is the
height of the highest expression, not their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.conditions import url_safe_base64
from quern.plans.materialise import cut

#: Values of an expression, nested expressions of an argument, and levels of a static string, at most.
MOST_VALUES, MOST_NESTED, MOST_DEPTH = 64, 1_024, 24
#: Kinds whose strings follow each other, and kinds that nested expressions are not counted through.
SEQUENCES = ("plus", "adjacent", "interpolation")
CALLS = ("call", "creation", "closure")
_STRINGS = "array<string>"


def bottom_up(nodes: DataFrame, operands: DataFrame | None, leaf: Column, combine: Callable[[Column], Column], folds: Column | None = None, holds: Column | None = None, rest: bool = False) -> DataFrame:
    """id, value: of nodes without operands ``leaf``, of others ``combine`` of the array of their operands' structs (position, value), in order.

    Without operands the nodes form trees, and each one names its parent and its position there.
    Nodes on or above a ring of operands get no row, or with ``rest`` a null. Nodes that ``holds``
    does not hold for are leaves, whatever operands they have. Of nodes that ``folds`` holds for, the first and
    the last of equal operand values are combined, so that they may have any
    number of operands: repeats in between must change nothing.

    A value goes to those that wait for it once, and only if some do. What a level has met is
    written, its values are not: they are combined where they are read.
    """
    if operands is None:
        links, of, up = None, nodes.where("parent is not null").select(F.col("parent").alias("id")), ["parent", "position"]
    else:
        folded = None if folds is None else nodes.where(folds).select("id", F.lit(True).alias("fold"))
        links, up = operands.select("id", "position", "operand"), []
        links = of = cut(links.withColumn("fold", F.lit(False)) if folded is None else links.join(folded, "id", "left").withColumn("fold", F.coalesce("fold", F.lit(False))))
    rows = nodes.join(of.groupBy("id").agg(F.count("*").alias("_n")), "id", "left")
    used = F.col("parent").isNotNull()
    if links is not None:
        rows, used = rows.join(links.select(F.col("operand").alias("id"), F.lit(True).alias("_some")).distinct(), "id", "left"), F.col("_some").isNotNull()
    rows = cut(rows.select(*nodes.columns, (F.col("_n") if holds is None else F.when(holds, F.col("_n"))).alias("_n"), used.alias("_used")))
    fresh = rows.where("_n is null").select("id", *up, "_used", leaf.alias("value"))
    args = f"array<struct<position:{(nodes if links is None else links).schema['position'].dataType.simpleString()},value:{fresh.schema['value'].dataType.simpleString()}>>"
    waiting = rows.where("_n is not null").withColumn("_have", F.lit(0).cast("bigint")).withColumn("_args", F.array().cast(args))
    known, pieces = rows.agg(F.count(F.when(F.col("_n").isNull() & F.col("_used"), 1)).alias("told"), F.count("_n").alias("waits")).first(), [fresh]
    while known.told and known.waits:
        told = fresh.where("_used")
        if links is None:
            met = told.select(F.col("parent").alias("id"), "position", "value", F.lit(1).alias("m"))
        else:
            met = links.join(told.select(F.col("id").alias("operand"), "value"), "operand")
            ends = met.where("fold").groupBy("id", "value").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count("*").alias("c"))
            ends = ends.select("id", F.explode(F.array_distinct(F.array("a", "b"))).alias("position"), "value", "a", "c")
            met = met.where("not fold").select("id", "position", "value", F.lit(1).cast("bigint").alias("m"))
            if folds is not None:
                met = met.unionByName(ends.select("id", "position", "value", F.when(F.col("position") == F.col("a"), F.col("c")).otherwise(0).alias("m")))
        new = met.groupBy("id").agg(F.sum("m").alias("_m"), F.collect_list(F.struct("position", "value")).cast(args).alias("_new"))
        step = waiting.join(new, "id", "left").withColumn("_have", F.col("_have") + F.coalesce("_m", F.lit(0)))
        step = step.withColumn("_all", F.array_sort(F.concat("_args", F.coalesce("_new", F.array().cast(args)))))
        # Equal values at one place are one.
        step = step.withColumn("_args", F.filter("_all", lambda x, k: (k == 0) | ~x.eqNullSafe(F.get("_all", k - 1))))
        step = cut(step.select(*nodes.columns, "_n", "_used", "_have", "_args"))
        ready = F.col("_have") == F.col("_n")
        known = step.agg(F.count(F.when(ready & F.col("_used"), 1)).alias("told"), F.count(F.when(~ready, 1)).alias("waits")).first()
        fresh, waiting = step.where(ready).select("id", *up, "_used", combine(F.col("_args")).alias("value")), step.where(~ready)
        pieces.append(fresh)
    out = pieces[0].select("id", "value")
    for more in pieces[1:]:
        out = out.unionByName(more.select("id", "value"))
    return out.unionByName(waiting.select("id", F.lit(None).cast(fresh.schema["value"].dataType).alias("value"))) if rest else out


def _union(most: int | None):
    def step(s, x):
        v = x["value"]
        out = F.array_union(s, v)
        none = s.isNull() | v.isNull()
        return F.when(~(none if most is None else none | (F.size(s) + F.size(v) > most)), out)

    return lambda args: F.aggregate(args, F.array().cast(_STRINGS), step)


def _product(args: Column) -> Column:
    def step(s, x):
        v = x["value"]
        pairs = F.array_distinct(F.flatten(F.transform(s, lambda a: F.transform(v, lambda b: F.concat(a, b)))))
        return F.when(s.isNotNull() & v.isNotNull() & (F.size(s) * F.size(v) <= MOST_VALUES), pairs)

    return F.aggregate(args, F.array(F.lit("")), step)


def exact_values(nodes: DataFrame, operands: DataFrame) -> DataFrame:
    """id, exact: the finite set of strings an expression can have, null if it is not bounded.

    Kinds: literal and constant (text, or null), parens, plus, adjacent, interpolation,
    conditional, reference (its operands are all its definitions), accessor (its
    operands are the literals of its assets); anything else, as variables that are written by other
    operators, is unbounded. A set of more than 64 values is, products and definitions
    alike; so is what depends on itself.
    """
    leaf = F.when(F.col("kind").isin("literal", "constant") & F.col("text").isNotNull(), F.array("text")).cast(_STRINGS)
    kind = F.col("kind")

    def combine(args):
        out = F.when(kind.isin(*SEQUENCES), _product(args)).when(kind == "conditional", _union(None)(args)).when(kind == "reference", _union(MOST_VALUES)(args))
        return out.when(kind == "accessor", _union(None)(args)).when(kind == "parens", F.get(args, F.lit(0))["value"]).cast(_STRINGS)

    known = bottom_up(nodes, operands, leaf, combine, kind.isin("reference", "accessor", "conditional"), rest=True)
    return known.select("id", F.array_sort("value").alias("exact"))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([$()*+.?\[\\\]^{|}])", r"\\$1")


def patterns(nodes: DataFrame, operands: DataFrame, exact: DataFrame) -> DataFrame:
    """id, pattern: an anchored regular expression for strings that are known in part, with a hole for each part that is not; null if nothing is known."""
    # Only the one string of a set goes along, not the set.
    single = exact.select("id", F.when(F.size("exact") == 1, F.get("exact", F.lit(0))).alias("one")).where("one is not null")
    known = cut(nodes.join(single, "id", "left"))
    made = F.col("one").isNull() & F.col("kind").isin("plus", "interpolation", "parens")
    hole = lambda x: F.coalesce(x["value"], F.lit(".*"))
    joined = lambda args: F.when(F.col("kind") == "parens", F.get(args, F.lit(0))["value"]).otherwise(F.array_join(F.transform(args, hole), ""))
    found = bottom_up(known, operands, F.when(F.col("one").isNotNull(), _escaped(F.col("one"))), joined, holds=made)
    return found.select("id", F.when(F.col("value") != ".*", F.concat(F.lit("^"), "value", F.lit("$"))).alias("pattern"))


def provenance(nodes: DataFrame, operands: DataFrame) -> DataFrame:
    """id, nested, complete: how many expressions an argument holds, itself included, not through calls and closures; beyond the bound the walk is not complete."""
    through = ~F.col("kind").isin(*CALLS, "reference", "accessor")
    found = bottom_up(nodes, operands, F.lit(1).cast("bigint"), lambda args: F.aggregate(args, F.lit(1).cast("bigint"), lambda s, x: s + x["value"]), holds=through)
    return found.select("id", F.least("value", F.lit(MOST_NESTED)).alias("nested"), (F.col("value") <= MOST_NESTED).alias("complete"))


_STATE = ("expr", "env", "seen")
_VALUE = "struct<exact:string,prefix:string>"


def static_strings(uses: DataFrame, nodes: DataFrame, operands: DataFrame, elements: DataFrame, arguments: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """use_id, exact, prefix of uses(use_id, expr): the string an expression has, or the one it begins with; both null if neither is known.

    Kinds: literal, parens, plus, adjacent, interpolation, reference (text: an element) and call
    (text: an executable). elements(element, constant, source): a constant value, else the
    initialiser or what an executable returns. arguments(call, parameter, argument): inside a
    call parameters stand for its arguments. An element that is being evaluated
    is unknown inside itself, and so is what lies more than ``depth`` levels deep.

    What is asked is expanded downwards, each state (expression, bindings, elements on the
    way) once a level, and folded upwards along the same links.
    """
    bound = arguments.groupBy(F.col("call").alias("expr")).agg(F.map_from_entries(F.collect_list(F.struct("parameter", "argument"))).alias("more"))
    known = cut(nodes.join(bound, nodes["id"] == bound["expr"], "left").join(elements, F.col("text") == F.col("element"), "left").select("id", "kind", "text", "more", "constant", "source"))
    key = lambda: F.md5(F.to_json(F.struct("expr", F.array_sort(F.map_entries("env")).alias("env"), F.array_sort("seen").alias("seen")))).alias("state")
    asked = uses.select("use_id", "expr", F.map_from_arrays(F.array().cast(_STRINGS), F.array().cast(_STRINGS)).alias("env"), F.array().cast(_STRINGS).alias("seen"))
    asked = cut(asked.select("use_id", key(), *_STATE))
    waiting, levels = {0: [asked.select("state", *_STATE)]}, []
    for d in range(depth + 1):
        front = waiting.pop(d, None)
        if front is None:
            levels.append(None)
            continue
        rows = front[0]
        for more in front[1:]:
            rows = rows.unionByName(more)
        at = rows.dropDuplicates(["state"]).join(known, F.col("expr") == F.col("id"), "left")
        given, fresh = F.element_at("env", F.col("text")), F.col("source").isNotNull() & ~F.array_contains("seen", F.coalesce("text", F.lit("")))
        is_ref, is_call = F.col("kind") == "reference", F.col("kind") == "call"
        to_source = (is_ref & given.isNull() & F.col("constant").isNull() | is_call) & fresh
        child = F.when(is_ref & given.isNotNull(), given).when(to_source, F.col("source"))
        env = F.when(is_call & F.col("more").isNotNull(), F.expr("map_from_entries(concat(filter(map_entries(env), x -> NOT array_contains(map_keys(more), x.key)), map_entries(more)))")).otherwise(F.col("env"))
        seen = F.when(to_source, F.array_append("seen", F.col("text"))).otherwise(F.col("seen"))
        text = F.when(F.col("kind") == "literal", F.col("text")).when(is_ref & given.isNull(), F.col("constant"))
        # What an element stands for is two levels down, everything else one.
        at = cut(at.select("state", "expr", "kind", text.alias("known"), child.alias("child"), env.alias("env"), seen.alias("seen"), F.when(is_ref, d + 2).otherwise(d + 1).alias("child_depth")))
        parts = at.where(F.col("kind").isin("parens", *SEQUENCES)).join(operands.withColumnRenamed("id", "expr"), "expr").select("state", "position", F.col("operand").alias("expr"), "env", "seen", "child_depth")
        single = at.where("child is not null").select("state", F.lit(0).alias("position"), F.col("child").alias("expr"), "env", "seen", "child_depth")
        below = cut(parts.unionByName(single.select(*parts.columns)).select(F.col("state").alias("above"), "position", key(), *_STATE, "child_depth"))
        levels.append((at.select("state", "kind", "known"), below.select("above", "position", "state", "child_depth")))
        for deeper in sorted(r[0] for r in below.select("child_depth").distinct().collect()):  # two at most
            waiting.setdefault(deeper, []).append(below.where(F.col("child_depth") == deeper).select("state", *_STATE))
        if not waiting:
            break
    values: dict[int, DataFrame] = {}
    for d in range(len(levels) - 1, -1, -1):
        if levels[d] is None:
            continue
        at, below = levels[d]
        held = None
        for step in (1, 2):
            if d + step in values:
                met = below.where(F.col("child_depth") == d + step).join(values[d + step], "state").select("above", "position", "value")
                held = met if held is None else held.unionByName(met)
        none = F.lit(None).cast(_VALUE)
        if held is None:
            args = below.select("above", "position").withColumn("value", none)
        else:
            args = below.select("above", "position").join(held, ["above", "position"], "left")
        args = args.groupBy(F.col("above").alias("state")).agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("args"))
        values[d] = cut(at.join(args, "state", "left").select("state", _static(F.col("kind"), F.col("known"), F.col("args")).alias("value")))
    out = asked.select("use_id", "state").join(values[0], "state", "left")
    return out.select("use_id", "value.exact", "value.prefix")


def _static(kind: Column, known: Column, args: Column) -> Column:
    """The value of a node over its operands' values: exact, or a prefix only."""
    exact = lambda s: F.struct(s.alias("exact"), s.alias("prefix"))
    partial = lambda s: F.struct(F.lit(None).cast("string").alias("exact"), s.alias("prefix"))
    first = F.struct(F.lit("").alias("text"), F.lit(False).alias("ended"))

    def step(s, x):
        v = x["value"]
        text = F.concat(s["text"], F.coalesce(v["prefix"], F.lit("")))
        return F.when(s["ended"], s).otherwise(F.struct(text.alias("text"), v["exact"].isNull().alias("ended")))

    joined = F.aggregate(args, first, step)
    sequence = F.when(joined["ended"], partial(joined["text"])).otherwise(exact(joined["text"]))
    one, two = F.get(args, F.lit(0))["value"], F.get(args, F.lit(1))["value"]
    # A sum whose left side is unknown is unknown; other sequences then have an empty prefix.
    plus = F.when(one.isNotNull(), F.when(one["exact"].isNull(), one).when(two["exact"].isNotNull(), exact(F.concat(one["exact"], two["exact"]))).otherwise(partial(F.concat(one["exact"], F.coalesce(two["prefix"], F.lit(""))))))
    out = F.when(kind.isin("literal", "reference") & known.isNotNull(), exact(known)).when(kind == "plus", plus)
    return out.when(kind.isin(*SEQUENCES), sequence).when(kind.isin("parens", "reference", "call"), one).cast(_VALUE)


def type_keys(types: DataFrame) -> DataFrame:
    """id, type_key of types(id, parent, position, kind, library, name, nullability): equal exactly for equal types, null for types without a stable identity.

    A type's arguments are the rows that have it as their parent. Only interface types of
    libraries with an absolute address that is no file have an identity, and only
    if their arguments do.
    """
    stable = (F.col("kind") == "interface") & F.col("library").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.lower("library").startswith("file:") & F.col("name").isNotNull() & F.col("nullability").isin("nonNullable", "nullable", "legacy")
    own = F.concat_ws("|", F.lit("interface"), _token(F.col("library")), _token(F.col("name")), "nullability")

    def combine(args):
        keys = F.transform(args, lambda x: x["value"])
        whole = F.concat(F.col("own"), F.lit("|"), F.size(args).cast("string"), F.lit("|"), F.array_join(F.transform(keys, _token), "|"))
        return F.when(F.col("own").isNotNull() & ~F.exists(keys, lambda k: k.isNull()), whole)

    rows = types.select("id", "parent", "position", F.when(stable, own).alias("own"))
    found = bottom_up(rows, None, F.concat("own", F.lit("|0")), combine, rest=True)
    return found.select("id", F.col("value").alias("type_key"))


def _token(text: Column) -> Column:
    return url_safe_base64(text)
