"""Plans of removal: what is blocked, which findings go together and in what order."""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.conditions import bag_digest
from quern.operators.closure import closure
from quern.plans.materialise import cut

#: Nodes and edges up to which one task finds the components.
LOCAL_EDGES = 25_000
#: Rounds that settle nodes without edges in or out before whole ways are looked along.
PATIENCE = 3


def neutralised(edges: DataFrame, empty: DataFrame) -> DataFrame:
    """Adds ``neutral`` to edges(src, dst, kind, exact, unconditional, description): whether the edge is an import or export of an empty library (id) that goes with it."""
    stale = (F.col("kind") == "imports") & F.col("exact") & F.col("unconditional") & F.col("description").isin("import directive", "export directive")
    known = empty.select(F.col("id").alias("dst"), F.lit(True).alias("is_empty"))
    return edges.join(known, "dst", "left").withColumn("neutral", F.coalesce(stale & F.col("is_empty"), F.lit(False))).drop("is_empty")


def dependencies(selected: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """selected(id, path), edges(src, dst[, neutral]) -> edges between selected findings, and id with its smallest outside consumer.

    Findings of one path depend on each other, through the smallest of them. Neutral edges from outside hold nothing back.
    """
    ids = selected.select("id").distinct()
    neutral = F.col("neutral") if "neutral" in edges.columns else F.lit(False)
    into = cut(edges.select("src", "dst", neutral.alias("neutral")).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    inner = into.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").where("src <> dst").select("src", "dst")
    consumers = into.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").where("not neutral").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("consumer"))
    heads = selected.where("path is not null").groupBy("path").agg(F.min("id").alias("head"))
    star = selected.join(heads, "path").where("id <> head").select("id", "head")
    both = star.select(F.col("id").alias("src"), F.col("head").alias("dst")).unionByName(star.select(F.col("head").alias("src"), F.col("id").alias("dst")))
    return cut(inner.unionByName(both).distinct()), cut(consumers)


def blocked(inner: DataFrame, consumers: DataFrame) -> DataFrame:
    """id, reason, blocked_by: the smallest outside consumer, else the smallest blocked finding that needs it."""
    direct = consumers.select("id", F.lit("retainedConsumer").alias("reason"), F.col("consumer").alias("blocked_by"))
    reached = closure(consumers.select(F.lit("").alias("context"), "id"), inner).select("id")
    later = reached.join(consumers, "id", "left_anti")
    needed = inner.join(reached.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("blocked_by"))
    return direct.unionByName(later.join(needed, "id").select("id", F.lit("blockedByRetainedDependency").alias("reason"), "blocked_by"))


def _walked(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Components by two depth-first walks: one along the edges for the order of leaving, one against them in the reverse of it."""
    rows = ids.select("id", F.lit(None).cast("string").alias("dst")).unionByName(edges.where("src <> dst").select(F.col("src").alias("id"), "dst"))

    def run(batches):
        import pyarrow as pa

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        src, dst = table["id"].to_pylist(), table["dst"].to_pylist()
        names = sorted({a for a, b in zip(src, dst) if b is None})
        code = {name: k for k, name in enumerate(names)}
        out, back = [[] for _ in names], [[] for _ in names]
        for a, b in zip(src, dst):
            if b in code and a in code:
                out[code[a]].append(code[b])
                back[code[b]].append(code[a])
        left, seen = [], bytearray(len(names))
        for start in range(len(names)):
            if seen[start]:
                continue
            seen[start], path = 1, [(start, iter(out[start]))]
            while path:
                node, more = path[-1]
                step = next((k for k in more if not seen[k]), None)
                if step is None:
                    left.append(node)
                    path.pop()
                else:
                    seen[step] = 1
                    path.append((step, iter(out[step])))
        of = [-1] * len(names)
        for start in reversed(left):
            if of[start] >= 0:
                continue
            of[start], todo, members = start, [start], [start]
            while todo:
                for k in back[todo.pop()]:
                    if of[k] < 0:
                        of[k] = start
                        todo.append(k)
                        members.append(k)
            least = min(members)
            for k in members:
                of[k] = least
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([names[k] for k in of], pa.string())], names=["id", "component"])

    return rows.repartition(1).mapInArrow(run, "id string, component string")


def _forced(edges: DataFrame) -> DataFrame:
    """id, component of the nodes whose only way on ends in a ring of such nodes or where no way goes on, from distinct edges without loops.

    Each node looks twice as far in every round, so a way of any length costs its logarithm. Once no fewer nodes are
    looked at than in the round before, they are the rings and the ends.
    """
    ways = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("next"))
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    one = F.col("n") == 1
    step = ids.join(ways, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.when(one, F.col("next")).otherwise(F.col("id")).alias("far"), F.col("id").alias("least"))
    step, before = cut(step), None
    while True:
        again = step.select(F.col("id").alias("far"), F.col("far").alias("further"), F.col("least").alias("less"))
        now = cut(step.join(again, "far").select("id", "n", F.col("further").alias("far"), F.least("least", "less").alias("least"), (one & (F.col("less") < F.col("least"))).alias("fell")))
        held = now.join(now.select(F.col("far").alias("id")).distinct(), "id", "left_semi").agg(F.count("*").alias("size"), F.count_if("fell").alias("fell")).first()
        step = now.drop("fell")
        # On a ring the least seen is the smallest of all once it falls nowhere.
        if held.size == before and not held.fell:
            break
        before = held.size
    open_ = step.where("n > 1").select(F.col("id").alias("far"))
    ring = step.where(one).join(step.select(F.col("far").alias("id")).distinct(), "id", "left_semi").select("id", F.col("least").alias("component"))
    return cut(step.join(open_, "far", "left_anti").select("id").join(ring, "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def strong_components(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """id, component: the smallest id that it reaches and is reached from, itself included.

    A graph of at most LOCAL_EDGES edges is walked in one task. In a larger one each round settles nodes without edges in or out, lets the smallest id that reaches
    a node run forward as its colour, and takes from every colour what reaches its origin
    backward inside the colour. Where the first does not end soon, nodes with one way on, or one way in,
    are settled along the whole of it at once.
    """
    ids = cut(nodes.select("id").distinct())
    known = ids.withColumnRenamed
    if ids.count() <= local_edges and edges.count() <= local_edges:
        return _walked(ids, edges)
    left = cut(edges.select("src", "dst").where("src <> dst").distinct().join(known("id", "src"), "src", "left_semi").join(known("id", "dst"), "dst", "left_semi").select("src", "dst"))
    done = ids.limit(0).select("id", F.col("id").alias("component"))
    trims, without = 0, lambda rows, gone: cut(rows.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    while not left.isEmpty():
        both = cut(left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id"))))
        trimmed = cut(left.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if trimmed.count() < left.count():
            left, trims = trimmed, trims + 1
            if trims == PATIENCE:
                for a, b in (("src", "dst"), ("dst", "src")):
                    found = _forced(left.select(F.col(a).alias("src"), F.col(b).alias("dst")))
                    done, left = cut(done.unionByName(found)), without(left, found.select("id"))
            continue
        colour = cut(both.select("id", F.col("id").alias("colour")))
        while True:
            sent = left.join(colour.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "colour")
            met = colour.unionByName(sent).groupBy("id").agg(F.min("colour").alias("colour"))
            # What reaches a node's colour reaches the node: paths are halved in every step.
            further = colour.select(F.col("id").alias("colour"), F.col("colour").alias("further"))
            now = cut(met.join(further, "colour").select("id", F.least("colour", "further").alias("colour")))
            changed = not now.exceptAll(colour).isEmpty()
            colour = now
            if not changed:
                break
        ends = [colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("src", "dst")]
        back = left.join(ends[0], "src").join(ends[1], "dst").where("src_colour = dst_colour").select(F.col("src_colour").alias("context"), F.col("dst").alias("src"), F.col("src").alias("dst"))
        origins = colour.where("id = colour").select(F.col("colour").alias("context"), "id")
        found = closure(origins, back, per_context=True).select("id", F.col("context").alias("component"))
        done = cut(done.unionByName(found))
        left = without(left, found.select("id"))
    single = ids.join(done, "id", "left_anti").select("id", F.col("id").alias("component"))
    return done.unionByName(single)


def units(components: DataFrame, inner: DataFrame) -> DataFrame:
    """component, unit_id, members, needs (unit ids): one row per unit."""
    named = cut(components.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members")).withColumn("unit_id", F.concat(F.lit("unit:"), F.substring(F.sha2(F.array_join("members", "\0"), 256), 1, 16))))
    of = lambda end: components.select(F.col("id").alias(end), F.col("component").alias(f"{end}_unit"))
    between = inner.join(of("src"), "src").join(of("dst"), "dst").where("src_unit <> dst_unit").select("src_unit", "dst_unit").distinct()
    far = named.select(F.col("component").alias("dst_unit"), F.col("unit_id").alias("far_id"))
    needs = between.join(far, "dst_unit").groupBy(F.col("src_unit").alias("component")).agg(F.array_sort(F.collect_set("far_id")).alias("needs"))
    return named.join(needs, "component", "left").select("component", "unit_id", "members", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that is joined to it by edges, whatever their direction."""
    pairs = edges.select("src", "dst").where("src <> dst")
    now = cut(pairs.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = None
    while (after := mark(now)) != before:
        before = after
        # Larger neighbours move to the smallest one, then every node and the smaller ones do.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    return nodes.select("id").distinct().join(now.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def ordered(rows: DataFrame) -> DataFrame:
    """unit_id, component, lead, step of units(component, unit_id, needs): by lead and step, dependants come before what they need, always the one with the smallest member next.

    Units that no need joins don't wait for each other. So each group of joined units is put in
    order by itself, in a task that holds that group alone; of all groups the one
    whose next unit is smallest goes on, which is the order of the largest member so far.
    """
    near = rows.select("component", "unit_id", "needs")
    known = near.select(F.col("unit_id").alias("dst"))
    ways = near.select(F.col("unit_id").alias("src"), F.explode("needs").alias("dst")).join(known, "dst", "left_semi").select("src", "dst")
    groups = weak_components(near.select(F.col("unit_id").alias("id")), cut(ways)).select(F.col("id").alias("unit_id"), F.col("component").alias("grp"))
    dealt = near.join(groups, "unit_id").select("grp", "component", "unit_id", "needs")

    def run(batches):
        import pyarrow as pa

        def put(group):
            key, needs = {u: c for c, u, _ in group}, {u: [x for x in n if x] for _, u, n in group}
            waiting = dict.fromkeys(key, 0)
            for some in needs.values():
                for u in some:
                    if u in waiting:
                        waiting[u] += 1
            ready = [(key[u], u) for u, n in waiting.items() if not n]
            heapq.heapify(ready)
            lead, out = "", []
            while ready:
                c, unit = heapq.heappop(ready)
                lead = max(lead, c, key=lambda x: x.encode())
                out.append((unit, c, lead, len(out)))
                for u in needs[unit]:
                    if u in waiting:
                        waiting[u] -= 1
                        if not waiting[u]:
                            heapq.heappush(ready, (key[u], u))
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["unit_id", "component", "lead", "step"])

        now, held = None, []
        for b in batches:
            for grp, *row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if grp != now and held:
                    yield put(held)
                    held = []
                now = grp
                held.append(row)
        if held:
            yield put(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(run, "unit_id string, component string, lead string, step bigint")


def order(rows: DataFrame) -> list[str]:
    """Unit ids in the order of a plan, one after another."""
    return [r.unit_id for r in ordered(rows).orderBy("lead", "step").select("unit_id").toLocalIterator()]


def plan(selected: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units of what is not blocked, and what is blocked."""
    inner, consumers = dependencies(selected, edges)
    stopped = cut(blocked(inner, consumers))
    active = selected.select("id").distinct().join(stopped.select("id"), "id", "left_anti")
    return freed(active, inner, stopped), stopped


def freed(active: DataFrame, inner: DataFrame, stopped: DataFrame) -> DataFrame:
    """The units of the findings ``active`` (id), from the edges between selected ones and what is blocked (id)."""
    held = stopped.select("id")
    free = cut(inner.join(held.withColumnRenamed("id", "src"), "src", "left_anti").join(held.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    return units(cut(strong_components(active, free)), free)


def fingerprint(rows: DataFrame, stopped: DataFrame, ordered: list[str]) -> str:
    """sha256 of the plan: a digest of its units, one of what is blocked, and the order; equal plans have equal fingerprints."""
    digest = lambda df: df.select(F.to_json(F.struct(*sorted(df.columns))).alias("line")).agg(bag_digest("line").alias("h")).first().h
    return hashlib.sha256("|".join([digest(rows), digest(stopped), ",".join(ordered)]).encode()).hexdigest()
