"""Fixed points over (context, node): all contexts advance in one loop.

A node's contexts are the bits of a mask, so an edge is followed once for all of them. Edges and
the bulk of what was reached are dealt out by node once and kept; a step shuffles what it
reaches and nothing else. Where the loop does not end soon, chains (nodes with
one way in and one way out) are contracted by pointer jumping, so that a chain costs the
logarithm of its length.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.materialise import bounded, cut

#: Rows up to which the edges are broadcast in every step.
BROADCAST_EDGES = 200_000
#: Edges and seeds up to which one task walks the whole graph, in memory of its own: small projects, where a job costs more than the walk.
LOCAL_EDGES = 25_000
#: Contexts in a mask.
WORD = 60
#: Edges of one source beyond which they are met by broadcasting the source, not by its key.
HUB = 100_000
#: Rows of a frontier that is small, and steps that a small one takes in one job.
SMALL_FRONT, HOPS = 100_000, 4
#: Frontiers that are kept apart before they become one table.
PIECES = 6
#: Edges beyond which a small frontier goes one step a job, broadcast to them: reading them costs more than a job.
LONG_READ = BROADCAST_EDGES
#: Namespaces that each id is held against; the beginnings of ids are met with more of them.
FEW_SPACES = 32
#: Steps of the loop before chains are contracted.
PATIENCE = 16


def closure(seeds: DataFrame, edges: DataFrame, per_context: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """context, id: the least set that holds the seeds (context, id) and follows the edges (src, dst[, context]).

    Null ends are no nodes; a null context is one like others. A graph of at most
    ``local_edges`` edges is walked in one task; a larger one in a loop of joins.
    """
    if not per_context:
        return closures({"": (seeds, None)}, edges, local_edges).drop("run")
    edges = cut(edges.select("src", "dst", "context").where("src is not null and dst is not null"))
    seeds = cut(seeds.select("context", "id").where("id is not null").distinct())
    if edges.count() <= local_edges and seeds.count() <= local_edges:
        return cut(_walked(seeds, edges, True))
    names = seeds.select("context").distinct().limit(WORD + 1).collect()
    if len(names) > WORD:
        # Too many contexts for a mask: a node of a context is a node of its own.
        key = lambda c: F.struct("context", F.col(c).alias("id"))
        one = F.lit(1).cast("bigint").alias("mask")
        found = _spread(seeds.select(key("id").alias("key"), one), cut(edges.select(key("src").alias("key"), key("dst").alias("dst"), one).distinct()))
        return cut(found.select("key.context", "key.id"))
    names = [r[0] for r in names]
    of = F.coalesce(*[F.when(F.col("context").eqNullSafe(F.lit(c)), F.lit(1 << k)) for k, c in enumerate(names)]).cast("bigint") if names else F.lit(0).cast("bigint")
    ways = edges.select(F.col("src").alias("key"), "dst", of.alias("mask")).where("mask is not null").groupBy("key", "dst").agg(F.bit_or("mask").alias("mask"))
    found = _spread(seeds.select(F.col("id").alias("key"), of.alias("mask")).groupBy("key").agg(F.bit_or("mask").alias("mask")), cut(ways))
    return cut(_decoded(found, [("", c) for c in names]).drop("run"))


def closures(runs: dict[str, tuple[DataFrame, Column | None]], edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """run, context, id of several closures over the same edges in one pass: each run has its seeds (context, id), and which edges it follows."""
    out = [_decoded(found, some) if some else found for found, some in _closed(runs, edges, local_edges)]
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return cut(rows)


def memberships(runs: dict[str, tuple[DataFrame, Column | None]], edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """The same closures as one row a node: id, for each run whether the node is in it, and ``<run>_in``, the contexts that are not null, in order."""
    out = []
    for found, some in _closed(runs, edges, local_edges):
        if some:
            of = lambda run: [(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, c) for k, (r, c) in enumerate(some) if r == run]  # noqa: B023, E731
            any_ = lambda run: F.col("mask").bitwiseAND(F.lit(sum(1 << k for k, (r, _) in enumerate(some) if r == run)).cast("bigint")) != 0  # noqa: B023, E731
            sets = [F.array_compact(F.array(*[F.when(bit, F.lit(c)) for bit, c in of(run)])).cast("array<string>").alias(f"{run}_in") for run in runs]
            out.append(found.select(F.col("key").alias("id"), *[any_(run).alias(run) for run in runs], *sets))
        else:
            held = [F.bool_or(F.col("run") == run).alias(run) for run in runs] + [F.collect_set(F.when(F.col("run") == run, F.col("context"))).alias(f"{run}_in") for run in runs]
            out.append(found.groupBy("id").agg(*held))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    if len(out) > 1:
        rows = rows.groupBy("id").agg(*[F.bool_or(run).alias(run) for run in runs], *[F.array_distinct(F.flatten(F.collect_list(f"{run}_in"))).alias(f"{run}_in") for run in runs])
    return cut(rows.select("id", *runs, *[F.sort_array(f"{run}_in").alias(f"{run}_in") for run in runs]))


def _closed(runs: dict[str, tuple[DataFrame, Column | None]], edges: DataFrame, local_edges: int) -> list[tuple[DataFrame, list]]:
    """The closures in parts: key and mask with the (run, context) of each bit, or run, context, id as they are."""
    flags = {f"_follows{k}": F.coalesce(follows, F.lit(False)) for k, (_, follows) in enumerate(runs.values()) if follows is not None}
    edges = edges.where("src is not null and dst is not null").select("src", "dst", *[c.alias(name) for name, c in flags.items()])
    held = None
    for run, (seeds, _) in runs.items():
        rows = seeds.where("id is not null").select(F.lit(run).alias("run"), "context", "id")
        held = rows if held is None else held.unionByName(rows)
    held = cut(held.distinct())
    names = [tuple(r) for r in held.select("run", "context").distinct().orderBy("run", "context").collect()]  # a row per context
    if len(names) > WORD:
        edges = cut(edges)
    out, few = [], held.count() <= local_edges
    for start in range(0, max(1, len(names)), WORD):
        some = names[start : start + WORD]
        of = F.coalesce(*[F.when((F.col("run") == r) & F.col("context").eqNullSafe(F.lit(c)), F.lit(1 << k)) for k, (r, c) in enumerate(some)]) if some else F.lit(None)
        mask, along = F.lit(0).cast("bigint"), {}
        for k, run in enumerate(runs):
            along[run] = sum(1 << j for j, (r, _) in enumerate(some) if r == run)
            bits = F.lit(along[run]).cast("bigint")
            mask = mask.bitwiseOR(F.when(F.col(f"_follows{k}"), bits).otherwise(F.lit(0).cast("bigint")) if f"_follows{k}" in flags else bits)
        ways = cut(_live(edges.select(F.col("src").alias("key"), "dst", mask.alias("mask")).where("mask <> 0"), held.select(F.col("id").alias("key"))))
        first = held.select("run", "context", "id", of.cast("bigint").alias("mask")).where("mask is not null")
        if few and ways.count() <= local_edges:
            for run in {r: None for r, _ in some}:
                own = ways.where(F.col("mask").bitwiseAND(F.lit(along[run]).cast("bigint")) != 0).select(F.col("key").alias("src"), "dst")
                out.append((_walked(first.where(F.col("run") == run).select("context", "id"), own, False).select(F.lit(run).alias("run"), "context", "id"), []))
        else:
            out.append((_spread(first.select(F.col("id").alias("key"), "mask").groupBy("key").agg(F.bit_or("mask").alias("mask")), ways), some))
    return out or [(held, [])]


def _live(ways: DataFrame, seeds: DataFrame) -> DataFrame:
    """The ways whose beginning is a seed or the end of a way: nothing reaches the others, so they are neither kept nor read again."""
    ends = ways.select(F.col("dst").alias("key")).unionByName(seeds.select("key")).distinct()
    # The ends of a partition are held, its ways pass by: they need not be sorted.
    return ways.join(ends.hint("shuffle_hash"), "key", "left_semi")


def _decoded(found: DataFrame, names: list[tuple[str, str | None]]) -> DataFrame:
    """run, context, id of keys and masks."""
    if not names:
        return found.select(F.lit("").alias("run"), F.lit(None).cast("string").alias("context"), F.col("key").alias("id")).limit(0)
    each = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.struct(F.lit(r).alias("run"), F.lit(c).cast("string").alias("context"))) for k, (r, c) in enumerate(names)])
    return found.select(F.col("key").alias("id"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.run", "x.context", "id")


def _walked(seeds: DataFrame, edges: DataFrame, per_context: bool) -> DataFrame:
    """The closure by breadth-first search over arrays, context by context."""
    none = F.lit(None).cast("string")
    facts = seeds.select("context", F.col("id").alias("src"), none.alias("dst"))
    facts = facts.unionByName(edges.select(F.col("context") if per_context else none.alias("context"), "src", "dst"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        names = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks]).combine_chunks().dictionary_encode()
        codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        src, dst = codes[: table.num_rows], codes[table.num_rows :]
        spaces = table["context"].combine_chunks().dictionary_encode()
        space = spaces.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        # A null context is one like others; edges without contexts hold in all.
        space = np.where(space < 0, len(spaces.dictionary), space)
        is_edge, n = dst >= 0, len(names.dictionary)
        if per_context:
            # A node of a context is a node of its own: one walk for all of them.
            pair, code = np.unique(np.concatenate([space * n + src, (space * n + dst)[is_edge]]), return_inverse=True)
            walks = [(None, _reached(len(pair), code[: len(src)][is_edge], code[len(src) :], code[: len(src)][~is_edge]))]
        else:
            graph = _rows(n, src[is_edge], dst[is_edge])
            walks = ((c, _reached(n, None, None, src[~is_edge & (space == c)], graph)) for c in np.unique(space[~is_edge]))
        labels = pa.concat_arrays([spaces.dictionary.cast(pa.string()), pa.array([None], pa.string())])
        for c, seen in walks:
            of, found = (pair[seen] // n, pair[seen] % n) if c is None else (np.full(len(seen), c), seen)
            yield pa.RecordBatch.from_arrays([pc.take(labels, pa.array(of)), pc.take(names.dictionary, pa.array(found)).cast(pa.string())], names=["context", "id"])

    return facts.repartition(1).mapInArrow(run, "context string, id string")


def _rows(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's targets begin, and the targets."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def _reached(n: int, src, dst, seeds: np.ndarray, graph=None) -> np.ndarray:
    first, to = graph or _rows(n, src, dst)
    seen, front = np.zeros(n, dtype=bool), np.unique(seeds)
    while len(front):
        seen[front] = True
        size = first[front + 1] - first[front]
        front = np.unique(to[np.repeat(first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        front = front[~seen[front]]
    return np.flatnonzero(seen)


class _Kept:
    """Tables that are dealt out and sorted by key once and kept while a loop runs, so that a step's join only reads them; lost parts come again from their checkpoints."""

    def __init__(self, parts: int):
        self.parts, self.held = parts, []

    def __call__(self, df: DataFrame) -> DataFrame:
        df = df.repartition(self.parts, "key").sortWithinPartitions("key").persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(df)
        return df

    def free(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held = []


def _spread(seeds: DataFrame, ways: DataFrame) -> DataFrame:
    """key, mask reached from the seeds (key, mask) along ways (key, dst, mask), which were cut: a mask passes as far as its bits are in the way's."""
    kept = _Kept(int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = cut(seeds)
    after, n = _stepper(ways, kept), base.count()
    front, recent, steps, inner, hops = base, [], 0, None, HOPS if ways.count() <= LONG_READ else 1
    near, near_n, recent_n = kept(base), n, 0
    # A small frontier meets only what lies between its least and its largest key: the kept tables are sorted, so the rest is not read.
    between = lambda df, ends: df if ends is None else df.where(F.col("key").between(*map(F.lit, ends)))
    ranged, ends = dict(ways.dtypes)["key"] == "string", None
    while n:
        if steps >= PATIENCE and inner is None:
            inner, shorter = _contracted(ways, base, recent)
            if shorter is not None:
                after = _stepper(shorter, kept)
        small = n <= SMALL_FRONT
        single, span = small and hops == 1 and ranged, None
        reached = front = after(F.broadcast(front) if small and hops == 1 else front, ends if single else None)
        if single:
            reached = cut(reached)
            span = _ends(reached)[1]
        if small and hops > 1:
            for _ in range(hops - 1):
                front = after(front, None)
                reached = reached.unionByName(front)
            reached = reached.groupBy("key").agg(F.bit_or("mask").alias("mask"))
        for seen in [near, *recent]:
            old = between(seen, span).select("key", F.col("mask").alias("old"))
            reached = reached.join(old, "key", "left").select("key", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("bigint")))).alias("mask")).where("mask <> 0")
        front = cut(reached)
        (n, ends), steps = _ends(front), steps + (hops if small else 1)
        recent.append(front)
        recent_n += n
        # What was reached lately joins the rest when there are many pieces or it has grown as large: each row moves a few times in all.
        if n and (len(recent) > PIECES or recent_n > near_n):
            base, near_n, recent_n = cut(_joined(base, recent)), near_n + recent_n, 0
            near, recent = kept(base), []
    out = _joined(base, recent)
    if inner is not None:
        out = cut(out)
        far = inner.join(out.select(F.col("key").alias("start"), F.col("mask").alias("come")), "start").select("key", F.col("mask").bitwiseAND(F.col("come")).alias("mask"))
        out = out.unionByName(far.where("mask <> 0"))
    out = cut(out)
    kept.free()
    return out


def _ends(rows: DataFrame) -> tuple[int, tuple | None]:
    """How many rows there are, and their least and largest key."""
    n, least, most = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    return n, (least, most) if n else None


def _joined(base: DataFrame, recent: list[DataFrame]) -> DataFrame:
    for piece in recent:
        base = base.unionByName(piece)
    return base.groupBy("key").agg(F.bit_or("mask").alias("mask"))


def _stepper(ways: DataFrame, kept: _Kept):
    """What a frontier reaches in a step; hubs are broadcast to their ways, not met by key."""
    step = ways.withColumnRenamed("mask", "along")
    hubs = cut(step.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("key"))
    many, wide = bounded(hubs), None
    if not hubs.isEmpty():
        wide, step = cut(step.join(many, "key", "left_semi")), cut(step.join(many, "key", "left_anti"))
    narrow = F.broadcast(step) if step.count() <= BROADCAST_EDGES else kept(step)

    def after(front, ends):
        mine = narrow if ends is None else narrow.where(F.col("key").between(*map(F.lit, ends)))
        go = lambda met: met.select(F.col("dst").alias("key"), F.col("mask").bitwiseAND(F.col("along")).alias("mask")).where("mask <> 0")
        out = go(front.join(mine, "key"))
        if wide is not None:
            out = out.unionByName(go(wide.join(bounded(front.join(many, "key", "left_semi")), "key")))
        return out.groupBy("key").agg(F.bit_or("mask").alias("mask"))

    return after


def _contracted(ways: DataFrame, base: DataFrame, recent: list[DataFrame]) -> tuple[DataFrame | None, DataFrame | None]:
    """Inner nodes of chains that nothing has reached, with the start of their chain and what passes from there (key, start, mask); and ways without them."""
    ways = cut(ways.groupBy("key", "dst").agg(F.bit_or("mask").alias("mask")))
    into = ways.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n"), F.first("key").alias("start"), F.first("mask").alias("mask")).where("n = 1").drop("n")
    once = ways.groupBy("key").agg(F.count("*").alias("n")).where("n = 1").select("key")
    inner = into.join(once, "key", "left_semi")
    for seen in [base, *recent]:
        inner = inner.join(seen.select("key"), "key", "left_anti")
    inner = cut(inner)
    n = inner.count()
    if not n:
        return None, None
    back = inner
    # A ring of inner nodes has no start, so its nodes would move for ever; nothing reaches it.
    for _ in range(n.bit_length() + 1):
        far = back.select(F.col("key").alias("start"), F.col("start").alias("further"), F.col("mask").alias("more"))
        met = back.join(far, "start", "left")
        now = cut(met.select("key", F.coalesce("further", "start").alias("start"), F.when(F.col("further").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseAND(F.col("more"))).alias("mask"), F.col("further").isNotNull().alias("moved")))
        back = now.drop("moved")
        if now.where("moved").isEmpty():
            break
    start = back.select("key", "start", F.col("mask").alias("so_far"))
    out = ways.join(back.select(F.col("key").alias("dst")), "dst", "left_anti").join(start, "key", "left")
    out = out.select(F.coalesce("start", "key").alias("key"), "dst", F.when(F.col("start").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseAND(F.col("so_far"))).alias("mask")).where("mask <> 0")
    return back, cut(out.groupBy("key", "dst").agg(F.bit_or("mask").alias("mask")))


def proven(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """What the roots reach over exact edges."""
    return closure(roots, edges.where("exact"))


def addressed(namespaces: DataFrame, nodes: DataFrame) -> DataFrame:
    """affected_namespace, id: the nodes that each namespace covers, as an equi-join.

    An id offers its beginnings of every length that a namespace has, and, for
    namespaces without a colon, the stretches of those lengths after each slash.
    """
    spaces = bounded(namespaces.where(F.col("affected_namespace").isNotNull()).select("affected_namespace").distinct())
    few = [r[0] for r in spaces.limit(FEW_SPACES + 1).collect()]
    if 0 < len(few) <= FEW_SPACES:
        id_ = F.col("id")
        covers = [id_.startswith(s) if ":" in s else id_.startswith(s) | id_.contains("/" + s) for s in few]
        held = F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in zip(covers, few)]))
        return nodes.select("id").where(id_ != "").select(F.explode(held).alias("affected_namespace"), "id")
    # As many lengths as the longest namespace has characters, at most.
    seen = spaces.groupBy(F.length("affected_namespace").alias("n")).agg(F.bool_or(~F.contains("affected_namespace", F.lit(":"))).alias("inner")).collect()
    if not seen:
        return nodes.limit(0).select(F.col("id").alias("affected_namespace"), "id")
    id_ = F.col("id")

    def stretches(start, sizes):
        return F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length(id_) - start + 1), lambda n: F.substring(id_, start, n))

    keys = stretches(F.lit(1), [r.n for r in seen])
    if any(r.inner for r in seen):
        slashes = F.filter(F.sequence(F.lit(1), F.length(id_)), lambda i: F.substring(id_, i, F.lit(1)) == "/")
        inner = F.flatten(F.transform(slashes, lambda i: stretches(i + 1, [r.n for r in seen if r.inner])))
        keys = F.concat(keys, F.filter(inner, lambda x: ~x.contains(":")))
    offered = nodes.select("id").where(id_ != "").select("id", F.explode(F.array_distinct(keys)).alias("affected_namespace"))
    return offered.join(spaces, "affected_namespace").select("affected_namespace", "id")


#: The scope of blockers that name neither a namespace nor ids: it covers every node.
EVERYTHING = "scope*"


def _scope(blockers: DataFrame) -> DataFrame:
    """Blockers with ``hub``: the node of their namespace, or the scope of everything; null if they only list ids."""
    ids = F.coalesce(F.size("affected_node_ids"), F.lit(0)) > 0
    hub = F.when(F.col("affected_namespace").isNotNull(), F.concat(F.lit("scope:"), "affected_namespace")).when(~ids, F.lit(EVERYTHING))
    return blockers.withColumn("hub", hub)


def address_edges(blockers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blockers as edges: source -> scope -> addressed nodes. A scope is a node of its own, so nothing is multiplied out."""
    scoped = _scope(blockers)
    into = scoped.where("source_node_id is not null and hub is not null").select(F.col("source_node_id").alias("src"), F.col("hub").alias("dst"))
    out = addressed(blockers, nodes).select(F.concat(F.lit("scope:"), "affected_namespace").alias("src"), F.col("id").alias("dst"))
    listed = blockers.where(F.col("source_node_id").isNotNull()).select(F.col("source_node_id").alias("src"), F.explode("affected_node_ids").alias("dst"))
    # Ids that are listed but are no nodes are addressed by nothing.
    listed = listed.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    everything = nodes.select(F.lit(EVERYTHING).alias("src"), F.col("id").alias("dst"))
    if scoped.where(F.col("hub") == EVERYTHING).isEmpty():
        return into.unionByName(out).unionByName(listed)
    return into.unionByName(out).unionByName(listed).unionByName(everything)


def sourceless(blockers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blockers that are active everywhere: without a source, or with one that is no node."""
    known = nodes.select(F.col("id").alias("source_node_id"))
    unknown = blockers.where(F.col("source_node_id").isNotNull()).join(known, "source_node_id", "left_anti").select(*blockers.columns)
    return blockers.where(F.col("source_node_id").isNull()).unionByName(unknown)


def _retaining(roots: DataFrame, protected: DataFrame, blockers: DataFrame, nodes: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds of the fail-closed closure, the edges that blockers add, and all contexts."""
    blockers = cut(blockers)
    free = sourceless(blockers, nodes)
    listed = free.select(F.explode("affected_node_ids").alias("id")).join(nodes.select("id"), "id", "left_semi")
    everywhere = protected.select("id").unionByName(_scope(free).where("hub is not null").select(F.col("hub").alias("id"))).unionByName(listed).distinct()
    every = bounded(contexts.select("context").distinct())  # tens of contexts
    seeds = roots.select("context", "id").unionByName(everywhere.join(every).select("context", "id"))
    return seeds, address_edges(blockers, nodes), every


def _real(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("id").startswith("scope:") & (F.col("id") != EVERYTHING))


def retained(roots: DataFrame, edges: DataFrame, protected: DataFrame, blockers: DataFrame, nodes: DataFrame, contexts: DataFrame, per_context: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """The fail-closed closure: every edge, protected nodes, and what active blockers address.

    With ``per_context`` the edges carry the context in which they apply.
    """
    seeds, pseudo, every = _retaining(roots, protected, blockers, nodes, contexts)
    if per_context:
        all_edges = edges.select("context", "src", "dst").unionByName(pseudo.join(every).select("context", "src", "dst"))
    else:
        all_edges = edges.select("src", "dst").unionByName(pseudo)
    return _real(closure(seeds, all_edges, per_context, local_edges))


def proven_and_retained(roots: DataFrame, edges: DataFrame, protected: DataFrame, blockers: DataFrame, nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Both closures over edges(src, dst, exact) in one pass: a row a node with proven, retained, proven_in and retained_in."""
    seeds, pseudo, _ = _retaining(roots, protected, blockers, nodes, contexts)
    all_edges = edges.select("src", "dst", "exact").unionByName(pseudo.withColumn("exact", F.lit(False)))
    return _real(memberships({"proven": (roots, F.col("exact")), "retained": (seeds, None)}, all_edges))


def without(kept: DataFrame, seeds: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """context, id of the closure after the nodes ``gone`` (id) and their edges went, from the closure before.

    What they led to is taken out, and what a seed or a node that stays still leads to is put back: the work goes by what
    was lost, not by the graph.
    """
    gone = cut(gone.select("id").distinct())
    ends = [bounded(gone).withColumnRenamed("id", c) for c in ("src", "dst")]
    lost = closure(kept.join(bounded(gone), "id", "left_semi").select("context", "id"), edges)
    open_ = cut(lost.join(ends[0].withColumnRenamed("src", "id"), "id", "left_anti"))
    sure = cut(kept.join(lost, ["context", "id"], "left_anti").select("context", "id"))
    live = edges.join(open_.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").join(ends[0], "src", "left_anti").select("src", "dst")
    live = cut(live)
    into = sure.withColumnRenamed("id", "src").join(live, "src").select("context", F.col("dst").alias("id"))
    back = seeds.select("context", "id").unionByName(into).join(open_, ["context", "id"], "left_semi")
    again = closure(back, live).join(open_, ["context", "id"], "left_semi").select("context", "id")
    return cut(sure.unionByName(again))


def unreachable(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    return nodes.join(reached.select("id").distinct(), "id", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select("id")
    ends = [edges.join(known.withColumnRenamed("id", end), end, "left_anti").select("src", "dst") for end in ("src", "dst")]
    return ends[0].unionByName(ends[1]).distinct()
