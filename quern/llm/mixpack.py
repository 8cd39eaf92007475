"""Mixture-controlled packing: deficit round-robin over source queues.

Every document is tokenised once and joins the queue of its source. A window is a
sequence of ``capacity`` tokens. In each window every queue earns its share of the
window, sends what it is owed in whole units of ``unit`` tokens, and carries the rest,
its deficit, to the next window, whichever partition makes that. Queues meet two by
two up a tree: of n units that a pair has sent together, the left one has sent
floor(n * left / both), and the remainder of that division is its deficit. So the
state after any number of windows is known without making the windows before: a
partition begins with the deficits that the one before carries over, and a place in a
queue tells its window.

Without weights the target proportions are the sources' shares of all tokens, and all
queues run dry in the last window. With weights, what remains is shared by weight again
whenever a queue runs dry. What whole windows leave over (less than a window, and less
than a unit a queue) is cut into sequences of powers of two, so nothing is padded.

Documents queue up in the order in which they are stored. Only the table of queues and,
for each block of documents, its place in every queue are shared between tasks.

Defined results: null texts are empty, their tokens are the end id alone; null sources
are one source; null and repeated ids are rows like others; very long texts are cut by
windows as any other; sources beyond the ``queues`` - 1 largest share one queue; sources
without a weight (or of weight 0) come after all others; no rows: no rows; only
doc_id, source and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import cut, stored
from quern.llm.ranks import earlier, small

CAPACITY = 2048
END_ID = 1
#: Tokens that a queue sends at a time.
UNIT = 16
#: Queues at most: the table of queues goes to every task.
QUEUES = 1_024


class Mixture:
    """What each queue has sent after any number of units, and when each of its units goes out."""

    def __init__(self, tokens: list[int], weights: list[int] | None = None, capacity: int = CAPACITY, unit: int = UNIT):
        if capacity % unit:
            raise ValueError("a window holds whole units")
        self.tokens, self.unit, self.capacity = tokens, unit, capacity
        self.units = [t // unit for t in tokens]
        self.leaves = 1 << max(0, len(tokens) - 1).bit_length()
        total = sum(self.units)
        # Products of two counts must fit.
        self.kind = np.int64 if total * total < 1 << 62 else object
        self._phases(weights)
        self.per_window = capacity // unit
        self.windows = total // self.per_window
        whole = [unit * int(self.served(q, np.array([self.windows * self.per_window], self.kind))[0][0]) for q in range(len(tokens))]
        #: Tokens of each queue that whole windows take, and where its rest begins in the rest of all.
        self.whole = whole
        self.rest = np.concatenate([[0], np.cumsum([t - w for t, w in zip(tokens, whole)], dtype=np.int64)])
        left, edges = int(self.rest[-1]), [0]
        while left:
            edges.append(edges[-1] + (capacity if left >= capacity else 1 << (left.bit_length() - 1)))
            left -= edges[-1] - edges[-2]
        self.rest_edges = np.array(edges, dtype=np.int64)

    def _phases(self, weights: list[int] | None) -> None:
        """Stretches in which the same queues send: trees of the units each sends in one, and those sent before it."""
        n, sent = len(self.units), [0] * len(self.units)
        self.first, self.before, self.trees = [], [], []
        ends = []
        if weights is not None:
            # A queue runs dry when the level of units a weight reaches units / weight.
            some = sorted((k for k in range(n) if weights[k] > 0), key=lambda k: (self.units[k] / weights[k], k))
            for d in some:
                ends.append([min(self.units[k], weights[k] * self.units[d] // weights[d]) for k in range(n)])
        ends.append(list(self.units))
        start = 0
        for end in ends:
            amounts = [max(0, e - s) for e, s in zip(end, sent)]
            if not sum(amounts):
                continue
            tree = [0] * self.leaves + amounts + [0] * (self.leaves - n)
            for k in range(self.leaves - 1, 0, -1):
                tree[k] = tree[2 * k] + tree[2 * k + 1]
            self.first.append(start)
            self.before.append(sent)
            self.trees.append(tree)
            start, sent = start + tree[1], [s + a for s, a in zip(sent, amounts)]

    def served(self, q: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of queue q, and of the queues before it, among the first n that went out."""
        own, ahead = np.zeros(len(n), self.kind), np.zeros(len(n), self.kind)
        for first, tree in zip(self.first, self.trees):
            now = np.clip(n - first, 0, tree[1])
            if not now.any():
                break
            node, leaf = 1, q + self.leaves
            while node < self.leaves:
                left = now * tree[2 * node] // tree[node] if tree[node] else now * 0
                node = leaf >> (leaf.bit_length() - node.bit_length() - 1)
                if node & 1:
                    ahead, now = ahead + left, now - left
                else:
                    now = left
            own = own + now
        return own, ahead

    def turn(self, q: int, u: int) -> int:
        """How many units go out before unit u of queue q."""
        k = max(k for k in range(len(self.first)) if self.before[k][q] <= u)
        tree, node, j = self.trees[k], q + self.leaves, u - self.before[k][q]
        while node > 1:
            both, mine = tree[node // 2], tree[node]
            j = j * both // mine if node & 1 else -(-(j + 1) * both // mine) - 1
            node //= 2
        return self.first[k] + j

    def cuts(self, q: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens lo to hi of queue q: where stretches begin, the sequence of each, and its offset there."""
        at, sequence, offset = [], [], []
        main = min(hi, self.whole[q])
        if lo < main:
            w0, w1 = (self.turn(q, x // self.unit) // self.per_window for x in (lo, main - 1))
            w = np.arange(w0, w1 + 2)
            own, ahead = self.served(q, w.astype(self.kind) * self.per_window)
            some = np.diff(own) > 0
            at.append((self.unit * own[:-1][some]).astype(np.int64))
            sequence.append(w[:-1][some])
            offset.append((self.unit * np.diff(ahead)[some]).astype(np.int64))
        if hi > self.whole[q]:
            base, end = self.rest[q], self.rest[q + 1]
            k = np.arange(np.searchsorted(self.rest_edges, base, side="right") - 1, np.searchsorted(self.rest_edges, end, side="left"))
            begin = np.maximum(self.rest_edges[k], base)
            at.append(begin - base + self.whole[q])
            sequence.append(self.windows + k)
            offset.append(begin - self.rest_edges[k])
        return tuple(np.concatenate(x) for x in (at, sequence, offset))


def _blocks(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """Token ids of documents, a bounded lot to a row: part, block, doc_ids, sources, sizes, payload."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from quern.llm._tokens import encoder

        part, block, e = TaskContext.get().partitionId(), 0, encoder(path)
        width = "<u2" if e.plain.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for b in batches:
            for start, flat, counts in e.slabs(b.column(2)):
                sizes = counts + 1
                ends = np.cumsum(sizes) - 1
                ids, own = np.full(int(sizes.sum()), end_id, dtype=width), np.ones(int(sizes.sum()), dtype=bool)
                own[ends] = False
                ids[own] = flat
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), one(b.column(0).slice(start, len(counts))), one(b.column(1).slice(start, len(counts))), one(pa.array(sizes, pa.int64())), pa.array([ids.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_ids", "sources", "sizes", "payload"])
                block += 1

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, f"part int, block int, doc_ids array<{kind}>, sources array<string>, sizes array<bigint>, payload binary")


def pack(docs: DataFrame, path: str, weights: dict[str | None, int] | None = None, capacity: int = CAPACITY, end_id: int = END_ID, unit: int = UNIT, queues: int = QUEUES, digest: bool = False) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32 bits; with ``digest`` ids_crc32 instead), doc_tokens, sequence_id and offset of every piece.

    ``weights`` are whole numbers by source.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    blocks = stored(_blocks(docs, path, end_id, kind), "mixture-ids")
    each = blocks.select("part", "block", F.explode(F.arrays_zip("sources", "sizes")).alias("x"))
    held = cut(each.groupBy("part", "block", F.col("x.sources").alias("source")).agg(F.sum("x.sizes").alias("n")))
    top = held.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("source"))
    named = [r.source for r in top.limit(queues - 1).collect()]  # a row per queue
    named = sorted(named, key=lambda s: (s is None, s or ""))
    table = spark.createDataFrame([(s, k) for k, s in enumerate(named)], "of_source string, q int")
    held = held.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("of_source")), "left").withColumn("q", F.coalesce("q", F.lit(len(named))))
    held = cut(held.groupBy("part", "block", "q").agg(F.sum("n").alias("n")))
    tokens = [0] * (len(named) + 1)
    for r in held.groupBy("q").agg(F.sum("n").alias("n")).collect():
        tokens[r.q] = int(r.n)
    share = None if weights is None else [int(weights.get(s, 0)) for s in named] + [0]
    sent = spark.sparkContext.broadcast((Mixture(tokens, share, capacity, unit), {s: k for k, s in enumerate(named)}))
    # Where each block's tokens stand in each queue: after the parts before, and after the part's blocks before.
    within = Window.partitionBy("part", "q").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = earlier(cut(held.groupBy("q", "part").agg(F.sum("n").alias("n"))), ["q"], ["n"]).withColumnRenamed("n", "base")
    bases = held.select("part", "block", "q", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("here")).join(before, ["part", "q"])
    bases = cut(bases.groupBy("part", "block").agg(F.map_from_entries(F.collect_list(F.struct("q", (F.col("base") + F.col("here")).alias("base")))).alias("bases")))
    name, type_ = ("ids_crc32", "bigint") if digest else ("ids", "binary")
    names = ["doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        import pyarrow as pa

        mixture, queue_of = sent.value
        last = len(queue_of)
        for b in batches:
            for k in range(b.num_rows):
                ids = b.column(0)[k].values
                sizes = b.column(2)[k].values.to_numpy()
                first = np.cumsum(sizes) - sizes
                payload = b.column(3)[k].as_py()
                flat = np.frombuffer(payload, "<u2" if len(payload) == 2 * sizes.sum() else "<u4").astype("<u4")
                raw = memoryview(flat).cast("B")
                coded = b.column(1)[k].values.dictionary_encode()
                of = np.array([*(queue_of.get(s, last) for s in coded.dictionary.to_pylist()), queue_of.get(None, last)])
                queue = of[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]
                for q, base in b.column(4)[k].as_py():
                    docs_here = np.flatnonzero(queue == q)
                    n = sizes[docs_here]
                    starts = base + np.cumsum(n) - n
                    end = int(starts[-1] + n[-1])
                    at, sequence, offset = mixture.cuts(q, int(base), end)
                    x = np.unique(np.concatenate([starts, at[(at > base) & (at < end)]]))
                    length = np.diff(np.append(x, end))
                    doc = np.searchsorted(starts, x, side="right") - 1
                    cut_ = np.searchsorted(at, x, side="right") - 1
                    inside = x - starts[doc]
                    lo = 4 * (first[docs_here][doc] + inside)
                    parts = [raw[i:j] for i, j in zip(lo.tolist(), (lo + 4 * length).tolist())]
                    found = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array([bytes(p) for p in parts], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs_here[doc])), pa.array(inside), pa.array(length), found, pa.array(n[doc]), pa.array(sequence[cut_].astype(np.int64)), pa.array(offset[cut_] + x - at[cut_])], names=names)

    met = blocks.join(small(bases), ["part", "block"]).select("doc_ids", "sources", "sizes", "payload", "bases")
    return met.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, {name} {type_}, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and length of every sequence of pieces with ids; a sequence has ``capacity`` tokens at most."""
    by = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    ids = F.aggregate("x", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return by.select("sequence_id", ids.alias("ids")).withColumn("length", (F.length("ids") / 4).cast("int"))
