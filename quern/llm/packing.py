"""Best-fit-decreasing packing of tokenised documents into sequences.

Documents become pieces of at most ``capacity`` tokens. Pieces of one length are
alike, so the packing is made on the table of lengths: from the longest length down,
a segment tree over remaining capacities finds the tightest open sequences, and a run
of pieces goes into a run of them at once. That is best-fit decreasing, piece by
piece, but its cost depends on ``capacity`` only. Its runs (length, ranks, sequences,
offset) are then looked up by length and rank.

Defined results: a null text is empty, its one piece is the end id; very long texts
are cut into pieces as any other; null and repeated ids are rows like others; equal
lengths are ranked by a hash of id, piece and ids, then by these; no rows: no rows;
only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import cut, stored

CAPACITY = 2048
END_ID = 0
#: Chunks that a worker remembers and bytes that it encodes at a time: less than elsewhere, as in the pipeline its executor's heap is full by then.
MEMO_CHUNKS, SLAB_BYTES = 150_000, 2_000_000
#: Bits of a rank within its length.
RANK_BITS = 48


class CapacityTree:
    """Counts by remaining capacity; ``tightest`` finds the least one at or above a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.leaves
        while k:
            self.some[k] += n
            k >>= 1

    def tightest(self, length: int) -> int | None:
        k = length + self.leaves
        if self.some[k]:
            return length
        while k > 1:
            if not k & 1 and self.some[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.some[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) of best-fit decreasing on counts by length."""
    tree, open_, runs, fresh = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                n = max(1, left // each)
                room, first, fresh = capacity, fresh, fresh + n
            else:
                each = room // length
                first, have = open_[room].pop()
                tree.add(room, -have)
                n = min(have, max(1, left // each))
                put(room, first + n, have - n)
            # Each of n sequences takes as many as it holds; a last one may take fewer.
            each = min(each, left) if n == 1 else each
            for k in range(each):
                runs.append((length, rank, n, first, capacity - room + k * length))
                rank += n
            left -= n * each
            put(room - each * length, first, n)
    return runs


class Places:
    """Runs in the order of length and rank, found by binary search: one run a piece."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]):
        r = np.array(sorted(runs) or [(0, 0, 0, 0, 0)], dtype=np.int64)
        self.key, self.rank, self.sequence, self.at = (r[:, 0] << RANK_BITS) + r[:, 1], r[:, 1], r[:, 3], r[:, 4]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        k = np.searchsorted(self.key, (length << RANK_BITS) + rank, side="right") - 1
        return self.sequence[k] + rank - self.rank[k], self.at[k]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every document."""

    def run(batches):
        import pyarrow as pa

        from quern.llm._tokens import encoder

        tail, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for b in batches:
            for start, flat, counts in encoder(path, MEMO_CHUNKS, SLAB_BYTES).slabs(b.column(1)):
                rows = [], [], [], []
                of, at = [], 0
                raw = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
                for k, n in enumerate(counts.tolist()):
                    last = 4 * n
                    for j, first in enumerate(range(0, last + 4, step)):
                        # The end id follows the text's ids, in a piece of its own if they fill theirs.
                        crc = zlib.crc32(raw[at + first : at + min(first + step, last)])
                        ended = first + step > last
                        of.append(start + k)
                        for c, x in zip(rows, (j, first // 4, (min(first + step, last + 4) - first) // 4, zlib.crc32(tail, crc) if ended else crc)):
                            c.append(x)
                    at += last
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(rows[0], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    rows = stored(pieces(docs, path, capacity, end_id), "pieces")
    # Ranks within a length: within one of many buckets, after the buckets before it.
    buckets = F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets).cast("int"))
    counts = cut(rows.groupBy("length", "bucket").count())
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), "count")
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most ``capacity`` rows
    runs = best_fit_decreasing(lengths, capacity)
    sent = spark.sparkContext.broadcast(Places(runs))  # as many runs as ``capacity`` allows, however many pieces there are
    here = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(here) - 1).join(counts.drop("count"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    def put(batches):
        import pyarrow as pa

        for b in batches:
            sequence, at = sent.value.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(at)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = dict(rows.dtypes)["doc_id"]
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(put, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
