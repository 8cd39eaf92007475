"""Token ids in binary files: interleaved range asymmetric numeral systems with shared static tables.

A file set is a folder with ``table`` (one row: the frequencies, which all blocks
share) and ``blocks`` (rows of part, block, n_tokens, doc_ids, doc_tokens, payload) in
ascending order of document. A block holds whole documents. Its ids are dealt over
lanes, coded in segments of steps, each lane a rANS state of 64 bits that emits words of
32; the states at each segment's start are checkpoints, from which segments decode
independently. The payload is

    magic, ids' width, ids, lanes, steps, segments, crc32 of the table, crc32 of the ids
    words of each segment | states of each segment and lane | words

Reading checks both checksums. Frequencies come from all ids of the corpus.

Defined results: null texts are empty, so they hold the end id only; null ids come
first; rows of equal id follow each other in the order of their texts; an empty table
gives an empty file set and no rows; only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._common import cut, scratch, stored

END_ID = 1
#: Tokens after which a block ends with the document it is in.
BLOCK = 1 << 20
SCALE = 20
LANES, STEPS = 512, 512
#: Ranges whose limits are compared one by one, at most.
RANGES = 1_000
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sBIHIIII")
_MAGIC = b"QANS"
BLOCKS = "part int, block int, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, payload binary"


def normalised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^scale, at least 1 for each id that occurs."""
    total, size = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    if (counts > 0).sum() > size:
        raise ValueError("more ids occur than the scale has slots")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(object) * size // total), 0).astype(np.int64)
    excess = int(freq.sum()) - size
    for k in np.argsort(-freq, kind="stable"):
        if excess == 0:
            break
        step = min(excess, int(freq[k]) - 1) if excess > 0 else excess
        freq[k] -= step
        excess -= step
    return freq


class Tables:
    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.freq = scale, freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def encode(ids: np.ndarray, tables: Tables, lanes: int = LANES, steps: int = STEPS) -> bytes:
    """The payload of a block."""
    n = len(ids)
    while lanes > 1 and n < 64 * lanes:
        lanes //= 2
    segments = max(1, -(-n // (lanes * steps)))
    full = np.zeros(segments * lanes * steps, dtype=np.int64)
    full[:n] = ids
    full = full.reshape(segments, steps, lanes)
    there = np.arange(full.size).reshape(full.shape) < n
    state = np.full((segments, lanes), _LOW)
    shift, scale = np.uint64(63 - tables.scale), np.uint64(tables.scale)
    words, whose = [], []
    for k in range(steps - 1, -1, -1):
        on = there[:, k]
        if not on.any():
            continue
        f, all_on = tables.freq[full[:, k]], on.all()
        f = f if all_on else np.where(on, f, np.uint64(1))
        out = state >= (f << shift)
        out = out if all_on else out & on
        s = np.nonzero(out)[0]
        words.append((state[out] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        whose.append(s)
        state = np.where(out, state >> np.uint64(32), state)
        q = state // f
        new = (q << scale) + (state - q * f) + tables.start[full[:, k]]
        state = new if all_on else np.where(on, new, state)
    flat = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    seg = np.concatenate(whose[::-1]) if whose else np.zeros(0, np.int64)
    order = np.argsort(seg, kind="stable")
    head = _HEAD.pack(_MAGIC, 4, n, lanes, steps, segments, tables.crc, zlib.crc32(ids.astype("<u4").tobytes()))
    return b"".join([head, np.bincount(seg, minlength=segments).astype("<u4").tobytes(), state.astype("<u8").tobytes(), flat[order].tobytes()])


def decode(payload: bytes, tables: Tables) -> np.ndarray:
    """The ids of a block (unsigned 32 bits); all segments at once."""
    magic, _, n, lanes, steps, segments, table_crc, ids_crc = _HEAD.unpack_from(payload)
    if magic != _MAGIC or table_crc != tables.crc:
        raise ValueError("not a block of this table")
    at = _HEAD.size
    sizes = np.frombuffer(payload, "<u4", segments, at).astype(np.int64)
    state = np.frombuffer(payload, "<u8", segments * lanes, at + 4 * segments).reshape(segments, lanes).copy()
    words = np.frombuffer(payload, "<u4", offset=at + 4 * segments + 8 * segments * lanes).astype(np.uint64)
    words = np.concatenate([words, np.zeros(lanes + 1, np.uint64)])
    next_ = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros((segments, steps, lanes), dtype="<u4")
    scale, mask = np.uint64(tables.scale), np.uint64((1 << tables.scale) - 1)
    left = n - np.arange(segments)[:, None] * steps * lanes - np.arange(lanes)[None, :]
    for k in range(steps):
        on = left > k * lanes
        if not on.any():
            break
        slot = state & mask
        ids = tables.of_slot[slot]
        out[:, k] = ids
        new = tables.freq[ids] * (state >> scale) + slot - tables.start[ids]
        state = new if on.all() else np.where(on, new, state)
        need = on & (state < _LOW)
        place = np.cumsum(need, axis=1)
        got = words[np.minimum(next_[:, None] + place - 1, len(words) - 1)]
        state = np.where(need, (state << np.uint64(32)) | got, state)
        next_ = next_ + place[:, -1]
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("a block's ids fail their checksum")
    return ids


def _raw_blocks(docs: DataFrame, path: str, end_id: int, block: int) -> DataFrame:
    """Blocks of ids as they are, in the order of documents."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from quern.llm._tokens import encoder

        part, at = TaskContext.get().partitionId(), 0
        tail = np.array([end_id], dtype="<u4")
        doc_ids, sizes, held, n = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([np.concatenate(held).astype("<u2" if narrow else "<u4").tobytes()], pa.binary())],
                names=["part", "block", "n_tokens", "doc_ids", "doc_tokens", "payload"],
            )

        e = encoder(path)
        narrow = e.plain.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        for b in batches:
            ids = b.column(0).to_pylist()
            for start, flat, counts in e.slabs(b.column(1)):
                at_id = 0
                for doc, size in zip(ids[start : start + len(counts)], counts.tolist()):
                    held += [flat[at_id : at_id + size], tail]
                    at_id += size
                    doc_ids.append(doc)
                    sizes.append(size + 1)
                    n += size + 1
                    if n >= block:
                        yield row()
                        at, n, doc_ids, sizes, held = at + 1, 0, [], [], []
        if n:
            yield row()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if parts <= RANGES:
        # Range limits from the ids alone; sampling the rows themselves would read all texts once more.
        limits = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
        limits = F.array(*[F.lit(x) for x in sorted(set(limits))]).cast("array<bigint>")
        part = F.size(F.filter(limits, lambda x: x < F.col("doc_id")))
        dealt = rows.repartitionById(parts, F.coalesce(part, F.lit(0)).cast("int"))
    else:
        dealt = rows.repartitionByRange(parts, "doc_id")
    return dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCKS)


def write(docs: DataFrame, out: str, path: str, end_id: int = END_ID, block: int = BLOCK) -> None:
    """Encodes the documents' ids into a file set."""
    spark = docs.sparkSession
    raw = stored(_raw_blocks(docs, path, end_id, block), "raw-ids")
    # The shuffled texts are no longer needed: let Spark remove them before more is written.
    spark.sparkContext._jvm.System.gc()

    def width(row_n, payload):
        return np.frombuffer(payload, "<u2" if len(payload) == 2 * row_n else "<u4")

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.bincount(width(n, p), minlength=len(total))
                c[: len(total)] += total
                total = c
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    counted = raw.select("n_tokens", "payload").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row per id of the vocabulary
    ids, n = counted["id"].to_numpy(), counted["n"].to_numpy()
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.int64)
    counts[ids] = n
    freq = normalised(counts)
    tables = Tables(freq)

    def code(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                payload = encode(width(one.column(2)[0].as_py(), one.column(5)[0].as_py()).astype(np.int64), tables)
                yield pa.RecordBatch.from_arrays([*one.columns[:5], pa.array([payload], pa.binary())], names=b.schema.names)

    spark.createDataFrame([(SCALE, tables.crc, freq.tolist())], "scale int, crc bigint, freq array<bigint>").coalesce(1).write.parquet(f"{out}/table")
    raw.mapInArrow(code, BLOCKS).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    _remove(spark, raw.inputFiles()[0].rsplit("/", 1)[0] if raw.inputFiles() else None)


def _remove(spark: SparkSession, path: str | None) -> None:
    """Removes a folder of ours in the shared one."""
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32 bits) of every document of a file set, decoded; with ``digest`` ids_crc32 instead of ids."""
    table = spark.read.parquet(f"{out}/table").first()
    tables = Tables(np.array(table["freq"], dtype=np.int64), table["scale"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    name, kind = ("ids_crc32", "bigint") if digest else ("ids", "binary")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part, block, docs, sizes, payload in zip(*(b.column(k).to_pylist() for k in range(5))):
                raw = memoryview(decode(payload, tables).tobytes())
                ends = np.cumsum(sizes)
                first = ends - sizes
                cuts = [raw[4 * x : 4 * y] for x, y in zip(first.tolist(), ends.tolist())]
                last = pa.array([zlib.crc32(c) for c in cuts], pa.int64()) if digest else pa.array([bytes(c) for c in cuts], pa.binary())
                m = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([block] * m, pa.int32()), pa.array(docs, pa.int64()), pa.array(first, pa.int64()), pa.array(sizes, pa.int64()), last], names=["part", "block", "doc_id", "at", "n_tokens", name])

    found = blocks.select("part", "block", "doc_ids", "doc_tokens", "payload").mapInArrow(run, f"part int, block int, doc_id bigint, at bigint, n_tokens bigint, {name} {kind}")
    starts = block_starts(blocks)
    side = F.broadcast(starts) if starts.count() <= 200_000 else starts
    return found.join(side, ["part", "block"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", name)


def block_starts(blocks: DataFrame) -> DataFrame:
    """Tokens before each block: those of the parts before, and of the part's blocks before."""
    sizes = cut(blocks.select("part", "block", "n_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per part
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return cut(sizes.join(parts, "part").select("part", "block", (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start")))


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID, block: int = BLOCK, digest: bool = False) -> DataFrame:
    """Writes a new file set and returns what reading it gives."""
    out = scratch(docs.sparkSession, "ids")
    write(docs, out, path, end_id, block)
    return read(docs.sparkSession, out, digest)
