"""SimHash near-dedup by multi-index hashing.

Fingerprints (64 bits) are compared through two segments of 32 bits. Two that differ
in at most 4 bits differ in at most 2 within one segment, so their balls of radius 1
in that segment share a key: each fingerprint enters the segment's table under the
33 keys of its ball, and members of a table entry are verified by complete distance.
Entries of more than BUCKET members are not compared pairwise: their members go
under the keys of their whole ball of radius 2 in 64 bits, where all members of an
entry are within 4 of each other, so a star holds every link that matters.
Components come from alternating large-star and small-star steps over the links.

Defined results: null and empty texts have fingerprint 0, which links like any
other; equal texts share a fingerprint and copies are never paired; ids may repeat;
null ids are no component's smallest unless it has no other; an empty table gives
no rows; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import cut, texts_of, trimmed

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Members of a table entry that are compared pairwise at most.
BUCKET = 256
#: Shingle hashes turned into bits at a time.
SLAB = 200_000
#: Rows of an Arrow batch that are worked on at a time.
SLICE = 1_000


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle, repeats included; one of all words if there are fewer."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    if len(words) <= width:
        return [h(joined, SEED)]
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprints(texts: list[bytes | None], width: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints; a bit is 1 if it is set in over half the hashes."""
    return majorities(shingle_hashes(t, width) for t in texts)


def majorities(hashes) -> np.ndarray:
    """The bits set in over half of each list of hashes, a bounded lot of lists at a time."""
    out, slab, n = [], [], 0

    def flush():
        counts = np.array([len(s) for s in slab])
        some = np.flatnonzero(counts)
        major = np.zeros(len(slab), dtype=np.uint64)
        if len(some):
            flat = np.concatenate([np.asarray(slab[k], dtype=np.uint64) for k in some])
            at = np.concatenate([[0], np.cumsum(counts[some])])
            ones = np.empty((len(some), 64), dtype=np.int64)
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for k in range(len(some)):
                ones[k] = bits[at[k] : at[k + 1]].sum(0, dtype=np.int32)
            over = (2 * ones > counts[some][:, None]).astype(np.uint8)
            major[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
        out.append(major)

    for s in hashes:
        slab.append(s)
        n += len(s)
        if n >= SLAB:
            flush()
            slab, n = [], 0
    flush()
    return np.concatenate(out)


def fingerprinted(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""

    def run(batches):
        import pyarrow as pa

        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(texts_of(b.column(1)), width).view(np.int64))], names=["doc_id", "fp"])
        trimmed()

    schema = docs.select("doc_id").withColumn("fp", F.lit(0).cast("bigint")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _forests(batches):
    """Of lists of fingerprints, links of a spanning forest of those within the distance."""
    import pyarrow as pa

    for b in batches:
        one, two = [], []
        for members in b.column(0).to_pylist():
            f = np.unique(np.array(members, dtype=np.int64))
            near = np.bitwise_count((f[:, None] ^ f[None, :]).view(np.uint64)) <= DISTANCE
            left = np.ones(len(f), dtype=bool)
            while left.any():
                front = np.zeros(len(f), dtype=bool)
                front[left.argmax()] = True
                left &= ~front
                while front.any():
                    reach = near[front][:, left]
                    hit = reach.any(0)
                    a, c = np.flatnonzero(front)[reach[:, hit].argmax(0)], np.flatnonzero(left)[hit]
                    one.append(f[a])
                    two.append(f[c])
                    front = np.zeros(len(f), dtype=bool)
                    front[c] = True
                    left[c] = False
        flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (one, two)]
        yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1])], names=["a", "b"])


#: Rows of a side that is broadcast, at most.
BROADCAST_ROWS = 20_000


def bounded(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join side, to be broadcast only if it has few rows."""
    return F.broadcast(side) if side.count() <= rows else side


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links a, b between different fingerprints: enough of them to keep every component whole."""
    low, flips = F.lit(0xFFFFFFFF), F.sequence(F.lit(0), F.lit(31))
    one = F.lit(1).cast("bigint")

    def ball(value, tag):
        # The segment number goes into bit 32.
        keys = F.concat(F.array(value), F.transform(flips, lambda i: value.bitwiseXOR(F.call_function("shiftleft", one, i))))
        return F.transform(keys, lambda k: k.bitwiseOR(F.lit(tag << 32)))

    halves = F.concat(ball(F.shiftrightunsigned("fp", 32), 0), ball(F.col("fp").bitwiseAND(low), 1))
    balls = fps.select("fp", F.explode(halves).alias("key"))
    # Keys are dealt out once and counted where they meet; what stands alone under a key goes no further.
    entries = cut(balls.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    small = entries.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    out = small.mapInArrow(_forests, "a bigint, b bigint").distinct()
    large = entries.where(F.col("n") > bucket).select("fp").distinct()
    if large.isEmpty():
        return out
    # All 2081 keys within two bits.
    bit = lambda i: F.call_function("shiftleft", one, i)
    first = large.select("fp", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), F.lit(63)))).alias("i"))
    first = first.select("fp", "i", F.when(F.col("i") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(bit(F.col("i")))).alias("c"))
    second = F.when(F.col("i") < 0, F.array(F.col("c"))).otherwise(F.concat(F.array(F.col("c")), F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: j > F.col("i")), lambda j: F.col("c").bitwiseXOR(bit(j)))))
    balls = first.select("fp", F.explode(second).alias("key"))
    least = balls.groupBy("key").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(least, "key").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return out.unionByName(stars)


#: Links up to which one task finds the components, in memory of its own.
LOCAL_LINKS = 4_000_000


def components(edges: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """node and root (the least node of its component) of all nodes of links a, b; the result is a checkpoint."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = now.count()
    if n <= local:
        return cut(now.repartition(1).mapInArrow(_rooted, "node bigint, root bigint"))
    return cut(_starred(now))


def _rooted(batches):
    """Components of all links by least labels and pointer jumping."""
    import pyarrow as pa

    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    a, b = (table.column(k).to_numpy() for k in (0, 1))
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while True:
        low, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _starred(now: DataFrame) -> DataFrame:
    """Components by alternating large-star and small-star steps over distinct links a > b."""
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node move to its least one.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: those at or below it do, and the node itself.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = cut(small)
        after = mark(now)
        if after == before:
            break
        before = after
    tops = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = cut(fingerprinted(docs, width))
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(reps.select("fp"), bucket)).withColumnRenamed("node", "fp")
    # Only linked fingerprints have a component to be named; any other is its own.
    linked = cut(reps.join(bounded(roots), "fp").select("fp", "root", "least_id"))
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = cut(linked.join(bounded(cut(ids)), "root").select("fp", F.col("component_id").alias("joined_id"), F.lit(True).alias("joined")))
    alone = reps.join(bounded(of_fp), "fp", "left").select(F.col("fp").alias("of_fp"), F.when(F.col("joined"), F.col("joined_id")).otherwise(F.col("least_id")).alias("component_id"))
    return rows.join(alone, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")
