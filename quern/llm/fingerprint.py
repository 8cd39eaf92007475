"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs where its content says so (after line ends, and after
white space whose preceding letters hash to a fixed residue), so an edit changes the
paragraphs it touches only. A paragraph's digest holds 48 hashed bits and 16 bits of
length; repeats are told apart by their number. A sketch adds each digest to three
cells of (count, digest sum, check sum). Subtracting two sketches leaves the digests
that differ; peeling cells of one digest recovers them. If some cells stay, the
pair is sketched anew with more cells, until nothing stays. Pairs that never peel
(two equal digests in one text) are compared digest by digest after twelve retries.

The likeness of two fingerprints is 1 minus the share of their paragraphs' length
that the recovered digests make up: 1 for equal texts, 0 if no paragraph is shared.

Defined results: null text is empty; two empty texts have likeness 1; rows of equal
id follow each other in the order of their texts; null ids are the smallest; very
long texts are sketched whole; the only document's next one is itself; an empty table
gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import texts_of

#: Cells of the fingerprint that is returned, and the factor of each retry.
CELLS = 24
LARGER = 8
#: Retries after which a pair is compared without sketches.
RETRIES = 12
#: One of so many white-space places ends a paragraph.
EVERY = 4
#: Bytes of text compared at a time.
SLAB = 6_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def digests(text: bytes) -> np.ndarray:
    """A digest of each paragraph; the low 16 bits are its length in bytes (65535 at most)."""
    import xxhash

    if not text:
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(text, dtype=np.uint8)
    space = np.flatnonzero((b == 32) | (b == 10) | (b == 9))
    space = space[space >= 3]
    word = b[space - 1].astype(np.uint32) | (b[space - 2].astype(np.uint32) << 8) | (b[space - 3].astype(np.uint32) << 16)
    cut = (b[space] == 10) | ((word * np.uint32(2654435761)) >> np.uint32(16)) % EVERY == 0
    ends = (space[cut] + 1).tolist()
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    seen: dict[bytes, int] = {}
    out, start, h = [], 0, xxhash.xxh64_intdigest
    for end in ends:
        p = text[start:end]
        k = seen.get(p, 0)
        seen[p] = k + 1
        out.append((h(p, k) & ~0xFFFF) | min(end - start, 0xFFFF))
        start = end
    return np.array(out, dtype=np.uint64)


def _cells(keys: np.ndarray, of: np.ndarray, sizes: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """Three cells of each key, in a third of the sketch each."""
    third = (sizes[of] // 3).astype(np.uint64)
    h = _mixed(keys + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64))
    parts = [(_mixed(h + np.uint64(j)) % third).astype(np.int64) + j * third.astype(np.int64) for j in range(3)]
    return np.stack([first[of] + p for p in parts])


def _check(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)


def sketch(keys: np.ndarray, of: np.ndarray, sign: np.ndarray, sizes: np.ndarray, salt: int = 0):
    """Counts, digest sums and check sums of the sketches one after another; sums wrap at 64 bits."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    total, at = int(sizes.sum()), _cells(keys, of, sizes, first, salt)
    count, key, check = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    signed = sign.astype(np.int64).view(np.uint64)
    for row in at:
        np.add.at(count, row, sign)
        np.add.at(key, row, keys * signed)
        np.add.at(check, row, _check(keys) * signed)
    return count, key, check, first


def peel(count, key, check, first, sizes, salt: int = 0):
    """The recovered digests, whose pair each is of, and the pairs that peel to nothing."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found, found_of = [], []
    look = np.arange(len(count))
    while len(look):
        look = look[np.abs(count[look]) == 1]
        s = count[look]
        k = np.where(s > 0, key[look], np.uint64(0) - key[look])
        c = np.where(s > 0, check[look], np.uint64(0) - check[look])
        pure = _check(k) == c
        look, s, k = look[pure], s[pure], k[pure]
        if not len(look):
            break
        of = owner[look]
        order = np.lexsort((k, of))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (k[order][1:] != k[order][:-1]) | (of[order][1:] != of[order][:-1])
        pick = order[new]
        s, k, of = s[pick], k[pick], of[pick]
        found.append(k)
        found_of.append(of)
        signed = s.view(np.uint64)
        at = _cells(k, of, sizes, first, salt)
        for row in at:
            np.subtract.at(count, row, s)
            np.subtract.at(key, row, k * signed)
            np.subtract.at(check, row, _check(k) * signed)
        look = np.unique(at)
    stuck = np.bincount(owner, (count != 0) | (key != 0) | (check != 0), len(sizes)) > 0
    return np.concatenate(found or [np.zeros(0, np.uint64)]), np.concatenate(found_of or [np.zeros(0, np.int64)]), ~stuck


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """The length of the paragraphs in which two arrays of digests differ, repeats counted."""
    keys, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    more = np.bincount(of[: len(a)], minlength=len(keys)) - np.bincount(of[len(a) :], minlength=len(keys))
    return float((np.abs(more) * (keys & np.uint64(0xFFFF)).astype(np.int64)).sum())


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> np.ndarray:
    """Likeness of each pair of digest arrays, by subtraction and peeling, larger where that fails."""
    out, todo, salt = np.ones(len(pairs)), np.arange(len(pairs)), 0
    sizes = np.full(len(pairs), cells)
    weight = lambda d: int((d & np.uint64(0xFFFF)).sum())
    total = np.array([weight(a) + weight(b) for a, b in pairs], dtype=float)
    most = np.array([3 * (len(a) + len(b)) for a, b in pairs])
    while len(todo):
        parts = [x for i in todo for x in pairs[i]]
        lens = [len(x) for x in parts]
        of = np.repeat(np.repeat(np.arange(len(todo)), 2), lens)
        sign = np.repeat(np.tile([1, -1], len(todo)), lens)
        now = sizes[todo]
        keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        *state, first = sketch(keys, of, sign, now, salt)
        k, k_of, done = peel(*state, first, now, salt)
        lost = np.bincount(k_of, (k & np.uint64(0xFFFF)).astype(float), len(todo))
        i = todo[done]
        out[i] = np.where(total[i] > 0, 1 - lost[done] / np.maximum(total[i], 1), 1.0)
        todo = todo[~done]
        if salt == RETRIES:
            # What no sketch tells apart (digests that collide within a text) is compared digest by digest.
            for i in todo:
                out[i] = 1 - _apart(*pairs[i]) / total[i] if total[i] else 1.0
            break
        # A sketch with three cells for each digest of both seldom fails; then its double is taken.
        larger = np.where(sizes[todo] < most[todo], np.minimum(sizes[todo] * LARGER, most[todo]), sizes[todo] * 2)
        sizes[todo] = -(-np.maximum(larger, cells) // 3) * 3
        salt += 1
    return np.clip(out, 0.0, 1.0)


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """paragraphs:length:cells as text, the same for equal texts."""
    sizes = np.full(len(sets), cells)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    count, key, check, _ = sketch(keys, of, np.ones(len(keys), np.int64), sizes)
    raw = np.empty(len(count), dtype=[("count", "<u4"), ("key", "<u8"), ("check", "<u8")])
    raw["count"], raw["key"], raw["check"] = count, key, check
    return [f"{len(s)}:{int((s & np.uint64(0xFFFF)).sum())}:{base64.b64encode(raw[i * cells : (i + 1) * cells].tobytes()).decode()}" for i, s in enumerate(sets)]


def differing(one: str, two: str) -> np.ndarray | None:
    """The digests in which two fingerprints differ, or None if larger ones are needed."""
    kind = [("count", "<u4"), ("key", "<u8"), ("check", "<u8")]
    a, b = (np.frombuffer(base64.b64decode(x.split(":")[2]), dtype=kind) for x in (one, two))
    sizes = np.array([len(a)])
    count = a["count"].astype(np.int64) - b["count"].astype(np.int64)
    found, _, done = peel(count, a["key"] - b["key"], a["check"] - b["check"], np.array([0]), sizes)
    return found if done[0] else None


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(rows: list[tuple], out_schema):
    """rows: doc_id, text and the next text."""
    import pyarrow as pa

    raw = [t.encode("utf-8", "surrogatepass") for _, t, _ in rows]
    ed = [edited(t, n).encode("utf-8", "surrogatepass") for _, t, n in rows]
    here, there, after = [digests(t) for t in raw], [digests(t) for t in ed], [digests(n.encode("utf-8", "surrogatepass")) for _, _, n in rows]
    near = likeness(list(zip(here, there)) + list(zip(here, after)))
    columns = [
        [d for d, _, _ in rows], [len(t) for _, t, _ in rows], [hashlib.sha256(t).hexdigest() for t in ed],
        fingerprints(here), fingerprints(there), near[: len(rows)], near[len(rows) :],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    spark = docs.sparkSession
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("none"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0]
    if cuts is None:
        return spark.createDataFrame([], schema)
    cuts = np.unique(np.array(cuts, dtype=np.int64))
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + step].tolist() for k in range(0, len(cuts), step)]
    tops, limits = F.array(*[F.lit(g[-1]) for g in groups]).cast("array<bigint>"), F.array(*[F.array(*map(F.lit, g)) for g in groups]).cast("array<array<bigint>>")

    def bucket(ids: str):
        """How many cuts lie below an id: whole groups of them first, then within the next."""
        below = F.size(F.filter(tops, lambda c: c < F.col(ids)))
        more = F.coalesce(F.size(F.filter(F.get(limits, below), lambda c: c < F.col(ids))), F.lit(0))
        return F.least(below * step + more, F.lit(len(cuts)))

    # The first row of each range also goes to the range above it, whose last row it follows.
    firsts = sorted(rows.groupBy(bucket("doc_id").alias("bucket")).agg(F.max("doc_id").alias("doc_id")).collect())
    to = [(firsts[k][1], firsts[(k + 1) % len(firsts)][0]) for k in range(len(firsts))]
    extra = spark.createDataFrame(to, "doc_id bigint, bucket int")  # a row per range
    again = rows.join(F.broadcast(extra), "doc_id").select("doc_id", "text", "bucket", F.lit(True).alias("extra"), "none")
    dealt = rows.select("doc_id", "text", bucket("doc_id").alias("bucket"), F.lit(False).alias("extra"), "none").unionByName(again)
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.desc("doc_id"), "none", "text")

    def run(batches):
        import pyarrow as pa

        out_schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        last, slab, size = None, [], 0
        for b in batches:
            for doc_id, text, where, more, none in zip(*(b.column(k).to_pylist() for k in range(5))):
                if last and last[2] == where and not last[3]:
                    slab.append((last[0], last[1], text))
                    size += len(last[1]) + len(text)
                    if size > SLAB:
                        yield _compared(slab, out_schema)
                        slab, size = [], 0
                last = (None if none else doc_id, text, where, more)
        if slab:
            yield _compared(slab, out_schema)

    return dealt.mapInArrow(run, schema)
