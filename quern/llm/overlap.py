"""Near copies by the Jaccard similarity of word shingles, found through SimHash and through bands.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of at least 4/5. Every link is verified on the whole sets. Candidates come
from two indexes:

1. SimHash by multi-index hashing (``simhash.links``) over fingerprints of five-word
   shingles. Its balls of 4 bits hold close copies only: at a similarity of 0.8 two
   fingerprints of 64 bits differ in 10 bits on average, and tables for so wide a
   radius would meet every text. So it can't find all pairs by itself.
2. Bands of minima: of 160 orders of the shingles the least ones, five to a band. Two
   texts of similarity 0.8 share a given band with probability 0.8 ** 5, and none of
   32 with probability 3e-6; the number of keys of a text does not depend on its length.

Each of the 160 minima also leaves four bits in a signature. Texts of similarity 0.8
agree in 130 of 160 places on average; a pair that agrees in fewer than LEAST is none
(an error of 3e-6), so unlike texts that share a key by chance cost no sets.

Keys are not multiplied out. Every text that shares a key with a text of another
group is first compared with one of those, the one it shares most keys with, and groups
grow. Of what is open then,

- keys of at most GROUP texts meet by signature inside the join;
- texts of larger keys meet by rare shingles. Two sets of that similarity share one of
  their n / 5 + 1 rarest shingles, whatever the order, so those that at most GROUP of
  these texts have name every pair exactly: a template that thousands share costs
  nothing. Only texts of which frequent shingles are four fifths or more may meet in
  frequent ones alone. Those go on as in the beginning, at most ROUNDS times, until
  comparing what is left of their keys across groups, by signature, costs few pairs a text.

So a text meets at most GROUP others under a key, but for the last kind, of which texts
that share their frequent shingles are near copies of each other, and one group soon.

Defined results: texts are known by their hash, so copies are never paired; null
counts as empty; texts without words are copies of each other; a text of fewer than
five words is one shingle; long texts are taken whole; only the text is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import cut, texts_of, trimmed
from quern.llm.simhash import SLICE, bounded, components, links, majorities, shingle_hashes

WIDTH = 5
#: Bands, and minima of a band.
BANDS, ROWS = 32, 5
#: Rounds of one comparison a text for texts of frequent shingles, and texts of a key or shingle that meet each other at most.
ROUNDS, GROUP = 6, 64
#: Signatures that a member of a key is compared with at most, on average, before another round.
PAIRS = 1_000
#: Fewer shingles than this hold more than 1/MANY of all; they are broadcast.
MANY = 20_000
#: Places of two signatures that agree at least, and words of a signature.
LEAST, WORDS = 108, BANDS * ROWS // 16
#: Shingles whose minima are taken at a time.
SLAB = 400_000
#: Rows, sets, and bare ids of a side that is broadcast at most.
BROADCAST_ROWS, BROADCAST_SETS, BROADCAST_IDS = 20_000, 2_000, 1_000_000
_FACTORS = np.random.default_rng(20_021).integers(1, 2**63, size=BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def hashed(text: Column) -> Column:
    """What a text is known by."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, WIDTH), dtype=np.uint64))


def bands(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The band keys and the signature of each set of shingles; those of empty sets are equal."""
    out, sig = np.zeros((len(sets), BANDS), dtype=np.uint64), np.zeros((len(sets), WORDS), dtype=np.uint64)
    some = [k for k, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[k] for k in some])
        first = np.cumsum([0, *[len(sets[k]) for k in some[:-1]]])
        key = np.zeros(len(some), dtype=np.uint64)
        for k, f in enumerate(_FACTORS):
            least = np.minimum.reduceat(flat * f, first) * np.uint64(0x9E3779B97F4A7C15)
            sig[some, k // 16] |= (least >> np.uint64(60)) << np.uint64(4 * (k % 16))
            key = (key ^ least) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
            if k % ROWS == ROWS - 1:
                out[some, k // ROWS] = key
                key = np.zeros(len(some), dtype=np.uint64)
    return out + np.arange(BANDS, dtype=np.uint64), sig


def _banded(texts: DataFrame) -> DataFrame:
    """h, n (shingles), fp (SimHash), keys and the words of the signature of each different text."""
    words = [f"s{k}" for k in range(WORDS)]

    def run(batches):
        import pyarrow as pa

        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            n, fps, keys, sigs, lot, size = [], [], [], [], [], 0

            def flush(lot):
                sets = [np.unique(s) for s in lot]
                n.extend(map(len, sets))
                fps.append(majorities(lot))
                for held, x in zip((keys, sigs), bands(sets)):
                    held.append(x)

            for t in texts_of(b.column(1)):
                lot.append(np.array(shingle_hashes(t, WIDTH), dtype=np.uint64))
                size += len(lot[-1])
                if size > SLAB:
                    flush(lot)
                    lot, size = [], 0
            flush(lot)
            flat, sig = np.concatenate(keys).ravel().view(np.int64), np.concatenate(sigs).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            columns = [b.column(0), pa.array(n, pa.int32()), pa.array(np.concatenate(fps).view(np.int64)), lists, *[pa.array(np.ascontiguousarray(sig[:, k])) for k in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "n", "fp", "keys", *words])
        trimmed()

    schema = "h bigint, n int, fp bigint, keys array<bigint>" + "".join(f", {w} bigint" for w in words)
    return texts.select("h", "text").mapInArrow(run, schema).dropDuplicates(["h"])


def _sets(texts: DataFrame) -> DataFrame:
    """h and set of each different text."""

    def run(batches):
        import pyarrow as pa

        for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            sets = [shingle_set(t).view(np.int64) for t in texts_of(b.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["h", "set"])
        trimmed()

    return texts.dropDuplicates(["h"]).select("h", "text").mapInArrow(run, "h bigint, set array<bigint>")


def _alike(one: str = "s", two: str = "t") -> Column:
    """Whether two signatures, columns one0.. and two0.., agree in LEAST places."""
    apart = F.lit(0)
    for k in range(WORDS):
        x = F.col(f"{one}{k}").bitwiseXOR(F.col(f"{two}{k}"))
        for bits in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, bits))
        # The lowest bit of each four is set where they differ.
        apart = apart + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return apart <= 16 * WORDS - LEAST


def _signed(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of the pairs h, y whose signatures leave the similarity possible."""
    words = range(WORDS)
    of = lambda id_, name: keyed.select(F.col("h").alias(id_), *[F.col(f"s{k}").alias(f"{name}{k}") for k in words])
    return pairs.join(of("h", "s"), "h").join(of("y", "t"), "y").where(_alike()).select("h", "y")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs h, y whose sets reach the similarity, as links a, b."""
    pairs = cut(pairs.select(F.greatest("h", "y").alias("a"), F.least("h", "y").alias("b")).where("a <> b").distinct())
    n = pairs.count()
    if not n:
        return pairs
    small = lambda side, rows: F.broadcast(side) if n <= rows else side
    # Only the sets of texts that are compared are made.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h"))
    sets = cut(_sets(texts.join(small(wanted, BROADCAST_IDS // 2), "h", "left_semi")))
    of_b = sets.join(small(pairs.select(F.col("b").alias("h")), BROADCAST_IDS), "h", "left_semi").select(F.col("h").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("set").alias("sa")), "a").join(small(of_b, BROADCAST_SETS), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return cut(both.where(9 * shared >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"))


def _by_fingerprint(keyed: DataFrame) -> DataFrame:
    """Pairs h, y through SimHash: texts of one fingerprint with the least of them, and the least ones of linked fingerprints."""
    least = cut(keyed.groupBy("fp").agg(F.min("h").alias("y"), F.count("*").alias("m")))
    same = keyed.join(least.where("m > 1"), "fp").select("h", "y")
    met = links(least.select("fp"))
    far = met.join(least.select(F.col("fp").alias("a"), F.col("y").alias("h")), "a").join(least.select(F.col("fp").alias("b"), "y"), "b").select("h", "y")
    return same.unionByName(far).where("h <> y")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame | None:
    """key, h, n, root, m of the members of keys whose m texts are of several groups; None if there is no such key."""
    named = members.join(bounded(roots), F.col("h") == F.col("node"), "left").select("key", "h", "n", F.coalesce("root", "h").alias("root"))
    several = cut(named.groupBy("key").agg((F.min("root") < F.max("root")).alias("open"), F.count("*").alias("m")).where("open").select("key", "m"))
    few = several.count()
    return cut(named.join(F.broadcast(several) if few <= BROADCAST_ROWS else several, "key")) if few else None


def _near() -> Column:
    """Whether two texts are of different groups and of sizes that leave the similarity possible."""
    return (F.col("root") != F.col("other")) & (5 * F.least("n", "yn") >= 4 * F.greatest("n", "yn"))


def _other() -> list[Column]:
    return [F.col("h").alias("y"), F.col("n").alias("yn"), F.col("root").alias("other")]


def _fringe(named: DataFrame) -> DataFrame:
    """The members of each key that are not of its largest group: every pair of two groups holds one."""
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("c"))
    top = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("top"))
    return named.join(top, "key").where("root <> top").drop("top")


def _crossing(fringe: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs h, y of members of one key that are of different groups, not both hot, and alike by signature."""
    other = named.select("key", *_other(), F.col("hot").alias("other_hot"), *[F.col(f"s{k}").alias(f"t{k}") for k in range(WORDS)])
    met = fringe.join(other, "key").where(_near() & ~(F.col("hot") & F.col("other_hot")) & _alike())
    return met.select(F.greatest("h", "y").alias("h"), F.least("h", "y").alias("y")).distinct()


def _star(named: DataFrame, tried: DataFrame | None, keyed: DataFrame, k: int) -> DataFrame:
    """Pairs h, y: of each key one text, another one in each round; of those a text meets, the one it shares most keys with."""
    centres = named.groupBy("key").agg(F.min_by(F.struct(*_other()), F.xxhash64("h", F.lit(k))).alias("centre"))
    met = named.join(centres, "key").select("h", "n", "root", "centre.*").where(_near())
    met = met.groupBy("h", "y").agg(F.count("*").alias("s"))
    met = met if tried is None else met.join(tried, ["h", "y"], "left_anti")
    return cut(_signed(met.groupBy("h").agg(F.max_by("y", F.struct("s", "y")).alias("y")), keyed))


def _by_rare(hot: DataFrame, texts: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Pairs h, y of hot texts (h, root) of different groups that share one of their rarest shingles, and those texts (h) that may be alike through frequent ones only."""
    sets = cut(_sets(texts.join(bounded(hot.select("h"), BROADCAST_IDS), "h", "left_semi")))
    total = sets.agg(F.sum(F.size("set"))).first()[0] or 0
    many = cut(sets.select(F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
    # What so many hold goes along as one row of fewer than MANY shingles and leaves the sets before they are dealt out.
    bar = max(group, total // MANY)
    top = many.where(F.col("df") > bar).agg(F.collect_list("s").alias("top"))
    rest = sets.crossJoin(F.broadcast(top)).select("h", F.size("set").alias("n"), F.size(F.array_intersect("set", "top")).alias("tops"), F.array_except("set", "top").alias("rest"))
    rest = cut(rest)
    met = rest.select("h", "n", F.explode("rest").alias("s")).join(many.where(F.col("df") <= bar), "s")
    rare = F.collect_list(F.when(F.col("df") <= group, F.struct("df", "s")))
    of = met.groupBy("h").agg(F.first("n").alias("n"), F.array_sort(rare).alias("rare"), F.sum((F.col("df") > group).cast("int")).alias("f"))
    of = cut(of.select("h", "n", F.slice("rare", F.lit(1), F.floor(F.col("n") / 5).cast("int") + 1).alias("rare"), "f").join(bounded(hot, BROADCAST_IDS), "h"))
    held = rest.select("h", "n", F.col("tops").alias("f")).unionByName(of.select("h", "n", "f")).groupBy("h").agg(F.max("n").alias("n"), F.sum("f").alias("f"))
    full = held.where("5 * (n - f) <= n + 5").select("h")
    keys = cut(of.select("h", "n", "root", F.posexplode("rare").alias("at", "x")).select("h", "n", "root", "at", F.col("x.s").alias("s")))
    # Texts of one group meet no more: most shingles are shared inside a group only.
    parted = keys.groupBy("s").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("s")
    keys = cut(keys.join(parted, "s"))
    # The smaller one of a pair has a shared shingle among its n / 9 + 1 rarest ones.
    less = keys.where("9 * at <= n").select(F.col("h").alias("y"), F.col("n").alias("yn"), F.col("root").alias("other"), "s")
    pairs = keys.join(less, (keys["s"] == less["s"]) & (F.col("root") != F.col("other")) & (F.col("yn") <= F.col("n")) & (5 * F.col("yn") >= 4 * F.col("n")))
    return pairs.select(F.greatest("h", "y").alias("h"), F.least("h", "y").alias("y")).distinct(), cut(full)


def _affordable(named: DataFrame) -> bool:
    """Whether comparing all members of open keys across groups, by signature inside the join, costs at most PAIRS pairs a member."""
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("most"))
    r = keys.agg(F.sum("m").alias("rows"), F.sum((F.col("m") - F.col("most")) * F.col("m")).alias("pairs")).first()
    return r.pairs <= PAIRS * r.rows


def near_copies(docs: DataFrame, rounds: int = ROUNDS, group: int = GROUP) -> DataFrame:
    """h (hashed(text)) and root of every text that is a near copy of a different one, directly or through others."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", hashed(F.col("text")))
    keyed = cut(_banded(texts))
    found = _verified(_signed(_by_fingerprint(keyed), keyed), texts)
    entries = keyed.select("h", "n", F.explode("keys").alias("key"))
    shared = cut(entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"))
    members = cut(entries.join(bounded(shared), "key").select("key", "h", "n"))
    roots, tried = components(found), None

    def linked(pairs, signed=False):
        nonlocal found, roots
        more = _verified(pairs if signed else _signed(pairs, keyed), texts)
        if not more.isEmpty():
            found = found.unionByName(more)
            roots = components(found)

    if (named := _open(members, roots)) is not None:
        tried = _star(named, None, keyed, 0)
        linked(tried, signed=True)
    if tried is None or (named := _open(members, roots)) is None:
        return roots.withColumnRenamed("node", "h")
    words = [f"s{k}" for k in range(WORDS)]
    hot = cut(named.where(F.col("m") > group).select(F.col("h").alias("of"), F.col("root").alias("of_root")).distinct())
    few = named.where(F.col("m") <= group).join(bounded(hot.select("of"), BROADCAST_IDS), F.col("h") == F.col("of"), "left").withColumn("hot", F.col("of").isNotNull()).drop("m", "of")
    few = few.join(keyed.select("h", *words), "h")
    rest = _crossing(_fringe(few), few)
    full = None
    if not hot.isEmpty():
        pairs, full = _by_rare(hot.select(F.col("of").alias("h"), F.col("of_root").alias("root")), texts, group)
        rest = rest.unionByName(_signed(pairs, keyed))
    tested = tried.select(F.greatest("h", "y").alias("h"), F.least("h", "y").alias("y"))
    linked(rest.join(tested, ["h", "y"], "left_anti"), signed=True)
    if full is None or full.isEmpty():
        return roots.withColumnRenamed("node", "h")
    members = cut(members.join(bounded(full, BROADCAST_IDS), "h", "left_semi"))
    for k in range(1, rounds + 1):
        if (named := _open(members, roots)) is None or _affordable(named):
            break
        best = _star(named, tried, keyed, k)
        if best.isEmpty():
            break
        linked(best, signed=True)
        tried = tried.unionByName(best)
    if (named := _open(members, roots)) is not None:
        named = named.drop("m").withColumn("hot", F.lit(False)).join(keyed.select("h", *words), "h")
        linked(_crossing(_fringe(named), named), signed=True)
    return roots.withColumnRenamed("node", "h")
