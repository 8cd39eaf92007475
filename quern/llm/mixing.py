"""Mixing sources to target weights by pivotal rounding. DataFrame functions only.

Targets: the share of all sizes is dealt to the sources by weight; a target stops
at ``most`` times its source's size and the excess goes to the others by weight,
which ends at the level where every open target is weight * level.

Copies: a document of a source with target/size = c gets floor(c) copies and, with
probability c - floor(c), one more. The fractions are rounded by the pivotal
method: two fractions meet, words of expectation move from one to the other at
random, with both expectations kept, until one is 0 or 1, and the other goes on.
The words expected of the two stay the same sum, so a source misses its target by
part of one document at most. Within chunks of bounded length each document meets
the rest of its chunk as one unit, largest first, so that a small one stays open;
what chunks leave open goes up a reduction tree, pair by pair, until one is left
per source. Random numbers are hashes of ids, so reruns agree.

Defined results: null or empty texts have size 0 and take 0; null sources are one
source, the last; ids may be null or repeat, each row is rounded by itself, rows that
are alike too; sources of size 0 have target 0; very long texts are counted whole; an
empty table gives no rows; columns that are neither named above nor payload stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import WORD, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Documents of a chunk, on average.
CHUNK = 128
#: Rows that are alike and numbered at a time.
LOT = 4_096
SEED = 20_011


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. The windows run over one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # Sources close in the order of cap / weight. Before the k-th closes, the open ones stand at this level:
    closing = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumns({
        "closed": F.coalesce(F.sum("cap").over(closing.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(closing.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(everything) * F.lit(float(share)),
    })
    by = by.withColumn("level", (F.col("all") - F.col("closed")) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)
    by = by.withColumn("stand", level["level"])
    target = F.when(F.col("stand").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("stand"), F.col("cap")))
    return by.select("source", "source_size", target.alias("target"))


def _random(*parts) -> Column:
    """A number in [0, 1) made of the parts' hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _meet(units: Column, salt: Column) -> Column:
    """Rounds an array of struct<size, key, p>: the one left open, and ``out``, the decided struct<key, one>."""
    first = F.struct(F.lit(None).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("p"), F.array().cast("array<struct<key:bigint,one:int>>").alias("out"))

    def state(s, x, p, other, one):
        done = F.struct(other["key"].alias("key"), F.lit(one).alias("one"))
        return F.struct(x["key"].alias("key"), x["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), F.array_append(s["out"], done).alias("out"))

    def step(s, u):
        up_s, down_s, up_u, down_u = (1 - s["p"]) * s["size"], s["p"] * s["size"], (1 - u["p"]) * u["size"], u["p"] * u["size"]
        to_s, to_u = F.least(up_s, down_u), F.least(down_s, up_u)
        s_gains = F.when(up_s <= down_u, state(s, u, u["p"] - to_s / u["size"], s, 1)).otherwise(state(s, s, s["p"] + to_s / s["size"], u, 0))
        u_gains = F.when(down_s <= up_u, state(s, u, u["p"] + to_u / u["size"], s, 0)).otherwise(state(s, s, s["p"] - to_u / s["size"], u, 1))
        r = _random(salt, s["key"], u["key"], F.lit(SEED))
        start = F.struct(u["key"].alias("key"), u["size"].alias("size"), u["p"].alias("p"), s["out"].alias("out"))
        return F.when(s["key"].isNull(), start).when(r * (to_s + to_u) < to_u, s_gains).otherwise(u_gains)

    return F.aggregate(units, first, step)


def _share(units: Column, salt: Column) -> Column:
    """Rounds an array of struct<size, key, p> with equal p, largest first: each one's p, of which one at most stays open."""
    mass = F.aggregate(units, F.lit(0).cast("bigint"), lambda s, u: s + u["size"])
    first = F.struct(F.get(units, F.lit(0))["p"].alias("q"), mass.alias("rest"), F.array().cast("array<double>").alias("out"))

    def step(s, u):
        rest, q = s["rest"] - u["size"], s["q"]
        gain, loss = F.least((1 - q) * u["size"], q * rest), F.least(q * u["size"], (1 - q) * rest)
        gains = _random(salt, u["key"], F.lit(SEED)) * (gain + loss) < loss
        moved = F.when(gains, gain).otherwise(-loss)
        p, q = q + moved / u["size"], F.when(rest > 0, q - moved / rest).otherwise(q)
        return F.struct(_snapped(q).alias("q"), rest.alias("rest"), F.array_append(s["out"], _snapped(p)).alias("out"))

    return F.aggregate(units, first, step, lambda s: s["out"])


def _snapped(p: Column) -> Column:
    return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)


def _places(*fields: str) -> Column:
    """The column ``units`` largest first, each with its place as key, so that repeated ids stay apart."""
    return F.transform(F.sort_array("units", asc=False), lambda u, i: F.struct(u["size"].alias("size"), i.cast("bigint").alias("key"), *[u[f].alias(f) for f in fields]))


def rounded(units: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``one`` (0 or 1, with expectation p) to rows of grp, size, key, p and payload."""
    counts = units.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(chunk)).alias("chunks"))
    counts = cut(counts)
    side = F.broadcast(counts) if counts.count() <= 100_000 else counts
    level = units.join(side, "grp").withColumn("slot", F.pmod(F.xxhash64("key", F.lit(SEED)), F.col("chunks")))
    level = level.groupBy("grp", "slot").agg(F.collect_list(F.struct("size", "key", "p", "payload")).alias("units"))
    level = level.withColumn("units", _places("p", "payload")).withColumn("chunk", F.xxhash64("grp", "slot"))
    # Texts without words, which come last, have none to pass on: they are rounded alone.
    shared = _share(F.filter("units", lambda u: u["size"] > 0), F.col("chunk"))
    chunks = cut(level.withColumn("ps", shared))
    left = F.filter(F.arrays_zip("units", "ps"), lambda x: (x["ps"] > 0) & (x["ps"] < 1))
    open_ = chunks.select("grp", "chunk", F.get(left, F.lit(0)).alias("x")).where(F.col("x").isNotNull()).select("grp", "chunk", F.col("x.units.size").alias("size"), F.col("x.ps").alias("p"))
    settled = []
    # The reduction tree: what is open in some chunks meets, and one of each lot goes up.
    while (most := open_.groupBy("grp").count().agg(F.max("count")).first()[0] or 0) > 1:
        lots = -(-most // chunk)
        level = open_.groupBy("grp", F.pmod(F.xxhash64("chunk", F.lit(len(settled))), F.lit(lots)).alias("lot")).agg(F.collect_list(F.struct("size", "chunk", "p")).alias("units"))
        level = cut(level.withColumn("units", _places("p", "chunk")).withColumn("met", _meet(F.col("units"), F.xxhash64("grp", "lot", F.lit(len(settled))))))
        settled.append(level.select("units", F.explode("met.out").alias("x")).select(F.get("units", F.col("x.key").cast("int"))["chunk"].alias("chunk"), F.col("x.one").alias("last")))
        open_ = level.select("grp", F.get("units", F.col("met.key").cast("int"))["chunk"].alias("chunk"), F.col("met.size").alias("size"), F.col("met.p").alias("p"))
    last = open_.select("chunk", (_random(F.col("chunk"), F.lit("last")) < F.col("p")).cast("int").alias("last"))
    for more in settled:
        last = last.unionByName(more)
    chunks = chunks.join(last, "chunk", "left")
    alone = lambda u: (_random(F.col("chunk"), u["key"], F.lit(SEED)) < u["p"]).cast("int")
    one = lambda p: F.when((p > 0) & (p < 1), F.coalesce("last", F.lit(0))).otherwise(p.cast("int"))
    both = F.transform("units", lambda u: F.struct(u["payload"].alias("payload"), u["size"].alias("size"), F.when(u["size"] > 0, one(F.get(F.col("ps"), u["key"].cast("int")))).otherwise(alone(u)).alias("one")))
    return chunks.select(F.explode(both).alias("x")).select("x.*")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, payload=()) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every row, and the payload columns."""
    names = ["doc_id", "source", *payload]
    # Rows that are alike in all that is read are counted, then numbered, so that each meets a chunk of its own.
    sized = cut(docs.select(*names, size_of(F.col("text")).alias("size")).groupBy(*names, "size").agg(F.count("*").alias("alike")))
    goal = cut(targets(sized.select("source", (F.col("size") * F.col("alike")).alias("size")), weights, share, most))
    # One row per source: a side of bounded size in practice, checked before it is broadcast.
    side = F.broadcast(goal) if goal.count() <= 100_000 else goal
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(side.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rows = rows.withColumn("rate", F.least(rate, F.lit(float(most)))).withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.col("whole"))
    kept = F.struct(*[F.col(c) for c in names], "source_size", "target", "whole")
    lots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("alike") - 1) / LOT)))
    rows = rows.select("*", lots.alias("lot")).withColumn("number", F.explode(F.sequence(F.col("lot") * LOT, F.least((F.col("lot") + 1) * LOT, F.col("alike")) - 1)))
    key = F.xxhash64(*names, "size", "number")
    units = rows.select(F.xxhash64(F.coalesce("source", F.lit("\x00null"))).alias("grp"), "size", key.alias("key"), "p", kept.alias("payload"))
    out = rounded(units).select("payload.*", "size", "one")
    copies = (F.col("whole") + F.col("one")).cast("bigint")
    return out.select(*names, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
