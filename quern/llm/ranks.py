"""Places and running sums over rows that are sorted across partitions.

A row's place is its partition and its number there, both part of one long that grows
with the order. Running sums go up in levels: within a partition, over the partitions
of a lot, over the lots, so that no task holds more than one partition or one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import cut, stored

#: Partitions of a lot.
LOT = 1 << 10
#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 100_000


def small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A computed join side, broadcast only if it has at most so many rows."""
    return F.broadcast(side) if side.count() <= rows else side


def placed(df: DataFrame, order: list[str | Column], name: str, *columns: str | Column) -> DataFrame:
    """Columns of df in a stored table, with ``place``: longs that ascend in the order.

    ``spread`` breaks ties, so that equal rows don't meet in one partition; it is
    made here and must not be a column of df.
    """
    # The rows are written before they are dealt: their tie-breakers stay when a task runs again.
    df = stored(df.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), name)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order, "spread").sortWithinPartitions(*order, "spread")
    return stored(dealt.select(*columns, F.monotonically_increasing_id().alias("place")), f"{name}-placed")


def part(place: Column) -> Column:
    """The partition of a place."""
    return F.shiftright(place, 33)


def earlier(sums: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows (keys, part, values), which should be a checkpoint: values become their sums over earlier parts with the same keys."""
    above = Window.partitionBy(*keys).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "lot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = sums.withColumn("lot", F.floor(F.col("part") / LOT))
    lots = sums.groupBy(*keys, "lot").agg(*[F.sum(c).alias(c) for c in values])
    lots = lots.select(*[F.col(k).alias(f"lot_{k}") for k in keys], F.col("lot").alias("of_lot"), *[over(c, above).alias(f"lot_{c}") for c in values])
    same = F.col("lot") == F.col("of_lot")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"lot_{k}"))
    rows = sums.select(*keys, "part", "lot", *[over(c, within).alias(c) for c in values])
    return rows.join(lots, same).select(*keys, "part", *[(F.col(c) + F.col(f"lot_{c}")).cast("bigint").alias(c) for c in values])


def counted(rows: DataFrame, key: str) -> DataFrame:
    """Stored rows sorted by a key first, with ``at``: the number of rows of the same key before each, and ``size``: the key's rows."""
    spans = cut(rows.groupBy(key, part(F.col("place")).alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n")))
    before = earlier(spans.select(key, "part", "n"), [key], ["n"])
    sizes = spans.groupBy(F.col(key).alias("size_key")).agg(F.sum("n").alias("size"))
    spans = spans.select(key, "part", "first").join(before.select(F.col(key).alias("k"), F.col("part").alias("p"), "n"), F.col(key).eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    spans = cut(spans.join(sizes, F.col(key).eqNullSafe(F.col("size_key"))).select("k", "p", (F.col("n") - F.col("first")).alias("shift"), "size"))
    met = rows.join(small(spans), F.col(key).eqNullSafe(F.col("k")) & (part(F.col("place")) == F.col("p")))
    return met.select(*rows.columns, (F.col("place") + F.col("shift")).alias("at"), "size")


def running(rows: DataFrame, values: list[str]) -> DataFrame:
    """Adds, for rows with different places, before_<value>: the sums of values over all earlier places."""
    rows = rows.withColumn("part", part(F.col("place")))
    sums = cut(rows.groupBy("part").agg(*[F.sum(c).cast("bigint").alias(c) for c in values]))
    before = cut(earlier(sums, [], values).select(F.col("part").alias("p"), *[F.col(c).alias(f"to_{c}") for c in values]))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"in_{c}") for c in values])
    met = rows.join(small(before), F.col("part") == F.col("p"))
    return met.select(*[c for c in rows.columns if c != "part" and not c.startswith("in_")], *[(F.col(f"in_{c}") + F.col(f"to_{c}")).cast("bigint").alias(f"before_{c}") for c in values])
