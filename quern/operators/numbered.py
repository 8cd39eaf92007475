"""Consecutive numbers over rows in an order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.materialise import bounded, cut


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with ``name``: 0, 1, ... in the order of columns.

    Rows are dealt out by ranges and sorted there; what is before a range comes from the ranges' counts, one row each.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = cut(cut(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at))
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    here = F.shiftright("_at", 33)
    met = placed.join(bounded(ranges), here == F.col("_range"))
    return met.withColumn(name, F.col("_before") + F.col("_at") - F.call_function("shiftleft", here, F.lit(33))).drop("_at", "_range", "_before")
