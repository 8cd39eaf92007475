"""Append-only ledgers, their guards, and validation of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a transaction and the states that may come before each.
BEFORE = {
    "pending": [None],
    "applied": ["pending"],
    "verified": ["applied"],
    "committed": ["verified"],
    "rolledBackVerified": ["pending", "applied", "verified", "recoveryRequired"],
    "recoveryRequired": ["pending", "applied", "verified"],
}


def allowed_step(before: Column, state: Column) -> Column:
    ok = F.lit(False)
    for name, earlier in BEFORE.items():
        one = before.isNull() if earlier == [None] else F.coalesce(before.isin(*earlier), F.lit(False))
        ok = F.when(state == name, one).otherwise(ok)
    return ok


def violations(events: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """Events whose state may not follow the one before it, with that one as ``before``."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).where(~allowed_step(F.col("before"), F.col(state)))


def shared_members(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Members that several transactions claim, with how many."""
    return rows.groupBy(member).agg(F.count_distinct(key).alias("claims")).where("claims > 1")


def blocking_runs(events: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """Runs whose last state is neither completed nor rolled back."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state")).where(~F.col("state").isin("completed", "committed", "rolledBackVerified"))


def last_writes(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One whole row per key: the one written last."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def count_mismatches(findings: DataFrame, reported: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, reported, counted where reported(dimension, value, n) differs from a recount."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    counted = findings.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("counted"))
    both = reported.withColumnRenamed("n", "reported").join(counted, ["dimension", "value"], "full_outer")
    filled = both.select("dimension", "value", F.coalesce("reported", F.lit(0)).alias("reported"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return filled.where("reported <> counted")
