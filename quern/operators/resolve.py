"""Resolution of content, names, routes, locales and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.materialise import bounded


def duplicate_content(files: DataFrame) -> DataFrame:
    """path, content -> digest, size, copies, waste, first_path. Only sizes that occur twice are hashed."""
    sized = files.select("path", "content", F.octet_length("content").cast("bigint").alias("size"))
    shared = sized.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    hashed = sized.join(shared, "size", "left_semi").select("path", "size", F.sha2("content", 256).alias("digest"))
    groups = hashed.groupBy("size", "digest").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")
    return groups.select("digest", "size", "copies", ((F.col("copies") - 1) * F.col("size")).alias("waste"), "first_path")


def lookups(requests: DataFrame, registrations: DataFrame, keys: list[str]) -> DataFrame:
    """request keys with n candidates and the outcome: edge, id_blocker or namespace_blocker."""
    held = registrations.groupBy(*keys).agg(F.count("*").alias("candidates"), F.min("id").alias("first_id"))
    n = F.coalesce("candidates", F.lit(0))
    outcome = F.when(n == 0, "namespace_blocker").when(n == 1, "edge").otherwise("id_blocker")
    return requests.join(held, keys, "left").select(*requests.columns, n.alias("candidates"), outcome.alias("outcome"), F.when(n == 1, F.col("first_id")).alias("target"))


def missing_locales(messages: DataFrame) -> DataFrame:
    """key and the locales (of all there are) that lack it."""
    pairs = messages.select("key", "locale").distinct()
    all_ = bounded(pairs.select("locale").distinct())  # tens; the answer itself has a row per key and locale
    gaps = pairs.select("key").distinct().join(all_).join(pairs, ["key", "locale"], "left_anti")
    return gaps.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("locale")), ",").alias("missing"))


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """left_id and right_id of intervals of one key that overlap, met by buckets of ``width``."""

    def bucketed(df, side):
        buckets = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
        return df.where("start < end").select(F.col(key), F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.explode(buckets).alias("bucket"))

    met = bucketed(left, "left").join(bucketed(right, "right"), [key, "bucket"]).where("left_start < right_end and right_start < left_end")
    # Each pair counts in the bucket where it begins to overlap.
    return met.where(F.col("bucket") == F.floor(F.greatest("left_start", "right_start") / width)).select("left_id", "right_id")


def multiset_difference(candidate: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """key and how often the candidate has it more than the baseline."""
    a, b = candidate.groupBy(key).agg(F.count("*").alias("a")), baseline.groupBy(key).agg(F.count("*").alias("b"))
    more = F.col("a") - F.coalesce("b", F.lit(0))
    return a.join(b, key, "left").select(key, more.alias("more")).where("more > 0")


def latest_state(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("events"))


def grading(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """tp, tn, fp, fn."""
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    return rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
