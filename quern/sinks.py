"""Reports: JSON rows and an append-only store with a commit record."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.conditions import bag_digest


def finding_json() -> Column:
    """A finding as compact JSON with a fixed order of fields."""
    return F.to_json(F.struct("id", "kind", F.col("tier").alias("confidence"), F.col("reasons").alias("classificationReasons")))


#: Limits of the older format: blocker references, id references, ids of one blocker.
LIMITS = (250_000, 2_000_000, 100_000)


def check_limits(findings: DataFrame) -> None:
    """Raises before anything is written if findings(blocker_ids array, affected counts array) pass the older format's limits."""
    r = findings.agg(F.sum(F.size("blocker_ids")).alias("refs"), F.sum(F.expr("aggregate(affected, 0L, (a, x) -> a + x)")).alias("ids"), F.max(F.array_max("affected")).alias("most")).first()
    for got, limit, what in zip(r, LIMITS, ("blocker references", "id references", "ids of one blocker")):
        if (got or 0) > limit:
            raise ValueError(f"{got} {what} are more than {limit}")


def finding_json_v2() -> Column:
    """A finding in the older format: its blockers stand inside it, tiers in capitals."""
    return F.to_json(F.struct("id", "kind", F.upper("tier").alias("confidence"), "blockers", F.col("why_not_safe").alias("whyNotSafe")))


def write_v2(findings: DataFrame, path: str) -> None:
    """Writes findings(..., blockers array, blocker_ids, affected) in the older format, or raises before anything is written if they are too many for it."""
    check_limits(findings)
    findings.orderBy("id").select(finding_json_v2().alias("value")).write.mode("errorifexists").text(path)


def _record(lines: DataFrame) -> DataFrame:
    """rows and digest of the lines (value): equal lines count as often as they are there."""
    return lines.select(F.col("value").alias("line")).agg(F.count("*").alias("rows"), bag_digest("line").alias("digest"))


def _findings(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.text(f"{target}/findings")


def write_report(rows: DataFrame, folder: str, run_id: str) -> str:
    """Writes sorted JSON lines to a new folder of the run, reads them back, and commits their count and digest last.

    A run that is there already is an error; one without a commit record does not count.
    """
    return write_reports({run_id: rows}, folder)[0]


def write_reports(reports: dict[str, DataFrame], folder: str) -> list[str]:
    """As write_report, for several runs: no commit record is written before the rows of all of them are."""
    targets = {run_id: f"{folder.rstrip('/')}/{run_id}" for run_id in reports}
    for run_id, rows in reports.items():
        rows.select(finding_json().alias("value")).orderBy("value").write.mode("errorifexists").text(f"{targets[run_id]}/findings")
    for run_id, rows in reports.items():
        record = _record(_findings(rows.sparkSession, targets[run_id]))
        record.select(F.to_json(F.struct("rows", "digest")).alias("value")).coalesce(1).write.mode("errorifexists").text(f"{targets[run_id]}/commit")
    return list(targets.values())


def recovery_state(spark: SparkSession, target: str) -> str:
    """absent, uncommitted (rows without a record), altered (rows that differ from it), lost (a record without rows) or complete."""
    held = {}
    for part in ("findings", "commit"):
        try:
            held[part] = spark.read.text(f"{target}/{part}")
        except AnalysisException:
            held[part] = None
    if held["findings"] is None:
        return "absent" if held["commit"] is None else "lost"
    if held["commit"] is None:
        return "uncommitted"
    same = _record(held["findings"]).select(F.to_json(F.struct("rows", "digest")).alias("value")).first() == held["commit"].first()
    return "complete" if same else "altered"


def committed(spark: SparkSession, target: str) -> bool:
    """Whether a run's rows still equal its commit record."""
    return recovery_state(spark, target) == "complete"
