"""Findings: unproven nodes, their safety predicates, tier and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that are never reported, tiers in rising order.
NOT_REPORTED = ("assetVariant", "generatedArtifact", "package", "entrypoint")
TIERS = ("protected", "review", "high", "safe")
RISKS = ("externalConsumersNotScanned", "broadRemovalScope")


def tier(protected: Column, kind: Column, gates: Column, risks: Column, package_mode: Column = None) -> Column:
    package_mode = F.lit(False) if package_mode is None else package_mode
    allowed = (F.size(risks) == 1) & F.array_contains(F.array(*map(F.lit, RISKS)), F.element_at(risks, 1))
    level = F.when(protected, "protected").when((kind == "duplicateGroup") | ~gates, "review").when(F.size(risks) == 0, "safe").when(F.when(F.size(risks) == 1, allowed).otherwise(False), "high").otherwise("review")
    return F.when(package_mode & ~protected, "review").otherwise(level)


def tier_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), level)


def ordered(rows: DataFrame) -> DataFrame:
    """Findings by tier, protected first, then by id; ``tier_rank`` says where a tier stands."""
    return rows.withColumn("tier_rank", tier_rank(F.col("tier"))).orderBy("tier_rank", "id")


def candidates(nodes: DataFrame, proven: DataFrame, retained: DataFrame, protected: DataFrame, blocked: DataFrame) -> DataFrame:
    """Unproven, reportable nodes with retained_in, is_protected and has_blockers."""
    open_ = nodes.where(~F.col("kind").isin(*NOT_REPORTED)).join(proven.select("id").distinct(), "id", "left_anti")
    kept = retained.groupBy("id").agg(F.array_sort(F.collect_set("context")).alias("retained_in"))
    return _flagged(open_.join(kept, "id", "left"), protected, blocked)


def marked(nodes: DataFrame, found: DataFrame, protected: DataFrame, blocked: DataFrame) -> DataFrame:
    """As candidates, from one row a reached node: id, proven, retained_in."""
    out = nodes.where(~F.col("kind").isin(*NOT_REPORTED)).join(found.select("id", "proven", "retained_in"), "id", "left")
    return _flagged(out.where(~F.coalesce("proven", F.lit(False))).drop("proven"), protected, blocked)


def _flagged(out: DataFrame, protected: DataFrame, blocked: DataFrame) -> DataFrame:
    out = out.withColumn("retained_in", F.coalesce("retained_in", F.array().cast("array<string>")))
    for side, name in ((protected, "is_protected"), (blocked, "has_blockers")):
        out = out.join(side.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def classified(rows: DataFrame, supported: Column, external: Column, coverage: Column, integrity: Column, package_mode: bool = False) -> DataFrame:
    """Adds not_retained, no_blockers, action_supported, external, tier and reasons. ``generated``, if there, tells generated references apart."""
    retained, generated = F.size("retained_in") > 0, F.col("generated") if "generated" in rows.columns else F.lit(False)
    clear = ~F.col("has_blockers") & integrity
    gates = coverage & ~retained & clear & ~F.col("is_protected") & supported
    risks = F.filter(F.array(F.when(external, F.lit(RISKS[0]))), lambda x: x.isNotNull())
    reason = [(~coverage, "incompleteTargetMatrix"), (~integrity, "incompleteGraphIntegrity"), (retained, "retainedOnly"), (F.col("kind") == "duplicateGroup", "duplicateCanonicalChoice"), (F.col("has_blockers"), F.when(generated, "generatedCodeUncertainty").otherwise("dynamicReference")), (~supported, "unsupportedAction"), (external, RISKS[0])]
    reasons = F.filter(F.array(*[F.when(c, name if isinstance(name, Column) else F.lit(name)) for c, name in reason]), lambda x: x.isNotNull())
    level = tier(F.col("is_protected"), F.col("kind"), gates, risks, F.lit(package_mode))
    return rows.withColumns({"not_retained": ~retained, "no_blockers": clear, "action_supported": supported, "external": external, "tier": level, "reasons": reasons})


def allowed(mode: str) -> Column:
    """Whether a classified finding may be acted on in application, package or packageInternal mode."""
    gates = F.col("not_retained") & F.col("no_blockers") & ~F.col("is_protected") & F.col("action_supported")
    high = (F.col("tier") == "high") & F.col("external")
    level = {"application": F.col("tier") == "safe", "package": F.lit(False), "packageInternal": (F.col("tier") == "safe") | high}[mode]
    return gates & level


def selection(rows: DataFrame, requested: DataFrame, mode: str) -> DataFrame:
    """id, state of requested(id): selected, not_actionable in the mode, or unknown. Ids are exact and case-sensitive.

    Null, empty and repeated ids are errors. A run goes on only if all of them are selected.
    """
    bad = requested.groupBy("id").agg(F.count("*").alias("n")).where("id is null OR id = '' OR n > 1")
    if not bad.isEmpty():
        raise ValueError("requested ids must be different and not empty")
    known = rows.groupBy("id").agg(F.bool_or(allowed(mode)).alias("may"))
    state = F.when(F.col("may").isNull(), "unknown").when(F.col("may"), "selected").otherwise("not_actionable")
    return requested.join(known, "id", "left").select("id", state.alias("state"))


def exactly(rows: DataFrame, requested: DataFrame, mode: str) -> DataFrame:
    """The requested findings, all of which must be known and actionable in the mode; nothing else is taken."""
    judged = selection(rows, requested, mode)
    counts = {r.state: r.n for r in judged.groupBy("state").agg(F.count("*").alias("n")).collect()}
    if set(counts) - {"selected"}:
        raise ValueError(f"not all requested findings can be taken: {counts}")
    return rows.join(requested.select("id"), "id", "left_semi")


def statistics(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """dimension, value, n: by tier (zero-filled), kind, reason and the columns of ``extra``, in one pass over the findings."""
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in ("tier", "kind", *extra)]
    tagged = F.concat(F.array(*pairs), F.transform("reasons", lambda r: F.struct(F.lit("reason").alias("dimension"), r.alias("value"))))
    counted = rows.select(F.explode(tagged).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    zero = rows.sparkSession.createDataFrame([("tier", t, 0) for t in TIERS], "dimension string, value string, n bigint")
    return counted.unionByName(zero).groupBy("dimension", "value").agg(F.sum("n").alias("n"))
