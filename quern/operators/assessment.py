"""Findings as users see them: rule, title, adapter, predicates, risks, tier, reasons and the proposed action.

Rows are candidates with id, kind, owner, display_name, removal_supported,
declaration_count, externally_addressable, size_bytes, is_protected, retained_in,
auxiliary_retained_in and blocker_reasons (of the blockers that are active on them).
What is missing of the metadata is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.findings import NOT_REPORTED, RISKS, TIERS, tier

#: Rule and title by kind of node; any other kind is unknown.
RULES = {
    "asset": ("PRN-ASSET-001", "Unused asset"),
    "duplicateGroup": ("PRN-DUP-001", "Duplicate file"),
    "declaration": ("PRN-DART-001", "Unreachable declaration"),
    "dartLibrary": ("PRN-DART-002", "Unreachable library"),
    "analyzerDiagnostic": ("PRN-DART-003", "Analyzer unused diagnostic"),
    "route": ("PRN-ROUTE-001", "Unused route"),
    "localizationKey": ("PRN-L10N-001", "Unused localization key"),
    "diRegistration": ("PRN-DI-001", "Unused DI registration"),
}
UNKNOWN = ("PRN-UNKNOWN-001", "Unknown finding")
#: Schemes whose adapter has another name.
ADAPTERS = {"asset": "assets", "duplicate": "duplicates"}
#: The actions that may be taken, by adapter and kind.
ACTIONS = {
    ("assets", "asset"): "Move to quarantine",
    ("dart", "declaration"): "Remove declaration",
    ("dart", "dartLibrary"): "Remove empty library and stale imports",
}
#: The nine predicates in order, and what is said of one that fails.
PREDICATES = {
    "rule_allows_auto_fix": "rule not on auto-fix allowlist",
    "unreachable_everywhere": "reachable in at least one target",
    "not_retained": "node is retained in a configured or auxiliary execution context",
    "no_dynamic_blockers": "an unresolved dynamic construct could match",
    "not_protected": "node is protected",
    "no_public_api_risk": "node may be part of a public API surface",
    "deterministic_inverse": "edit is not reversibly invertible",
    "coverage_complete": "analysis target/root coverage is incomplete",
    "action_supported": "no supported apply action exists",
}
#: Codes of the reasons, in order.
REASONS = (
    "incomplete-target-matrix", "incomplete-root-coverage", "package-review-only", "incomplete-graph-integrity", "retained-only", "duplicate-canonical-choice",
    "generated-code-uncertainty", "dynamic-reference", "unsupported-action", "non-deterministic-inverse", "external-consumers-not-scanned", "broad-removal-scope",
)
#: Codes of the risks, in the order of their names.
RISK_CODES = ("external-consumers-not-scanned", "broad-removal-scope")
#: The mode that a declared root coverage must have in each analysis mode.
ROOT_MODES = {"application": "applicationEntrypoints", "package": "packagePublicApi", "packageInternal": "packageInternal"}


def _kept(pairs) -> Column:
    """The values whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]), lambda x: x.isNotNull())


def _by(column: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def adapter_of(id_: Column, owner: Column) -> Column:
    """The owner of a node, else the adapter that its scheme names."""
    scheme = F.substring_index(id_, ":", 1)
    named = scheme
    for k, v in ADAPTERS.items():
        named = F.when(scheme == k, F.lit(v)).otherwise(named)
    return F.coalesce(owner, named)


def catalogued(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds adapter, rule_id and title. catalogue(adapter, kind, rule_id, title) overrides the built-in rules of the adapters it names."""
    rows = rows.withColumn("adapter", adapter_of(F.col("id"), F.col("owner")))
    known = catalogue.select(F.col("adapter").alias("a"), F.col("kind").alias("k"), F.col("rule_id").alias("own_rule"), F.col("title").alias("own_title"))
    adapters = catalogue.select(F.col("adapter").alias("held")).distinct()
    # A catalogue has a row per rule, whatever the number of findings.
    rows = rows.join(F.broadcast(known), (F.col("adapter") == F.col("a")) & (F.col("kind") == F.col("k")), "left").join(F.broadcast(adapters), F.col("adapter") == F.col("held"), "left")
    built_in = [_by(F.col("kind"), {k: v[i] for k, v in RULES.items()}, UNKNOWN[i]) for i in (0, 1)]
    rule, head = (F.coalesce(own, F.when(F.col("held").isNotNull(), F.lit(UNKNOWN[i])).otherwise(built_in[i])) for i, own in enumerate((F.col("own_rule"), F.col("own_title"))))
    title = F.concat(head, F.lit(": "), F.coalesce("display_name", "id"))
    return rows.withColumns({"rule_id": rule, "title": title}).drop("a", "k", "own_rule", "own_title", "held")


def capability(adapter: Column, kind: Column, removal_supported: Column, declaration_count: Column) -> tuple[Column, Column]:
    """Whether an action is on the list, and its name. Missing metadata lets assets and declarations be removed, but no library."""
    action = F.lit(None).cast("string")
    for (a, k), name in ACTIONS.items():
        free = F.coalesce(declaration_count == 0, F.lit(False)) if k == "dartLibrary" else F.coalesce(removal_supported, F.lit(True))
        action = F.when((adapter == a) & (kind == k) & free, F.lit(name)).otherwise(action)
    return action.isNotNull(), action


def coverage(matrix_status: Column, mode: Column, root_mode: Column, boundary: Column, external: Column, evaluated_equal: Column) -> dict[str, Column]:
    """matrix_complete, boundary_complete, external_covered and coverage_complete of declarations.

    A root mode that does not fit the analysis mode counts as inferred and covers nothing;
    application mode without a declaration is complete by itself.
    """
    wanted = _by(mode, ROOT_MODES, "")
    undeclared = root_mode.isNull() & (mode == "application")
    fits = F.coalesce((root_mode == wanted) | ((root_mode == "inferred") & ~boundary), F.lit(False))
    inside = F.when(undeclared, True).otherwise(fits & F.coalesce(boundary, F.lit(False)))
    outside = F.when(undeclared, True).otherwise(fits & F.coalesce(external, F.lit(False)))
    matrix = matrix_status == "declaredComplete"
    return {"matrix_complete": matrix, "boundary_complete": inside, "external_covered": outside, "coverage_complete": matrix & inside & evaluated_equal}


def same_targets(evaluated: DataFrame, declared: DataFrame) -> DataFrame:
    """One row, same: whether the evaluated targets are the declared ones, each as often, in all that defines a build."""

    def keyed(df):
        defines = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("dart_defines"))))
        return df.select("name", "platform", "entrypoint", "flavor", defines.alias("defines"))

    a, b = keyed(evaluated), keyed(declared)
    left = a.exceptAll(b).select(F.lit(1).alias("n")).unionByName(b.exceptAll(a).select(F.lit(1).alias("n")))
    return left.agg((F.count("*") == 0).alias("same"))


def assessed(rows: DataFrame, facts: dict[str, Column], mode: str = "application", broad: Column | None = None) -> DataFrame:
    """Adds predicates, risks, tier, reasons, why_not_safe and proposed_action to catalogued rows.

    ``facts`` has matrix_complete, boundary_complete, coverage_complete and integrity_complete. ``broad`` marks supported
    actions of wide scope; none of those on the list is.
    """
    able, action = capability(F.col("adapter"), F.col("kind"), F.col("removal_supported"), F.col("declaration_count"))
    external = F.coalesce(F.col("externally_addressable"), F.lit(False)) if mode == "packageInternal" else F.lit(False)
    kept = (F.size("retained_in") > 0) | (F.size("auxiliary_retained_in") > 0)
    blocked = F.size("blocker_reasons") > 0
    holds = {
        "rule_allows_auto_fix": able, "unreachable_everywhere": F.lit(True), "not_retained": ~kept, "no_dynamic_blockers": ~blocked & facts["integrity_complete"],
        "not_protected": ~F.col("is_protected"), "no_public_api_risk": ~external, "deterministic_inverse": able, "coverage_complete": facts["coverage_complete"], "action_supported": able,
    }
    rows = rows.withColumns(holds)
    rows = rows.withColumn("risks", _kept([(external, RISK_CODES[0]), (able & (F.lit(False) if broad is None else broad), RISK_CODES[1])]))
    hard = F.lit(True)
    for name in PREDICATES:
        if name != "no_public_api_risk":
            hard = hard & F.col(name)
    named = F.transform("risks", lambda r: F.when(r == RISK_CODES[0], RISKS[0]).otherwise(RISKS[1]))
    level = tier(F.col("is_protected"), F.col("kind"), hard, named, F.lit(mode == "package"))
    generated = F.exists("blocker_reasons", lambda r: F.lower(r).contains("generated"))
    when = (
        ~facts["matrix_complete"] | ~facts["coverage_complete"], ~facts["boundary_complete"], F.lit(mode == "package"), ~facts["integrity_complete"], kept,
        F.col("kind") == "duplicateGroup", blocked & generated, blocked & ~generated, ~able, ~able, F.array_contains("risks", RISK_CODES[0]), F.array_contains("risks", RISK_CODES[1]),
    )
    rows = rows.withColumns({"tier": level, "reasons": _kept(zip(when, REASONS))})
    failed = _kept([(~F.col(name), text) for name, text in PREDICATES.items()])
    why = F.when((F.col("tier") != "safe") & (F.size(failed) > 0), F.array_join(failed, "; "))
    return rows.withColumns({"why_not_safe": why, "proposed_action": F.when(F.col("tier").isin("safe", "high"), action)})


def reportable(rows: DataFrame, schemes: list[str] | None = None) -> DataFrame:
    """Without the kinds that are never reported, and only of the schemes asked for."""
    rows = rows.where(~F.col("kind").isin(*NOT_REPORTED))
    return rows if schemes is None else rows.where(F.substring_index("id", ":", 1).isin(*schemes))


def with_evidence(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds evidence: that of all edges into the node, sorted."""
    held = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("evidence")).alias("evidence"))
    return rows.join(held, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(held.schema["evidence"].dataType)))


def totals(rows: DataFrame, adapters: DataFrame) -> DataFrame:
    """dimension, value, n: by tier, adapter, adapter and tier (both zero-filled, executed adapters included), rule, kind and reason, in one pass."""

    def pair(dimension, value):
        return F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))

    both = lambda a, t: F.concat_ws("/", a, t)
    fixed = [pair("tier", F.col("tier")), pair("adapter", F.col("adapter")), pair("adapter_tier", both(F.col("adapter"), F.col("tier"))), pair("rule", F.col("rule_id")), pair("kind", F.col("kind"))]
    tagged = F.concat(F.array(*fixed), F.transform("reasons", lambda r: pair("reason", r)))
    counted = rows.select(F.explode(tagged).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    tiers = F.array(*map(F.lit, TIERS))
    names = adapters.select("adapter").unionByName(rows.select("adapter")).distinct()
    zero = names.select(F.explode(F.concat(F.array(pair("adapter", F.col("adapter"))), F.transform(tiers, lambda t: pair("adapter_tier", both(F.col("adapter"), t))))).alias("x")).select("x.*")
    zero = zero.unionByName(rows.sparkSession.createDataFrame([("tier", t) for t in TIERS], "dimension string, value string"))
    return counted.unionByName(zero.withColumn("n", F.lit(0).cast("bigint"))).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def affected(rows: DataFrame) -> DataFrame:
    """findings, affected: all findings, and those with an active blocker."""
    return rows.agg(F.count("*").alias("findings"), F.count_if(F.size("blocker_reasons") > 0).alias("affected"))
