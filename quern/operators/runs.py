"""Runs: contributions of adapters, actions, apply rounds, outcomes, verification, reports and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.conditions import blocker_id, context_domain
from quern.operators.assessment import PREDICATES
from quern.operators.findings import allowed

#: How a transaction may end, and states of a file's case with what may come before each.
TERMINAL = ("committed", "rolledBackVerified", "recoveryRequired", "nonTerminal")
CASE_BEFORE = {"backedUp": [None], "applied": ["backedUp"], "kept": ["applied"], "rolledBack": ["backedUp", "applied"], "failed": ["backedUp", "applied", "rolledBack"]}
#: Outcomes that need a transaction.
TRANSACTIONAL = ("committed", "rejectedRecovered", "recoveryRequired")
#: Kinds of details that an adapter may declare.
DETAIL_TYPES = ("text", "path", "integer", "boolean", "bytes", "paths")
#: Adapter and rule of each kind of candidate, and the kinds that are never more than review.
CONTRACTS = {
    "dartLibrary": ("dart", "PRN-DART-002"), "dartDeclaration": ("dart", "PRN-DART-001"), "analyzerDiagnostic": ("dart", "PRN-DART-003"), "asset": ("assets", "PRN-ASSET-001"),
    "duplicateGroup": ("duplicates", "PRN-DUP-001"), "getItRegistration": ("get_it", "PRN-DI-001"), "route": ("go_router", "PRN-ROUTE-001"), "localizationKey": ("l10n", "PRN-L10N-001"),
}
ACTIONABLE = ("dartLibrary", "dartDeclaration", "asset")
#: Names of the predicates in reports, in their order.
WIRE_PREDICATES = dict(zip(PREDICATES, ("ruleAllowsAutoFix", "unreachableAcrossAllTargets", "notRetained", "noDynamicBlockers", "notProtected", "noPublicApiRisk", "hasDeterministicInverse", "analysisCoverageComplete", "actionSupported")))


def contributions(adapters: DataFrame, facts: DataFrame) -> DataFrame:
    """adapters(adapter, role, status, micros), facts(producer, fact, key) -> how many nodes, edges and blockers each adapter was the first to add."""
    first = facts.groupBy("fact", "key").agg(F.min_by("producer", "seq").alias("adapter"))
    added = first.groupBy("adapter").pivot("fact", ["node", "edge", "blocker"]).count()
    n = [F.coalesce(c, F.lit(0)).alias(f"{c}s_added") for c in ("node", "edge", "blocker")]
    return adapters.join(added, "adapter", "left").select("adapter", "role", "status", "micros", *n)


def apply_counters(transactions: DataFrame) -> DataFrame:
    """run_id, begun, one column per way to end, and whether these sum up to what was begun; transactions(run_id, state: null if unknown)."""
    ends = [F.count_if(F.col("state") == t).alias(t) for t in TERMINAL]
    rows = transactions.groupBy("run_id").agg(F.count("*").alias("begun"), *ends)
    return rows.withColumn("partitioned", F.col("begun") == sum(F.col(t) for t in TERMINAL))


def detail_rows(findings: DataFrame, details: DataFrame) -> DataFrame:
    """findings(id, adapter, kind, metadata), details(adapter, kind, key, type) -> id, key, value: declared details whose value has the declared type, as JSON.

    Anything else is left out; lists keep their texts only, sorted.
    """
    v = F.parse_json("metadata")
    met = findings.withColumn("v", v).join(F.broadcast(details), ["adapter", "kind"])  # a row per declared detail
    raw = F.expr("get_json_object(metadata, concat('$.', key))")
    shape = F.expr("schema_of_variant(try_variant_get(v, concat('$.', key), 'variant'))")
    whole = shape.startswith("BIGINT")
    texts = F.array_sort(F.filter(F.from_json(raw, "array<variant>"), lambda x: F.call_function("schema_of_variant", x) == "STRING").cast("array<string>"))
    kind = F.col("type")
    value = F.when(kind.isin("text", "path") & (shape == "STRING"), F.to_json(F.struct(raw.alias("v")))).when((kind == "integer") & whole, raw).when((kind == "bytes") & whole & (F.expr("try_cast(" + "get_json_object(metadata, concat('$.', key))" + " AS bigint)") >= 0), raw)
    value = value.when((kind == "boolean") & (shape == "BOOLEAN"), raw).when((kind == "paths") & shape.startswith("ARRAY"), F.to_json(texts))
    return met.select("id", "key", value.alias("value")).where("value is not null")


# Reports.


def blocker_registry(blockers: DataFrame) -> DataFrame:
    """blocker_id and the blocker, one row per different blocker."""
    six = ("producer", "reason", "location", "source_node_id", "affected_namespace", "affected_node_ids")
    return blockers.select(blocker_id(*map(F.col, six)).alias("blocker_id"), *six).dropDuplicates(["blocker_id"])


def finding_json(mode: str) -> Column:
    """An assessed finding as a compact JSON object in the report's order of fields; fields without a value are left out where the format says so."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    node = F.struct("id", "kind", F.col("display_name").alias("displayName"), "origin")
    predicates = F.struct(*[F.col(c).alias(w) for c, w in WIRE_PREDICATES.items()])
    eligible = allowed(mode) & F.col("coverage_complete") & F.col("deterministic_inverse")
    return F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), F.col("adapter").alias("reportingAdapterId"), F.upper("tier").alias("confidence"), "title", node.alias("node"), predicates.alias("predicates"),
        F.col("reasons").alias("classificationReasons"), F.array_sort("risks").alias("manualRiskCodes"), eligible.alias("applyEligible"), F.col("retained_in").alias("retainedIn"),
        F.col("auxiliary_retained_in").alias("auxiliaryRetainedIn"), some("protection_reasons").alias("protectionReasons"), some("blocker_ids").alias("blockerIds"),
        F.col("proposed_action").alias("proposedAction"), F.col("why_not_safe").alias("whyNotSafe"),
    ))


def human_line() -> Column:
    """A finding as a line of text for a terminal."""
    return F.concat(F.lit("["), "rule_id", F.lit(" "), F.upper("tier"), F.lit("] "), "title", F.coalesce(F.concat(F.lit(" — "), "why_not_safe"), F.lit("")))


def html_row() -> Column:
    """A finding as a table row; every text is escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    cells = [F.concat(F.lit("<td>"), safe(F.col(c)), F.lit("</td>")) for c in ("rule_id", "tier", "title")]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


# Actions and rounds.


def actions(findings: DataFrame, variants: DataFrame, importers: DataFrame, companions: DataFrame) -> DataFrame:
    """finding, action_id, path, operation, counts: every file operation of the findings.

    findings(id, kind, path, unit), variants(id, path), importers(id, path, directive), companions(id, path). An asset's variants go
    with it, a library's generated companions too; files that import a library lose the directive unless they go themselves.
    """
    of = findings.select("id", F.col("path").alias("own"), "kind", "unit")
    drop = lambda rows, tag: rows.select("id", "unit", F.concat("id", F.lit(f"@{tag}:"), "path").alias("action_id"), "path", F.lit("deleteFile").alias("operation"), F.lit(False).alias("counts"))
    more = drop(variants.join(of.where("kind = 'asset'"), "id"), "variant").unionByName(drop(companions.join(of.where("kind = 'dartLibrary'"), "id"), "generated"))
    gone = of.where("kind = 'dartLibrary'").select(F.col("own").alias("path"), "unit").distinct()
    stale = importers.join(of.where("kind = 'dartLibrary'"), "id").where("path <> own").join(gone, ["path", "unit"], "left_anti")
    stale = stale.groupBy("id", "unit", "path").agg(F.min("directive").alias("directive"))
    clean = stale.select("id", "unit", F.concat("id", F.lit("@"), "directive", F.lit(":"), "path").alias("action_id"), "path", F.lit("cleanupImports").alias("operation"), F.lit(False).alias("counts"))
    main = of.select("id", "unit", F.col("id").alias("action_id"), F.col("own").alias("path"), F.when(F.col("kind") == "dartLibrary", "deleteFile").otherwise("removeFinding").alias("operation"), F.lit(True).alias("counts"))
    return main.unionByName(more).unionByName(clean)


def round_outcomes(units: DataFrame, needs: DataFrame, rejected: DataFrame) -> DataFrame:
    """unit_id, outcome of one apply round: units(unit_id), needs(unit_id, needs_id), rejected(unit_id).

    A unit whose verification failed is rejected and restored; every unit that it needs, directly or through others, is skipped, as is what it would have freed; the rest is committed.
    """
    from quern.operators.closure import closure

    ways = needs.select(F.col("unit_id").alias("src"), F.col("needs_id").alias("dst"))
    held = closure(rejected.select(F.lit("").alias("context"), F.col("unit_id").alias("id")), ways).select(F.col("id").alias("unit_id"))
    stop = rejected.select("unit_id", F.lit("rejectedRecovered").alias("outcome"))
    skip = held.join(rejected, "unit_id", "left_anti").select("unit_id", F.lit("skippedDependency").alias("outcome"))
    return units.select("unit_id").join(stop.unionByName(skip), "unit_id", "left").select("unit_id", F.coalesce("outcome", F.lit("committed")).alias("outcome"))


def transaction_id(round_: Column, unit_id: Column) -> Column:
    return F.concat(F.lit("tx-r"), F.lpad(round_.cast("string"), 3, "0"), F.lit("-"), F.substring_index(unit_id, ":", -1))


def edited_sources(sources: DataFrame, spans: DataFrame) -> DataFrame:
    """sources(path, text), spans(path, start, end) -> path, text without the spans; spans must not overlap; the text ends with one line end unless it is empty."""
    held = spans.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text = F.col("text")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s, x):
        kept = F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int"))
        return F.struct(x["end"].cast("bigint").alias("at"), F.concat(s["out"], kept).alias("out"))

    rest = F.aggregate("spans", first, step, lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, 1 << 30)))
    trimmed = F.regexp_replace(F.when(F.col("spans").isNull(), text).otherwise(rest), r"\s+$", "")
    return sources.join(held, "path", "left").select("path", F.when(trimmed == "", "").otherwise(F.concat(trimmed, F.lit("\n"))).alias("text"))


# Ledger.


def case_violations(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events of file cases whose state may not follow the one before it."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    ok = F.lit(False)
    for state, earlier in CASE_BEFORE.items():
        here = F.col("before").isNull() if earlier == [None] else F.coalesce(F.col("before").isin(*earlier), F.lit(False))
        ok = F.when(F.col("state") == state, here).otherwise(ok)
    return events.withColumn("before", before).where(~ok)


def quarantine_listing(events: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, state, cases by their last state, restorable bytes: what list and inspect show. events(run_id, case_id, seq, state, size_bytes)."""
    last = events.groupBy("run_id", "case_id").agg(F.max_by(F.struct("state", "size_bytes"), "seq").alias("x")).select("run_id", "x.*")
    held = F.col("state").isin("backedUp", "applied", "failed")
    summed = last.groupBy("run_id").agg(F.count("*").alias("cases"), F.count_if(held).alias("open_cases"), F.sum(F.when(held, F.col("size_bytes")).otherwise(0)).alias("restorable_bytes"))
    return runs.join(summed, "run_id", "left").select("run_id", "state", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cases", "open_cases", "restorable_bytes")])


def outcome_violations(outcomes: DataFrame) -> DataFrame:
    """finding_id, problem: outcomes(finding_id, status, reason_code, reason, transaction_id, rollback_verified) that lack what their status needs."""
    back = F.coalesce("rollback_verified", F.lit(False))
    rules = (
        (F.coalesce(F.length("reason_code"), F.lit(0)) * F.coalesce(F.length("reason"), F.lit(0)) == 0, "no reason"),
        ((F.col("status") == "rejectedRecovered") & ~back, "no verified rollback"),
        ((F.col("status") == "recoveryRequired") & back, "verified rollback"),
        (F.col("status").isin(*TRANSACTIONAL) & F.col("transaction_id").isNull(), "no transaction"),
    )
    problem = F.explode(F.filter(F.array(*[F.when(c, F.lit(text)) for c, text in rules]), lambda x: x.isNotNull()))
    return outcomes.select("finding_id", problem.alias("problem"))


def selection_violations(selections: DataFrame) -> DataFrame:
    """run_id, problem: selections(run_id, mode, requested, planned, fingerprint) whose lists are not sorted sets, or that plan more than was asked for."""

    def set_like(c):
        return (F.array_sort(F.array_distinct(c)) == F.col(c)) & ~F.array_contains(c, "")

    rules = (
        (~set_like("requested"), "requested ids are not a sorted set"),
        (~set_like("planned"), "planned ids are not a sorted set"),
        ((F.col("mode") == "exact") & (F.size("requested") == 0), "exact selection without ids"),
        ((F.col("mode") == "allEligible") & (F.size("requested") > 0), "ids in a selection of everything"),
        ((F.col("mode") == "exact") & (F.size(F.array_except("planned", "requested")) > 0), "plan beyond the request"),
        (~F.coalesce(F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(True)), "fingerprint is no SHA-256"),
        ((F.size("planned") == 0) != F.col("fingerprint").isNull(), "fingerprint does not go with a plan"),
    )
    problem = F.explode(F.filter(F.array(*[F.when(c, F.lit(text)) for c, text in rules]), lambda x: x.isNotNull()))
    return selections.select("run_id", problem.alias("problem"))


# Verification.


def policy_hash(commands: DataFrame) -> DataFrame:
    """policy_id, hash, steps: commands(policy_id, seq, id, executable, arguments) as one hash of their ordered JSON, with the parser that each one's shape calls for."""
    tool = F.when(F.col("executable").isin("flutter", "dart"), F.get("arguments", F.lit(0))).when((F.col("executable") == "fvm") & F.coalesce(F.get("arguments", F.lit(0)).isin("flutter", "dart"), F.lit(False)), F.get("arguments", F.lit(1)))
    parser = F.when(tool == "analyze", "humanAnalyzer").when(tool == "test", "compactTest").otherwise("opaque")
    one = F.struct("seq", F.struct("id", "executable", "arguments", parser.alias("parserKind")).alias("c"))
    # A policy has a handful of commands.
    held = commands.groupBy("policy_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return held.select("policy_id", F.sha2(F.to_json(F.col("x.c")), 256).alias("hash"), F.size("x").alias("steps"))


def complete_runs(runs: DataFrame, steps: DataFrame, required: DataFrame) -> DataFrame:
    """run_id, complete: whether the steps of a run are just the required ones, each once and with the parser asked for. steps(run_id, name, parser), required(name, parser)."""
    wanted = required.agg(F.array_sort(F.collect_list(F.struct("name", "parser"))).alias("wanted"), (F.count("*") == F.count_distinct("name")).alias("unique"))
    held = steps.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("name", "parser"))).alias("held"))
    met = runs.join(held, "run_id", "left").crossJoin(F.broadcast(wanted))  # one row
    return met.select("run_id", F.coalesce((F.col("held") == F.col("wanted")) & F.col("unique") & (F.size("wanted") > 0), F.lit(False)).alias("complete"))


def verification_gates(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """run_id, kind, detail: what is worse than the baseline, and what makes a comparison impossible.

    Rows are steps (run_id, name, policy, toolchain, exit_code, fingerprints: array of digests). A step that passed and fails is new;
    of one that failed before, the fingerprints that it has more often than then.
    """
    b = baseline.select("name", F.col("policy").alias("old_policy"), F.col("toolchain").alias("old_toolchain"), F.col("exit_code").alias("old_exit"), F.col("fingerprints").alias("old_prints"))
    met = candidate.join(b, "name", "left")
    gate = lambda rows, kind, detail: rows.select("run_id", F.lit(kind).alias("kind"), detail.alias("detail"))
    stop = gate(met.where("policy <> old_policy").select("run_id").distinct(), "infrastructure", F.lit("verification policy does not match baseline"))
    stop = stop.unionByName(gate(met.where("toolchain <> old_toolchain").select("run_id").distinct(), "infrastructure", F.lit("verification toolchain does not match baseline")))
    stop = stop.unionByName(gate(met.where("exit_code < 0"), "infrastructure", F.concat("name", F.lit(": not run"))))
    ran = met.where("exit_code >= 0")
    stop = stop.unionByName(gate(ran.where("old_exit is null"), "infrastructure", F.concat("name", F.lit(": missing stored baseline step"))))
    stop = stop.unionByName(gate(ran.where("old_exit is not null and exit_code <> 0 and size(fingerprints) = 0"), "infrastructure", F.concat("name", F.lit(": nonzero exit without stable diagnostic evidence"))))
    judged = ran.where("old_exit is not null and (exit_code = 0 or size(fingerprints) > 0)")
    fell = gate(judged.where("old_exit = 0 and exit_code <> 0"), "new", F.concat("name", F.lit(": command changed from pass to fail")))
    red = judged.where("old_exit <> 0 and exit_code <> 0")
    now = red.select("run_id", "name", F.explode("fingerprints").alias("p")).groupBy("run_id", "name", "p").agg(F.count("*").alias("n"))
    then = baseline.select("name", F.explode("fingerprints").alias("p")).groupBy("name", "p").agg(F.count("*").alias("m"))
    more = now.join(then, ["name", "p"], "left").withColumn("d", F.col("n") - F.coalesce("m", F.lit(0))).where("d > 0")
    each = gate(more.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("d")))), "new", F.concat("name", F.lit(": fingerprint "), "p"))
    return stop.unionByName(fell).unionByName(each)


def baseline_evidence(steps: DataFrame) -> DataFrame:
    """run_id, name, digest, n: fingerprints of failures as digests with their counts; no output of a verifier is kept."""
    each = steps.select("run_id", "name", F.explode("fingerprints").alias("p"))
    return each.groupBy("run_id", "name", F.sha2("p", 256).alias("digest")).agg(F.count("*").alias("n"))


# Accuracy.


def oracle_case_violations(cases: DataFrame) -> DataFrame:
    """case_id, problem: cases(case_id, contexts, reachable, retained, truth, expected) that contradict themselves."""
    rules = (
        (F.size(F.array_except("reachable", "retained")) > 0, "reachable beyond retained"),
        (F.size(F.array_except("retained", "contexts")) > 0, "unknown context"),
        ((F.size("reachable") > 0) & (F.col("expected") == "shouldReport"), "reachable candidate should be reported"),
        ((F.size("retained") > 0) & (F.col("truth") == "removableInDeclaredScope"), "retained candidate is removable"),
    )
    problem = F.explode(F.filter(F.array(*[F.when(c, F.lit(text)) for c, text in rules]), lambda x: x.isNotNull()))
    return cases.select("case_id", problem.alias("problem"))


def finding_contracts(cases: DataFrame) -> DataFrame:
    """case_id, adapter, rule_id, tier (null: no finding), apply_eligible of cases(case_id, kind, expected, truth, mode, protected, gates, api_known, risks).

    ``gates``: whether all hard gates are known to hold; ``api_known``: whether the public surface is known.
    """
    kind = F.col("kind")
    adapter, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (a, r) in CONTRACTS.items():
        adapter, rule = F.when(kind == k, F.lit(a)).otherwise(adapter), F.when(kind == k, F.lit(r)).otherwise(rule)
    removable, risks = F.col("truth") == "removableInDeclaredScope", F.size("risks")
    tier = F.when(F.col("expected") != "shouldReport", None).when(~kind.isin(*ACTIONABLE), "REVIEW").when(F.col("protected"), "PROTECTED").when(F.col("mode") == "package", "REVIEW")
    tier = tier.when(~removable | ~F.col("api_known") | ~F.col("gates"), "REVIEW").when(risks == 0, "SAFE").when(risks == 1, "HIGH").otherwise("REVIEW")
    internal = (tier == "SAFE") | ((tier == "HIGH") & F.array_contains("risks", "external-consumers-not-scanned"))
    eligible = (F.col("expected") == "shouldReport") & removable & F.when(F.col("mode") == "application", tier == "SAFE").when(F.col("mode") == "package-internal", internal).otherwise(False)
    return cases.select("case_id", adapter.alias("adapter"), rule.alias("rule_id"), tier.alias("tier"), F.coalesce(eligible, F.lit(False)).alias("apply_eligible"))


def membership_violations(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """context, id, problem: members(context, id) of contexts that are not canonical, that repeat, or that are no nodes."""
    counted = members.groupBy("context", "id").agg(F.count("*").alias("n"))
    odd = ~F.coalesce(context_domain(F.col("context")).isin("configuredTarget", "auxiliary"), F.lit(False))
    met = counted.join(nodes.select("id").distinct().withColumn("known", F.lit(True)), "id", "left")
    rules = ((odd, "context is not canonical"), (F.col("n") > 1, "repeated id"), (F.col("known").isNull(), "unknown node"))
    problem = F.explode(F.filter(F.array(*[F.when(c, F.lit(text)) for c, text in rules]), lambda x: x.isNotNull()))
    return met.select("context", "id", problem.alias("problem"))


def registry_violations(adapters: DataFrame, rules: DataFrame, reserved: DataFrame) -> DataFrame:
    """subject, problem: adapters(adapter, scheme, built_in), rules(adapter, rule_id, title), reserved(name) that clash.

    Adapter ids, schemes and rules have one owner; built-in names are reserved; texts must not be empty.
    """
    twice = adapters.groupBy("adapter").agg(F.count_distinct("built_in").alias("n")).where("n > 1").select(F.col("adapter").alias("subject"), F.lit("adapter is registered twice").alias("problem"))
    scheme = adapters.groupBy("scheme").agg(F.count_distinct("adapter").alias("n")).where("n > 1").select(F.col("scheme").alias("subject"), F.lit("scheme has several owners").alias("problem"))
    owner = rules.groupBy("rule_id").agg(F.count_distinct("adapter").alias("n")).where("n > 1").select(F.col("rule_id").alias("subject"), F.lit("rule has several owners").alias("problem"))
    taken = adapters.where("not built_in").select(F.col("adapter").alias("name")).distinct().join(reserved, "name", "left_semi").select(F.col("name").alias("subject"), F.lit("name is reserved").alias("problem"))
    blank = rules.where("trim(rule_id) = '' or trim(title) = ''").select(F.col("adapter").alias("subject"), F.lit("empty text in the catalogue").alias("problem")).distinct()
    return twice.unionByName(scheme).unionByName(owner).unionByName(taken).unionByName(blank)
