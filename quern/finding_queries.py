"""Registered queries of whole findings, their statistics and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalogue import _FOUND, QUERIES, _findings, _read, query
from quern.operators import assessment, facts, runs
from quern.operators.findings import allowed
from quern.plans.materialise import cut
from quern.plans.projection import Graph

__all__ = ["QUERIES"]

_KINDS = ("asset", "duplicateGroup", "declaration", "dartLibrary", "analyzerDiagnostic", "route", "localizationKey", "diRegistration", "package")
_SCHEMES = ("asset", "duplicate", "dart", "dart", "dart", "go_router", "l10n", "get_it", "package")
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_MODES = ("application", "packageInternal", "package")

#: Parts as candidates: kinds by size, metadata by key, retaining contexts from line items, active blockers from events.
_CANDIDATES = f"""
    n AS (SELECT p_partkey, {_LIST(_KINDS)}[p_size % 9 + 1] AS kind, {_LIST(_SCHEMES)}[p_size % 9 + 1] || ':' || p_partkey AS id,
            CASE WHEN p_partkey % 10 = 0 THEN 'custom' WHEN p_partkey % 3 > 0 THEN CASE p_size % 9 WHEN 0 THEN 'assets' WHEN 1 THEN 'duplicates' ELSE {_LIST(_SCHEMES)}[p_size % 9 + 1] END END AS owner,
            CASE WHEN p_partkey % 4 > 0 THEN p_name END AS display_name, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN true END AS removal_supported,
            CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS declaration_count, p_partkey % 7 = 0 AS externally_addressable, p_partkey % 13 = 0 AS is_protected
        FROM part WHERE p_size % 9 < 8),
    kept AS (SELECT l_partkey, list_sort(list(DISTINCT l_returnflag)) AS k FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 40 GROUP BY 1),
    aux AS (SELECT l_partkey, list_sort(list(DISTINCT l_linestatus)) AS k FROM lineitem WHERE l_linenumber = 6 AND l_quantity > 45 GROUP BY 1),
    b AS (SELECT user_id, list(DISTINCT event_type || CASE WHEN event_type = 'view' THEN ' Generated' ELSE '' END) AS rs FROM events WHERE event_type IN ('view', 'error') AND event_id % 20 = 0 GROUP BY 1),
    c AS (SELECT n.*, m.mode, coalesce(owner, CASE split_part(id, ':', 1) WHEN 'asset' THEN 'assets' WHEN 'duplicate' THEN 'duplicates' ELSE split_part(id, ':', 1) END) AS adapter,
            kept.k IS NOT NULL OR aux.k IS NOT NULL AS retained, rs IS NOT NULL AS blocked, rs IS NOT NULL AND len(list_filter(rs, lambda x: contains(lower(x), 'generated'))) > 0 AS generated
        FROM n CROSS JOIN (SELECT unnest({_LIST(_MODES)}) AS mode) m LEFT JOIN kept ON kept.l_partkey = p_partkey LEFT JOIN aux ON aux.l_partkey = p_partkey LEFT JOIN b ON b.user_id = p_partkey),
    a AS (SELECT *, CASE WHEN adapter = 'assets' AND kind = 'asset' AND coalesce(removal_supported, true) THEN 'Move to quarantine'
            WHEN adapter = 'dart' AND kind = 'declaration' AND coalesce(removal_supported, true) THEN 'Remove declaration'
            WHEN adapter = 'dart' AND kind = 'dartLibrary' AND coalesce(declaration_count = 0, false) THEN 'Remove empty library and stale imports' END AS action,
            mode = 'packageInternal' AND externally_addressable AS external FROM c),
    found AS (SELECT *, action IS NOT NULL AS able, CASE WHEN is_protected THEN 'protected' WHEN mode = 'package' OR kind = 'duplicateGroup' OR action IS NULL OR retained OR blocked THEN 'review' WHEN external THEN 'high' ELSE 'safe' END AS tier,
            CASE WHEN adapter = 'custom' THEN CASE kind WHEN 'asset' THEN 'CUS-001' ELSE 'PRN-UNKNOWN-001' END ELSE
                ['PRN-ASSET-001', 'PRN-DUP-001', 'PRN-DART-001', 'PRN-DART-002', 'PRN-DART-003', 'PRN-ROUTE-001', 'PRN-L10N-001', 'PRN-DI-001'][list_position({_LIST(_KINDS)}, kind)] END AS rule_id,
            CASE WHEN adapter = 'custom' THEN CASE kind WHEN 'asset' THEN 'Custom asset' ELSE 'Unknown finding' END ELSE
                ['Unused asset', 'Duplicate file', 'Unreachable declaration', 'Unreachable library', 'Analyzer unused diagnostic', 'Unused route', 'Unused localization key', 'Unused DI registration'][list_position({_LIST(_KINDS)}, kind)] END
                || ': ' || coalesce(display_name, id) AS title,
            list_filter([CASE WHEN mode = 'package' THEN 'package-review-only' END, CASE WHEN retained THEN 'retained-only' END, CASE WHEN kind = 'duplicateGroup' THEN 'duplicate-canonical-choice' END,
                CASE WHEN generated THEN 'generated-code-uncertainty' END, CASE WHEN blocked AND NOT generated THEN 'dynamic-reference' END, CASE WHEN action IS NULL THEN 'unsupported-action' END,
                CASE WHEN action IS NULL THEN 'non-deterministic-inverse' END, CASE WHEN external THEN 'external-consumers-not-scanned' END], lambda x: x IS NOT NULL) AS reasons,
            list_filter([CASE WHEN action IS NULL THEN 'rule not on auto-fix allowlist' END, CASE WHEN retained THEN 'node is retained in a configured or auxiliary execution context' END,
                CASE WHEN blocked THEN 'an unresolved dynamic construct could match' END, CASE WHEN is_protected THEN 'node is protected' END, CASE WHEN external THEN 'node may be part of a public API surface' END,
                CASE WHEN action IS NULL THEN 'edit is not reversibly invertible' END, CASE WHEN action IS NULL THEN 'no supported apply action exists' END], lambda x: x IS NOT NULL) AS failed FROM a)"""


def _candidates(spark, sf_dir):
    part, line, events = (_read(spark, sf_dir, t) for t in ("part", "lineitem", "events"))
    k, size = F.col("p_partkey"), (F.col("p_size") % 9)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), size + 1)
    scheme = pick(_SCHEMES)
    owner = F.when(k % 10 == 0, "custom").when(k % 3 > 0, F.when(size == 0, "assets").when(size == 1, "duplicates").otherwise(scheme))
    nodes = part.select(
        k, pick(_KINDS).alias("kind"), F.concat(scheme, F.lit(":"), k.cast("string")).alias("id"), owner.alias("owner"), F.when(k % 4 > 0, F.col("p_name")).alias("display_name"),
        F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("removal_supported"), F.when(k % 4 == 0, 0).when(k % 4 == 1, 2).alias("declaration_count"),
        (k % 7 == 0).alias("externally_addressable"), (k % 13 == 0).alias("is_protected"),
    )
    held = lambda where, flag, name: line.where(where).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_set(flag)).alias(name))
    reason = F.concat("event_type", F.when(F.col("event_type") == "view", " Generated").otherwise(""))
    stops = events.where("event_type IN ('view', 'error') AND event_id % 20 = 0").groupBy(F.col("user_id").alias("p_partkey")).agg(F.collect_set(reason).alias("blocker_reasons"))
    rows = nodes.join(held("l_linenumber = 7 AND l_quantity > 40", "l_returnflag", "retained_in"), "p_partkey", "left")
    rows = rows.join(held("l_linenumber = 6 AND l_quantity > 45", "l_linestatus", "auxiliary_retained_in"), "p_partkey", "left").join(stops, "p_partkey", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("retained_in", "auxiliary_retained_in", "blocker_reasons")})
    catalogue = spark.createDataFrame([("custom", "asset", "CUS-001", "Custom asset")], "adapter string, kind string, rule_id string, title string")
    return assessment.catalogued(assessment.reportable(rows), catalogue)


_COMPLETE = ("matrix_complete", "boundary_complete", "coverage_complete", "integrity_complete")


def _assessed(spark, sf_dir, modes=_MODES):
    rows = cut(_candidates(spark, sf_dir))
    out = None
    for mode in modes:
        one = assessment.assessed(rows, {c: F.lit(True) for c in _COMPLETE}, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_CANDIDATES} SELECT id, mode, adapter, rule_id, title, tier, array_to_string(reasons, ',') AS reasons,
    CASE WHEN tier <> 'safe' AND len(failed) > 0 THEN array_to_string(failed, '; ') END AS why_not_safe, CASE WHEN tier IN ('safe', 'high') THEN action END AS proposed_action FROM found""")
def assessed_findings(spark, sf_dir):
    rows = _assessed(spark, sf_dir)
    return rows.select("id", "mode", "adapter", "rule_id", "title", "tier", F.array_join("reasons", ",").alias("reasons"), "why_not_safe", "proposed_action")


@query(f"""WITH {_CANDIDATES} SELECT id, mode, tier, able AS rule_allows_auto_fix, NOT retained AS not_retained, NOT blocked AS no_dynamic_blockers, NOT is_protected AS not_protected, NOT external AS no_public_api_risk,
    able AS deterministic_inverse, tier = 'safe' AND mode = 'application' OR mode = 'packageInternal' AND tier IN ('safe', 'high') AS may_apply FROM found""")
def safety_predicates(spark, sf_dir):
    rows = _assessed(spark, sf_dir).withColumns({"no_blockers": F.col("no_dynamic_blockers"), "external": ~F.col("no_public_api_risk")})
    may = F.lit(False)
    for mode in _MODES:
        may = F.when(F.col("mode") == mode, allowed(mode)).otherwise(may)
    return rows.select("id", "mode", "tier", "rule_allows_auto_fix", "not_retained", "no_dynamic_blockers", "not_protected", "no_public_api_risk", "deterministic_inverse", may.alias("may_apply"))


_ADAPTERS = ("assets", "dart", "go_router", "idle")
_TIERS = "['protected', 'review', 'high', 'safe']"


@query(f"""WITH {_CANDIDATES}, f AS (SELECT * FROM found WHERE mode = 'packageInternal'), names AS (SELECT unnest({_LIST(_ADAPTERS)}) AS adapter UNION SELECT adapter FROM f)
    SELECT 'tier' AS dimension, t AS value, (SELECT count(*) FROM f WHERE tier = t) AS n FROM unnest({_TIERS}) AS x(t)
    UNION ALL SELECT 'adapter', adapter, (SELECT count(*) FROM f WHERE f.adapter = names.adapter) FROM names
    UNION ALL SELECT 'adapter_tier', adapter || '/' || t, (SELECT count(*) FROM f WHERE f.adapter = names.adapter AND tier = t) FROM names, unnest({_TIERS}) AS x(t)
    UNION ALL SELECT 'rule', rule_id, count(*) FROM f GROUP BY rule_id UNION ALL SELECT 'kind', kind, count(*) FROM f GROUP BY kind
    UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(reasons) AS r FROM f) GROUP BY r""")
def finding_totals(spark, sf_dir):
    adapters = spark.createDataFrame([(a,) for a in _ADAPTERS], "adapter string")
    return assessment.totals(_assessed(spark, sf_dir, ("packageInternal",)), adapters)


@query(f"WITH {_CANDIDATES} SELECT count(*) AS findings, count(*) FILTER (blocked) AS affected FROM found WHERE mode = 'application'")
def affected_findings(spark, sf_dir):
    return assessment.affected(_candidates(spark, sf_dir))


@query("""SELECT 'part:' || l_partkey AS id, string_agg(e, ',' ORDER BY e) AS evidence FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag || '-' || l_linestatus AS e FROM lineitem WHERE l_quantity > 30)
    GROUP BY l_partkey UNION ALL SELECT 'part:' || p_partkey, '' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)""")
def finding_evidence(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem").where("l_quantity > 30")
    edges = line.select(F.concat(F.lit("part:"), "l_partkey").alias("dst"), "l_suppkey", F.concat_ws("-", "l_returnflag", "l_linestatus").alias("evidence")).distinct()
    nodes = _read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    return assessment.with_evidence(nodes, edges).select("id", F.array_join("evidence", ",").alias("evidence"))


@query("""WITH d AS (SELECT p_name AS name, p_brand AS platform, p_type AS entrypoint, CASE WHEN p_size > 25 THEN 'f' END AS flavor, p_size % 3 AS k FROM part),
    e AS (SELECT name, platform, entrypoint, flavor, k FROM d), g AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE k = 1)
    SELECT 'same' AS matrix, (SELECT count(*) FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM e)) + (SELECT count(*) FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM d)) = 0 AS same
    UNION ALL SELECT 'repeated', (SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM d)) + (SELECT count(*) FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM g)) = 0""")
def target_equivalence(spark, sf_dir):
    two = F.create_map(F.lit("b"), F.lit("1"), F.lit("k"), (F.col("p_size") % 3).cast("string"))
    turned = F.create_map(F.lit("k"), (F.col("p_size") % 3).cast("string"), F.lit("b"), F.lit("1"))
    of = lambda defines: _read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("platform"), F.col("p_type").alias("entrypoint"), F.when(F.col("p_size") > 25, "f").alias("flavor"), defines.alias("dart_defines"), (F.col("p_size") % 3).alias("k"))
    a, b = of(two), of(turned)
    more = a.unionByName(a.where("k = 1"))
    return assessment.same_targets(a, b).select(F.lit("same").alias("matrix"), "same").unionByName(assessment.same_targets(more, b).select(F.lit("repeated").alias("matrix"), "same"))


_COVER = """SELECT p_partkey, ['declaredComplete', 'declaredPartial', 'inferredDefault'][p_size % 3 + 1] AS matrix_status, ['application', 'package', 'packageInternal'][p_partkey % 3 + 1] AS mode,
    CASE p_partkey % 5 WHEN 0 THEN 'applicationEntrypoints' WHEN 1 THEN 'packagePublicApi' WHEN 2 THEN 'packageInternal' WHEN 3 THEN 'inferred' END AS root_mode, p_partkey % 2 = 0 AS boundary, p_partkey % 7 > 0 AS outside FROM part"""


@query(f"""WITH c AS ({_COVER}), f AS (SELECT *, CASE WHEN root_mode IS NULL AND mode = 'application' THEN true WHEN root_mode = CASE mode WHEN 'application' THEN 'applicationEntrypoints' WHEN 'package' THEN 'packagePublicApi' ELSE 'packageInternal' END THEN true
        WHEN root_mode = 'inferred' AND NOT boundary THEN true ELSE false END AS fits, root_mode IS NULL AND mode = 'application' AS free FROM c)
    SELECT p_partkey, matrix_status = 'declaredComplete' AS matrix_complete, free OR (fits AND boundary) AS boundary_complete, free OR (fits AND outside) AS external_covered, matrix_status = 'declaredComplete' AND (free OR (fits AND boundary)) AS coverage_complete FROM f""")
def coverage_model(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    root = F.when(k % 5 == 0, "applicationEntrypoints").when(k % 5 == 1, "packagePublicApi").when(k % 5 == 2, "packageInternal").when(k % 5 == 3, "inferred")
    rows = _read(spark, sf_dir, "part").select(k, pick(F.col("p_size") % 3, ("declaredComplete", "declaredPartial", "inferredDefault")).alias("matrix_status"), pick(k % 3, ("application", "package", "packageInternal")).alias("mode"), root.alias("root_mode"), (k % 2 == 0).alias("boundary"), (k % 7 > 0).alias("outside"))
    facts_ = assessment.coverage(F.col("matrix_status"), F.col("mode"), F.col("root_mode"), F.col("boundary"), F.col("outside"), F.lit(True))
    return rows.select("p_partkey", *[c.alias(name) for name, c in facts_.items()])


_REPORT = f"""WITH {_CANDIDATES}, f AS (SELECT *, coalesce(kept.k, []) AS retained_in, coalesce(aux.k, []) AS auxiliary_retained_in FROM found LEFT JOIN kept ON kept.l_partkey = found.p_partkey LEFT JOIN aux ON aux.l_partkey = found.p_partkey WHERE mode = 'packageInternal')"""
_Q = lambda key, expr: f"'\"{key}\":' || {expr}"
_S = lambda expr: f"to_json({expr})::VARCHAR"


@query(f"""{_REPORT} SELECT id, '{{' || array_to_string(list_filter([{_Q("ruleId", _S("rule_id"))}, {_Q("reportingAdapterId", _S("adapter"))}, {_Q("confidence", _S("upper(tier)"))}, {_Q("title", _S("title"))},
    '"node":{{' || array_to_string(list_filter([{_Q("id", _S("id"))}, {_Q("kind", _S("kind"))}, {_Q("displayName", _S("display_name"))}, {_Q("origin", _S("'file:///' || p_partkey"))}], lambda x: x IS NOT NULL), ',') || '}}',
    '"predicates":{{' || array_to_string([{_Q("ruleAllowsAutoFix", _S("able"))}, '"unreachableAcrossAllTargets":true', {_Q("notRetained", _S("NOT retained"))}, {_Q("noDynamicBlockers", _S("NOT blocked"))}, {_Q("notProtected", _S("NOT is_protected"))},
        {_Q("noPublicApiRisk", _S("NOT external"))}, {_Q("hasDeterministicInverse", _S("able"))}, '"analysisCoverageComplete":true', {_Q("actionSupported", _S("able"))}], ',') || '}}',
    {_Q("classificationReasons", _S("reasons"))}, {_Q("manualRiskCodes", _S("CASE WHEN external THEN ['external-consumers-not-scanned'] ELSE []::VARCHAR[] END"))}, {_Q("applyEligible", _S("tier IN ('safe', 'high')"))},
    {_Q("retainedIn", _S("retained_in"))}, {_Q("auxiliaryRetainedIn", _S("auxiliary_retained_in"))}, CASE WHEN is_protected THEN '"protectionReasons":["kept by rule"]' END,
    {_Q("proposedAction", _S("CASE WHEN tier IN ('safe', 'high') THEN action END"))}, {_Q("whyNotSafe", _S("CASE WHEN tier <> 'safe' AND len(failed) > 0 THEN array_to_string(failed, '; ') END"))}], lambda x: x IS NOT NULL), ',') || '}}' AS payload FROM f""")
def report_findings(spark, sf_dir):
    rows = _assessed(spark, sf_dir, ("packageInternal",)).withColumns({
        "origin": F.concat(F.lit("file:///"), F.col("p_partkey").cast("string")), "protection_reasons": F.when(F.col("is_protected"), F.array(F.lit("kept by rule"))).otherwise(F.array().cast("array<string>")),
        "blocker_ids": F.array().cast("array<string>"), "no_blockers": F.col("no_dynamic_blockers"), "external": ~F.col("no_public_api_risk"),
    })
    return rows.select("id", runs.finding_json("packageInternal").alias("payload"))


@query(f"""WITH {_CANDIDATES}, t AS (SELECT id, rule_id, tier, title, CASE WHEN tier <> 'safe' AND len(failed) > 0 THEN array_to_string(failed, '; ') END AS why FROM found WHERE mode = 'application')
    SELECT id, '[' || rule_id || ' ' || upper(tier) || '] ' || title || coalesce(' — ' || why, '') AS line, '<tr><td>' || rule_id || '</td><td>' || tier || '</td><td>' || title || '</td></tr>' AS html FROM t""")
def report_lines(spark, sf_dir):
    return _assessed(spark, sf_dir, ("application",)).select("id", runs.human_line().alias("line"), runs.html_row().alias("html"))


@query("""SELECT 'customer:' || user_id AS id, string_agg(event_type, ',' ORDER BY event_id) AS reasons FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id""")
def protection_reasons(spark, sf_dir):
    e = _read(spark, sf_dir, "events").where("event_type IN ('error', 'signup')")
    rows = facts.protections(e.select(F.concat(F.lit("customer:"), "user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("reason")))
    return rows.select("id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT 'node' AS fact, p_type AS kind, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'edge', l_returnflag, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'root', '*', count(*) FROM orders UNION ALL SELECT 'blocker', '*', count(*) FROM events""")
def graph_counts(spark, sf_dir):
    of = lambda t, c: _read(spark, sf_dir, t).select(F.col(c).alias("kind"))
    return facts.counts(of("part", "p_type"), of("lineitem", "l_returnflag"), of("orders", "o_orderstatus"), of("events", "event_type"))


@query("""WITH r AS (SELECT 'aux:test:' || user_id AS id, event_type AS domain, event_id AS seq FROM events WHERE event_id % 7 = 0), f AS (SELECT id, arg_min(domain, seq) AS domain FROM r GROUP BY id)
    SELECT f.id, f.domain, (SELECT count(DISTINCT r.domain) FROM r WHERE r.id = f.id) - 1 AS issues, (SELECT count(DISTINCT event_id % 11) FROM events e WHERE 'aux:test:' || e.user_id = f.id AND e.event_type = f.domain) AS roots FROM f""")
def auxiliary_registry(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("id", F.concat(F.lit("aux:test:"), F.col("user_id").cast("string")))
    accepted, issues, stops = facts.auxiliary_targets(e.where("event_id % 7 = 0").select("id", F.col("event_type").alias("domain"), F.col("event_id").alias("seq")), ["domain"])
    definition = F.sha2(F.to_json(F.struct("id", F.col("event_type").alias("domain"))), 256)
    roots = facts.auxiliary_roots(e.select(F.concat(F.lit("node:"), (F.col("event_id") % 11).cast("string")).alias("node_id"), F.lit("root").alias("reason"), F.col("id").alias("aux_id"), definition.alias("definition")), accepted)
    held = roots.groupBy(F.col("aux_id").alias("id")).agg(F.count("*").alias("roots"))
    found = issues.join(stops.select(F.substring_index("reason", " ", -1).alias("id")).distinct(), "id").groupBy("id").agg(F.count("*").alias("issues"))
    return accepted.join(found, "id", "left").join(held, "id", "left").select("id", "domain", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("roots", F.lit(0)).alias("roots"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '1:a|' || len(CASE WHEN event_id % 2 = 0 THEN '6:string|0:' ELSE 'null' END) || ':' || CASE WHEN event_id % 2 = 0 THEN '6:string|0:' ELSE 'null' END END AS part,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE len('1:a|' || len(CASE WHEN event_id % 2 = 0 THEN '6:string|0:' ELSE 'null' END) || ':' || CASE WHEN event_id % 2 = 0 THEN '6:string|0:' ELSE 'null' END) || ':' || '1:a|' || len(CASE WHEN event_id % 2 = 0 THEN '6:string|0:' ELSE 'null' END) || ':' || CASE WHEN event_id % 2 = 0 THEN '6:string|0:' ELSE 'null' END END AS form FROM events""")
def metadata_forms(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 2 == 0, '{"a": ""}').otherwise('{"a": null}')
    rows = facts.with_metadata_form(_read(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    return rows.select("event_id", F.when(F.col("form") != "", F.regexp_replace("form", r"^\d+:", "")).alias("part"), "form")


_LINES = f"""{_FOUND}, b AS (SELECT DISTINCT 'blocker-' || substr(sha256(producer || chr(0) || 'unresolved' || chr(0) || chr(0) || source || chr(0) || space || chr(0)), 1, 16) AS blocker_id, producer, source, space FROM blockers),
    br AS (SELECT blocker_id, row_number() OVER (ORDER BY blocker_id) AS n, '"' || blocker_id || '":{{"producer":"' || producer || '","sourceNodeId":"' || source || '","affectedNamespace":"' || space || '"}}' AS text FROM b),
    fr AS (SELECT row_number() OVER (ORDER BY list_position(['protected', 'review', 'high', 'safe'], tier), id) AS n, '{{"id":"' || id || '","kind":"' || kind || '","confidence":"' || upper(tier) || '","classificationReasons":[' || array_to_string(list_transform(reasons, lambda x: '"' || x || '"'), ',') || ']}}' AS text FROM found),
    nb AS (SELECT count(*) AS b FROM br), nf AS (SELECT count(*) AS f FROM fr),
    document AS (SELECT 0 AS place, '{{' AS line UNION ALL SELECT 1, '"version":3,' UNION ALL SELECT 2, '"statistics":{{"total":' || f || '}},' FROM nf
        UNION ALL SELECT 3, '"blockers":{{' UNION ALL SELECT 3 + n, text || CASE WHEN n < b THEN ',' ELSE '' END FROM br, nb UNION ALL SELECT 4 + b, '}},' FROM nb
        UNION ALL SELECT 5 + b, '"findings":[' FROM nb UNION ALL SELECT 5 + b + n, text || CASE WHEN n < f THEN ',' ELSE '' END FROM fr, nb, nf UNION ALL SELECT 6 + b + f, ']' FROM nb, nf UNION ALL SELECT 7 + b + f, '}}' FROM nb, nf)"""


def _document(spark, sf_dir):
    from quern import documents

    found = cut(_findings(spark, sf_dir).select("id", "kind", "tier", "reasons"))
    rank = F.array_position(F.array(*map(F.lit, ("protected", "review", "high", "safe"))), F.col("tier"))
    rows = found.select(rank.alias("rank"), "id", F.to_json(F.struct("id", "kind", F.upper("tier").alias("confidence"), F.col("reasons").alias("classificationReasons"))).alias("text"))
    blockers = Graph(spark, sf_dir).blockers().select("producer", "reason", "location", F.col("source_node_id"), "affected_namespace", "affected_node_ids")
    value = F.to_json(F.struct("producer", F.col("source_node_id").alias("sourceNodeId"), F.col("affected_namespace").alias("affectedNamespace")))
    held = runs.blocker_registry(blockers).withColumn("value", value).select("blocker_id", documents.map_entry("blocker_id").alias("text"))
    entries = [("version", "3"), ("statistics", f'{{"total":{found.count()}}}'), ("blockers", documents.Section(held, ["blocker_id"], "{}")), ("findings", documents.Section(rows, ["rank", "id"]))]
    return documents.document(spark, entries)


@query(f"{_LINES} SELECT * FROM document")
def report_document(spark, sf_dir):
    """The report as one document, line by line: head, registry of blockers, findings in order."""
    return _document(spark, sf_dir)


@query(f"""{_LINES} SELECT place + 3 AS place, replace(line, '<', chr(92) || 'u003c') AS line FROM document UNION ALL SELECT 0, '<!doctype html>' UNION ALL SELECT 1, '<title>Findings</title>'
    UNION ALL SELECT 2, '<script type="application/json" id="report">' UNION ALL SELECT max(place) + 4, '</script>' FROM document""")
def report_page(spark, sf_dir):
    """The report as a page that holds the document."""
    from quern import documents

    return documents.page(cut(_document(spark, sf_dir)), "Findings")
