"""Inventories and references of assets, routes, registrations and messages; scans of paths and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.conditions import blocker_id, segments
from quern.operators.closure import addressed
from quern.plans.materialise import bounded

#: Directories and files that no scan enters.
EXCLUDED_DIRECTORIES = (".agent", ".agents", ".claude", ".codex", ".dart_tool", ".fvm", ".git", ".gradle", ".idea", ".vscode", "Pods", "build", "coverage", "node_modules")
EXCLUDED_FILES = (".DS_Store", "Thumbs.db")
#: Fixed value: values that one bounded string may take before it counts as unbounded.
MOST_VALUES = 64


def exclusion_reason(path: Column, directories=EXCLUDED_DIRECTORIES, files=EXCLUDED_FILES) -> Column:
    """directory:<name> of the first excluded directory, file:<name>, or null."""
    parts = segments(path)
    names = F.array(*map(F.lit, directories))
    first = F.get(F.filter(parts, lambda x: F.array_contains(names, x)), F.lit(0))
    last = F.get(parts, F.size(parts) - 1)
    return F.when(F.size(parts) == 0, None).when(first.isNotNull(), F.concat(F.lit("directory:"), first)).when(last.isin(*files), F.concat(F.lit("file:"), last))


def exclusions(paths: DataFrame, **rules) -> DataFrame:
    """reason, paths: distinct excluded paths by reason."""
    return paths.select("path", exclusion_reason(F.col("path"), **rules).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count_distinct("path").alias("paths"))


def variant_families(files: DataFrame) -> DataFrame:
    """files(path, size_bytes) -> base, variants, size_bytes: a base with its copies in sibling folders such as 2.0x."""
    parts = F.split("path", "/")
    folder = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    is_variant = folder.rlike(r"^\d+(\.\d+)?x$")
    base = F.when(is_variant, F.array_join(F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), F.array(F.element_at(parts, -1))), "/")).otherwise(F.col("path"))
    grouped = files.select(base.alias("base"), is_variant.alias("v"), "size_bytes").groupBy("base")
    sums = grouped.agg(F.count_if("v").alias("variants"), F.sum("size_bytes").alias("size_bytes"), F.count_if(~F.col("v")).alias("bases"))
    return sums.where("bases > 0").drop("bases")


def asset_references(uses: DataFrame, assets: DataFrame, namespace: str) -> DataFrame:
    """uses(use_id, exact_values, pattern), assets(key) -> use_id, outcome, kind, targets.

    A finite set of values gives edges to the assets among them, a pattern blocks the
    assets that match it (none: nothing), anything else blocks the namespace. Patterns
    are met through the literal beginning that they share with a key, not pair by pair.
    """
    finite = uses.where("exact_values is not null")
    edges = finite.select("use_id", F.size(F.array_distinct("exact_values")).alias("n"), F.explode(F.array_distinct("exact_values")).alias("key")).join(assets.select("key").distinct(), "key")
    edges = edges.groupBy("use_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("key")).alias("targets"))
    edges = edges.select("use_id", F.lit("edge").alias("outcome"), F.when(F.col("n") == 1, "constString").otherwise("finiteStringSet").alias("kind"), "targets")
    wild = uses.where("exact_values is null and pattern is not null")
    literal = F.regexp_extract("pattern", r"^\^?([A-Za-z0-9_/-]*)(?![?*+{|])", 1)
    asked = bounded(wild.select("pattern", literal.alias("start")).distinct())
    lengths = F.array(*[F.lit(r[0]) for r in asked.select(F.length("start")).distinct().collect()]).cast("array<int>")
    keys = assets.select("key").distinct().withColumn("start", F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))))
    met = keys.join(asked, "start").where(F.expr("key rlike pattern")).groupBy("pattern").agg(F.array_sort(F.collect_set("key")).alias("targets"))
    blocks = wild.join(met, "pattern").select("use_id", F.lit("id_blocker").alias("outcome"), F.lit("pattern").alias("kind"), "targets")
    open_ = uses.where("exact_values is null and pattern is null").select("use_id", F.lit("namespace_blocker").alias("outcome"), F.lit(namespace).alias("kind"), F.array().cast("array<string>").alias("targets"))
    return edges.unionByName(blocks).unionByName(open_)


def string_products(left: Column, right: Column) -> Column:
    """All joins of two finite sets of strings; null (unbounded) if either is, or beyond the bound."""
    pairs = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, b))))
    out = F.array_sort(F.array_distinct(pairs))
    return F.when(F.size(out) <= MOST_VALUES, out)


def route_conflicts(routes: DataFrame) -> DataFrame:
    """routes(node_id, full_path, name) -> node_id, path_usable, name_usable: paths and names that two hold are not."""
    of = lambda c, out: routes.where(F.col(c).isNotNull()).groupBy(c).agg((F.count("*") == 1).alias(out))
    both = routes.join(of("full_path", "path_usable"), "full_path", "left").join(of("name", "name_usable"), "name", "left")
    return both.select("node_id", F.coalesce("path_usable", F.lit(False)).alias("path_usable"), F.coalesce("name_usable", F.lit(False)).alias("name_usable"))


def named_navigations(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """nav_id, outcome, target: a unique name is an edge, an unknown one nothing, one that is not constant blocks the namespace."""
    held = routes.where("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"))
    outcome = F.when(F.col("name").isNull(), "namespace_blocker").when(F.col("n").isNull(), "none").when(F.col("n") == 1, "edge").otherwise("id_blocker")
    return asked.join(held, "name", "left").select("nav_id", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("first_id")).alias("target"))


def lookups_all(requests: DataFrame, registrations: DataFrame, key: str) -> DataFrame:
    """request_id, candidates, outcome of asking for all of a type: edges unless one is uncertain."""
    held = registrations.groupBy(key).agg(F.count("*").alias("candidates"), F.bool_or("uncertain").alias("doubt"))
    n = F.coalesce("candidates", F.lit(0))
    outcome = F.when(n == 0, "namespace_blocker").when(F.col("doubt"), "id_blocker").otherwise("edges")
    return requests.join(held, key, "left").select("request_id", n.alias("candidates"), outcome.alias("outcome"))


def placeholder_mismatches(messages: DataFrame) -> DataFrame:
    """messages(key, locale, is_template, message) -> key, locale where the {placeholders} differ from the template's.

    In messages with a plural or a select, a brace right after a selector opens a text, not a placeholder.
    """
    name = r"\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*[,}]"
    found = lambda pattern: F.regexp_extract_all("message", F.lit(pattern), F.lit(1))
    choosing = F.col("message").rlike(r",\s*(plural|select|selectordinal)\s*,")
    held = messages.withColumn("held", F.array_sort(F.array_distinct(F.when(choosing, found(r"(?<![A-Za-z0-9])" + name)).otherwise(found(name)))))
    template = held.where("is_template").select("key", F.col("held").alias("wanted"))
    return held.where("not is_template").join(template, "key").where(F.col("held") != F.col("wanted")).select("key", "locale")


def normal_locale(text: Column) -> Column:
    """language[_Script][_REGION] in normal case, or null."""
    parts = F.split(F.translate(text, "-", "_"), "_")
    language, second, third = F.lower(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    is_script = second.rlike("^[A-Za-z]{4}$")
    script = F.when(is_script, F.initcap(second))
    region = F.upper(F.when(is_script, third).otherwise(second))
    ok = language.rlike("^[a-z]{2,3}$") & F.coalesce(region.rlike("^([A-Z]{2}|[0-9]{3})$"), F.lit(True)) & (F.size(parts) <= F.when(is_script, 3).otherwise(2))
    return F.when(F.coalesce(ok, F.lit(False)), F.concat_ws("_", language, script, region))


def repeated_json_keys(text: Column) -> Column:
    """Keys that the outer object of a JSON text holds more than once."""
    keys = F.array_sort(F.json_object_keys(text))
    # Equal keys are neighbours once sorted, so no key is looked for among all others.
    rest = F.greatest(F.size(keys) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(keys, 1, rest).alias("a"), F.slice(keys, 2, rest).alias("b"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda x: x["a"] == x["b"]), lambda x: x["a"]))


def blocker_counts(blockers: DataFrame, active: DataFrame, nodes: DataFrame) -> DataFrame:
    """producer, recorded, distinct_blockers, active, unbound (addressing no node)."""
    six = ("producer", "reason", "location", "source_node_id", "affected_namespace", "affected_node_ids")
    with_id = lambda df: df.withColumn("blocker_id", blocker_id(*map(F.col, six)))
    rows = with_id(blockers)
    listed = rows.select("blocker_id", F.explode("affected_node_ids").alias("id")).join(nodes.select("id"), "id", "left_semi").select("blocker_id").distinct().withColumn("lists", F.lit(True))
    spaces = addressed(blockers, nodes).select("affected_namespace").distinct().withColumn("covers", F.lit(True))
    on = with_id(active).select("blocker_id").distinct().withColumn("is_active", F.lit(True))
    marked = rows.join(on, "blocker_id", "left").join(listed, "blocker_id", "left").join(spaces, "affected_namespace", "left")
    whole = F.col("affected_namespace").isNull() & (F.coalesce(F.size("affected_node_ids"), F.lit(0)) <= 0)
    bound = F.coalesce("covers", F.lit(False)) | F.coalesce("lists", F.lit(False)) | whole
    return marked.groupBy("producer").agg(F.sum("recorded").alias("recorded"), F.count("*").alias("distinct_blockers"), F.count_if(F.col("is_active").isNotNull()).alias("active"), F.count_if(~bound).alias("unbound"))


def measurements(findings: DataFrame, kind: str, size: str) -> DataFrame:
    """kind, known, unknown, total: sums over known sizes; null where every size is unknown."""
    return findings.groupBy(kind).agg(F.count(size).alias("known"), F.count_if(F.col(size).isNull()).alias("unknown"), F.sum(size).alias("total"))
