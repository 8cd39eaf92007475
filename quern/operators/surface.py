"""Fixed points and selections over libraries: exported names, units, conditional directives, ownership of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.materialise import bounded, cut

#: Owners in the lists of names that are broadcast at most; beyond, the tasks that a name's list is dealt to.
BROADCAST_OWNERS, PARTS = 1_000_000, 16


def exported_names(own: DataFrame, exports: DataFrame) -> DataFrame:
    """library, name, exact: own(library, name) and what comes through exports(library, target, exact, show, hide).

    A null ``show`` lets every name pass. A name is exact if any path to it is.
    """
    seen = front = cut(own.select("library", "name", F.lit(True).alias("exact")).distinct())
    shown = F.col("show").isNull() | F.array_contains("show", F.col("name"))
    hidden = F.coalesce(F.array_contains("hide", F.col("name")), F.lit(False))
    ways = cut(exports.select("library", "target", F.col("exact").alias("way_exact"), "show", "hide"))
    while not front.isEmpty():
        passed = ways.join(front.withColumnRenamed("library", "target"), "target").where(F.coalesce(shown, F.lit(False)) & ~hidden)
        new = passed.groupBy("library", "name").agg(F.bool_or(F.col("exact") & F.col("way_exact")).alias("exact"))
        old = seen.select("library", "name", F.col("exact").alias("old"))
        front = cut(new.join(old, ["library", "name"], "left").where("old is null or (exact and not old)").select("library", "name", "exact"))
        seen = cut(seen.unionByName(front).groupBy("library", "name").agg(F.bool_or("exact").alias("exact")))
    return seen


def selected_alternatives(alternatives: DataFrame, key: list[str]) -> DataFrame:
    """The alternatives(key, position, outcome true/false/unknown, ...) that a directive may take, and whether that is exact.

    Nothing after the first true one is possible, nor any false one; an unknown one leaves the choice open.
    """
    before = Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.coalesce(F.max((F.col("outcome") == "true").cast("int")).over(before), F.lit(0)) == 1
    doubted = F.coalesce(F.max((F.col("outcome") == "unknown").cast("int")).over(before), F.lit(0)) == 1
    marked = alternatives.withColumns({"_settled": settled, "exact": (F.col("outcome") == "true") & ~doubted})
    return marked.where(~F.col("_settled") & (F.col("outcome") != "false")).drop("_settled")


def owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, owner: roots(name, root) by the longest root that holds the path; external without one, unknown if two share it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    held = roots.groupBy(F.rtrim("root", F.lit("/")).alias("root")).agg(F.when(F.count_distinct("name") == 1, F.min("name")).otherwise("unknown").alias("owner"))
    asked = paths.select("path").distinct()
    hits = asked.select("path", F.explode(above).alias("root")).join(bounded(held), "root")
    best = hits.groupBy("path").agg(F.max_by("owner", F.length("root")).alias("owner"))
    return asked.join(best, "path", "left").select("path", F.coalesce("owner", F.lit("external")).alias("owner"))


def package_owners(paths: DataFrame, listed: DataFrame, manifests: DataFrame, selected: str) -> DataFrame:
    """path, ownership (selected, external or unknown), package: listed(name, root) by the longest root, unless a nearer manifest(root) or a root of two names contradicts it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = paths.select("path").distinct()
    offered = asked.select("path", F.explode(above).alias("root"))
    held = listed.groupBy(F.rtrim("root", F.lit("/")).alias("root")).agg(F.count_distinct("name").alias("names"), F.min("name").alias("package"))
    best = offered.join(bounded(held), "root").groupBy("path").agg(F.max_by(F.struct("root", "names", "package"), F.length("root")).alias("c"))
    near = offered.join(bounded(manifests.select(F.rtrim("root", F.lit("/")).alias("root")).distinct()), "root").groupBy("path").agg(F.max(F.length("root")).alias("near"))
    met = asked.join(best, "path", "left").join(near, "path", "left")
    clear = F.col("c").isNotNull() & (F.col("c.names") == 1) & (F.coalesce("near", F.lit(0)) <= F.length("c.root"))
    ownership = F.when(F.coalesce(clear, F.lit(False)), F.when(F.col("c.package") == selected, "selected").otherwise("external")).otherwise("unknown")
    return met.select("path", ownership.alias("ownership"), F.when(ownership != "unknown", F.col("c.package")).alias("package"))


def repeated_names(own: DataFrame) -> DataFrame:
    """library, name of what a library declares more than once: an issue of its surface."""
    return own.groupBy("library", "name").agg(F.count("*").alias("n")).where("n > 1").select("library", "name")


def directive_issues(alternatives: DataFrame, key: list[str]) -> DataFrame:
    """The directives that leave their choice open: with an unknown alternative before the first true one, or with none that can hold."""
    first = alternatives.groupBy(*key).agg(F.min(F.when(F.col("outcome") == "true", F.col("position"))).alias("yes"), F.min(F.when(F.col("outcome") == "unknown", F.col("position"))).alias("maybe"))
    open_ = F.col("maybe").isNotNull() & (F.col("yes").isNull() | (F.col("maybe") < F.col("yes")))
    reason = F.when(open_, "condition is not known").when(F.col("yes").isNull(), "no alternative holds")
    return first.select(*key, reason.alias("reason")).where("reason is not null")


def reference_candidates(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs(ref_id, name, can_dispatch), names(name, owner_id, kind) -> ref_id, candidates, outcome.

    A name may be any top-level or member of that name, a dispatched one also any owner of
    noSuchMethod; a nameless reference blocks its namespace, an unmatched name nothing.

    Each name has its list once; a row for each reference and owner is never made. References
    that share a ref_id share their candidates.
    """
    caught = names.where("name = 'noSuchMethod'").agg(F.array_sort(F.collect_set("owner_id")).alias("caught"))
    lists = names.groupBy("name").agg(F.array_sort(F.collect_set("owner_id")).alias("own"))
    lists = cut(lists.crossJoin(F.broadcast(caught)).select("name", "own", F.array_sort(F.array_union("own", "caught")).alias("any")))
    asked, keys = refs, ["name"]
    if (lists.agg(F.sum(F.size("any"))).first()[0] or 0) <= BROADCAST_OWNERS:
        lists = F.broadcast(lists)
    else:
        # Few names may have nearly all references: a name's list goes to several tasks.
        asked, keys = asked.withColumn("_part", F.pmod(F.xxhash64("ref_id"), F.lit(PARTS)).cast("int")), ["name", "_part"]
        lists = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = asked.join(lists, keys, "left").crossJoin(F.broadcast(caught))
    none = F.array().cast(lists.schema["own"].dataType)
    of = F.when(F.col("ref_id").isNull() | F.col("name").isNull(), none).when(F.col("can_dispatch"), F.coalesce("any", "caught")).otherwise(F.coalesce("own", none))
    found = met.select("ref_id", "name", of.alias("candidates"))
    again = cut(refs.where("ref_id is not null").groupBy("ref_id").agg(F.count("*").alias("n")).where("n > 1").select("ref_id"))
    if not again.isEmpty():
        shared = found.join(again, "ref_id")
        one = shared.groupBy("ref_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("candidates"))
        found = found.join(again, "ref_id", "left_anti").unionByName(shared.drop("candidates").join(one, "ref_id"))
    outcome = F.when(F.col("name").isNull(), "namespace_blocker").when(F.size("candidates") > 0, "id_blocker").otherwise("none")
    return found.select("ref_id", "candidates", outcome.alias("outcome"))
