"""Graphs put together from extracted facts: contexts and their roots, execution edges, assets, libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.conditions import bag_digest, context_domain, generated_path, sanitised_id
from quern.operators.closure import closure
from quern.plans.materialise import cut

#: Fixed value: passes after which accessors that still grow are left as they are.
ACCESSOR_PASSES = 64


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def blocker_rows(rows: DataFrame, producer: str, reason: Column, source: Column | None = None, namespace: Column | None = None, ids: Column | None = None, location: Column | None = None) -> DataFrame:
    """Rows as blockers; a missing part is null, missing ids are none."""
    parts = {"location": location, "source_node_id": source, "affected_namespace": namespace}
    return rows.select(
        F.lit(producer).alias("producer"), reason.alias("reason"), *[(_none() if c is None else c).alias(name) for name, c in parts.items()],
        (F.array().cast("array<string>") if ids is None else ids).alias("affected_node_ids"),
    )


# Contexts.


def context_facts(libraries: DataFrame, targets: DataFrame, public: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """libraries(path, node_id, owner, has_main, is_test, environment_complete), targets(name, entrypoint), public(path) -> contexts, roots, issues.

    Contexts (id, domain, environment_complete, reason) and roots (context, node_id, reason): the configured
    entrypoints, tests, public libraries for external consumers, and other files with a main function as
    programs of their own. An entrypoint outside the selected package is an issue and no root.
    """
    app = targets.join(libraries.withColumnRenamed("path", "entrypoint"), "entrypoint", "left")
    mine = F.coalesce(F.col("owner") == "selected", F.lit(False))
    context = F.when(F.col("name").startswith("app:"), F.col("name")).otherwise(F.concat(F.lit("app:"), "name"))
    app_context = app.select(context.alias("id"), F.lit("configured").alias("domain"), F.lit(True).alias("environment_complete"), F.lit("configured target").alias("reason")).distinct()
    main = F.explode(F.array(F.struct(F.col("node_id").alias("node_id"), F.lit("contains main() entry point").alias("reason")), F.struct(F.concat("node_id", F.lit("#main")).alias("node_id"), F.lit("main() entry point").alias("reason"))))
    app_roots = app.where(mine).select(context.alias("context"), main.alias("x")).select("context", "x.*")
    issue = F.when(F.col("owner") == "external", "dart-root-external-package").otherwise("dart-root-ownership-unknown")
    issues = app.where(~mine).select(F.col("entrypoint").alias("path"), issue.alias("code"))

    def auxiliary(rows, kind, reason):
        id_ = F.concat(F.lit(f"aux:{kind}:"), sanitised_id(F.col("path")))
        return rows.select(id_.alias("id"), F.lit("auxiliary").alias("domain"), "environment_complete", F.lit(reason).alias("reason"), "node_id")

    own = libraries.where("owner = 'selected'")
    tests = auxiliary(own.where("is_test and has_main"), "test", "test entry library")
    outside = auxiliary(own.join(public, "path", "left_semi"), "external", "public package entry library imported by external consumers")
    started = targets.select(F.col("entrypoint").alias("path"))
    programs = auxiliary(own.where("has_main and not is_test").join(started, "path", "left_anti"), "runtime", "unclassified main() entry point")
    aux = tests.unionByName(outside).unionByName(programs)
    contexts = app_context.unionByName(aux.select("id", "domain", "environment_complete", "reason").distinct())
    return contexts, app_roots.unionByName(aux.select(F.col("id").alias("context"), "node_id", "reason")).distinct(), issues


def mirrored(contexts: DataFrame, roots: DataFrame, issues: DataFrame, matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots that may enter the graph, and blockers.

    contexts(id, domain), roots(context, node_id, reason), issues(code, reason, node_id: null if everything is meant), matrix(name).
    The configured contexts must be those of the matrix; roots of unknown contexts are left out; an issue blocks its root or everything.
    """
    wanted = matrix.select(F.when(F.col("name").startswith("app:"), F.col("name")).otherwise(F.concat(F.lit("app:"), "name")).alias("id")).distinct()
    held = contexts.where("domain = 'configured'").select("id").distinct()
    if not wanted.exceptAll(held).isEmpty() or not held.exceptAll(wanted).isEmpty():
        raise ValueError("the configured contexts are not those of the target matrix")
    known = roots.join(contexts.select(F.col("id").alias("context")), "context", "left_semi")
    reason = F.concat("code", F.lit(": "), "reason")
    return known, blocker_rows(issues, "dart", reason, ids=F.when(F.col("node_id").isNotNull(), F.array("node_id")).otherwise(F.array().cast("array<string>")))


def inventory_differences(configured: DataFrame, auxiliary: DataFrame, observed: DataFrame) -> DataFrame:
    """id, problem: contexts (id) that a report lacks, has besides, declares twice or names in a form that is not canonical. No row: the report may be written."""
    expected = configured.select("id").unionByName(auxiliary.select("id"))
    counted = expected.groupBy("id").count()
    lost = counted.join(observed, "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    more = observed.select("id").distinct().join(counted, "id", "left_anti").select("id", F.lit("unexpected").alias("problem"))
    twice = counted.where("count > 1").select("id", F.lit("duplicate").alias("problem"))
    odd = counted.where(~F.coalesce(context_domain(F.col("id")).isin("configuredTarget", "auxiliary"), F.lit(False))).select("id", F.lit("not canonical").alias("problem"))
    return lost.unionByName(more).unionByName(twice).unionByName(odd)


# Libraries.


def library_reach(seeds: DataFrame, directives: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """seeds(context, id), directives(context, src, dst, exact), units(library, path) -> units reached, issues and a content digest, by context.

    A library stands for all its units. A reached library without units and a reached directive that is
    not exact are issues. The digest is of the sorted unit paths and issues, so equal results have equal digests.
    """
    libraries = cut(closure(seeds, directives.select("context", "src", "dst"), per_context=True))
    held = libraries.join(units.select(F.col("library").alias("id"), "path"), "id", "left")
    reached = held.where("path is not null").select("context", "path").distinct()
    lost = held.where("path is null").select("context", F.col("id").alias("subject"), F.lit("library has no units").alias("reason"))
    doubt = directives.where("not exact").join(libraries.withColumnRenamed("id", "src"), ["context", "src"], "left_semi").select("context", F.concat("src", F.lit(" -> "), "dst").alias("subject"), F.lit("directive is not exact").alias("reason"))
    issues = lost.unionByName(doubt).distinct()
    lines = reached.select("context", F.concat(F.lit("unit "), "path").alias("line")).unionByName(issues.select("context", F.concat(F.lit("issue "), "subject", F.lit(": "), "reason").alias("line")))
    digest = lines.groupBy("context").agg(bag_digest("line").alias("digest"))
    return reached, issues, digest


def external_walk(seeds: DataFrame, imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files outside the package that seeds(id) pull in, and issues: imports(src, dst, conditional), files(id, owner, readable).

    The walk goes on through readable files of other packages only; a file that cannot be read, one of unknown
    owner and a conditional import are issues and end it there.
    """
    through = files.where("owner = 'external' and readable").select(F.col("id").alias("src"))
    ways = imports.where("not conditional").join(through, "src", "left_semi").select("src", "dst")
    seen = cut(closure(seeds.select(F.lit("").alias("context"), "id"), ways).select("id"))
    met = seen.join(files, "id", "left")
    issue = F.when(F.col("owner").isNull() | (F.col("owner") == "unknown"), "unknown owner").when((F.col("owner") == "external") & ~F.col("readable"), "not readable")
    first = met.select("id", issue.alias("reason")).where("reason is not null")
    conditional = imports.where("conditional").join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(through, "src", "left_semi").select(F.col("src").alias("id"), F.lit("conditional import").alias("reason")).distinct()
    return seen, first.unionByName(conditional)


def accessor_assets(direct: DataFrame, wrappers: DataFrame, passes: int = ACCESSOR_PASSES) -> DataFrame:
    """element, key: the assets of generated accessors, direct(element, key) and through wrappers(element, target), so many passes deep at most."""
    seen = cut(direct.select("element", "key").distinct())
    front, ways = seen, cut(wrappers.select("element", F.col("target").alias("inner")).distinct())
    for _ in range(passes):
        more = ways.join(front.withColumnRenamed("element", "inner"), "inner").select("element", "key").distinct()
        front = cut(more.join(seen, ["element", "key"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def execution_edges(directives: DataFrame, owners: DataFrame, namespace: str, package: str) -> tuple[DataFrame, DataFrame]:
    """directives(src, dst, kind, exact, condition_key), owners(id, owner, dependency) -> edges(src, dst, kind, exact, condition_key), blockers.

    A selected target is an edge to it, one of another package an edge to that package's boundary, one of unknown owner blocks the namespace from its source.
    """
    met = directives.join(owners.withColumnRenamed("id", "dst"), "dst", "left")
    boundary = F.concat(F.lit(f"dart-package:{package}/"), "dependency")
    far = F.when(F.col("owner") == "selected", F.col("dst")).when(F.col("owner") == "external", boundary)
    edges = met.select("src", far.alias("to"), "kind", F.when(F.col("owner") == "external", True).otherwise(F.col("exact")).alias("exact"), "condition_key").where("to is not null")
    stop = met.where(F.coalesce(F.col("owner"), F.lit("unknown")) == "unknown")
    reason = F.concat(F.lit("directive target has unknown package ownership: "), "dst")
    return edges.withColumnRenamed("to", "dst").distinct(), blocker_rows(stop, "dart", reason, source=F.col("src"), namespace=F.lit(namespace)).distinct()


def library_nodes(files: DataFrame, declarations: DataFrame, references: DataFrame, package: str) -> tuple[DataFrame, DataFrame]:
    """files(path), declarations(path, name), references(src_path, dst_id) -> nodes(id, kind, declaration_count), blockers.

    A file without declarations is a library node with none; a generated one is an artifact whose referenced declarations are blocked.
    """
    id_ = F.concat(F.lit(f"dart:{package}/"), "path")
    counted = declarations.groupBy("path").agg(F.count("*").alias("n"))
    met = files.select("path", generated_path(F.col("path")).alias("generated")).join(counted, "path", "left")
    kind = F.when(F.col("generated"), "generatedArtifact").otherwise("dartLibrary")
    named = F.when(F.col("generated"), F.concat(F.lit(f"dart-generated:{package}/"), "path")).otherwise(id_)
    nodes = met.select(named.alias("id"), kind.alias("kind"), F.when(~F.col("generated"), F.coalesce("n", F.lit(0))).alias("declaration_count"))
    out = references.withColumnRenamed("src_path", "path").join(met.where("generated").select("path"), "path", "left_semi")
    held = out.groupBy("path").agg(F.array_sort(F.collect_set("dst_id")).alias("ids"))
    return nodes, blocker_rows(held, "dart", F.concat(F.lit("generated library references declarations: "), "path"), ids=F.col("ids"))


# Assets.


def asset_graph(assets: DataFrame, variants: DataFrame, owned: DataFrame, references: DataFrame, package: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and protections of assets.

    assets(key, size_bytes, transformers, by_directory), variants(key, ratio, size_bytes), owned(key, package), references(caller, key, exact).
    An asset's size is its family's; it can be removed if a folder declares it and nothing transforms it. Assets of
    dependencies are protected whether or not they are nodes. References to keys that are no asset are nothing.
    """
    id_ = F.concat(F.lit(f"asset:{package}/"), "key")
    family = variants.groupBy("key").agg(F.count("*").alias("variants"), F.sum("size_bytes").alias("more"))
    base = assets.join(family, "key", "left")
    size = F.col("size_bytes") + F.coalesce("more", F.lit(0))
    own = base.select(id_.alias("id"), F.lit("asset").alias("kind"), size.alias("size_bytes"), (F.col("by_directory") & ~F.col("transformers")).alias("removal_supported"), F.coalesce("variants", F.lit(0)).alias("variants"))
    folder, name = F.regexp_extract("key", "^(.*/)?([^/]*)$", 1), F.regexp_extract("key", "([^/]*)$", 1)
    variant_id = F.concat(F.lit(f"asset:{package}/"), folder, F.col("ratio").cast("double").cast("string"), F.lit("x/"), name)
    of_known = variants.join(assets.select("key"), "key", "left_semi")
    more = of_known.select(variant_id.alias("id"), F.lit("assetVariant").alias("kind"), "size_bytes", _none("boolean").alias("removal_supported"), F.lit(0).alias("variants"))
    edges = of_known.select(id_.alias("src"), variant_id.alias("dst"), F.lit("bundlesVariant").alias("kind"), F.lit(True).alias("exact"))
    used = references.join(assets.select("key"), "key", "left_semi").select(F.col("caller").alias("src"), id_.alias("dst"), F.lit("loadsAsset").alias("kind"), "exact")
    kept = owned.select(F.concat(F.lit("asset:"), "package", F.lit("/"), "key").alias("id"), F.concat(F.lit("owned by package "), "package").alias("reason"))
    return own.unionByName(more), edges.unionByName(used).distinct(), kept
