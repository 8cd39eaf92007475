"""Paths through tables of links: what a path names in the end, and whose it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.materialise import bounded, cut

#: Links that are followed for one path at most, as file systems do; more are a ring. Links followed in one job.
MOST_LINKS, HOPS = 40, 4


def normal(path: Column) -> Column:
    """An absolute path without empty steps, . and .., which never leaves the top."""
    step = lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, x))
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def within(root: Column, path: Column) -> Column:
    """Whether a normal path is a normal root or lies below it."""
    return (path == root) | path.startswith(F.when(root == "/", root).otherwise(F.concat(root, F.lit("/"))))


def above(path: Column) -> Column:
    """A normal path and all that it lies in, but the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def canonical(paths: DataFrame, links: DataFrame) -> DataFrame:
    """path, canonical, is_link of paths(path) over links(path, target): links are followed from the top down, links of links too.

    A relative target goes from the folder that holds its link. The canonical path is null if more than
    40 links are followed. All paths take a step at a time, so the number of joins goes by the longest way.
    """
    own = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(F.regexp_replace(normal(F.col("path")), "[^/]*$", ""), "target"))
    held = bounded(links.select(normal(F.col("path")).alias("link"), normal(own).alias("to")).dropDuplicates(["link"]))
    start = cut(paths.select("path").distinct().withColumn("at", normal(F.col("path"))))
    open_, done = start.withColumn("moved", F.lit(True)), []

    def hop(rows):
        offered = rows.select("path", F.explode(above(F.col("at"))).alias("link"))
        first = offered.join(held, "link").groupBy("path").agg(F.min_by(F.struct("link", "to"), F.length("link")).alias("x"))
        at = F.when(F.col("x").isNull(), F.col("at")).otherwise(normal(F.concat("x.to", F.col("at").substr(F.length("x.link") + 1, F.length("at")))))
        return rows.select("path", "at").join(first, "path", "left").select("path", at.alias("at"), F.col("x").isNotNull().alias("moved"))

    for _ in range(0, MOST_LINKS, HOPS):
        for _ in range(HOPS):
            open_ = hop(open_)
        now = cut(open_)
        done.append(now.where("not moved").select("path", F.col("at").alias("canonical")))
        open_ = now.where("moved")
        if open_.isEmpty():
            break
    out = open_.select("path", F.lit(None).cast("string").alias("canonical"))
    for rows in done:
        out = out.unionByName(rows)
    is_link = held.select(F.col("link").alias("of"), F.lit(True).alias("is_link"))
    return out.join(is_link, normal(F.col("path")) == F.col("of"), "left").select("path", "canonical", F.coalesce("is_link", F.lit(False)).alias("is_link"))


def boundary(paths: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """path, reason why it is not read: outside-project, symlink, symlink-escape, unreadable-path, or null. Null paths are left out."""
    top = canonical(paths.sparkSession.createDataFrame([(root,)], "path string"), links).select(F.coalesce("canonical", "path").alias("top"))
    rows = canonical(paths.where("path is not null"), links).crossJoin(F.broadcast(top))  # one row
    reason = F.when(~within(normal(F.lit(root)), normal(F.col("path"))), "outside-project").when(F.col("is_link"), "symlink").when(F.col("canonical").isNull(), "unreadable-path").when(~within(F.col("top"), F.col("canonical")), "symlink-escape")
    return rows.select("path", reason.alias("reason"))


def owners(paths: DataFrame, links: DataFrame, listed: DataFrame, manifests: DataFrame, selected: str, root: str) -> DataFrame:
    """path, ownership (selected, external or unknown), package, reason: whose source a path is.

    listed(name, root): what the package configuration claims; manifests(root, name): where packages are described.
    The nearest description below the claimed root decides, and only if the configuration agrees. A path whose
    links lead into the selected package or out of it is nobody's.
    """
    spark = paths.sparkSession
    names = canonical(listed.select(F.col("root").alias("path")).unionByName(manifests.select(F.col("root").alias("path"))).unionByName(spark.createDataFrame([(root,)], "path string")), links)
    names = cut(names.select(F.col("path").alias("of"), F.coalesce("canonical", normal(F.col("path"))).alias("real")))
    real = lambda df: df.join(names, F.col("root") == F.col("of")).select(F.col("real").alias("root"), "name")
    claims = real(listed.select("root", "name")).groupBy("root").agg(F.count_distinct("name").alias("names"), F.min("name").alias("name"))
    described = real(manifests.select("root", "name")).groupBy("root").agg(F.min("name").alias("name"))
    top = names.where(F.col("of") == root).select(F.col("real").alias("top"))
    rows = cut(canonical(paths.where("path is not null"), links).crossJoin(F.broadcast(top)))  # one row
    lexical = within(normal(F.lit(root)), normal(F.col("path"))) | within(F.col("top"), normal(F.col("path")))
    inside = within(F.col("top"), F.col("canonical"))
    offered = cut(rows.where("canonical is not null").select("path", F.explode(above(F.col("canonical"))).alias("root")))
    claim = offered.join(bounded(claims), "root").groupBy("path").agg(F.max_by(F.struct("root", "names", "name"), F.length("root")).alias("c"))
    rows = rows.join(claim, "path", "left").withColumn("floor", F.when(inside, F.col("top")).otherwise(F.col("c.root")))
    near = offered.join(bounded(described), "root").join(rows.select("path", "floor"), "path").where(within(F.col("floor"), F.col("root")))
    near = near.groupBy("path").agg(F.max_by(F.struct("root", "name"), F.length("root")).alias("m"))
    rows = rows.join(near, "path", "left")
    lower = (F.col("c.root") != F.col("m.root")) & within(F.col("c.root"), F.col("m.root"))
    unclaimed, nested = F.col("c").isNull() | lower, (F.col("m.name") != selected) & within(F.col("top"), F.col("m.root"))
    reason = (
        F.when(F.col("canonical").isNull(), "source could not be resolved")
        .when(lexical & ~inside, "source leaves the selected package through a link")
        .when(~lexical & inside, "source enters the selected package through a link")
        .when(F.col("c.names") > 1, "several packages claim one root")
        .when(F.col("floor").isNull(), "source is outside every package")
        .when(F.col("m.name").isNull(), "no package description was found")
        .when(unclaimed & ~nested, "the configuration does not claim the owner")
        .when(~unclaimed & ((F.col("c.name") != F.col("m.name")) | (F.col("c.root") != F.col("m.root"))), "the configuration differs from the nearest description")
        .when((F.col("m.name") == selected) & (F.col("m.root") != F.col("top")), "the selected name stands for another root")
    )
    rows = rows.withColumn("reason", reason)
    ownership = F.when(F.col("reason").isNotNull(), "unknown").when(F.col("m.name") == selected, "selected").otherwise("external")
    return rows.select("path", ownership.alias("ownership"), F.when(F.col("reason").isNull(), F.col("m.name")).alias("package"), "reason")
