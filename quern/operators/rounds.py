"""Removal in rounds: plan, commit, and again on what is left, until no unit is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import closure as C
from quern.operators import planner
from quern.plans.materialise import passing, stored


def attempts(units: DataFrame, places: DataFrame, rejected: DataFrame) -> DataFrame:
    """unit_id, outcome of one round, in which units are tried in order and the first rejected one ends the run.

    units(unit_id, needs), places(unit_id, lead, step), rejected(unit_id). What comes before it is committed; what it needs,
    directly or through others, is skipped; the rest is not attempted.
    """
    at = F.struct("lead", "step")
    first = places.join(rejected, "unit_id", "left_semi").agg(F.min(F.struct(at.alias("at"), "unit_id")).alias("x")).select("x.*").first()
    if first.at is None:
        return units.select("unit_id", F.lit("committed").alias("outcome"))
    ways = units.select(F.col("unit_id").alias("src"), F.explode("needs").alias("dst"))
    start = units.where(F.col("unit_id") == first.unit_id).select(F.lit("").alias("context"), F.col("unit_id").alias("id"))
    held = C.closure(start, ways).select(F.col("id").alias("unit_id"), F.lit(True).alias("held"))
    earlier = at < F.struct(F.lit(first.at.lead).alias("lead"), F.lit(first.at.step).cast("bigint").alias("step"))
    outcome = F.when(F.col("unit_id") == first.unit_id, "rejectedRecovered").when(F.col("held"), "skippedDependency").when(earlier, "committed").otherwise("notAttempted")
    return units.select("unit_id").join(places, "unit_id").join(held, "unit_id", "left").select("unit_id", outcome.alias("outcome"))


#: Rows up to which what a round took is broadcast to the tables it is taken out of.
SMALL = 10_000


def _ways(edges: DataFrame, pseudo: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """src, dst, real of the distinct ways to what is not ``fixed`` (id): those from elsewhere, and of those from fixed nodes the least source for each end."""
    ends = lambda end: fixed.withColumnRenamed("id", end)
    rows = edges.select("src", "dst", F.lit(True).alias("real")).unionByName(pseudo.select("src", "dst", F.lit(False).alias("real"))).where("src is not null and dst is not null")
    rows = stored(rows.join(ends("dst"), "dst", "left_anti").select("src", "dst", "real").distinct())
    held = rows.join(ends("src"), "src", "left_semi").groupBy("dst", "real").agg(F.min("src").alias("src")).select("src", "dst", "real")
    return stored(rows.join(ends("src"), "src", "left_anti").select("src", "dst", "real")), stored(held)


def apply(graph: tuple[DataFrame, ...], contexts: DataFrame, select: Callable[[DataFrame], DataFrame], failing: DataFrame | None = None) -> DataFrame:
    """id, round, outcome of every finding that a round takes up, and of those that stay blocked.

    graph: nodes(id, ...), edges(src, dst, exact), roots(context, id), protected(id), blockers. ``select`` takes unproven,
    unprotected nodes with ``retained`` and returns those that may go (id, path). A unit with a member in ``failing`` (id) is rejected.

    Unproven nodes lead to nothing that is proven, so the proven closure stays as it is; the retained one is that of the
    rest after each round. Blockers of removed nodes go with them.

    What is proven or protected is retained in every round and never goes. So only ways to other nodes are kept and followed,
    and what fixed nodes lead to are seeds. Edges are read from their source twice and never written as they are; units are
    made only if one of them may fail.
    """
    spark = graph[0].sparkSession
    with passing(spark) as (keep, drop):
        out = _applied(graph, contexts, select, failing, keep, drop)
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def _applied(graph, contexts, select, failing, keep, drop) -> list[DataFrame]:
    nodes, edges, roots, protected, blockers = graph
    spark = nodes.sparkSession
    edges = edges.select("src", "dst", "exact")
    # Edges hold in every context and no round asks where a node is reached: one context stands for all.
    one = lambda rows: rows.select(F.lit("").alias("context"), "id").distinct()
    any_ = contexts.limit(1).select(F.lit("").alias("context"))

    with passing(spark) as (hold, _):
        proven = hold(stored(C.closure(one(roots), edges.where("exact")).select("id")))
    with passing(spark) as (hold, _):
        seeds, pseudo, every = C._retaining(roots, protected, blockers, nodes, any_)
        fixed = stored(proven.unionByName(protected.where("id is not null").select("id").join(every).select("id")).distinct())
        ways, held = map(hold, _ways(edges, pseudo, fixed))
        seeds = seeds.select("id").where("id is not null").join(fixed, "id", "left_anti").unionByName(held.select(F.col("dst").alias("id")))
        seeds = hold(stored(seeds.distinct()))
    open_ = stored(nodes.where("id is not null").join(proven, "id", "left_anti").join(protected.select("id").distinct(), "id", "left_anti"))
    drop(proven)

    out, round_ = [], 0
    while True:
        round_ += 1
        with passing(spark) as (hold, _):
            kept = C.closure(one(seeds), ways.select("src", "dst")).select("id", F.lit(True).alias("retained"))
            chosen = stored(select(open_.join(kept, "id", "left").withColumn("retained", F.coalesce("retained", F.lit(False)))).select("id", "path"))
            links = ways.unionByName(held).where("real").select("src", "dst")
            inner, consumers = planner.dependencies(chosen, links)
            stopped = consumers.select("id") if inner.isEmpty() else C.closure(consumers.select(F.lit("").alias("context"), "id"), inner).select("id")
            active = chosen.select("id").distinct().join(stopped, "id", "left_anti")
            bad = None
            if failing is None:
                done = stored(active.select("id", F.lit(round_).alias("round"), F.lit("committed").alias("outcome")))
            else:
                units = stored(planner.freed(active, inner, stopped))
                members = units.select("unit_id", F.explode("members").alias("id"))
                bad = stored(members.join(failing, "id", "left_semi").select("unit_id").distinct())
                places = planner.ordered(units).select("unit_id", "lead", "step")
                done = stored(members.join(attempts(units, places, bad), "unit_id").select("id", F.lit(round_).alias("round"), "outcome"))
            n = done.count()
            if n == 0:
                done = stored(stopped.select("id", F.lit(round_).alias("round"), F.lit("blocked").alias("outcome")))
            out.append(hold(done))
            last = n == 0 or bad is not None and not bad.isEmpty()
            if not last:
                gone = F.broadcast(done.select("id")) if n <= SMALL else done.select("id")
                rest = lambda e: e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "real")  # noqa: B023, E731
                now = [hold(stored(x)) for x in (open_.join(gone, "id", "left_anti"), seeds.join(gone, "id", "left_anti"), rest(ways), rest(held))]
        keep(done)
        if last:
            return out
        for old in (open_, seeds, ways, held):
            drop(old)
        open_, seeds, ways, held = now
