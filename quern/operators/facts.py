"""Facts of the graph: nodes, edges, blockers and auxiliary targets, without duplicates and independent of order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.numbered import numbered


def fingerprint(*parts: Column) -> Column:
    """Length-prefixed parts as one string; a null part is written like an empty one."""
    each = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat_ws("|", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in each])


def _joined(parts) -> str:
    # Lengths are in UTF-16 units, as the ids that other tools wrote have them.
    return "|".join(f"{len(p.encode('utf-16-le')) // 2}:{p}" for p in parts)


def _form(value) -> str:
    """The canonical form of a JSON value: its type, then its parts, maps in the order of their keys' forms."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return _joined(["bool", str(value).lower()])
    if isinstance(value, int):
        return _joined(["int", str(value)])
    if isinstance(value, float):
        return _joined(["double", repr(value)])
    if isinstance(value, str):
        return _joined(["string", value])
    if isinstance(value, list):
        return _joined(["list", *map(_form, value)])
    return _joined(["map", *[_joined([k, _form(v)]) for k, v in sorted((_form(k), v) for k, v in value.items())]])


def metadata_form(text: str | None) -> str | None:
    """The canonical form of a JSON object: equal objects have equal forms whatever the order of their keys. Null for what is no object."""
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return _joined(_joined([k, _form(v)]) for k, v in sorted(value.items())) if isinstance(value, dict) else None


def with_metadata_form(rows: DataFrame, column: str, name: str = "form") -> DataFrame:
    """Adds the canonical form of a column of JSON objects. Nested values have no form of bounded depth in SQL, so batches go through Python."""
    form = F.pandas_udf(lambda s: s.map(metadata_form), "string")
    return rows.withColumn(name, form(F.col(column)))


def nodes(rows: DataFrame, payload: list[str], metadata: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per id (the smallest fingerprint, the first producer as owner, all contributors), and a blocker per conflict.

    Definitions that differ only in a null against an empty text have one fingerprint, but conflict. ``metadata`` is a column of JSON
    objects, which are equal whatever the order of their keys; what is no object is compared as it is.
    """
    if metadata is not None:
        rows = with_metadata_form(rows, metadata, "_form").withColumn("_form", F.coalesce("_form", metadata))
        kept, blockers = nodes(rows, [*payload, "_form"])
        # Of equal definitions the smallest text stands for all.
        text = rows.groupBy("id", F.col("_form").alias("_of")).agg(F.min(metadata).alias(metadata))
        kept = kept.join(text.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & F.col("_form").eqNullSafe(F.col("_of")))
        return kept.select("id", *payload, metadata, "owner", "contributors"), blockers
    order = F.struct(fingerprint(*[F.col(c) for c in payload]).alias("fp"), *[F.col(c).isNull().alias(f"no_{c}") for c in payload])
    whole = F.struct(*payload)
    kept = rows.groupBy("id").agg(
        F.min_by(whole, order).alias("best"), F.min_by("producer", "seq").alias("owner"),
        F.array_sort(F.collect_set("producer")).alias("contributors"), F.count_distinct(whole).alias("definitions"),
    )
    blockers = kept.where("definitions > 1").select(
        F.lit("graph").alias("producer"), F.lit("conflicting definitions").alias("reason"), F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("source_node_id"), F.lit(None).cast("string").alias("affected_namespace"), F.array("id").alias("affected_node_ids"),
    )
    return kept.select("id", "best.*", "owner", "contributors"), blockers


def edges(rows: DataFrame) -> DataFrame:
    """One row per (src, dst, kind, condition_key): exact evidence first, then the smallest evidence fingerprint."""
    rank = F.struct((~F.col("exact")).alias("inexact"), fingerprint(F.col("evidence")).alias("fp"))
    return rows.groupBy("src", "dst", "kind", "condition_key").agg(F.min_by(F.struct("exact", "evidence"), rank).alias("best")).select("src", "dst", "kind", "condition_key", "best.*")


def blockers(rows: DataFrame) -> DataFrame:
    """Exact duplicates go; ids are a sorted set."""
    ids = F.array_sort(F.array_distinct(F.coalesce("affected_node_ids", F.array().cast("array<string>"))))
    return rows.withColumn("affected_node_ids", ids).groupBy("producer", "reason", "location", "source_node_id", "affected_namespace", "affected_node_ids").agg(F.count("*").alias("recorded"))


def auxiliary_targets(rows: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first definition of each id with its hash, an issue for each different later one, and a blocker of everything per issue."""
    marked = rows.withColumn("definition", F.sha2(F.to_json(F.struct("id", *payload), {"ignoreNullFields": "false"}), 256))
    first = marked.groupBy("id").agg(F.min_by("definition", "seq").alias("accepted"))
    marked = marked.join(first, "id")
    issues = marked.where("definition <> accepted").select("id", "accepted", F.col("definition").alias("rejected")).distinct()
    none = F.lit(None).cast("string")
    stop = issues.select(
        F.lit("graph").alias("producer"), F.concat(F.lit("conflicting auxiliary execution target definition for "), "id").alias("reason"), none.alias("location"),
        none.alias("source_node_id"), none.alias("affected_namespace"), F.array().cast("array<string>").alias("affected_node_ids"),
    )
    kept = marked.where("definition = accepted").groupBy("id", "definition").agg(F.min_by(F.struct(*payload), "seq").alias("t")).select("id", "definition", "t.*")
    return kept, issues, stop


def auxiliary_roots(roots: DataFrame, accepted: DataFrame) -> DataFrame:
    """roots(node_id, reason, aux_id, definition) whose target was accepted in just that definition, each record once."""
    known = accepted.select(F.col("id").alias("aux_id"), "definition")
    return roots.join(known, ["aux_id", "definition"], "left_semi").select("node_id", "reason", "aux_id").distinct()


def protections(rows: DataFrame) -> DataFrame:
    """id, reasons: every reason of each protected id in the order in which they came, repeats kept; ids need not be nodes."""
    held = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "reason"))).alias("r"))
    return held.select("id", F.col("r.reason").alias("reasons"))


def counts(nodes: DataFrame, edges: DataFrame, roots: DataFrame, blockers: DataFrame) -> DataFrame:
    """fact, kind, n: nodes by kind, edges by kind, roots and blockers."""
    one = lambda df, fact, kind: df.groupBy(F.lit(fact).alias("fact"), kind.alias("kind")).agg(F.count("*").alias("n"))
    every = F.lit("*")
    return one(nodes, "node", F.col("kind")).unionByName(one(edges, "edge", F.col("kind"))).unionByName(one(roots, "root", every)).unionByName(one(blockers, "blocker", every))


class FactBuilder:
    """Collects one producer's facts, each stamped with its name and place, as DataFrames that the graph unites."""

    def __init__(self, producer: str):
        self.producer, self.tables = producer, {}

    def add(self, table: str, rows: DataFrame) -> FactBuilder:
        held = self.tables.get(table)
        self.tables[table] = rows if held is None else held.unionByName(rows)
        return self

    def stamped(self, table: str, order: list[str]) -> DataFrame:
        """The table's rows with producer and seq: 0, 1, ... in the order of columns, so that the first definition has the smallest."""
        return numbered(self.tables[table], order, "seq").withColumn("producer", F.lit(self.producer))
