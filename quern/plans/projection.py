"""The star-schema tables as a conditional graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an event's kind of blocker addresses.
NAMESPACES = {"click": "supplier:1", "error": "part:19", "purchase": "part:7", "signup": "nation:2", "view": "orders:33"}


class Graph:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def ids(self, table: str, column: str, name: str = "id"):
        return F.concat(F.lit(f"{table}:"), F.col(column).cast("string")).alias(name)

    def nodes(self) -> DataFrame:
        keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
        out = None
        for t, k in keys.items():
            rows = self.table(t).select(self.ids(t, k), F.lit(t).alias("kind"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def edges(self, repeats: bool = False) -> DataFrame:
        """src, dst, exact; with ``repeats`` an edge as often as line items hold it, for closures, which fold equal edges themselves."""
        line = self.table("lineitem")
        yes = F.lit(True).alias("exact")

        def of(df, a, b, exact):
            return df.select(self.ids(*a, "src"), self.ids(*b, "dst"), exact)

        nation = self.table("nation")
        ring = nation.withColumn("next", (F.col("n_nationkey") + 1) % 25)
        to_part = line.groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "N").alias("exact"))
        to_supplier = line.groupBy("l_partkey", "l_suppkey").agg(F.bool_or(F.col("l_linestatus") == "F").alias("exact"))
        if repeats:
            to_part = line.select("l_orderkey", "l_partkey", (F.col("l_returnflag") == "N").alias("exact"))
            to_supplier = line.select("l_partkey", "l_suppkey", (F.col("l_linestatus") == "F").alias("exact"))
        parts = [
            of(self.table("customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), yes),
            of(self.table("orders"), ("orders", "o_orderkey"), ("customer", "o_custkey"), yes),
            of(to_part, ("orders", "l_orderkey"), ("part", "l_partkey"), F.col("exact")),
            of(to_supplier, ("part", "l_partkey"), ("supplier", "l_suppkey"), F.col("exact")),
            of(self.table("supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), yes),
            of(nation, ("nation", "n_nationkey"), ("region", "n_regionkey"), yes),
            of(ring, ("nation", "n_nationkey"), ("nation", "next"), (F.col("n_nationkey") % 5 != 0).alias("exact")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def contexts(self) -> DataFrame:
        return self.table("customer").select(F.col("c_mktsegment").alias("context")).distinct()

    def roots(self) -> DataFrame:
        urgent = self.table("orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
        return urgent.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("context"), self.ids("orders", "o_orderkey"))

    def protected(self) -> DataFrame:
        return self.table("supplier").where("s_acctbal < 0").select(self.ids("supplier", "s_suppkey"))

    def blockers(self) -> DataFrame:
        space = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
        rows = self.table("events").select(F.col("event_type").alias("producer"), F.lit("unresolved").alias("reason"), F.lit(None).cast("string").alias("location"), self.ids("customer", "user_id", "source_node_id"), F.element_at(space, F.col("event_type")).alias("affected_namespace"))
        return rows.distinct().withColumn("affected_node_ids", F.array().cast("array<string>"))
