"""The navigation model over the star schema's tables: modules, routes, components, forms, leaves, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmap.functions import expressions as X


class Tables:
    """Readers of one folder's tables, and their projections onto the model. Everything is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def modules(self) -> DataFrame:
        return self.region.select(F.concat(F.lit("M"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") == 0, "root").otherwise("routing").alias("role"), F.col("r_regionkey").cast("long").alias("ord"))

    def routes(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.nation.select(F.concat(F.lit("/n/"), n).alias("route"), F.concat(F.lit("M"), F.col("n_regionkey")).alias("module"), F.when(n % 3 == 0, F.col("n_name")).alias("title"), n.cast("long").alias("ord"))

    def redirections(self) -> DataFrame:
        """Some nations' paths lead to others, in chains and loops."""
        n = F.col("n_nationkey")
        return self.nation.where(n % 5 != 0).select(F.concat(F.lit("/r/"), n).alias("src"), F.concat(F.when(n % 5 == 1, "/n/").otherwise("/r/"), (n * 7 + 3) % 25).alias("dst"), n.cast("long").alias("ord"))

    def lines(self) -> DataFrame:
        """One row for each leaf: lineitem isn't unique by order and number, so the first by all its columns stands."""
        cols = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
        found = self.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*cols)).alias("x"))
        return found.select("l_orderkey", "l_linenumber", *[F.col("x")[c].alias(c) for c in cols])

    def leaves(self) -> DataFrame:
        """Leaf widgets under form, component, route and module, with the call that each makes."""
        line, order = self.lines(), self.orders.select("o_orderkey", "o_custkey")
        cust, nat = self.customer.select("c_custkey", "c_nationkey"), self.nation.select("n_nationkey", "n_regionkey")
        rows = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(
            F.concat(F.lit("M"), F.col("n_regionkey")).alias("module"),
            F.concat(F.lit("/n/"), F.col("n_nationkey")).alias("route"),
            F.concat(F.lit("C"), F.col("c_custkey")).alias("component"),
            F.concat(F.lit("F"), F.col("o_orderkey")).alias("form"),
            F.concat(F.lit("W"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("leaf"),
            F.concat(F.lit("s"), F.col("l_suppkey")).alias("service"),
            F.concat(F.lit("p"), F.col("l_partkey")).alias("method"),
            (F.col("l_returnflag") == "R").alias("triggers_submit"),
            "l_suppkey",
            "l_linestatus",
        )

    def pages_paths(self) -> DataFrame:
        path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
        return self.pages.select("page_id", "url", path.alias("path"))
