"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialise, path_of


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(doc_id, component) for every end of a link; the component is the smallest id in it.

    Each round, every document's larger neighbours and then its smaller ones are hung on
    the smallest of its neighbourhood, until only stars are left; rounds grow with the
    logarithm of the longest path. A round is written, so lineage stays short. Self-links
    and null ends are ignored.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = materialise(links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    state = mark(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct()
        after = materialise(small, "edges")
        was, state = state, mark(after)
        delete(edges.sparkSession, path_of(edges))
        edges = after
        if was == state:
            break
    hung = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "doc_id")
    roots = edges.select(F.col("v").alias("doc_id")).distinct().withColumn("component", F.col("doc_id"))
    return hung.unionAll(roots)
