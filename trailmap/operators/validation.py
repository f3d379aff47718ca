"""Checks of journeys against the graph, coverage, and the algebra of refined sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmap.functions import expressions as X
from trailmap.sources.requests import by_name

from .matching import suggest_ids


def missing_nodes(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps whose node isn't in the graph."""
    return steps.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def tail_mismatches(tails: DataFrame, nodes: DataFrame) -> DataFrame:
    """Last steps whose type is not their node's."""
    return tails.join(nodes.select(F.col("id").alias("node_id"), F.col("type").alias("node_type")), "node_id").where("step_type <> node_type")


def coverage(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: how many of the graph's routes and backends journeys touch, in whole percent; 100 of none.

    What journeys touch is counted whether or not it is in the graph, so it may exceed 100.
    """
    have = nodes.agg(F.count_distinct(F.when(F.col("type") == "route", F.col("id"))).alias("routes_total"), F.count_distinct(F.when(F.col("type") == "backend", F.col("id"))).alias("backends_total"))
    used = steps.agg(F.count_distinct(F.when(F.col("step_type") == "route", F.col("node_id"))).alias("routes_covered"), F.count_distinct(F.when(F.col("step_type") == "backend", F.col("node_id"))).alias("backends_covered"))
    pct = lambda c, t: F.when(F.col(t) == 0, 100).otherwise(F.floor(100 * F.col(c) / F.col(t) + 0.5)).cast("long")
    both = have.withColumn("_one", F.lit(1)).join(used.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("routes_pct", pct("routes_covered", "routes_total")).withColumn("backends_pct", pct("backends_covered", "backends_total"))


def uncovered(nodes: DataFrame, steps: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind).select("id").distinct().join(steps.select(F.col("node_id").alias("id")), "id", "left_anti")


def final_set(original: DataFrame, removed: DataFrame, merged_from: DataFrame, *added: DataFrame) -> DataFrame:
    """Originals neither removed nor merged, and what was added, updated or merged, as a bag."""
    out = original.join(removed.select("id"), "id", "left_anti").join(merged_from.select("id"), "id", "left_anti")
    for a in added:
        out = out.unionByName(a)
    return out


#: Examples of missing nodes that a report shows, and candidates that it names for one.
EXAMPLES, NAMED = 10, 3


def report(nodes: DataFrame, steps: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """One row about journeys' steps (journey, pos, step_type, node_id) against the graph's nodes (id, type).

    How many steps name no node, with some examples in the order of journey and step (of
    the same base id: the only node, or the first few); how many last steps are of another
    type than their node; how many widget steps have no hexadecimal suffix.
    """
    known = nodes.select(F.col("id").alias("node_id"), F.col("type").alias("node_type")).dropDuplicates(["node_id"])
    at = steps.join(known, "node_id", "left").withColumn("_last", F.max("pos").over(Window.partitionBy("journey")) == F.col("pos"))
    absent = F.col("node_type").isNull()
    counts = at.agg(
        F.count_if(absent).alias("missing"),
        F.count_if(F.col("_last") & ~absent & (F.col("node_type") != F.col("step_type"))).alias("tail_mismatches"),
        F.count_if((F.col("step_type") == "widget") & ~F.col("node_id").rlike(X.HEX_SUFFIX)).alias("base_looking_widgets"),
    )
    first = at.where(absent).orderBy("journey", "pos").limit(examples).select("journey", "pos", "step_type", "node_id")
    said = first.join(suggest_ids(first.select("node_id"), nodes, limit=NAMED), "node_id", "left")
    shown = said.agg(F.array_sort(F.collect_list(F.struct("journey", "pos", "step_type", "node_id", "suggested", "ambiguous"))).alias("examples"))
    return counts.withColumn("_one", F.lit(1)).join(shown.withColumn("_one", F.lit(1)), "_one").drop("_one")


class Registry:
    """Journeys by id, over a table (id, ...): an added one takes the place of one with its id."""

    def __init__(self, journeys: DataFrame):
        self.journeys = journeys

    def get(self, ident: str) -> DataFrame:
        return self.journeys.where(F.col("id") == ident)

    def all(self) -> DataFrame:
        """Sorted by id, as a reader would."""
        return by_name(self.journeys)

    def has(self, ident: str) -> bool:
        return not self.get(ident).isEmpty()

    def add(self, more: DataFrame) -> Registry:
        return Registry(self.journeys.join(more.select("id"), "id", "left_anti").select(*self.journeys.columns).unionByName(more))

    def remove(self, ident: str) -> Registry:
        return Registry(self.journeys.where(F.col("id") != ident))

    def size(self) -> int:
        return self.journeys.count()

    def clear(self) -> Registry:
        return Registry(self.journeys.limit(0))
