"""Deduplication where order is data: every table carries `ord`, and ties are never left to chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("_row"))
    return kept.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """One row for each key, the first in order, whole. Combined before the shuffle, so hot keys are harmless."""
    return _rows(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The last row for each key, at the place of the key's first."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("_row"), F.min(order).alias(order))
    return kept.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], order).select(*df.columns)


def first_filled(value: Column, order: Column) -> Column:
    """First value in order that is neither null nor ''."""
    return F.min_by(F.nullif(value, F.lit("")), F.when(F.nullif(value, F.lit("")).isNotNull(), order))


def merge_routes(routes: DataFrame, scalars: tuple[str, ...], arrays: tuple[str, ...] = (), maps: tuple[str, ...] = (), key: str = "route", order: str = "ord") -> DataFrame:
    """One row for each path: scalars first filled, guards united as first met, maps laid over each other, place of the first.

    Members and entries are combined by (path, column, member) before they are put
    together, so what is held of a path is what it has, not its rows.
    """
    o = F.col(order)
    one = routes.groupBy(key).agg(*[first_filled(F.col(c), o).alias(c) for c in scalars], F.min(order).alias(order))
    if not arrays and not maps:
        return one
    kind = "array<struct<c: string, p: int, k: string, v: string>>"
    none_of = lambda t: F.expr(f"cast(array() as array<{t}>)")

    def members(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), none_of("string")), lambda v, i: F.struct(F.lit(c).alias("c"), i.alias("p"), v.alias("k"), v.alias("v")))

    def entries(c: str) -> Column:
        return F.transform(F.coalesce(F.map_entries(c), none_of("struct<key: string, value: string>")), lambda e: F.struct(F.lit(c).alias("c"), F.lit(0).alias("p"), e["key"].alias("k"), e["value"].alias("v")))

    told = routes.select(key, o.alias("_o"), F.explode(F.concat(*[x.cast(kind) for x in (*map(members, arrays), *map(entries, maps))])).alias("m"))
    found = told.groupBy(key, F.col("m.c").alias("c"), F.col("m.k").alias("k")).agg(F.min(F.struct("_o", "m.p")).alias("at"), F.max_by("m.v", "_o").alias("v"))
    whole = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c", "at", "k", "v"))).alias("_all"))
    own = lambda c: F.filter(F.coalesce("_all", F.expr("cast(array() as array<struct<c: string, at: struct<_o: bigint, p: int>, k: string, v: string>>)")), lambda x: x["c"] == c)
    made = [F.transform(own(c), lambda x: x["v"]).alias(c) for c in arrays] + [F.map_from_entries(F.transform(own(c), lambda x: F.struct(x["k"], x["v"]))).alias(c) for c in maps]
    return one.join(whole, key, "left").select(key, *scalars, *made, order)
