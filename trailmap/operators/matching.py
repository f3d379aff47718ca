"""Joins by pattern and by first match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmap.functions import expressions as X

from .dedupe import first_wins


def lookup_first(left: DataFrame, right: DataFrame, on: str, order: str = "ord") -> DataFrame:
    """Left join to the first of the right rows with the key."""
    return left.join(first_wins(right, [on], order), on, "left")


def segments(path) -> F.Column:
    return F.split(path, "/")


def canonical_routes(targets: DataFrame, routes: DataFrame, target: str = "target", route: str = "route", order: str = "ord") -> DataFrame:
    """`targets` with `canonical`: the known route itself, else the first whose segments equal or are parameters, else unchanged.

    Routes have few shapes: a shape tells which segments are parameters. A target is masked by
    each shape of as many segments, and meets routes that are masked alike by equality; so
    however many routes there are, a target meets those only that fit it.
    """
    masked = lambda parts, shape: F.array_join(F.zip_with(parts, shape, lambda p, s: F.when(s, ":").otherwise(p)), "/")
    r = routes.select(F.col(route).alias("_r"), F.col(order).alias("_o"), segments(F.regexp_replace(route, "^/+", "")).alias("_rs"))
    r = r.withColumn("_shape", F.transform("_rs", lambda s: s.startswith(":"))).withColumn("_mask", masked(F.col("_rs"), F.col("_shape")))
    first = r.groupBy("_shape", "_mask").agg(F.min(F.struct("_o", "_r")).alias("_first"))
    shapes = r.select("_shape").distinct().withColumn("_n", F.size("_shape"))
    t = targets.select(target).distinct().withColumn("_s", segments(F.regexp_replace(target, "^/+", ""))).withColumn("_n", F.size("_s"))
    tried = t.join(shapes, "_n").select(target, "_shape", masked(F.col("_s"), F.col("_shape")).alias("_mask"))
    best = tried.join(first, ["_shape", "_mask"]).groupBy(target).agg(F.min("_first").alias("_best"))
    known = routes.select(F.col(route).alias(target)).distinct().withColumn("_known", F.lit(True))
    out = targets.join(best, target, "left").join(known, target, "left")
    return out.withColumn("canonical", F.when(F.col("_known"), F.col(target)).otherwise(F.coalesce("_best._r", target))).drop("_best", "_known")


def suggest_ids(missing: DataFrame, known: DataFrame, ident: str = "node_id", limit: int = 3) -> DataFrame:
    """For ids that are not known, those with the same base: their number, one as suggestion, a few as candidates."""
    m = missing.select(ident).distinct().withColumn("base", X.base_id(F.col(ident)))
    k = known.select(F.col("id")).distinct().withColumn("base", X.base_id(F.col("id")))
    found = m.join(k, "base", "left").groupBy(ident).agg(F.count("id").alias("candidates"), F.sort_array(F.collect_set("id")).alias("_ids"))
    return found.select(ident, "candidates", F.when(F.col("candidates") == 1, F.get("_ids", F.lit(0))).alias("suggested"), F.when(F.col("candidates") > 1, F.array_join(F.slice("_ids", 1, limit), ",")).alias("ambiguous"))


def contained_names(widgets: DataFrame, controls: DataFrame) -> DataFrame:
    """Rules of a control of the widget's component: of the same name as the widget's control, else the first whose name is within the widget's id.

    `widgets`: component, id, control and more; `controls`: component, control, rules, ord.
    The widget's own rules, where it has some, stand in html_rules.
    """
    w = widgets.withColumnRenamed("rules", "html_rules") if "rules" in widgets.columns else widgets
    same = controls.groupBy("component", "control").agg(F.min_by("rules", "ord").alias("exact_rules"))
    near = controls.select("component", F.lower("control").alias("_c"), F.col("rules").alias("_r"), F.col("ord").alias("_o"))
    within = w.select("component", "id").join(near, "component").where(F.contains(F.lower("id"), F.col("_c"))).groupBy("component", "id").agg(F.min_by("_r", "_o").alias("near_rules"))
    found = w.join(same, ["component", "control"], "left").join(within, ["component", "id"], "left")
    return found.withColumn("rules", F.coalesce("exact_rules", "near_rules")).drop("exact_rules", "near_rules")


def assigned_modules(routes: DataFrame, modules: DataFrame) -> DataFrame:
    """`routes` with their module: the known one that a loader names, else the first that declares the component."""
    owner = modules.select(F.explode("declarations").alias("component"), F.col("name").alias("_eager"), "ord").groupBy("component").agg(F.min_by("_eager", "ord").alias("_eager"))
    lazy = modules.select(F.col("name").alias("_lazy")).distinct()
    named = routes.withColumn("_named", F.nullif(F.regexp_extract(F.coalesce("load_children", F.lit("")), X.LAZY_CLASS, 1), F.lit("")))
    out = named.join(owner, "component", "left").join(lazy, F.col("_named") == F.col("_lazy"), "left")
    return out.withColumn("module", F.coalesce("_lazy", "_eager")).drop("_named", "_eager", "_lazy")


def first_route(components: DataFrame, routes: DataFrame) -> DataFrame:
    """(selector, route): the first route of the class that a selector's name stands for."""
    named = components.select("selector", X.selector_to_class(F.col("selector")).alias("component"))
    return named.join(routes.select("component", "route", "ord"), "component").groupBy("selector").agg(F.min_by("route", "ord").alias("route"))


def parents(nested: DataFrame) -> DataFrame:
    """(child, parent): the components that have a selector in their templates."""
    return nested.select("child", F.col("selector").alias("parent")).distinct()


def routes_of_selectors(components: DataFrame, routes: DataFrame) -> DataFrame:
    """(selector, route): all routes of the class that a selector's name stands for by convention."""
    named = components.select("selector", X.selector_to_class(F.col("selector")).alias("component"))
    return named.join(routes.select("component", "route"), "component").select("selector", "route")
