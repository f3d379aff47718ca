"""Transitions of the navigation graph from widgets' events, lazy loads, redirects and submit buttons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmap.functions import expressions as X

from .dedupe import first_wins
from .matching import canonical_routes

def widget_transitions(calls: DataFrame, routes: DataFrame, granularity: str = "method") -> DataFrame:
    """What the calls of each widget's events lead to: src, dst, type, dst_type, and what the call was.

    `calls`: widget, event, handler, call_ord, caller, called, data (array). An event leads
    to at most one known route, the smallest; to each of its backends; to every href; and
    to a virtual route where it has neither route nor backend. Calls are classified in one
    pass and gathered by (widget, event). Of equal (src, dst, type) the first stands, with
    its service, method, source_event, handler, effects and params; `ord` is its first call.
    """
    slash = lambda x: F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    none = F.lit(None).cast("string")
    said = F.trim(F.coalesce("called", F.lit("")))
    router = X.is_router_call(F.concat_ws(".", F.coalesce("caller", F.lit("")), F.coalesce("called", F.lit("")))) & (F.coalesce(F.size("data"), F.lit(0)) > 0)
    backend = (F.coalesce(F.get("data", F.lit(0)), F.lit("")) == "/backend") | F.coalesce(X.is_backend_caller(F.col("caller")), F.lit(False))
    kind = (
        F.when(F.col("event") == "href", "href").when(F.col("event") == "routerLink", "link").when(router, "link")
        .when(backend & F.col("called").isin(*X.NOISE_METHODS), "noise").when(backend, "backend").otherwise("effect")
    )
    rows = calls.withColumn("said", said).withColumn("kind", F.when(F.col("said") == "", "none").otherwise(kind))
    rows = rows.withColumn("target", F.when(F.col("kind") == "link", slash(F.when(F.col("event") == "routerLink", F.col("said")).otherwise(F.array_join("data", "/")))))
    known = routes.select(F.col("route").alias("known")).distinct()
    rows = canonical_routes(rows, routes).join(known, F.col("canonical") == F.col("known"), "left")
    raw_service = F.coalesce(F.nullif(F.get("data", F.lit(1)), F.lit("")), F.get(F.split(F.regexp_replace("caller", r"^this\.", ""), "[.]"), F.lit(0)))
    service, method = X.service_name(raw_service), F.coalesce(F.nullif(F.get("data", F.lit(2)), F.lit("")), F.nullif(F.col("said"), F.lit("")), F.lit("call"))
    rows = rows.withColumn("backend", F.when(F.col("kind") == "backend", F.struct(X.backend_target(service, method, granularity).alias("dst"), service.alias("service"), method.alias("method"))))
    events = rows.groupBy("widget", "event", "handler").agg(
        F.min("call_ord").alias("ord"),
        F.min("known").alias("nav"),
        F.collect_set("backend").alias("backends"),
        F.collect_set(F.when(F.col("kind") == "href", F.struct(F.col("said").alias("dst"), F.coalesce("data", F.expr("cast(array() as array<string>)")).alias("params")))).alias("hrefs"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "effect", F.struct("call_ord", "said")))).alias("_effects"),
    )
    events = events.withColumn("effects", F.transform("_effects", lambda e: e["said"]))
    idle = F.col("nav").isNull() & (F.size("backends") == 0)
    label = F.coalesce(F.nullif(F.trim(F.coalesce("handler", F.lit(""))), F.lit("")), F.get("effects", F.lit(0)), "event")
    source, no_params = F.col("event").cast("string"), F.lit(None).cast("array<string>")
    one = lambda dst, type_, kind_, service=none, method=none, source_event=none, effects=None, params=no_params: F.struct(
        dst.alias("dst"), type_.alias("type"), F.lit(kind_).alias("dst_type"), service.alias("service"), method.alias("method"), source_event.alias("source_event"),
        F.col("handler").cast("string").alias("handler"), (F.col("effects") if effects is None else effects).alias("effects"), params.alias("params"),
    )
    no_effects = F.lit(None).cast("array<string>")
    there = lambda x: F.filter(F.array(x), lambda t: t["dst"].isNotNull())
    out = F.concat(
        F.transform("hrefs", lambda h: one(h["dst"], source, "external-route", effects=no_effects, params=h["params"])),
        there(one(F.col("nav"), source, "route")),
        F.transform("backends", lambda b: one(b["dst"], F.lit("service-call"), "backend", b["service"], b["method"], source)),
        there(one(F.when(idle, X.node_id(F.concat(F.lit("/ui/"), F.col("widget"), F.lit("/"), label))), source, "virtual-route")),
    )
    flat = events.select(F.col("widget").alias("src"), "ord", F.posexplode(out).alias("_p", "t"))
    # the first of equal ones: by its event's place, then its own among the event's
    rest = ("dst_type", "service", "method", "source_event", "handler", "effects", "params")
    first = F.struct("ord", "_p", *[F.col("t")[c].alias(c) for c in rest])
    kept = flat.groupBy("src", F.col("t.dst").alias("dst"), F.col("t.type").alias("type")).agg(F.min_by(first, F.struct("ord", "_p", "t.service", "t.method")).alias("x"))
    return kept.select("src", "dst", "type", *[F.col("x")[c].alias(c) for c in (*rest, "ord")])


def lazy_loads(routes: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst) from a route's module to each module class that its loader names and that is known."""
    named = routes.select("module", F.explode(F.regexp_extract_all("load_children", F.lit(X.LAZY_CLASS), 1)).alias("dst"))
    return named.join(modules.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("module").alias("src"), "dst").distinct()


def union_first(emitters: list[DataFrame], keys: list[str]) -> DataFrame:
    """Emitters' rows in the order of (phase, ord), the first of each key whole."""
    phased = [e.withColumn("ord", F.struct(F.lit(i).alias("phase"), F.col("ord").cast("long").alias("at"))) for i, e in enumerate(emitters)]
    out = phased[0]
    for e in phased[1:]:
        out = out.unionByName(e)
    return first_wins(out, keys)
