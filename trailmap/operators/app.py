"""From a project's sources to its navigation graph and its journeys, in one call each.

    found = project.extracted(project.files(spark, folder, ".ts"))
    app = analysed(found, project.files(spark, folder, ".html"))
    registry = journeys_of(app)

Every step is a table of its own. Files are numbered in the order of their paths; what they
say is ordered by file, then place. Only a project's routing is one sequence: which file's
routes stand under which lazy load depends on what was read before, so one task takes the
names of the files that import the router and the lazy loads (no routes, no sources).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmap.functions import expressions as X
from trailmap.session import cut, passing
from trailmap.sources import html, project

from . import closure, graph, journeys, matching, roles
from .dedupe import first_wins, merge_routes

#: Rows of a file that its number leaves room for.
FILE_ROWS = 1 << 24


@dataclass
class App:
    modules: DataFrame
    components: DataFrame
    nested: DataFrame
    widgets: DataFrame
    routes: DataFrame
    redirections: DataFrame
    calls: DataFrame
    graph: graph.Graph


def numbered(found: DataFrame) -> DataFrame:
    """`found` with `ord` over the whole project: by file, then place. A row for each file is ordered in one task; sources are read once."""
    found = cut(found)
    files = found.select("path").distinct().withColumn("_file", F.row_number().over(Window.orderBy("path")).cast("long"))
    return found.join(files, "path").withColumn("ord", F.col("_file") * F.lit(FILE_ROWS).cast("long") + F.col("ord")).drop("_file")


def text(key: str) -> Column:
    return F.try_element_at("text", F.lit(key))


def listed(key: str) -> Column:
    return F.coalesce(F.try_element_at("lists", F.lit(key)), F.expr("cast(array() as array<string>)"))


def modules_of(found: DataFrame) -> DataFrame:
    """(path, name, imports, declarations, exports, bootstraps, all_external, role, ord) of every module class."""
    own = found.where("kind = 'module'").select("path", "name", listed("imports").alias("imports"), listed("declarations").alias("declarations"), listed("exports").alias("exports"), (F.size(listed("bootstrap")) > 0).alias("bootstraps"), "ord")
    symbols = found.where("kind = 'import'").select("path", F.col("name").alias("symbol"), text("specifier").alias("specifier"), "ord")
    return roles.module_roles(roles.external_modules(own, symbols))


def components_of(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, name, selector, template, primary, ord): component classes with a selector and a template, the first of each selector."""
    own = project.templates(found, pages).join(found.where("kind = 'component'").select("path", "name", text("primary").alias("primary"), "ord"), ["path", "name"])
    return first_wins(own.withColumn("primary", F.col("primary") == "true"), ["selector"])


def reading_order(routing: list[str], loads: dict[str, list[tuple[str, str | None]]]) -> Iterator[tuple[str, int, list[str]]]:
    """(path, part, prefixes) as a reader of the whole project meets the parts of files, which lazy loads (name, target) cut.

    Files that import the router are read in order; a lazy load reads its target there and
    then, under its own path, if no lazy load has before. Prefixes begin with the innermost.
    """
    seen: set[str] = set()
    for top in sorted(routing):
        open_ = [] if top in seen else [(top, 0, [])]
        while open_:
            path, part, prefixes = open_.pop()
            yield path, part, prefixes
            own = loads.get(path, [])
            if part < len(own):
                open_.append((path, part + 1, prefixes))
                name, target = own[part]
                if target is not None and target not in seen:
                    seen.add(target)
                    open_.append((target, 0, [name, *prefixes]))


def sequenced(found: DataFrame) -> DataFrame:
    """(kind, name, text, lists, at): routes and redirects as a reader of the whole project meets them, by `reading_order`.

    One task gets the files that import the router and the lazy loads; routes stay where they are.
    """
    rows = found.where("kind IN ('route', 'redirect', 'lazy')").select("path", F.pmod("ord", F.lit(FILE_ROWS).cast("long")).alias("ord"), "kind", "name", "text", "lists")
    paths = found.where("kind = 'file'").select("path").distinct()
    known = lambda c: paths.select(F.col("path").alias(c), F.col("path").alias(f"known_{c}"))
    lazy = rows.where("kind = 'lazy'").select("path", "ord", "name", text("routing_file").alias("r"), text("module_file").alias("m"))
    loads = lazy.join(known("r"), "r", "left").join(known("m"), "m", "left").select("path", "ord", "name", F.coalesce("known_r", "known_m").alias("target"))
    none = F.lit(None)
    routing = found.where((F.col("kind") == "file") & (text("routing") == "true")).select("path", none.cast("long").alias("ord"), none.cast("string").alias("name"), none.cast("string").alias("target"))
    shape = pa.schema([("path", pa.string()), ("part", pa.int64()), ("prefixes", pa.list_(pa.string())), ("place", pa.int64())])

    def read(table: pa.Table) -> pa.Table:
        tops, own = [], {}
        for r in sorted(table.to_pylist(), key=lambda r: (r["path"], r["ord"] or 0)):
            if r["ord"] is None:
                tops.append(r["path"])
            else:
                own.setdefault(r["path"], []).append((r["name"], r["target"]))
        return pa.Table.from_pylist([dict(zip(shape.names, (*x, i), strict=True)) for i, x in enumerate(reading_order(tops, own))], schema=shape)

    parts = routing.unionAll(loads).withColumn("app", F.lit(0)).groupBy("app").applyInArrow(lambda t: read(t.drop_columns(["app"])), "path string, part long, prefixes array<string>, place long")
    before = F.sum((F.col("kind") == "lazy").cast("long")).over(Window.partitionBy("path").orderBy("ord"))
    found_in = rows.withColumn("part", before).where("kind <> 'lazy'").join(parts, ["path", "part"])
    under = lambda name: F.aggregate("prefixes", name, lambda n, p: F.concat(p, F.when(n.startswith("/"), "").otherwise("/"), n))
    moved = F.transform_values("text", lambda k, v: F.when((F.col("kind") == "redirect") & (k == "redirect_to"), under(v)).otherwise(v))
    return found_in.select("kind", under(F.col("name")).alias("name"), moved.alias("text"), "lists", (F.col("place") * F.lit(FILE_ROWS).cast("long") + F.col("ord")).alias("at"))


GUARDS = ("can_activate", "can_activate_child", "can_load")


def routes_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes and redirections with normalised paths, one of each path: what a later one adds is filled in."""
    rows = cut(sequenced(found))
    under = lambda p: F.transform_keys(F.map_filter("text", lambda k, _: k.startswith(f"{p}.")), lambda k, _: F.substr(k, F.lit(len(p) + 2)))
    scalars = ("component", "load_children", "load_component", "path_match")
    r = rows.where("kind = 'route'").select(X.route_path(F.col("name")).alias("route"), *[text(k).alias(k) for k in scalars], *[listed(k).alias(k) for k in GUARDS], under("resolve").alias("resolve"), under("data").alias("data"), F.col("at").alias("ord"))
    d = rows.where("kind = 'redirect'").select(X.route_path(F.col("name")).alias("route"), X.route_path(text("redirect_to")).alias("redirect_to"), text("path_match").alias("path_match"), F.col("at").alias("ord"))
    return merge_routes(r, scalars, GUARDS, ("resolve", "data")), merge_routes(d, ("redirect_to", "path_match"))


def fragment_routes(routes: DataFrame) -> DataFrame:
    """(fragment, route): for whatever can stand after a slash at a route's end, the first such route."""
    parts = F.split("route", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "/"))
    return routes.where(F.contains("route", F.lit("/"))).select("route", "ord", F.explode(ends).alias("fragment")).groupBy("fragment").agg(F.min_by("route", "ord").alias("route"))


# fixed value: a handler that calls one function with one argument
FUNCTION_CALL = r"""^([A-Za-z_$][\w$]*)\(\s*(?:['"]?([^'")]+)['"]?)\s*\)\z"""


def calls_of(found: DataFrame, components: DataFrame, widgets: DataFrame, routes: DataFrame) -> DataFrame:
    """(widget, event, handler, call_ord, caller, called, data): what each widget's events call.

    A link is its own call. A handler of one function and one argument calls the first route
    that ends with it. Else the calls of the method that it names in the component's class
    stand, an empty row for a method without any; handlers that name none are left out.
    Only the first component class of a file has events.
    """
    own = components.where("primary").select("selector", "path", F.col("name").alias("class"), F.col("ord").alias("_c"))
    said = widgets.select(F.col("component").alias("selector"), F.col("id").alias("widget"), "ord", F.posexplode("events").alias("_e", "e")).join(own, "selector")
    event = F.when(F.col("e.event") == "ngSubmit", "submit").otherwise(F.col("e.event"))
    at = lambda last: F.array(*[x.cast("long") for x in (F.col("_c"), F.col("ord"), F.col("_e"), last)])
    bare = F.expr("cast(array() as array<string>)")
    said = said.select("path", "class", "widget", "_c", "ord", "_e", event.alias("event"), F.col("e.handler").alias("said"))
    is_link = F.col("event").isin("href", "routerLink", "static-redirect")
    links = said.where(is_link).select("widget", "event", F.lit("").alias("handler"), at(F.lit(0)).alias("call_ord"), F.col("event").alias("caller"), F.col("said").alias("called"), bare.alias("data"))
    rest = said.where(~is_link).withColumn("fragment", F.regexp_extract("said", FUNCTION_CALL, 2)).join(fragment_routes(routes), "fragment", "left")
    inline = rest.where("route IS NOT NULL").select("widget", "event", F.lit("").alias("handler"), at(F.lit(0)).alias("call_ord"), F.regexp_extract("said", FUNCTION_CALL, 1).alias("caller"), F.col("route").alias("called"), bare.alias("data"))
    named = rest.where("route IS NULL").withColumn("handler", X.trimmed(F.regexp_replace("said", r"\(.*\)\z", "")))
    known = found.where("kind = 'method'").select("path", F.col("name").alias("class"), text("handler").alias("handler")).distinct()
    made = found.where("kind = 'call'").select("path", F.col("name").alias("class"), text("handler").alias("handler"), F.col("ord").alias("_k"), text("caller").alias("caller"), text("called").alias("called"), listed("data").alias("data"))
    methods = named.join(known, ["path", "class", "handler"]).join(made, ["path", "class", "handler"], "left")
    return links.unionByName(inline).unionByName(methods.select("widget", "event", "handler", at(F.coalesce("_k", F.lit(0))).alias("call_ord"), "caller", "called", "data"))


def validators_of(found: DataFrame, components: DataFrame) -> DataFrame:
    """(component, control, rules, ord) of the forms that component classes build."""
    own = components.select(F.col("selector").alias("component"), "path", "name")
    return found.where("kind = 'validator'").join(own, ["path", "name"]).select("component", text("control").alias("control"), listed("rules").alias("rules"), "ord")


def analysed(found: DataFrame, pages: DataFrame, granularity: str = "method", root: str = "app-root") -> App:
    """All tables of a project and its graph, from `project.extracted` and the external templates (path, source)."""
    with passing(found.sparkSession) as kept:
        made = _analysed(found, pages, granularity, root)
        kept += [made.modules, made.components, made.nested, made.widgets, made.routes, made.redirections, made.calls, made.graph.nodes, made.graph.edges, made.graph.transitions]
    return made


def _analysed(found: DataFrame, pages: DataFrame, granularity: str, root: str) -> App:
    found = cut(numbered(found))
    modules, components = cut(modules_of(found)), cut(components_of(found, pages))
    rows = cut(html.elements(components.select("selector", "template"), "selector", "template"))
    nested = cut(html.nested(rows, "selector").withColumnRenamed("name", "child"))
    flat = cut(html.widgets(rows, "selector").withColumnRenamed("selector", "component").withColumn("ord", F.col("pos").cast("long")))
    widgets = cut(matching.contained_names(flat.withColumn("control", F.try_element_at("attributes", F.lit("formControlName"))), validators_of(found, components)).withColumnRenamed("rules", "validators").withColumnRenamed("html_rules", "rules"))
    raw, redirections = routes_of(found)
    routes, redirections = cut(matching.assigned_modules(raw, modules)), cut(redirections)
    kids = nested.join(first_wins(components.select(F.col("selector").alias("child"), F.col("name").alias("child_name"), "ord"), ["child"]).drop("ord"), "child").join(components.select("selector", F.col("name").alias("parent_name")), "selector")
    classes = components.select(F.col("name").alias("component"), "selector")
    root_class = (classes.where(F.col("selector") == root).agg(F.min("component").alias("c")).first() or {"c": None})["c"]
    usage = roles.reachable_usage(routes.where("component IS NOT NULL"), kids.select(F.col("parent_name").alias("parent"), F.col("child_name").alias("child")).distinct(), root_class)
    told = roles.component_roles(classes, usage, routes.count(), root_class or "", routes)
    components = cut(graph.looked_up_roles(components.drop("template"), told.select("selector", "role")))
    calls = cut(calls_of(found, components, widgets, routes))
    made = graph.build(modules, components, nested, widgets, routes, redirections, calls, granularity)
    made.transitions = cut(made.transitions)
    return App(modules, components, nested, widgets, routes, redirections, calls, made)


def labels_of(app: App) -> DataFrame:
    """(route, label) for every route that a journey may end at, redirects followed."""
    g = app.graph
    wanted = g.nodes.where("type = 'route'").select(F.col("id").alias("route"))
    hops = app.redirections.select(F.col("route").alias("src"), F.col("redirect_to").alias("dst"))
    stops = app.routes.where("component IS NOT NULL").select(F.col("route").alias("id"))
    led = closure.follow(hops.select(F.col("src").alias("id")), hops, stops)
    titled = app.routes.select("route", F.try_element_at("data", F.lit("title")).alias("title"))
    return journeys.route_labels(titled, wanted, led)


def journeys_of(app: App, mode: str = "primary") -> DataFrame:
    """The app's journeys: id, root, steps, siblings, auxiliary_of, success, intent, ord."""
    g = app.graph
    root = graph.root_module(g.nodes)
    parts = 1 + g.nodes.where("type = 'route'").count() // ROUTES_AT_ONCE
    if parts == 1:
        return journeys.registry(journeys.of_graph(g.nodes, g.edges, g.transitions, root), labels_of(app), mode)
    labels = cut(labels_of(app))
    made = []
    for i in range(parts):  # siblings share where they start, so no group is in two parts
        with passing(labels.sparkSession) as kept:
            made.append(cut(journeys.told(journeys.of_graph(g.nodes, g.edges, g.transitions, root, (i, parts)), labels, mode)))
            kept.append(made[-1])
    return journeys.last_of_ids(functools.reduce(DataFrame.unionAll, made))


#: Routes whose journeys are made at once; those of more are made and written part by part.
ROUTES_AT_ONCE = 120_000
