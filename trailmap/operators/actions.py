"""The test-action language, and actions inferred from journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmap.functions import expressions as X

# fixed values
FORM_FIELDS = ("input", "textarea", "select", "mat-select", "mat-checkbox", "mat-radio-group", "mat-radio-button", "mat-button-toggle", "mat-button-toggle-group", "mat-form-field")
SUBMIT_TYPES = ("button", "submit", "mat-button", "mat-icon-button")
DEFAULTS = {"email": "user@example.com", "number": "1", "date": "2000-01-01", "time": "12:00", "month": "2000-01", "week": "2000-W01", "color": "#000000"}
HINTS = (("data-e2e", '[data-e2e="%s"]'), ("id", "#%s"), ("formControlName", '[formControlName="%s"]'), ("name", '[name="%s"]'), ("aria-label", '[aria-label="%s"]'), ("role", '[role="%s"]'), ("matTooltip", '[matTooltip="%s"]'))


# fixed values: forms of references, and messages
REF_ID, REF_ATTR, QUOTED = r"^#([\w\-:./]+)\z", r"(?i)^attr\((.+)\)\z", r'^"([^"]*)"\z'
NEEDS_REF, NEEDS_VALUE, UNKNOWN = " needs a widget ref", ' needs <ref> = "value"', 'Unknown command "'


def _ref(raw: Column) -> tuple[Column, Column]:
    """(id, display) of `#id` or `attr(...)`, null for anything else."""
    t = X.trimmed(raw)
    ident, attr = F.regexp_extract(t, REF_ID, 1), F.regexp_extract(t, REF_ATTR, 1)
    return F.when(ident != "", ident).when(attr != "", F.concat(F.lit("attr:"), attr)), F.when((ident == "") & (attr != ""), F.concat(F.lit("attr("), attr, F.lit(")")))


def _quoted(s: Column) -> Column:
    return F.when(X.trimmed(s).rlike(QUOTED), F.regexp_extract(X.trimmed(s), QUOTED, 1))


def parsed(scripts: DataFrame) -> DataFrame:
    """A row for each line that says something: script_id, line, kind, target, value, or message."""
    lines = scripts.select("script_id", F.posexplode(F.split(F.coalesce("script", F.lit("")), "\r?\n")).alias("at", "raw")).withColumn("text", X.trimmed(F.col("raw")))
    rows = lines.where((F.col("text") != "") & ~F.col("text").rlike(r"^\s*(#|//)"))
    rows = rows.withColumn("head", F.upper(F.get(F.split("text", r"\s+"), F.lit(0)))).withColumn("tail", X.trimmed(F.expr("substring(text, length(head) + 1)")))
    head, rest = F.col("head"), F.col("tail")
    to = F.coalesce(_quoted(rest), rest)
    assigned = head.isin("INPUT", "CHANGE")
    split = F.instr(rest, "=")
    left = F.when(assigned, F.when(split > 0, F.expr("substring(tail, 1, instr(tail, '=') - 1)")).otherwise(rest)).otherwise(rest)
    right = X.trimmed(F.when(split > 0, F.expr("substring(tail, instr(tail, '=') + 1)")).otherwise(F.lit("")))
    ident, display = _ref(left)
    clicks = head.isin("CLICK", "SUBMIT", "CHECK", "UNCHECK")
    return rows.select(
        "script_id",
        (F.col("at") + 1).alias("line"),
        F.when(head == "NAVIGATE", "navigate").when((clicks | assigned) & ident.isNotNull(), F.lower(head)).when(head == "NOOP", "noop").alias("kind"),
        F.when(head == "NAVIGATE", F.when(X.is_external(to), "external").otherwise("route")).when((clicks | assigned) & ident.isNotNull(), "widget").when(head == "NOOP", "virtual").alias("target_type"),
        F.when(head == "NAVIGATE", F.when(X.is_external(to), to).otherwise(X.route_id(to))).when(clicks | assigned, ident).when(head == "NOOP", "/ui/noop").alias("target_id"),
        F.when(clicks | assigned, display).alias("display"),
        F.when(assigned & ident.isNotNull(), F.coalesce(_quoted(right), right)).alias("value"),
        F.when(head == "NOOP", F.coalesce(_quoted(rest), F.nullif(rest, F.lit("")), F.lit("noop"))).alias("reason"),
        F.when(clicks & ident.isNull(), F.concat(head, F.lit(NEEDS_REF))).when(assigned & ident.isNull(), F.concat(head, F.lit(NEEDS_VALUE))).when(~head.isin("NAVIGATE", "NOOP") & ~clicks & ~assigned, F.concat(F.lit(UNKNOWN), head, F.lit('"'))).alias("message"),
    )


def actions_of(lines: DataFrame) -> DataFrame:
    """Lines that are actions, numbered from 0 within their script."""
    w = Window.partitionBy("script_id").orderBy("line")
    return lines.where("kind IS NOT NULL").withColumn("order", F.row_number().over(w) - 1).drop("message")


def diagnostics_of(lines: DataFrame) -> DataFrame:
    return lines.where("message IS NOT NULL").select("script_id", "line", F.lit(1).alias("column"), "message", F.lit("error").alias("severity"))


def guessed_kind(type_: Column) -> Column:
    return F.when(type_.isin(*SUBMIT_TYPES), "submit").when(type_.isin("input", "textarea"), "input").when(type_.isin(*FORM_FIELDS), "change").otherwise("click")


def default_value(type_: Column, first_option: Column | None = None) -> Column:
    out = F.lit(None).cast("string")
    for k, v in DEFAULTS.items():
        out = F.when(type_ == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, first_option if first_option is not None else F.lit(None).cast("string"), F.lit(""))


def change_kind(type_: Column, rules: Column) -> Column:
    return F.when(type_.isin("checkbox", "mat-checkbox") & F.exists(rules, lambda r: r.rlike("(?i)requiredTrue")), "check").otherwise("change")


def selector_hint(attributes: Column) -> Column:
    """The best selector among the attributes: by test id, id, control, name, label, role, tooltip."""
    return F.coalesce(*[F.when(F.coalesce(F.try_element_at(attributes, F.lit(k)), F.lit("")) != "", F.format_string(f, F.try_element_at(attributes, F.lit(k)))) for k, f in HINTS])


def widgets_of(nodes: DataFrame) -> DataFrame:
    """(id, type, attributes, rules, triggers_submit) of a graph's widgets; the type is the attribute of that name, else the word widget."""
    own = nodes.where("type = 'widget'")
    kind = F.coalesce(F.nullif(F.try_element_at("attributes", F.lit("type")), F.lit("")), F.lit("widget"))
    none = F.expr("cast(array() as array<string>)")
    return own.select("id", kind.alias("type"), "attributes", F.coalesce("rules", none).alias("rules"), F.coalesce("triggers_submit", F.lit(False)).alias("triggers_submit"))


def widget_meta(via: Column, rules: Column, options: Column, attributes: Column) -> Column:
    """What an action notes of its widget: via, validators, options if there are any, and the best selector."""
    return F.struct(via.alias("via"), F.coalesce(rules, F.expr("cast(array() as array<string>)")).alias("validators"), F.when(F.size(options) > 0, options).alias("options"), selector_hint(attributes).alias("selector_hint"))


def inferred(steps: DataFrame, widgets: DataFrame) -> DataFrame:
    """(journey, order, kind, target_type, target_id, value) from steps (journey, pos, step_type, node_id, via).

    `widgets` (id, type, rules) are the graph's. A route is navigated to unless the last
    navigation already went there; an interaction acts by its via; a widget acts itself
    unless an interaction follows; backends and virtual routes only note what happens.
    Journeys without any navigation or click get one to their first route.
    """
    w = Window.partitionBy("journey").orderBy("pos")
    s = steps.withColumn("next_type", F.lead("step_type").over(w))
    nav = F.col("step_type").isin("route", "external-route")
    s = s.withColumn("nav_id", F.when(F.col("step_type") == "route", X.route_id(F.col("node_id"))).when(F.col("step_type") == "external-route", F.col("node_id")))
    s = s.withColumn("last_nav", F.last("nav_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.join(widgets.select(F.col("id").alias("node_id"), F.col("type").alias("wtype"), "rules"), "node_id", "left")
    via, known = F.lower(F.coalesce("via", F.lit(""))), F.col("wtype").isNotNull()
    is_w, is_i = F.col("step_type") == "widget", F.col("step_type") == "interaction"
    link = is_i & via.isin("routerlink", "href", "static-redirect")
    dangling = link & ~F.coalesce(F.col("next_type").isin("route", "external-route"), F.lit(False))
    fresh = nav & ~F.coalesce(F.col("nav_id") == F.col("last_nav"), F.lit(False))
    kind = (
        F.when(nav, F.when(fresh, "navigate"))
        .when(is_w, F.when(known & (F.coalesce("next_type", F.lit("")) != "interaction"), guessed_kind(F.col("wtype"))))
        .when(link, F.when(dangling, "navigate"))
        .when(is_i & ~known, "click")
        .when(is_i & via.isin("click", "submit", "input"), via)
        .when(is_i & (via == "change"), change_kind(F.col("wtype"), F.col("rules")))
        .when(is_i, guessed_kind(F.col("wtype")))
        .when(F.col("step_type").isin("backend", "virtual-route"), "noop")
    )
    target = F.when(nav, F.col("nav_id")).when(dangling, "/").when(F.col("step_type") == "backend", F.when(F.coalesce("node_id", F.lit("")) == "", X.VIRTUAL_BACKEND).when(F.startswith("node_id", F.lit("/backend")) | (F.col("node_id") == X.VIRTUAL_BACKEND), F.col("node_id")).otherwise(F.concat(F.lit("/backend/"), "node_id"))).otherwise(F.col("node_id"))
    target_type = F.when((F.col("step_type") == "route") | dangling, "route").when(F.col("step_type") == "external-route", "external").when(F.col("step_type") == "backend", "backend").when(F.col("step_type") == "virtual-route", "virtual").otherwise("widget")
    value = F.when(is_i & known & ~link & via.isin("input", "change"), default_value(F.col("wtype")))
    acts = s.select("journey", "pos", kind.alias("kind"), target_type.alias("target_type"), target.alias("target_id"), value.alias("value")).where("kind IS NOT NULL")
    idle = s.groupBy("journey").agg(F.min_by("node_id", F.when(F.col("step_type") == "route", F.col("pos"))).alias("first_route"), F.max("pos").alias("pos")).join(acts.where("kind IN ('navigate', 'click')").select("journey"), "journey", "left_anti")
    extra = idle.select("journey", (F.col("pos") + 1).alias("pos"), F.lit("navigate").alias("kind"), F.lit("route").alias("target_type"), F.coalesce(F.regexp_replace("first_route", "^/?", "/"), F.lit("/")).alias("target_id"), F.lit(None).cast("string").alias("value"))
    return acts.unionByName(extra).withColumn("order", (F.row_number().over(w) - 1).cast("long")).drop("pos")


def with_catalog(actions: DataFrame, catalog: DataFrame, widgets: DataFrame) -> DataFrame:
    """Actions, and after them one for each catalogued widget (journey, id, ord) that the graph knows and none targets yet.

    What is targeted is looked up once: an id twice in the catalog comes twice.
    """
    aimed = actions.where("target_type = 'widget'").select("journey", F.trim("target_id").alias("id"))
    extra = catalog.withColumn("id", F.trim("id")).join(aimed, ["journey", "id"], "left_anti").join(widgets.select("id", F.col("type").alias("wtype")), "id")
    kind = guessed_kind(F.col("wtype"))
    made = extra.select("journey", kind.alias("kind"), F.lit("widget").alias("target_type"), F.col("id").alias("target_id"), F.when(kind.isin("input", "change"), default_value(F.col("wtype"))).alias("value"), F.struct(F.lit(1).alias("late"), F.col("ord").cast("long").alias("at")).alias("_o"))
    both = actions.withColumn("_o", F.struct(F.lit(0).alias("late"), F.col("order").cast("long").alias("at"))).drop("order").unionByName(made)
    return both.withColumn("order", F.row_number().over(Window.partitionBy("journey").orderBy("_o")) - 1).drop("_o")
