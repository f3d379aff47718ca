"""Requests as JSON lines: an explicit schema, required fields and allowed values, and answers as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A condition that a request must meet, and what is said where it doesn't."""

    condition: str
    message: str


def required(*fields: str) -> tuple[Rule, ...]:
    return tuple(Rule(f"{f} IS NOT NULL AND CAST({f} AS STRING) <> ''", f"{f} is required") for f in fields)


def one_of(field: str, *values: str) -> Rule:
    return Rule(f"{field} IS NULL OR {field} IN ({', '.join(repr(v) for v in values)})", f"{field} must be one of {', '.join(values)}")


def parsed(lines: DataFrame, column: str, schema: str, rules: tuple[Rule, ...] = ()) -> DataFrame:
    """`lines` with the fields of `schema`, null where a body can't be read, and `violations`: what is wrong, in the order of the rules."""
    out = lines.withColumn("_body", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    out = out.select(*lines.columns, "_body.*", F.col("_body").isNull().alias("_unread"))
    said = [F.when(~F.coalesce(F.expr(r.condition), F.lit(False)), F.lit(r.message)) for r in rules]
    none = F.when(F.col("_unread"), F.lit("the body is no JSON object"))
    return out.withColumn("violations", F.filter(F.array(none, *said), lambda x: x.isNotNull())).drop("_unread")


def answers(df: DataFrame, success: Column | None = None) -> DataFrame:
    """One column `body`: each row as a JSON object with `success` first."""
    ok = success if success is not None else F.lit(True)
    return df.select(F.to_json(F.struct(ok.alias("success"), *[F.col(c) for c in df.columns])).alias("body"))


def by_name(df: DataFrame, column: str = "id") -> DataFrame:
    """Ordered as a reader would: a, A, b, B."""
    return df.orderBy(F.expr(f"{column} COLLATE UNICODE"), column)


# fixed values: kinds of nodes, steps and edges, and the fields of what is exchanged
NODE_KINDS = ("module", "route", "component", "widget", "external-route", "backend", "virtual-route")
STEP_KINDS = (*NODE_KINDS, "interaction")
EDGE_KINDS = ("contains", "imports", "declares")
NODE = "struct<id: string, type: string, attributes: map<string,string>, validationRules: array<string>, triggersFormSubmission: boolean>"
RELATION = "struct<from: string, to: string, type: string, metadata: map<string,string>>"
GRAPH = f"struct<nodes: array<{NODE}>, edges: array<{RELATION}>, transitions: array<{RELATION}>>"
ROUTE = "struct<route: string, module: string, component: string, loadChildren: string, loadComponent: string, pathMatch: string, canActivate: array<string>, canActivateChild: array<string>, canLoad: array<string>, resolve: map<string,string>, data: map<string,string>>"
REDIRECT = "struct<route: string, module: string, redirectTo: string, pathMatch: string>"
ROUTE_MAP = f"struct<routes: array<{ROUTE}>, redirections: array<{REDIRECT}>>"
STEP = "struct<stepType: string, nodeId: string, via: string, metadata: map<string,string>>"
JOURNEY = f"struct<id: string, rootModule: string, name: string, projectRoot: string, steps: array<{STEP}>, intent: string, success: boolean, source: string>"
REFINE_REQUEST = f"analysisId string, journeys array<{JOURNEY}>, routeMap {ROUTE_MAP}, graph {GRAPH}"
REFINE_ANSWER = f"added array<{JOURNEY}>, removed array<string>, merged array<struct<`from`: array<string>, `to`: {JOURNEY}>>, updated array<{JOURNEY}>, finalJourneys array<{JOURNEY}>, meta map<string,string>"


def _each(array: str, condition: str) -> str:
    return f"{array} IS NULL OR forall({array}, x -> coalesce({condition}, false))"


def _kind(field: str, values: tuple[str, ...]) -> str:
    return f"{field} IN ({', '.join(repr(v) for v in values)})"


def journey_rules(array: str) -> tuple[Rule, ...]:
    step = f"{_kind('s.stepType', STEP_KINDS)} AND s.nodeId <> ''"
    return (
        Rule(_each(array, "x.id <> '' AND x.rootModule <> ''"), f"{array}: each needs id and rootModule"),
        Rule(_each(array, f"size(x.steps) > 0 AND forall(x.steps, s -> coalesce({step}, false))"), f"{array}: each needs steps of known types with a nodeId"),
        Rule(_each(array, "x.source IS NULL OR x.source IN ('analyzer', 'llm')"), f"{array}: source is analyzer or llm"),
    )


REQUEST_RULES = (
    *required("analysisId"),
    Rule("size(journeys) > 0", "journeys is required"),
    *journey_rules("journeys"),
    Rule("graph IS NOT NULL OR routeMap IS NOT NULL", "graph or routeMap must be given"),
    Rule(f"graph IS NULL OR (graph.nodes IS NOT NULL AND graph.edges IS NOT NULL AND graph.transitions IS NOT NULL AND forall(graph.nodes, x -> coalesce(x.id <> '' AND {_kind('x.type', NODE_KINDS)}, false)))", "graph: needs nodes of known types, edges and transitions"),
    Rule(f"graph IS NULL OR graph.edges IS NULL OR forall(graph.edges, x -> coalesce(x.`from` <> '' AND x.`to` <> '' AND {_kind('x.type', EDGE_KINDS)}, false))", "graph: edges need from, to and a known type"),
    Rule("graph IS NULL OR graph.transitions IS NULL OR forall(graph.transitions, x -> coalesce(x.`from` <> '' AND x.`to` <> '' AND x.type <> '', false))", "graph: transitions need from, to and type"),
    Rule("routeMap IS NULL OR routeMap.routes IS NULL OR forall(routeMap.routes, x -> coalesce(x.route <> '' AND (x.pathMatch IS NULL OR x.pathMatch IN ('full', 'prefix')), false))", "routeMap: routes need a route, and pathMatch is full or prefix"),
    Rule("routeMap IS NULL OR routeMap.redirections IS NULL OR forall(routeMap.redirections, x -> coalesce(x.route <> '' AND x.redirectTo <> '', false))", "routeMap: redirections need route and redirectTo"),
)
ANSWER_RULES = tuple(r for a in ("added", "updated", "finalJourneys") for r in journey_rules(a)) + (Rule("merged IS NULL OR forall(merged, x -> coalesce(size(x.`from`) > 0 AND x.`to`.id <> '', false))", "merged: each needs from and to"),)


def refine_requests(lines: DataFrame, column: str) -> DataFrame:
    """Requests to refine journeys, with what violates their schema. Fields that it doesn't know are let pass."""
    return parsed(lines, column, REFINE_REQUEST, REQUEST_RULES)


def refine_answers(lines: DataFrame, column: str) -> DataFrame:
    """A model's answers, lists that it left out as empty ones, with what violates their schema."""
    out = parsed(lines, column, REFINE_ANSWER, ANSWER_RULES)
    kinds = dict(out.dtypes)
    return out.withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {kinds[c]})")) for c in ("added", "removed", "merged", "updated", "finalJourneys")})
