"""Behaviour of single operators on small cases, each with the reason for its expected value."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trailmap.functions import expressions as X
from trailmap.operators import actions, closure, dedupe, journeys, matching, navigation, validation
from trailmap.sources import html
from trailmap.streaming import stateful


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("app-foo-bar", "FooBarComponent"), ("app-fooBar", "FooBarComponent"), ("root", "")])
def test_selector_to_class(spark, given, wanted):
    assert one(spark, X.selector_to_class(F.col("s")), s=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("", "/"), ("/", "/"), ("a", "/a"), ("/a/", "/a"), ("/a//", "/a/")])
def test_route_path(spark, given, wanted):
    assert one(spark, X.route_path(F.col("s")), s=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("a__0123abcd/b__0123abcd", "a/b__0123abcd"), ("a__0123abcde", "a__0123abcde"), ("https://x/a__0123abcd", "https://x/a__0123abcd")])
def test_base_id_cuts_the_first_suffix_only(spark, given, wanted):
    assert one(spark, X.base_id(F.col("s")), s=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("mailto:a@b?subject=c", "Email • a@b"), ("tel:1", "Call • 1"), ("http://User@Host:80/x", "External • host"), ("x", "External")])
def test_external_label(spark, given, wanted):
    assert one(spark, X.external_label(F.col("s")), s=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("/a/b%20c", "b c"), ("/a/b+c", "b+c"), ("/", ""), ("/x%zz", "x%zz")])
def test_tail_segment_keeps_plus_signs(spark, given, wanted):
    assert one(spark, X.tail_segment(F.col("s")), s=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("['/u', id]", "/u"), ("/u/{{ a.b.id }}", "/u/:id"), ("/u in inline@x", "/u")])
def test_link(spark, given, wanted):
    assert one(spark, X.link(F.col("s")), s=given) == wanted


def test_backend_noise_is_dropped_before_backends_are_kept(spark):
    noise = X.is_noise_call(F.col("c"), F.col("m"), X.is_backend_caller(F.col("c")), F.lit(False), X.NOISE_METHODS, X.FREE_FUNCTIONS)
    assert one(spark, noise, c="this.http", m="get") is True
    assert one(spark, noise, c="this.http", m="post") is False
    assert one(spark, noise, c="console", m="log") is True
    assert one(spark, noise, c="", m="of") is True


def routes(spark, *rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "route string, ord long")


def test_canonical_route_prefers_itself_then_the_first(spark):
    known = routes(spark, "/a/:x", "/:y/b", "/a/b", "/a/:z/c")
    given = spark.createDataFrame([("/a/b",), ("/q/b",), ("/a/this.id/c",), ("/none",)], "target string")
    got = {r["target"]: r["canonical"] for r in matching.canonical_routes(given, known).collect()}
    assert got == {"/a/b": "/a/b", "/q/b": "/:y/b", "/a/this.id/c": "/a/:z/c", "/none": "/none"}


def test_first_wins_keeps_missing_attributes(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "role", 2), ("b", "x", 5), ("b", "y", 4)], "id string, role string, ord long")
    assert {tuple(r) for r in dedupe.first_wins(rows, ["id"]).collect()} == {("a", None, 1), ("b", "y", 4)}
    assert {tuple(r) for r in dedupe.last_wins(rows, ["id"]).collect()} == {("a", "role", 1), ("b", "x", 4)}


def test_merge_routes_whatever_the_partitions(spark):
    given = [("/a", "", ["g1"], {"t": "1"}, 2), ("/a", "A", ["g2", "g1"], {"t": "2", "u": "3"}, 3), ("/a", "B", None, None, 4), ("/b", None, None, None, 1)]
    for seed in range(3):
        random.Random(seed).shuffle(given)
        df = spark.createDataFrame(given, "route string, component string, guards array<string>, data map<string,string>, ord long").repartition(3)
        got = {r["route"]: r for r in dedupe.merge_routes(df, ("component",), ("guards",), ("data",)).collect()}
        assert got["/a"]["component"] == "A" and got["/a"]["guards"] == ["g1", "g2"] and got["/a"]["data"] == {"t": "2", "u": "3"} and got["/a"]["ord"] == 2
        assert got["/b"]["component"] is None and got["/b"]["guards"] == []


def test_closures_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("o", "a")], "origin string, id string")
    assert {r["id"] for r in closure.reach(start, edges).collect()} == {"a", "b", "c", "d"}
    paths = closure.paths(spark.createDataFrame([("a",)], "id string"), edges.withColumn("ord", F.lit(0).cast("long")))
    assert {tuple(r["path"]) for r in paths.collect()} == {("b",), ("b", "c"), ("b", "c", "d")}
    up = spark.createDataFrame([("w", "x"), ("x", "w")], "child string, parent string")
    assert closure.nearest(spark.createDataFrame([("w",)], "id string"), up, spark.createDataFrame([("f",)], "id string")).count() == 0


def test_redirects_stop_loop_end_and_give_up(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "/r"), ("l", "m"), ("m", "l"), ("e", "gone"), *[(f"c{i}", f"c{i + 1}") for i in range(20)]], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("l",), ("e",), ("c0",)], "id string")
    got = {r["id"]: (r["final"], r["hops"], r["outcome"]) for r in closure.follow(starts, hops, spark.createDataFrame([("/r",)], "id string")).collect()}
    assert got == {"a": ("/r", 2, "stop"), "l": ("m", 1, "loop"), "e": ("gone", 1, "end"), "c0": ("c12", 12, "limit")}


def test_an_href_also_makes_a_virtual_route(spark):
    calls = spark.createDataFrame([("w", "href", None, 1, "this", "http://x", []), ("v", "routerLink", None, 1, "this", "nowhere", []), ("u", "click", "go()", 1, "this.router", "navigate", ["a", "b"]), ("t", "click", None, 1, "this.userService", "load", []), ("t", "click", None, 2, "this.userService", "pipe", [])], "widget string, event string, handler string, call_ord long, caller string, called string, data array<string>")
    got = {tuple(r) for r in navigation.widget_transitions(calls, routes(spark, "/a/:id")).select("src", "dst", "type", "dst_type").collect()}
    assert got == {("w", "http://x", "href", "external-route"), ("w", "/ui/w/href", "href", "virtual-route"), ("v", "/ui/v/routerLink", "routerLink", "virtual-route"), ("u", "/a/:id", "click", "route"), ("t", "/backend/user/load", "service-call", "backend")}


STEPS = "array<struct<step_type: string, node_id: string, via: string>>"


def test_siblings_summary_and_collapse(spark):
    head = [("route", "/a", None), ("widget", "w", None), ("interaction", "w", "click")]
    rows = [("1", [*head, ("backend", "/backend/x", None)], 1), ("2", [*head, ("route", "/b", None)], 2), ("3", [*head, ("virtual-route", "/ui/w", None)], 3), ("4", [("route", "/a", None), ("backend", "/backend/y", None)], 4)]
    df = spark.createDataFrame(rows, f"id string, steps {STEPS}, ord long")
    got = {r["id"]: r for r in journeys.grouped(df).collect()}
    assert got["2"]["auxiliary_of"] is None and got["1"]["auxiliary_of"] == "2" and got["2"]["aux_backend"] == ["/backend/x"] and got["2"]["aux_virtual"] == ["/ui/w"]
    rows[1] = ("2", [*head, ("backend", "/backend/w", None)], 2)
    kept = {r["id"]: r for r in journeys.grouped(spark.createDataFrame(rows, f"id string, steps {STEPS}, ord long"), "collapse").collect()}
    assert set(kept) == {"1", "4"} and kept["1"]["steps"][-1]["node_id"] == "/virtual/backend" and kept["1"]["collapsed_from"] == "/backend/x"
    assert kept["4"]["steps"][-1]["node_id"] == "/backend/y"  # alone, so it stays


def test_labels(spark):
    known = spark.createDataFrame([("/users", " People "), ("/empty", ""), ("/plain-list", None)], "route string, title string")
    wanted = spark.createDataFrame([(r,) for r in ("/", "/**", "/users/:id", "/:id", "/users", "/empty", "/plain-list", "/other-one")], "route string")
    got = {r["route"]: r["label"] for r in journeys.route_labels(known, wanted).collect()}
    assert got == {"/": "Home", "/**": "Not Found", "/users/:id": "Users Profile", "/:id": "Item Profile", "/users": "People", "/empty": "", "/plain-list": "Plain List", "/other-one": "Other One"}


def test_coverage_may_exceed_a_hundred(spark):
    nodes = spark.createDataFrame([("/a", "route")], "id string, type string")
    steps = spark.createDataFrame([("/a", "route"), ("/x", "route")], "node_id string, step_type string")
    r = validation.coverage(nodes, steps).first()
    assert r["routes_pct"] == 200 and r["backends_pct"] == 100


def test_action_language(spark):
    script = '# note\nNAVIGATE "users"\nnavigate https://x.org\nclick #save\nSUBMIT\nINPUT #name = "a=b"\nINPUT attr(k="v") = "x"\nCHECK attr(formControlName="ok")\nNOOP\nDANCE now'
    lines = actions.parsed(spark.createDataFrame([(1, script)], "script_id long, script string"))
    got = [(r["order"], r["kind"], r["target_type"], r["target_id"], r["value"]) for r in actions.actions_of(lines).orderBy("order").collect()]
    assert got == [(0, "navigate", "route", "/users", None), (1, "navigate", "external", "https://x.org", None), (2, "click", "widget", "save", None), (3, "input", "widget", "name", "a=b"), (4, "check", "widget", 'attr:formControlName="ok"', None), (5, "noop", "virtual", "/ui/noop", None)]
    assert [(r["line"], r["message"]) for r in actions.diagnostics_of(lines).orderBy("line").collect()] == [(5, "SUBMIT needs a widget ref"), (7, 'INPUT needs <ref> = "value"'), (10, 'Unknown command "DANCE"')]


def test_catalog_ids_come_twice_if_listed_twice(spark):
    acts = spark.createDataFrame([("j", 0, "click", "widget", "a", None)], "journey string, order long, kind string, target_type string, target_id string, value string")
    widgets = spark.createDataFrame([("a", "button"), ("b", "input")], "id string, type string")
    catalog = spark.createDataFrame([("j", "a", 0), ("j", "b", 1), ("j", " b", 2), ("j", "zz", 3)], "journey string, id string, ord long")
    got = [(r["order"], r["kind"], r["target_id"]) for r in actions.with_catalog(acts, catalog, widgets).orderBy("order").collect()]
    assert got == [(0, "click", "a"), (1, "input", "b"), (2, "input", "b")]


def test_limiter_does_not_count_the_first_request(spark):
    rows = [("k", i, 10 * i) for i in range(6)] + [("k", 9, 60_001)]
    df = spark.createDataFrame(rows, "key string, request_id long, ms long")
    got = {r["request_id"]: r["allowed"] for r in stateful.rate_limited(df, limit=2).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 9: True}


def test_limiter_on_a_stream(spark, tmp_path):
    schema = "key string, request_id long, ms long"
    spark.createDataFrame([("k", i, 10 * i) for i in range(5)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.rate_limited_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), limit=2)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["request_id"]: r["allowed"] for r in spark.sql("SELECT * FROM limited").collect()} == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_cache(spark):
    e = spark.createDataFrame([(1, "k", 0, "get", None), (2, "k", 10, "set", "v"), (3, "k", 20, "get", None), (4, "k", 111, "get", None), (5, "k", 112, "set", "w"), (6, "k", 113, "delete", None), (7, "k", 114, "get", None)], "event_id long, key string, ms long, op string, value string")
    assert {r["event_id"]: r["value"] for r in stateful.cache_hits(e, 100).collect()} == {1: None, 3: "v", 4: None, 7: None}


def test_template_widgets(spark):
    page = '<app-x></app-x><form (ngSubmit)="save()"><input formControlName="eMail" required><button type="submit">Send it now</button></form><div><a [routerLink]="[\'/u\']">U</a></div><input formControlName="eMail">'
    rows = html.elements(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"))
    w = html.widgets(rows).orderBy("pos").collect()
    assert [r["tag"] for r in w] == ["form", "input", "button", "a", "input"]
    assert [r["type"] for r in w] == ["form", "text", "submit", "a", "text"]
    assert w[1]["rules"] == ["required"] and w[2]["triggers_submit"] and w[2]["id"].startswith("1__button__send_it_now__")
    assert w[1]["id"].startswith("1__input__email__") and w[4]["id"].startswith("1__input__email__") and w[1]["id"] != w[4]["id"]
    assert [r["parent_id"] for r in w] == [None, w[0]["id"], w[0]["id"], None, None]
    assert [tuple(e) for e in w[0]["events"]] == [("ngSubmit", "save")] and [tuple(e) for e in w[3]["events"]] == [("routerLink", "/u")]


def test_widgets_bubble_and_are_named_by_their_longest_text(spark):
    page = """<section (click)="pick($event)"><p>short</p><span>a longer text</span><em *ngIf="x">the longest text of all here</em><ng-template><b>or this one which is longer still</b></ng-template>{{ bound and very very very long }}
<div><div (hover)="h()"><my-el (x)="y()"></my-el></div></div></section><app-a (go)="g()"></app-a><APP-b></APP-b><form [formGroup]="theForm value"></form><input id=" own " [(ngModel)]="m"><a routerLink="/a/{{ b.c }}/d" href="">x</a>"""
    rows = html.elements(spark.createDataFrame([("k", page)], "sel string, html string"), "sel")
    w = html.widgets(rows, "sel").orderBy("pos").collect()
    ids = [r["id"] for r in w]
    assert ids[3] == "k__APP-A"
    assert ids[0].startswith("k__section__a_longer_text__") and ids[1:3] == ["k__DIV", "k__MY-EL"] and ids[4].startswith("k__form__theForm__") and ids[5] == "k__own" and ids[6].startswith("k__a___a_{{_b.c_}}_d__")
    assert [r["parent_id"] for r in w] == [None, ids[0], ids[1], None, None, None, None]
    assert [tuple(e) for e in w[0]["events"]] == [("click", "pick($event)")] and [tuple(e) for e in w[5]["events"]] == [("ngModelChange", "m")] and [tuple(e) for e in w[6]["events"]] == [("routerLink", "/a/:c/d")]
    assert [(r["name"], r["ord"]) for r in html.nested(rows, "sel").orderBy("ord").collect()] == [("app-a", 9), ("APP-b", 10)]


def test_symbolic_ids_are_numbered_as_elements_end(spark):
    rows = html.elements(spark.createDataFrame([("k", "<div (a)='x()'><div (a)='y()'></div></div><div (a)='z()'></div>")], "sel string, html string"), "sel")
    assert [r["id"] for r in html.widgets(rows, "sel").orderBy("pos").collect()] == ["k__DIV__2", "k__DIV", "k__DIV__3"]


def test_bounded_closures_raise_when_cut_short(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)], "src string, dst string")
    start = spark.createDataFrame([("o", "0")], "origin string, id string")
    assert closure.reach(start, edges, most=6).count() == 6
    with pytest.raises(RuntimeError, match="not complete"):
        closure.reach(start, edges, most=3)


def test_first_transition_stands_with_what_it_was(spark):
    calls = spark.createDataFrame(
        [("w", "click", "a()", 5, "this.userService", "load", []), ("w", "blur", "b()", 2, "this.userService", "load", []), ("w", "blur", "b()", 3, "this", "show", []), ("w", "blur", "b()", 1, "this", "hide", [])],
        "widget string, event string, handler string, call_ord int, caller string, called string, data array<string>",
    )
    got = [r.asDict() for r in navigation.widget_transitions(calls, routes(spark, "/a")).collect()]
    assert len(got) == 1 and got[0]["dst"] == "/backend/user/load" and got[0]["source_event"] == "blur" and got[0]["handler"] == "b()" and got[0]["effects"] == ["hide", "show"] and got[0]["service"] == "user"


def test_report_registry_and_lookups(spark):
    nodes = spark.createDataFrame([("w__0123abcd", "widget"), ("/a", "route"), ("/b", "backend")], "id string, type string")
    steps = spark.createDataFrame([("j", 0, "widget", "w"), ("j", 1, "route", "/b"), ("k", 0, "widget", "none__89abcdef"), ("k", 1, "backend", "/b")], "journey string, pos int, step_type string, node_id string")
    r = validation.report(nodes, steps).first()
    assert (r["missing"], r["tail_mismatches"], r["base_looking_widgets"]) == (2, 1, 1)
    assert [(e["node_id"], e["suggested"]) for e in r["examples"]] == [("w", "w__0123abcd"), ("none__89abcdef", None)]
    reg = validation.Registry(spark.createDataFrame([("b", 1), ("A", 2)], "id string, n int"))
    assert [x["id"] for x in reg.all().collect()] == ["A", "b"] and reg.has("b") and reg.size() == 2 and reg.clear().size() == 0
    more = reg.add(spark.createDataFrame([("b", 9)], "id string, n int"))
    assert more.get("b").first()["n"] == 9 and more.remove("A").size() == 1


def test_cache_on_a_stream_and_of_analyses(spark, tmp_path):
    schema = "event_id long, key string, ms long, op string, value string"
    rows = [(1, "k", 0, "get", None), (2, "k", 10, "set", "v"), (3, "k", 20, "get", None), (4, "k", 111, "get", None), (5, "k", 112, "set", "w"), (6, "k", 113, "delete", None), (7, "k", 114, "get", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stateful.cache_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100).writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"]: r["value"] for r in spark.sql("SELECT * FROM cached").collect()} == {1: None, 3: "v", 4: None, 7: None}
    assert stateful.swept(spark.createDataFrame([("a", 5), ("b", 4)], "key string, ends long"), 5).count() == 1
    now = [0]
    cache = stateful.AnalysisCache(10, lambda: now[0])
    assert not cache.put_journey("a", "j", 1)
    cache.put("a", "graph", "routes")
    now[0] = 8
    assert cache.put_journey("a", "j", 1) and cache.put_scenario("a", "j", "s", 2) and not cache.put_scenario("a", "x", "s", 2)
    now[0] = 18
    assert cache.get("a")["journeys"]["j"]["scenarios"] == {"s": 2}
    now[0] = 19
    assert cache.get("a") is None


def test_collapse_writes_nothing_and_keeps_journeys_of_the_primarys_id(spark, monkeypatch):
    rows = []
    for i, (ident, kind, node) in enumerate([("a", "backend", "/backend/x"), ("b", "backend", "/backend/y"), ("a", "backend", "/backend/x"), ("c", "route", "/r")]):
        root = "M" if i < 3 else "N"
        rows.append((ident, root, [("route", "/n", None), ("widget", root, None), ("interaction", root, "click"), (kind, node, None)], i))
    given = spark.createDataFrame(rows, f"id string, root string, steps array<{journeys.STEP}>, ord int")
    primaries = journeys.grouped(given).where("auxiliary_of IS NULL").select("id", "ord", "siblings", "primary", "aux_backend")
    wanted = sorted(map(tuple, primaries.collect()))

    def written(df):
        raise AssertionError("journeys were written")

    monkeypatch.setattr(journeys, "cut", written)
    got = journeys.grouped(given, "collapse")
    assert sorted(map(tuple, got.select("id", "ord", "siblings", "primary", "aux_backend").collect())) == wanted and len(wanted) == 3
    assert {r["ord"]: (r["collapsed_from"], r["steps"][-1]["node_id"]) for r in got.collect()} == {0: ("/backend/x", X.VIRTUAL_BACKEND), 2: ("/backend/x", X.VIRTUAL_BACKEND), 3: (None, "/r")}
