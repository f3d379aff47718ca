"""A small project read from disk, and what surrounds a language model's answers."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from trailmap.operators import app, graph, refine, screenshots
from trailmap.sources import project, requests, settings


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "app").mkdir()
    (root / "app" / "list.component.html").write_text('<a routerLink="/users/1">one</a>')
    (root / "app" / "list.component.ts").write_text("""
import { Component } from '@angular/core';
@Component({ selector: 'app-list', templateUrl: './list.component.html', styles: [`a { b: c }`] })
export class ListComponent {
  constructor(private router: Router, private userService: UserService) {}
  open(id: string) { if (id) { this.router.navigate(['/users', id]); } this.userService.load(id); this.userService.load(id); }
  get total() { return 1; }
}
@Component({ template: 'none' }) export class NoSelector {}
""")
    (root / "app" / "app-routing.module.ts").write_text("""
import { Routes, RouterModule } from '@angular/router';
// { path: 'commented' }
const routes: Routes = [
  { path: '', redirectTo: 'users', pathMatch: 'full' },
  { path: 'users', component: ListComponent, data: { title: 'Users' }, canActivate: [AuthGuard, RoleGuard], children: [{ path: ':id', component: OneComponent }] },
  { path: 'admin', loadChildren: () => import('./admin.module').then(m => m.AdminModule) },
];
@NgModule({ imports: [RouterModule.forRoot(routes), CommonModule], declarations: [ListComponent], exports: [RouterModule] })
export class AppRoutingModule {}
""")
    (root / "app" / "broken.ts").write_text("@Component({ selector: ")
    found = project.extracted(project.files(spark, str(root), ".ts"))
    return found.collect(), project.templates(found, project.files(spark, str(root), ".html")).collect()


def test_modules_and_components(rows):
    found, pages = rows
    module = next(r for r in found if r["kind"] == "module")
    assert module["name"] == "AppRoutingModule" and module["lists"]["imports"] == ["RouterModule.forRoot(routes)", "CommonModule"] and module["lists"]["declarations"] == ["ListComponent"]
    assert [(r["name"], r["selector"], r["template"]) for r in pages] == [("ListComponent", "app-list", '<a routerLink="/users/1">one</a>')]


def test_routes(rows):
    got = {r["name"]: r for r in rows[0] if r["kind"] == "route"}
    assert set(got) == {"users", "users/:id", "admin"}
    assert next(r for r in rows[0] if r["kind"] == "redirect")["text"]["redirect_to"] == "users"
    assert got["users"]["lists"]["can_activate"] == ["AuthGuard", "RoleGuard"] and got["users"]["text"]["data.title"] == "Users"
    assert "m => m.AdminModule" in got["admin"]["text"]["load_children"]


def test_calls(rows):
    got = [(r["text"]["handler"], r["text"]["caller"], r["text"]["called"], r["lists"]["data"]) for r in rows[0] if r["kind"] == "call"]
    assert got == [("open", "this.router", "navigate", ["users", "id"]), ("open", "this.userService", "load", ["/backend", "user", "load"])]


def test_refinement_asks_twice_when_nothing_changes(spark):
    class Late:
        def __init__(self):
            self.asked = []

        def complete(self, system, prompt, most_tokens):
            self.asked.append(prompt)
            return "```json\n{\"removed\": [\"x\"]}\n```" if len(self.asked) == 2 else "no json"

    late = Late()
    got = refine.ask(late, {"graph": {}}, lambda r, again: ("s", "again" if again else "first"))
    assert got.asked == 2 and got.answer["removed"] == ["x"] and got.answer["finalJourneys"] == [] and late.asked == ["first", "again"]
    silent = refine.ask(refine.Silent(), {"graph": {}, "journeys": [{"id": "j", "steps": []}]})
    assert silent.asked == 2 and silent.answer["finalJourneys"] == [{"id": "j", "steps": [], "source": "llm"}]
    with pytest.raises(refine.RefineError) as none:
        refine.ask(None, {"graph": {}})
    assert [refine.failure(e) for e in (none.value, TimeoutError(), ValueError(), ConnectionError(), KeyError())] == [503, 504, 502, 503, 500]
    for request, status in (({}, 400), ({"graph": "x" * refine.MOST_BYTES}, 413)):
        with pytest.raises(refine.RefineError) as e:
            refine.ask(late, request, lambda r, again: ("", ""))
        assert e.value.status == status
    df = spark.createDataFrame([("", None, [("route", "/a", None)]), ("k", "analyzer", [("route", "/a", "x")])], "id string, source string, steps array<struct<step_type: string, node_id: string, via: string>>")
    rows = {r["source"]: r["id"] for r in refine.stabilised(df, "M").collect()}
    assert rows == {"llm": "J-" + refine.sha1_hex("M#route:/a")[:12], "analyzer": "k"}
    assert refine.stable_json({"b": [1, {"d": 1, "c": "é"}], "a": None}) == '{"a":null,"b":[1,{"c":"é","d":1}]}'


def test_requests(spark):
    rules = (*requests.required("root"), requests.one_of("mode", "primary", "collapse"))
    lines = spark.createDataFrame([('{"root": "r", "mode": "primary"}',), ('{"mode": "x"}',), ("no json",), (None,)], "body string")
    got = [r["violations"] for r in requests.parsed(lines, "body", "root string, mode string", rules).collect()]
    assert got[0] == [] and got[1] == ["root is required", "mode must be one of primary, collapse"] and "root is required" in got[2] and got[3][0] == "the body is no JSON object"
    assert requests.answers(spark.createDataFrame([("a", 1)], "id string, n int")).first()["body"] == '{"success":true,"id":"a","n":1}'
    assert [r["id"] for r in requests.by_name(spark.createDataFrame([(x,) for x in "BbAa"], "id string")).collect()] == ["a", "A", "b", "B"]


def test_prompts_and_settled_answers():
    graph = {"nodes": [{"id": "M", "type": "module"}, {"id": "/a", "type": "route"}, {"id": "/b", "type": "route"}, {"id": "", "type": "route"}]}
    system, prompt = refine.prompt_of({"graph": graph, "journeys": []})
    assert "JSON" in system and '"routes":["/a","/b"]' in prompt and refine.NUDGE not in prompt and refine.NUDGE in refine.prompt_of({}, True)[1]
    step = {"stepType": "route", "nodeId": "/a"}
    out = refine.settled({"merged": [{"from": ["x", "y"], "to": {"rootModule": "M", "steps": [step]}}], "removed": ["z"]}, [{"id": i, "source": "analyzer"} for i in "xyzw"])
    made = "J-" + refine.sha1_hex("M#route:/a")[:12]
    assert [j["id"] for j in out["finalJourneys"]] == ["w", made] and out["finalJourneys"][0]["source"] == "analyzer"


def test_schemas_of_requests_and_answers(spark):
    import json

    step = {"stepType": "route", "nodeId": "/a", "more": 1}
    good = {"analysisId": "a", "journeys": [{"id": "j", "rootModule": "M", "steps": [step]}], "routeMap": {"routes": [{"route": "/a"}]}, "unknown": True}
    bad = {"analysisId": "", "journeys": [{"id": "j", "rootModule": "M", "steps": [{"stepType": "x", "nodeId": "/a"}], "source": "me"}]}
    worse = {"analysisId": "a", "journeys": [], "graph": {"nodes": [{"id": "n", "type": "odd"}], "edges": [{"from": "a", "to": "b", "type": "odd"}], "transitions": [{"from": "a", "to": "b", "type": ""}]}}
    rows = requests.refine_requests(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate((good, bad, worse))], "i int, body string"), "body").orderBy("i").collect()
    assert rows[0]["violations"] == [] and rows[0]["journeys"][0]["steps"][0]["nodeId"] == "/a"
    assert rows[1]["violations"] == ["analysisId is required", "journeys: each needs steps of known types with a nodeId", "journeys: source is analyzer or llm", "graph or routeMap must be given"]
    assert len(rows[2]["violations"]) == 4
    answer = requests.refine_answers(spark.createDataFrame([('{"removed": ["x"]}',), ('{"merged": [{"from": [], "to": {"id": "j"}}]}',)], "body string"), "body").collect()
    assert answer[0]["removed"] == ["x"] and answer[0]["added"] == [] and answer[0]["violations"] == [] and answer[1]["violations"] == ["merged: each needs from and to"]


def test_settings(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".env").write_text("# note\nexport PORT=80\nNAME='x y' \nON=Yes # why\nBAD\n")
    env = settings.with_dotenv({"PORT": "1"}, settings.dotenv_path({}, tmp_path / "a" / "b"))
    assert settings.number(env, "PORT", 5) == 1 and settings.word(env, "NAME", "") == "x y" and settings.flag(env, "ON", False) and settings.number({"N": "x"}, "N", 7) == 7
    assert settings.with_dotenv({"PORT": "1", "ENV_OVERRIDE": "true"}, tmp_path / ".env")["PORT"] == "80"
    (tmp_path / "other.env").write_text("A=1")
    assert settings.dotenv_path({"ENV_FILE": "other.env"}, tmp_path).name == "other.env"
    assert settings.resolved(None, "store", tmp_path / "a") == tmp_path / "store" and settings.resolved("/x/../y", "", tmp_path).as_posix() == "/y"
    assert settings.version(tmp_path) == "0.0.0"
    (tmp_path / "package.json").write_text('{"version": "1.2.3"}')
    assert settings.version(tmp_path) == "1.2.3"
    with pytest.raises(ValueError, match="tsconfig"):
        settings.tsconfig(tmp_path)
    log = settings.log_to(tmp_path / "logs" / "x.log", "trace", most_bytes=200, files=2)
    for i in range(20):
        log.log(settings.LEVELS["trace"], "line %d", i)
    assert len(list((tmp_path / "logs").iterdir())) == 3
    assert settings.request_id().startswith("R-") and settings.request_id() != settings.request_id()


def test_screenshots(spark):
    wanted = spark.createDataFrame([("a", "j", "x"), ("a", "j", "/y"), ("a", "j", "/z")], "analysis string, journey string, route string")
    got = screenshots.captured(wanted, "http://h/", lambda url: url.encode() if not url.endswith("y") else 1 / 0, probe=lambda _: True).collect()
    assert {r["route"]: r["png"] and bytes(r["png"]) for r in got} == {"x": b"http://h/x", "/y": None, "/z": b"http://h/z"}
    with pytest.raises(screenshots.NotSupported):
        screenshots.captured(wanted, "http://h/")
    with pytest.raises(screenshots.NotSupported):
        screenshots.captured(wanted, "http://h/", lambda _: b"", probe=lambda _: False)
    assert not screenshots.reachable("http://127.0.0.1:9/", 0.2)
    stem = wanted.select(screenshots.file_of(F.col("analysis"), F.col("journey"), F.col("route"))).first()[0][:-4]
    files = spark.createDataFrame([(f"/root/{stem}.pending",), (f"/root/{stem}.capturing",), ("/root/other.png",)], "path string")
    assert {r["route"]: r["status"] for r in screenshots.statuses(wanted, files).collect()} == {"x": "capturing", "/y": "missing", "/z": "missing"}


SOURCES = {
    "/a/app.module.ts": """import { NgModule } from '@angular/core';
import { RouterModule } from '@angular/router';
@NgModule({ imports: [RouterModule.forRoot([{ path: 'shop', loadChildren: () => import('./shop/shop.module').then(m => m.ShopModule) }, { path: 'deep', children: [{ path: '', children: [{ path: 'x', component: XComponent }] }] }]), CoreModule], declarations: [AppComponent, XComponent], bootstrap: [AppComponent] })
export class AppModule {}""",
    "/a/core.module.ts": "import { A } from 'a-lib';\nimport { B } from './b';\n@NgModule({ imports: [A, B], declarations: [] }) export class CoreModule {}",
    "/a/ext.module.ts": "import { A } from 'a-lib';\n@NgModule({ imports: [A], declarations: [] }) export class ExtModule {}",
    "/a/shop/shop-routing.module.ts": """import { Routes, RouterModule } from '@angular/router';
const routes: Routes = [{ path: '', redirectTo: 'list', pathMatch: 'full' }, { path: 'list', loadComponent: () => import('./x').then(m => m.ListComponent), resolve: { a: R }, canLoad: [G] }, { path: 'again', loadChildren: () => import('../shop/shop.module').then(m => m.ShopModule) }];
@NgModule({ imports: [RouterModule.forChild(routes)] }) export class ShopRoutingModule {}""",
    "/a/shop/shop.module.ts": "@NgModule({ declarations: [ListComponent] }) export class ShopModule {}",
    "/a/x.ts": """@Component({ selector: 'app-x', templateUrl: './x.html' })
export class XComponent {
  constructor(private formBuilder: FormBuilder) { const a = 1; this.form = this.formBuilder.group({ mail: ['', Validators.email], 'age': [1, [Validators.min(1), other]], free: [''] }); }
  go() { this.router.navigateByUrl('/shop/list'); new Thing(this.api.list()); this['call'](); this['_hidden'](); }
  idle() { }
}
@Component({ selector: 'app-second', template: '<button (click)="go()">b</button>' }) export class SecondComponent { go() {} }
@Component({ template: 'x' }) export class NoSelector {}""",
    "/a/broken.ts": "@Component({ selector: ",
}
PAGE = """<button (click)="go()">Go</button><button (click)="idle()">Idle</button><button (click)="open('list')">Open</button><button (click)="nothing()">None</button><form><input formControlName="mail" required><input name="the_age"><input type="submit" value="ok"></form>"""


@pytest.fixture(scope="module")
def app_of(spark):
    found = project.extracted(spark.createDataFrame(list(SOURCES.items()), "path string, source string"))
    pages = spark.createDataFrame([("/a/x.html", PAGE)], "path string, source string")
    return app.analysed(found, pages)


def test_lazy_modules_are_read_once_and_under_their_path(app_of):
    routes = {r["route"]: r for r in app_of.routes.collect()}
    assert set(routes) == {"/shop", "/shop/list", "/shop/again", "/deep/x"}
    assert routes["/shop/list"]["component"] == "ListComponent" and routes["/shop/list"]["resolve"] == {"a": "R"} and routes["/shop/list"]["can_load"] == ["G"] and routes["/shop"]["module"] == "ShopModule"
    assert [(r["route"], r["redirect_to"]) for r in app_of.redirections.collect()] == [("/shop", "/shop/list")]


def test_module_roles_of_a_project(app_of):
    assert {r["name"]: r["role"] for r in app_of.modules.collect()} == {"AppModule": "root", "CoreModule": "global", "ExtModule": "external", "ShopRoutingModule": "routing", "ShopModule": "shared"}


def test_events_lead_where_the_sources_say(app_of):
    calls = [(r["event"], r["handler"], r["caller"], r["called"], list(r["data"] or [])) for r in app_of.calls.orderBy("call_ord").collect()]
    assert calls == [
        ("click", "go", "this.router", "navigateByUrl", ["shop", "list"]), ("click", "go", "this.api", "list", ["/backend", "api", "list"]), ("click", "go", "this", "call", []),
        ("click", "idle", None, None, []), ("click", "", "open", "/shop/list", []),
    ]
    moves = {(r["src"].split("__")[1] if "__" in r["src"] else r["src"], r["dst"].split("__")[0], r["type"]) for r in app_of.graph.transitions.collect()}
    assert ("button", "/shop/list", "click") in moves and ("button", "/backend/api/list", "service-call") in moves and ("input", "app-x", "submit") in moves and ("ShopModule", "ShopModule", "lazy-load") in moves


def test_validators_reach_widgets(app_of):
    got = {r["attributes"].get("formControlName") or r["attributes"].get("name"): (r["rules"], r["validators"]) for r in app_of.widgets.where("type IN ('text')").collect()}
    assert got == {"mail": (["required"], ["Validators.email"]), "the_age": ([], ["Validators.min(1)"])}


def test_journeys_of_a_project(app_of):
    got = app.journeys_of(app_of).collect()
    assert {r["steps"][-1]["node_id"] for r in got} >= {"/shop/list", "/backend/api/list"} and all(r["success"] for r in got)
    assert next(r for r in got if r["id"].startswith("AppModule→/shop["))["steps"][0]["node_id"] == "AppModule"
    with pytest.raises(ValueError, match="root"):
        graph.root_module(app_of.graph.nodes.where("role IS NULL"))


def test_sources_are_read_once(spark):
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    sources = spark.createDataFrame([("/a.ts", "let a;"), ("/b.ts", "let b;")], "path string, source string").mapInArrow(counted, "path string, source string")
    assert app.numbered(project.extracted(sources)).count() == 2 and met.value == 2


def test_parts_of_files_in_reading_order():
    loads = {"a": [("x", "b"), ("y", "b")], "b": [("/z", "c")], "c": [("w", "c"), ("v", None)]}
    got = list(app.reading_order(["b", "a"], loads))
    assert got == [("a", 0, []), ("b", 0, ["x"]), ("c", 0, ["/z", "x"]), ("c", 1, ["/z", "x"]), ("c", 2, ["/z", "x"]), ("b", 1, ["x"]), ("a", 1, []), ("a", 2, [])]
