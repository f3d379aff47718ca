"""Refinement of journeys by a language model behind an interface: what surrounds the call is data work."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmap.functions import expressions as X

#: Largest request, in bytes of JSON.
MOST_BYTES = 1_000_000


class Provider(Protocol):
    """Answers a prompt with text. An offline provider may answer from a table or not at all."""

    def complete(self, system: str, prompt: str, most_tokens: int) -> str: ...


class Silent:
    """Proposes nothing; for tests and where no model is at hand."""

    def complete(self, system: str, prompt: str, most_tokens: int) -> str:
        return "{}"


class RefineError(Exception):
    """`status` is what an HTTP surface would answer."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def stable_json(value: Any) -> str:
    """JSON with sorted keys at every level, without spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parsed(text: str) -> dict:
    """The object in an answer, {} where there is none; a fence around it is taken off."""
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        found = json.loads(body)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def stabilised(journeys: DataFrame, root: str) -> DataFrame:
    """Ids from content where there is none or a model made the journey; the source is the model's unless the analyser's.

    Columns: id, source, steps.
    """
    made = X.journey_hash_id(F.lit(root), X.step_signature(F.col("steps")))
    unknown = (F.coalesce("id", F.lit("")) == "") | (F.col("source") == "llm")
    return journeys.withColumn("id", F.when(unknown, made).otherwise(F.col("id"))).withColumn("source", F.when(F.col("source") == "analyzer", "analyzer").otherwise("llm"))


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("#", *parts))


def stable_map(m: Column) -> Column:
    """A map of JSON values as JSON with sorted keys."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))


def is_idle(answer: dict, n_original: int | None = None) -> bool:
    """Whether an answer changes nothing, and has no more journeys than there were, so that it is worth asking once more."""
    changed = any(answer.get(k) for k in ("added", "updated", "removed", "merged"))
    return not changed and (n_original is None or len(answer.get("finalJourneys") or []) <= n_original)


SYSTEM = "You refine user journeys through a web application. Answer with one JSON object and nothing else."
TASK = """Given the navigation graph or route map, the index of its nodes and the journeys found so far, say which journeys to add, update, merge or remove.
- Use only node ids of the index; a journey's steps have stepType, nodeId and, for interactions, via.
- Merge journeys that differ in nothing a user would notice; remove those that lead nowhere.
- Add journeys for routes and backends that none covers.
The object has the lists added, updated, removed (ids), merged ({from: ids, to: journey}) and finalJourneys (may be empty), and meta."""
NUDGE = "The last proposal changed nothing. Add journeys for what is not covered yet."


def example() -> dict:
    """Two journeys that are one, and the answer that merges them."""
    steps = lambda via: [{"stepType": "route", "nodeId": "/cart"}, {"stepType": "interaction", "nodeId": "pay", "via": via}, {"stepType": "backend", "nodeId": "/backend/order/pay"}]
    journey = lambda ident, via: {"id": ident, "rootModule": "AppModule", "steps": steps(via)}
    return {"journeys": [journey("a", "click"), journey("b", "click")], "answer": {"added": [], "updated": [], "removed": [], "merged": [{"from": ["a", "b"], "to": journey("a", "click")}], "finalJourneys": [], "meta": {"understood": True}}}


def node_index(graph: dict | None) -> dict[str, list[str]]:
    """A request's node ids by kind, in order."""
    kinds = {"module": "modules", "route": "routes", "component": "components", "widget": "widgets", "backend": "backends", "virtual-route": "virtualRoutes", "external-route": "externalRoutes"}
    out: dict[str, list[str]] = {k: [] for k in kinds.values()}
    for n in (graph or {}).get("nodes") or []:
        if isinstance(n.get("id"), str) and n["id"] and n.get("type") in kinds:
            out[kinds[n["type"]]].append(n["id"])
    return out


def prompt_of(request: dict, again: bool = False) -> tuple[str, str]:
    """(system, prompt) for a request, with an example and, the second time, a nudge."""
    shown, index = example(), node_index(request.get("graph"))
    told = {k: request.get(k) for k in ("graph", "routeMap", "journeys")} | {"nodeIndex": index}
    parts = [TASK, "Example:", stable_json(shown["journeys"]), stable_json(shown["answer"]), "Input:", stable_json(told)]
    return SYSTEM, "\n".join(parts + ([NUDGE] if again else []))


def stable_journey(journey: dict) -> dict:
    """A journey with an id from its content where it has none or a model made it; its source is the model's unless the analyser's."""
    out = dict(journey)
    if not str(out.get("id") or "").strip() or out.get("source") == "llm":
        steps = out.get("steps") or []
        root = out.get("rootModule") or next((s["nodeId"] for s in steps if s.get("stepType") == "module"), None) or "AppModule"
        signature = "→".join(f"{s.get('stepType')}:{s.get('nodeId')}" + (f"@{s['via']}" if s.get("via") else "") for s in steps)
        out["id"] = f"J-{sha1_hex(f'{root}#{signature}')[:12]}"
    if out.get("source") != "analyzer":
        out["source"] = "llm"
    return out


def settled(answer: dict, originals: list[dict], fill: bool = True) -> dict:
    """An answer with all its lists, stable journeys and, where it names no final ones, what it makes of the originals."""
    out = {k: list(answer.get(k) or []) for k in ("added", "updated", "removed", "merged", "finalJourneys")} | {"meta": dict(answer.get("meta") or {})}
    for k in ("added", "updated"):
        out[k] = [stable_journey(j) for j in out[k]]
    out["merged"] = [{"from": m["from"], "to": stable_journey(m["to"])} for m in out["merged"]]
    if not out["finalJourneys"] and fill:
        gone = set(out["removed"]) | {i for m in out["merged"] for i in m["from"]}
        out["finalJourneys"] = [j for j in originals if j.get("id") not in gone] + out["added"] + out["updated"] + [m["to"] for m in out["merged"]]
    out["finalJourneys"] = [stable_journey(j) for j in out["finalJourneys"]]
    return out


def failure(error: Exception) -> int:
    """What an HTTP surface answers to an error."""
    if isinstance(error, RefineError):
        return error.status
    if isinstance(error, TimeoutError):
        return 504
    if isinstance(error, ValueError):
        return 502  # an answer that can't be used
    return 503 if isinstance(error, ConnectionError) else 500


@dataclass
class Refined:
    answer: dict
    asked: int


def ask(provider: Provider | None, request: dict, prompt: Callable[[dict, bool], tuple[str, str]] = prompt_of, most_tokens: int = 10_000) -> Refined:
    """One question and, if its answer changes nothing, one nudge, whose answer counts if it changes something."""
    if provider is None:
        raise RefineError(503, "no model is configured")
    if request.get("graph") is None and request.get("routeMap") is None:
        raise RefineError(400, "graph or routeMap is needed")
    if len(stable_json(request).encode()) > MOST_BYTES:
        raise RefineError(413, "the request is too large")
    originals = request.get("journeys") or []
    answer = settled(parsed(provider.complete(*prompt(request, False), most_tokens)), originals)
    if not is_idle(answer, len(originals)):
        return Refined(answer, 1)
    again = settled(parsed(provider.complete(*prompt(request, True), most_tokens)), originals, fill=False)
    return Refined(answer if is_idle(again, len(originals)) else again, 2)


def sha1_hex(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()
