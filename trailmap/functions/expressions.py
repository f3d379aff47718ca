"""Scalar functions as columns: names, paths, predicates, labels, signatures. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values -----------------------------------------------------------------
VIRTUAL_ERROR = "/virtual/error"
VIRTUAL_BACKEND = "/virtual/backend"
TERMINALS = ("route", "external-route", "backend", "virtual-route")
NAVIGATION_EVENTS = ("routerLink", "href", "static-redirect", "submit")
SERVICE_CALLER = r"(?i)\bthis\.(?:[A-Za-z]\w*Service|http|httpClient|api)(?=\.|$)"
ROUTER_CALL = r"\.\s*navigate(?:ByUrl)?\s*(?:\(|$)"
HEX_SUFFIX = r"__[0-9a-fA-F]{8}(?=\z|/)"
# the class that a lazy loader names
LAZY_CLASS = r"\.then\(\s*\w+\s*=>\s*\w+\.(\w+)\)"
# methods that never name a backend's operation, and creation functions
NOISE_METHODS = (
    "pipe", "subscribe", "toPromise", "then", "catch", "finally",
    "map", "switchMap", "mergeMap", "concatMap", "exhaustMap",
    "tap", "catchError", "finalize", "shareReplay", "debounceTime",
    "throttleTime", "delay", "filter", "take", "takeUntil", "first", "last", "scan",
    "log", "toLocaleDateString", "readAsDataURL", "reset", "get",
)
FREE_FUNCTIONS = ("of", "from", "timer", "interval")
HTML_RULES = ("required", "pattern", "min", "max", "minLength", "maxLength")
# ------------------------------------------------------------------------------

TRIM = r"^\s+|\s+\z"


def trimmed(x: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(x, TRIM, "")


def unquoted(x: Column) -> Column:
    """A literal without the quotes around it."""
    return F.regexp_replace(x, r"(?s)^['\"`](.*)['\"`]\z", "$1")


def selector_to_class(selector: Column) -> Column:
    """app-foo-bar -> FooBarComponent; '' without a hyphen."""
    parts = F.split(selector, "-")
    up = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.when(F.size(parts) < 2, "").otherwise(F.concat(F.array_join(up, ""), F.lit("Component")))


def class_to_selector(name: Column) -> Column:
    """FooBarComponent -> foo-bar."""
    bare = F.regexp_replace(name, r"Component\z", "")
    return F.lower(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1-$2"))


def route_path(raw: Column) -> Column:
    """A leading slash, and one less at the end; '' is /."""
    led = F.when(F.startswith(raw, F.lit("/")), raw).otherwise(F.concat(F.lit("/"), raw))
    return F.when(raw.isin("", "/"), "/").otherwise(F.regexp_replace(led, r"(?<=.)/\z", ""))


def node_id(ident: Column) -> Column:
    """Doubled slashes made one, but for URLs."""
    return F.when(ident.rlike("(?i)https?://"), ident).otherwise(F.regexp_replace(ident, "/{2,}", "/"))


def base_id(ident: Column) -> Column:
    """An id without its first eight-digit hexadecimal suffix; URLs as they are."""
    cut = F.regexp_replace(ident, r"^(.*?)__[0-9a-fA-F]{8}(?=\z|/)", "$1")
    return F.when(ident.rlike("(?i)^https?://"), ident).otherwise(cut)


def route_id(x: Column) -> Column:
    """One leading slash, doubled ones made one."""
    return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(F.coalesce(x, F.lit("")), "^/+", "")), "/{2,}", "/")


def link(raw: Column) -> Column:
    """{{a.b}} becomes :b, the first quoted literal is taken, and an inline origin cut off."""
    named = F.regexp_replace(raw, r"\{\{\s*(?:[\w$]+\.)*([\w$]+)\s*\}\}", ":$1")
    quoted = F.regexp_extract(named, "'([^']+)'", 1)
    return F.get(F.split(F.when(quoted != "", quoted).otherwise(named), " in inline@"), F.lit(0))


def is_router_call(text: Column) -> Column:
    return text.rlike(ROUTER_CALL)


def is_backend_caller(text: Column) -> Column:
    return ~F.contains(text, F.lit("(")) & text.rlike(SERVICE_CALLER)


def is_noise_call(caller: Column, method: Column, backend: Column, navigation: Column, methods: tuple[str, ...], functions: tuple[str, ...]) -> Column:
    """Noise methods first, even of backends; then backends and navigation stay; then console.log and free functions go."""
    return F.when(method.isin(*methods), True).when(backend | navigation, False).when((caller == "console") & (method == "log"), True).otherwise(~F.contains(F.coalesce(caller, F.lit("")), F.lit(".")) & method.isin(*functions))


def service_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^this\.", ""), r"Service\z", "")


def is_external(x: Column) -> Column:
    return x.rlike("(?i)^https?://")


def title_case(segment: Column) -> Column:
    """user-list -> User List; null for ''."""
    clean = F.regexp_replace(segment, "^:", "")
    words = F.filter(F.split(clean, "-"), lambda w: w != "")
    made = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return F.when(made != "", made)


def tail_segment(path: Column) -> Column:
    """Last segment of a path, decoded; '' if there is none. A plus sign stays one."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.coalesce(F.element_at(parts, F.when(F.size(parts) > 0, -1).otherwise(F.lit(None).cast("int"))), F.lit(""))
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def external_label(url: Column) -> Column:
    host = F.nullif(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\s", ""), F.lit(""))
    mail, tel = F.regexp_extract(url, r"^mailto:([^?#]*)", 1), F.regexp_extract(url, r"^tel:([^?#]*)", 1)
    return F.when(url.startswith("mailto:"), F.concat(F.lit("Email • "), mail)).when(url.startswith("tel:"), F.concat(F.lit("Call • "), tel)).when(host.isNotNull(), F.concat(F.lit("External • "), F.lower(host))).otherwise("External")


def backend_label(ident: Column) -> Column:
    parts = F.filter(F.split(ident, "/"), lambda p: p != "")
    second = F.get(parts, F.lit(1))
    return F.when(F.size(parts) <= 1, "Background Action").when(F.size(parts) == 2, F.concat(F.lit("Call "), second, F.lit(" service"))).otherwise(F.concat(F.lit("Call "), second, F.lit("."), F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), ".")))


def virtual_label(ident: Column) -> Column:
    parts = F.filter(F.split(ident, "/"), lambda p: p != "")
    return F.concat(F.lit("UI • "), F.when(F.size(parts) > 0, F.element_at(parts, F.when(F.size(parts) > 0, -1).otherwise(F.lit(None).cast("int")))).otherwise("UI Action"))


def backend_target(service: Column, method: Column, granularity: str) -> Column:
    """A backend node's id: all as one, a service, or a method."""
    if granularity == "single":
        return F.lit("/backend")
    if granularity == "service":
        return F.concat(F.lit("/backend/"), service)
    if granularity == "method":
        return F.concat_ws("/", F.lit("/backend"), service, method)
    raise ValueError(f"no such granularity: {granularity}")


def via_of(kind: Column, source_event: Column) -> Column:
    return F.when(kind == "service-call", F.coalesce(source_event, F.lit("click"))).otherwise(kind)


def is_terminal(kind: Column) -> Column:
    """Kinds of nodes at which a journey may end."""
    return F.coalesce(kind.isin(*TERMINALS), F.lit(False))


def terminal_of(kind: Column) -> Column:
    """A node's kind as a journey's end: what isn't one is a virtual route."""
    return F.when(is_terminal(kind), kind).otherwise("virtual-route")


def is_backend(kind: Column) -> Column:
    return F.coalesce(kind == "backend", F.lit(False))


def is_virtual(kind: Column) -> Column:
    return F.coalesce(kind == "virtual-route", F.lit(False))


def step_signature(steps: Column) -> Column:
    """type:node@via of each step, joined by arrows."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["step_type"], F.lit(":"), s["node_id"], F.when(F.coalesce(s["via"], F.lit("")) != "", F.concat(F.lit("@"), s["via"])).otherwise(""))), "→")


def journey_hash_id(root: Column, signature: Column) -> Column:
    """J- and twelve digits of a hash of root and signature."""
    return F.concat(F.lit("J-"), F.substring(F.sha1(F.concat(root, F.lit("#"), signature)), 1, 12))


def html_rules(attributes: Column) -> Column:
    """Validation flags among the attributes, in fixed order."""
    return F.filter(F.array(*[F.lit(r) for r in HTML_RULES]), lambda r: F.map_contains_key(attributes, r))


def triggers_submit(tag: Column, kind: Column) -> Column:
    return ((tag == "button") & (kind == "submit")) | ((tag == "input") & kind.isin("submit", "image")) | ((tag == "mat-button") & (kind == "submit"))


def last_nav_index(steps: Column) -> Column:
    """Place of the last navigating interaction before the last terminal, else of the last interaction there, else -1.

    Without a terminal, all steps count.
    """
    at = F.transform(steps, lambda s, i: F.struct(i.alias("i"), s["step_type"].alias("t"), s["via"].alias("v")))
    terminal = F.coalesce(F.array_max(F.transform(F.filter(at, lambda s: s["t"].isin(*TERMINALS)), lambda s: s["i"])), F.size(steps))
    before = F.filter(at, lambda s: (s["t"] == "interaction") & (s["i"] < terminal))
    navigating = F.array_max(F.transform(F.filter(before, lambda s: F.coalesce(s["v"].isin(*NAVIGATION_EVENTS), F.lit(False))), lambda s: s["i"]))
    return F.coalesce(navigating, F.array_max(F.transform(before, lambda s: s["i"])), F.lit(-1))


def fanout_key(steps: Column) -> Column:
    """What siblings share: all steps up to the navigating interaction."""
    horizon = last_nav_index(steps)
    shared = F.when(horizon >= 0, F.slice(steps, F.lit(1), horizon + 1)).otherwise(steps)
    name = lambda s: F.concat(s["step_type"], F.lit(":"), s["node_id"], F.when(s["step_type"] == "interaction", F.concat(F.lit(":"), F.coalesce(s["via"], F.lit("")))).otherwise(""))
    return F.array_join(F.transform(shared, name), "→")


def succeeded(steps: Column) -> Column:
    """False only where the last step is the virtual error route, as a backend or a route."""
    last = F.when(F.size(steps) > 0, F.element_at(steps, F.when(F.size(steps) > 0, -1).otherwise(F.lit(None).cast("int"))))
    return ~F.coalesce(last["step_type"].isin("backend", "virtual-route") & (last["node_id"] == VIRTUAL_ERROR), F.lit(False))
