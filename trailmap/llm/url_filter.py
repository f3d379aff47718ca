"""URL filtering against a list that changes over time, with DataFrame functions only.

A list is a log of dated entries: from `at` on, `key` has `action`, until its next entry.
The log becomes validity intervals, and an as-of join evaluates every capture against the
entries that were active when it was fetched. Keys are of three kinds, the most particular
first: a host with its first path segment (`host/segment`), a host, and a domain (a host's
ending at a dot; it holds for the hosts below it).

Defined cases: a url that is null, empty or has no host matches nothing and gets `none`;
so does a capture without a time. Every capture has a row of its own, whatever ids repeat or are null. Entries without key, time or action are ignored; of entries of
one key at one time the alphabetically last action holds, as `block` after `allow`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a period. Intervals are cut at the periods' ends, so that captures meet only
#: the entries of their own period however long a key's history is.
PERIOD = 30 * 86_400
#: Labels of the domains that the SQL looks up; its list has none of more than two. The operator looks up all.
MOST_LABELS = 6


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), "[.]$", ""), F.lit(""))


def first_segment(url: Column) -> Column:
    """First segment of the path; null if empty."""
    return F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of a log (key, at, action), cut into (key, period) pieces.

    A key's history may be long: entries are ordered within (key, period), and only a row
    for each (key, period) is ordered over the whole key.
    """
    log = entries.where("key IS NOT NULL AND at IS NOT NULL AND action IS NOT NULL").groupBy("key", "at").agg(F.max("action").alias("action")).withColumn("period", F.floor(F.col("at") / PERIOD))
    later = log.groupBy("key", "period").agg(F.min("at").alias("first")).withColumn("then", F.lead("first").over(Window.partitionBy("key").orderBy("period"))).drop("first")
    inner = log.withColumn("next", F.lead("at").over(Window.partitionBy("key", "period").orderBy("at")))
    return inner.join(later, ["key", "period"]).select("key", "action", F.col("at").alias("since"), F.coalesce("next", "then").alias("until"))


def candidate_keys(host: Column, segment: Column) -> Column:
    """Keys that may hold for a url, the most particular first; array of (rank, key)."""
    labels = F.split(host, "[.]")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(2), n), lambda k: F.struct((n - k + 2).alias("rank"), F.concat(F.lit("*."), F.array_join(F.slice(labels, -k, k), ".")).alias("key")))
    exact = F.array(F.struct(F.lit(0).alias("rank"), F.concat(host, F.lit("/"), segment).alias("key")), F.struct(F.lit(1).alias("rank"), host.alias("key")))
    return F.filter(F.concat(exact, F.when(n >= 2, domains).otherwise(F.slice(domains, 1, 0))), lambda x: x["key"].isNotNull())


def evaluate(captures: DataFrame, entries: DataFrame, ident: str = "page_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(ident, host, verdict, matched_key, n_active) for every capture.

    `at` of captures and entries are whole seconds. The verdict is the action of the most
    particular key that is active; n_active counts active keys. Only ids, urls and times are
    read and moved. The join is an equality of (key, period) with a range, so that Spark
    may broadcast a list below its size limit and otherwise splits hot keys.
    """
    seen = captures.select(F.col(ident).alias("id"), F.col(url).alias("url"), F.col(at).cast("long").alias("t")).withColumn("host", host_of(F.col("url")))
    seen = seen.withColumn("segment", first_segment(F.col("url")))
    looked = seen.select("id", "host", "segment", "t", F.explode_outer(candidate_keys(F.col("host"), F.col("segment"))).alias("c")).select("id", "host", "segment", "t", F.col("c.rank").alias("rank"), F.col("c.key").alias("key"), F.floor(F.col("t") / PERIOD).alias("period"))
    ends = captures.agg(F.min(F.col(at).cast("long")).alias("low"), F.max(F.col(at).cast("long")).alias("high")).first()
    low, high = (ends["low"], ends["high"]) if ends["low"] is not None else (0, -1)
    held = intervals(entries.select("key", F.col("at").cast("long").alias("at"), "action")).where((F.col("since") <= high) & (F.coalesce("until", F.lit(high + 1)) > low))
    first, last = F.floor(F.greatest("since", F.lit(low)) / PERIOD), F.floor((F.least(F.coalesce("until", F.lit(high + 1)), F.lit(high + 1)) - 1) / PERIOD)
    cut = held.withColumn("period", F.explode(F.sequence(first, last)))
    active = (looked["key"] == cut["key"]) & (looked["period"] == cut["period"]) & (looked["t"] >= cut["since"]) & (cut["until"].isNull() | (looked["t"] < cut["until"]))
    met = looked.join(cut, active, "left").select("id", "host", "segment", looked["t"], "rank", looked["key"], "action")
    hit = F.col("action").isNotNull()
    best = F.min(F.when(hit, F.struct("rank", "key", "action")))
    # captures alike in these have one verdict; each has one row for its host, or one without keys
    times = F.count(F.when(F.coalesce("rank", F.lit(1)) == 1, 1)).cast("int").alias("times")
    out = met.groupBy("id", "host", "segment", "t").agg(times, best.alias("best"), F.size(F.collect_set(F.when(hit, F.col("key")))).cast("long").alias("n_active"))
    out = out.withColumn("time", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return out.select(F.col("id").alias(ident), "host", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.key").alias("matched_key"), "n_active")


def digest(text: Column, most: int) -> Column:
    """A number below `most` from a text, the same in every engine."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(7)), 16, 10).cast("long") % most


#: The query's captures are fetched over this span, and its list is dated within it.
START, SPAN_DAYS = 1_704_067_200, 366


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures with a time that follows from the page's id."""
    return pages.select("page_id", "url", (F.lit(START) + (F.coalesce("page_id", F.lit(0)) * 7919 % (SPAN_DAYS * 24)) * 3600).alias("fetched_at"))


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' hosts: for some, entries to block, allow and block again."""
    at = host_of(F.col("url"))
    hosts = pages.select(at.alias("host"), first_segment(F.col("url")).alias("segment")).where("host IS NOT NULL").distinct()
    labels = F.split("host", "[.]")
    keys = F.array(F.concat("host", F.lit("/"), F.col("segment")), F.col("host"), F.when(F.size(labels) >= 2, F.concat(F.lit("*."), F.array_join(F.slice(labels, -2, 2), "."))))
    named = hosts.select(F.explode(keys).alias("key")).where("key IS NOT NULL").distinct()
    chosen = named.withColumn("h", digest(F.col("key"), 100_000)).where("h % 3 = 0")
    day = lambda k: F.lit(START) + (F.col("h") * k % SPAN_DAYS) * 86_400
    dated = F.array(*[F.struct(day(k).alias("at"), F.lit(a).alias("action")) for k, a in ((1, "block"), (7, "allow"), (31, "block"))])
    return chosen.select("key", F.explode(dated).alias("e")).select("key", "e.at", "e.action")


DUCKDB_SQL = f"""
WITH u AS (SELECT page_id, url, {START} + (coalesce(page_id, 0) * 7919 % {SPAN_DAYS * 24}) * 3600 t,
  nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '[.]$', ''), '') host,
  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1), '') segment FROM pages),
k AS (SELECT DISTINCT unnest([host || '/' || segment, host, CASE WHEN len(string_split(host, '.')) >= 2 THEN '*.' || array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END]) key FROM u),
h AS (SELECT key, ('0x' || substr(md5(key), 1, 7))::BIGINT % 100000 h FROM k WHERE key IS NOT NULL),
e0 AS (SELECT key, {START} + (h * m % {SPAN_DAYS}) * 86400 since, a action FROM h, (VALUES (1, 'block'), (7, 'allow'), (31, 'block')) v(m, a) WHERE h % 3 = 0),
e AS (SELECT key, since, max(action) action FROM e0 GROUP BY key, since),
i AS (SELECT key, action, since, lead(since) OVER (PARTITION BY key ORDER BY since) until FROM e),
c AS (SELECT DISTINCT page_id, host, t, url, unnest(list_concat([{{'rank': 0, 'key': host || '/' || segment}}, {{'rank': 1, 'key': host}}],
  list_transform(range(2, least(len(string_split(host, '.')), {MOST_LABELS}) + 1), lambda n: {{'rank': (100 - n)::INTEGER, 'key': '*.' || array_to_string(list_slice(string_split(host, '.'), -n, -1), '.')}}))) c FROM u),
m AS (SELECT page_id, host, t, c.rank, c.key, action FROM c JOIN i ON c.key = i.key AND t >= since AND (until IS NULL OR t < until)),
b AS (SELECT page_id, host, t, min({{'rank': rank, 'key': key, 'action': action}}) best, count(*) n FROM m GROUP BY ALL)
SELECT DISTINCT u.page_id, u.host, coalesce(best.action, 'none') verdict, best.key matched_key, coalesce(n, 0) n_active
FROM u LEFT JOIN b ON u.page_id IS NOT DISTINCT FROM b.page_id AND u.host IS NOT DISTINCT FROM b.host AND u.t = b.t"""
