"""URL filter and quality rules: against SQL, and on awkward rows."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from trailmap.llm import quality_rules, queries, url_filter

AWKWARD = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "one two three"), (5, "a b c a b c"), (6, "x\nx\n\nx"), (7, "word " * 5000), (7, "word " * 5000), (None, "Plain text, with an end."), (9, "#" * 50), (10, "é ü ß z")]
DOCS = "doc_id long, text string"


def check(spark, duck, df, sql):
    rows = duck.sql(sql)
    at = [df.columns.index(c) for c in rows.columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[i] for i in at) for r in df.collect()), key=key) == sorted(rows.fetchall(), key=key)


def test_quality_on_awkward_rows(spark):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", AWKWARD)
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumn("kept", F.lit("clash"))
    check(spark, duck, quality_rules.quality(docs).select("doc_id", *quality_rules.BASE, "base_failed", "kept"), quality_rules.duckdb_sql())


def test_repeated_words_by_hand(spark):
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.features(spark.createDataFrame([(1, "a b c a b c"), (2, "a a a a"), (3, "a b c d"), (4, "a b c x b c a b c")], DOCS)).collect()}
    assert got == {1: 6, 2: 4, 3: 0, 4: 6}


def test_quality_of_nothing(spark):
    assert quality_rules.quality(spark.createDataFrame([], DOCS)).count() == 0


def test_posteriors_follow_the_majority(spark):
    counts = spark.createDataFrame([("111-----", 80), ("110-----", 10), ("000-----", 10)], "pattern string, n long")
    got = {r["pattern"]: r["p_good"] for r in quality_rules.posteriors(counts).collect()}
    assert got["111-----"] > 0.9 and got["000-----"] < 0.5 < got["110-----"]


def test_url_as_of(spark):
    day = 86_400
    log = [("a.org", 10 * day, "block"), ("a.org", 100 * day, "allow"), ("*.a.org", 0, "block"), ("*.b.org", 0, "block"), ("a.org/x", 50 * day, "allow"), ("a.org", 10 * day, "allow"), ("z.org", None, "block"), (None, 1, "block")]
    seen = [(1, "http://a.org/y", 9 * day), (2, "http://a.org/y", 10 * day), (3, "https://u:p@A.org:80/x/1", 60 * day), (4, "http://a.org", 100 * day), (5, "http://sub.b.org/", 5), (6, "http://b.com", 5), (7, None, 5), (8, "nonsense", 5), (9, "http://a.org/y", None), (5, "http://sub.b.org/", 5)]
    got = {r["page_id"]: (r["verdict"], r["matched_key"], r["n_active"]) for r in url_filter.evaluate(spark.createDataFrame(seen, "page_id long, url string, fetched_at long"), spark.createDataFrame(log, "key string, at long, action string")).collect()}
    assert got == {1: ("block", "*.a.org", 1), 2: ("block", "a.org", 2), 3: ("allow", "a.org/x", 3), 4: ("allow", "a.org", 2), 5: ("block", "*.b.org", 1), 6: ("none", None, 0), 7: ("none", None, 0), 8: ("none", None, 0), 9: ("none", None, 0)}


def test_url_of_deep_hosts(spark):
    deep = ".".join(f"l{i}" for i in range(120))
    log = [("*.c.d.e.f.g.h.i", 0, "block"), ("*.h.i", 0, "allow"), ("*." + deep, 0, "block"), (deep + "/x", 0, "allow"), ("*.l118.l119", 0, "allow")]
    seen = [(1, "http://a.b.c.d.e.f.g.h.i/", 5), (2, "http://z.d.e.f.g.h.i/", 5), (3, f"http://{deep}/x", 5), (4, f"http://{deep}/y", 5)]
    got = {r["page_id"]: (r["verdict"], r["n_active"]) for r in url_filter.evaluate(spark.createDataFrame(seen, "page_id long, url string, fetched_at long"), spark.createDataFrame(log, "key string, at long, action string")).collect()}
    assert got == {1: ("block", 2), 2: ("allow", 1), 3: ("allow", 3), 4: ("block", 2)}


def test_url_has_a_row_for_each_capture(spark):
    log = [("a.org/x", 0, "block"), ("*.a.org", 0, "allow"), ("a.org", 0, "allow")]
    seen = [(None, "http://a.org/x", 5), (None, "http://a.org/y", 5), (None, "http://a.org/y?2", 5), (1, "http://a.org/x/1", 5), (1, "http://a.org/x/2", 5), (1, "http://a.org/", 5), (2, None, 5), (2, "none", 5), (3, "http://a.org/x", None), (3, "http://a.org/x", None), (4, "http://b", 5), (4, "http://b", 5)]
    got = url_filter.evaluate(spark.createDataFrame(seen, "page_id long, url string, fetched_at long"), spark.createDataFrame(log, "key string, at long, action string")).collect()
    rows = sorted(((r["page_id"] or 0, r["verdict"], r["n_active"]) for r in got))
    assert rows == [(0, "allow", 2), (0, "allow", 2), (0, "block", 3), (1, "allow", 2), (1, "block", 3), (1, "block", 3), (2, "none", 0), (2, "none", 0), (3, "none", 0), (3, "none", 0), (4, "none", 0), (4, "none", 0)]


def test_url_of_nothing(spark):
    e = spark.createDataFrame([], "key string, at long, action string")
    assert url_filter.evaluate(spark.createDataFrame([], "page_id long, url string, fetched_at long"), e).count() == 0
    assert url_filter.evaluate(spark.createDataFrame([(1, "http://a.b", 3)], "page_id long, url string, fetched_at long"), e).first()["verdict"] == "none"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    check(spark, duck, queries.queries()[name](spark, folder), queries.oracle_sql()[name])
