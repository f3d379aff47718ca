"""The registered queries on the smallest tables, against brute force."""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmap.llm import quality_rules, queries, source_mix, url_filter

from test_dedup import WORD, cut, linked, rows_of
from test_learned_and_written import nearest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def test_op2(spark, docs):
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for d, _ in docs:
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_op3(spark, docs):
    assert rows_of(queries.op3_suffix_dedup(spark, FOLDER)) == cut(docs)


def test_op5(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    turns += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r["conv_id"]: r for r in queries.op5_chat_format(spark, FOLDER).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, r in got.items():
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1:3] + (t[3] or "",))
        whole, learned = "".join(f"{t[2]}\n{t[3] or ''}\n" for t in own), "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_op7(spark, docs):
    from tokenizers import Tokenizer

    tok, start, wanted = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), 0, []
    for d, t in sorted(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        wanted.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(queries.op7_token_store(spark, FOLDER)) == sorted(wanted, key=str)


def test_op8(spark, docs):
    from trailmap.llm.decontaminate import EVERY, plain

    items = [(r["item_id"], [plain(w) for w in WORD.findall(r["text"] or "")]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op8_decontaminate(spark, FOLDER).collect()}
    texts = [(d, [plain(w) for w in WORD.findall(t or "")]) for d, t in docs]
    wanted = {}
    for d, words in texts:
        met = set(words)
        for k, item in items:
            if item and sum(w in met for w in item) >= len(item) - len(item) // EVERY:  # else too many words differ
                edits = nearest(words, item)[0]
                if edits <= len(item) // EVERY:
                    wanted[d, k] = edits
    assert set(got) <= set(wanted) and len(got) >= 0.95 * len(wanted) > 0


def test_op9(spark, docs):
    got = queries.op9_source_mix(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "text"), "doc_id").collect()
    assert len(got) == len(docs)
    names = sorted({r["source"] for r in got}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in got if r["source"] == s) for s in names]
    goals = dict(zip(names, source_mix.targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        assert r["source_size"] == sizes[names.index(r["source"])] and abs(r["target"] - goals[r["source"]]) < 1e-6
    for s in names:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - goals[s]) <= max(40, 0.02 * goals[s])  # what a small source can reach


def test_op10(spark, docs):
    assert rows_of(queries.op10_ngram_join(spark, FOLDER)) == linked(docs, 4, 85, 100)


def test_long_urls_and_clashing_columns(spark):
    deep = ".".join(["a"] * 100) + ".org"
    captures = spark.createDataFrame([(1, f"http://{deep}/" + "x" * 300_000, 100), (2, "http://b.org/p", 100), (2, "http://b.org/q", 100), (None, None, None)], "page_id long, url string, fetched_at long").withColumns({c: F.lit("clash") for c in ("host", "key", "rank", "action")})
    entries = spark.createDataFrame([(f"*.{deep}", 0, "block"), ("b.org/p", 0, "allow")], "key string, at long, action string").withColumn("id", F.lit(1))
    got = rows_of(url_filter.evaluate(captures, entries).select("page_id", "verdict"))
    assert got == sorted([(1, "block"), (2, "allow"), (2, "none"), (None, "none")], key=str)


def test_long_texts_in_rules_and_mix(spark):
    rows = [(1, "word and more words " * 150_000, "a"), (2, "x", "a"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("size", "rank", "part", "s", "h")})
    assert [r["n_words"] for r in quality_rules.quality(docs).orderBy("doc_id").collect()] == [600_000, 1, 0]
    assert sorted(r["size"] for r in source_mix.mix(docs).collect()) == [0, 1, 600_000]
