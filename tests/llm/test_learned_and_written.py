"""Toxicity, chats, token files, decontamination, mixing, and the pipeline."""

from __future__ import annotations

import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmap.llm import chat_format, common, decontaminate, queries, source_mix, token_store, toxicity
from trailmap.llm.common import trim_driver, word_codes

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_words_are_split_at_ascii_white_space_only():
    codes, offsets, distinct = word_codes(pa.array(["  a b\x0bc\x1cd e ", None, "", "a"]))
    assert [[distinct[c] for c in codes[a:z]] for a, z in zip(offsets[:-1], offsets[1:], strict=True)] == [["a", "b", "c\x1cd e"], [], [], ["a"]]


def test_toxicity_on_held_out_texts(spark):
    g = random.Random(2)
    neutral = ["".join(g.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(900):
        w = [g.choice(neutral) for _ in range(g.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            w[g.randrange(len(w))] = g.choice(["Nasty!", "vileone", "vileten"])
        rows.append((i, " ".join(w), "en" if i % 2 else "de", int(bad)))
    docs = spark.createDataFrame([r[:3] for r in rows] + [(2000, None, "en"), (2001, "", None), (2002, "vilesix", "xx"), (5, rows[5][1], "en")], DOCS + ", lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 3] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert toxicity.score(docs, model).count() == docs.count()
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum((got[r[0]]["toxicity"]["score"] >= 0.7) == bool(r[3]) for r in held) >= 0.97 * len(held)
    assert all(r["toxicity"]["toxic"] == (r["toxicity"]["score"] >= r["toxicity"]["threshold"]) for r in got.values())
    assert got[2000]["toxicity"]["score"] == got[2001]["toxicity"]["score"] < 0.5 and 0 <= got[2002]["toxicity"]["score"] <= 1


def test_toxicity_trains_outside_the_driver(spark, monkeypatch):
    driver, trained = os.getpid(), toxicity.fitted

    def away(*given, **named):
        assert os.getpid() != driver
        return trained(*given, **named)

    monkeypatch.setattr(toxicity, "fitted", away)
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad words here") for i in range(60)], DOCS)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) AS toxic")
    model = toxicity.train(docs, labels)
    score = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(docs, model).collect()}
    assert score[0] > 0.5 > score[1]


def test_driver_gives_native_memory_back(spark):
    version = [int(x) for x in spark._jvm.java.lang.System.getProperty("java.version").split(".")[:3]]
    assert trim_driver(spark) or version < [17, 0, 9]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none) is None
    assert toxicity.score(docs, None).first()["toxicity"]["score"] == 0.0
    assert toxicity.score(docs.limit(0), None).count() == 0


def random_model(seed):
    m = toxicity.Model.fresh(seed)
    m.bias = np.random.default_rng(seed).normal(0, 0.1, len(m.bias)).astype(np.float32)
    return m


def plainly(m, text):
    """A convolution written out: every filter at every word, the largest value, the logistic unit."""
    words = [w for w in re.split("[ \\t-\\r]+", text or "") if w]
    x = [sum(m.emb[r] for r in toxicity.word_rows(w)) for w in words]
    best = []
    for t in m.taps:
        for f in range(toxicity.FILTERS):
            best.append(max([0.0] + [sum(float(x[i + j] @ t[j][:, f]) for j in range(len(t)) if i + j < len(x)) for i in range(len(x))]))
    h = np.maximum(np.array(best) + m.bias, 0)
    return 1 / (1 + np.exp(-(h @ m.out + m.out_bias)))


def test_scores_are_those_of_a_plain_convolution(monkeypatch):
    g, m = random.Random(4), random_model(4)
    texts = [" ".join(g.choice("ab nasty Nasty! vile, x yy zzz".split()) for _ in range(g.choice([0, 1, 2, 3, 9, 30]))) for _ in range(40)] + [None, "", "  a ", "\x0b"]
    for at_once in (1, 2, 7, 1 << 16):
        monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", at_once)
        got = toxicity.Scorer(m)(pa.array(texts, pa.string()))
        assert np.allclose(got, [plainly(m, t) for t in texts], atol=1e-5)
    rows = [np.array([toxicity.word_rows(w) for w in (t or "").split()], np.uint16).reshape(-1, toxicity.SLOTS) for t in texts]
    assert np.allclose([toxicity.score_rows(m, r) for r in rows], got, atol=1e-5)


def test_a_very_long_text_is_scored_in_bounded_memory():
    import tracemalloc

    scorer, texts = toxicity.Scorer(random_model(1)), pa.array(["word nasty " * 400_000 + "vile", "word"], pa.string())
    tracemalloc.start()
    got = scorer(texts)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    assert got[0] == scorer(pa.array(["word nasty word nasty word nasty vile"]))[0]


def test_fitting_goes_downhill():
    g = np.random.default_rng(2)
    texts = [g.integers(1, 60, (int(g.integers(3, 12)), toxicity.SLOTS)).astype(np.uint16) for _ in range(120)]
    labels = np.array([float((t[:, 0] < 12).any()) for t in texts])
    loss = lambda m: float(np.mean([-np.log(max(1e-9, s if y else 1 - s)) for s, y in ((toxicity.score_rows(m, t), y) for t, y in zip(texts, labels, strict=True))]))
    assert loss(toxicity.fit(texts, labels, epochs=30)) < 0.5 * loss(toxicity.fit(texts, labels, epochs=1))


def test_columns_of_the_input_stay_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a", True, 0.3, "x")], "doc_id long, text string, is_toxic boolean, toxic_score double, toxicity string")
    got = toxicity.without_toxic(docs, random_model(3)).unionByName(toxicity.without_toxic(docs, None))
    assert got.columns == docs.columns and all(tuple(r) == (1, "a", True, 0.3, "x") for r in got.collect())
    with pytest.raises(ValueError, match="toxicity"):
        toxicity.score(docs, None)


def test_few_labels_train_and_calibrate_like_many(spark):
    docs = spark.createDataFrame([(i, "nasty vile" if i % 2 else "kind word") for i in range(12)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(docs, model).collect()}
    assert model.thresholds == {} and min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)


@pytest.mark.parametrize("text", ["", "<s>", "</s>", "[INST]x[/INST]", "[\\INST]", "[\\\\/INST]", "a\\", "<\\s>", "<s", "[[INST]", "\\[INST]"])
def test_escaping_is_undone(text):
    made = chat_format.escape(text)
    assert chat_format.unescape(made) == text and not any(c in made for c in chat_format.CONTROLS)


def test_chats_read_back(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(chat_format, "PIECE", 5)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, 1, "assistant", "é </s> ok"), (1, 0, "user", "[INST] hi"), (1, 2, "assistant", ""), (1, 2, "assistant", "more"), (2, 0, None, None), (None, 3, "user", "x" * 3000), (None, 4, "assistant", " " * 1_000_000 + "b" * 300_000 + " \n" * 100_000), (3, None, "odd</s>role", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(turns, path, pattern), path, pattern).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(said) and got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[2]["formatted_chars"] == len("<s>[INST][/INST]</s>")
    assert chat_format.format_chats(turns.limit(0), path, pattern).count() == 0


def test_token_store_is_what_the_library_says(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    texts = ["it's A.B. tests, Ünïcode x", None, "", " \x1c a\x0bb", "<|endoftext|> ok", "Σίσυφος ΟΔΟΣ", "é é", "wörd. word, WORD.", "a" * 500, "don't 'll x'd"]
    rows = [(i * 7 % 10, t) for i, t in enumerate(texts)] + [(None, "null id"), (-3, "minus"), (3, "again")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ident", F.lit("clash"))
    tok, start, wanted = Tokenizer.from_file(path), 0, []
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r])):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(token_store.token_store(docs, path)) == sorted(wanted, key=str)
    assert token_store.token_store(docs.limit(0), path).count() == 0


def test_shards_are_searched(spark):
    out = io.BytesIO()
    w = token_store.ShardWriter(out, block_bytes=60)
    keys = [None, *range(-50, 200, 3), 300, 300]
    for k in keys:
        w.add(token_store.key_of(k), np.array([abs(k or 0), 1]))
    w.finish()
    r = token_store.ShardReader(out, len(out.getvalue()))
    assert len(r.blocks) > 5 and r.entries == len(keys)
    assert [token_store.ident_of(k) for k, _ in r] == keys
    assert [len(r.get(k)) for k in (None, -50, 1, 2, 300, 301)] == [1, 1, 1, 0, 2, 0]
    damaged = bytearray(out.getvalue())
    damaged[3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_store.ShardReader(io.BytesIO(damaged), len(damaged)))


def test_other_tokenizer_files_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "It's a test."), (2, None), (0, "  two  spaces ")], DOCS)
    start, wanted = 0, []
    for i, t in sorted(docs.collect()):
        ids = Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [7]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert not token_store.encoder(path).by_words
    assert rows_of(token_store.token_store(docs, path, end_id=7)) == sorted(wanted, key=str)


def test_words_are_encoded_as_the_library_encodes_texts():
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    encode, tok, g = token_store.WordEncoder(path), Tokenizer.from_file(path), random.Random(6)
    signs = "abcdeABZ ÀéÉßÿÞĀāǅİı'’s.,!?#`^~<|>[]{}0123٣中文あ́̈ \t\n\x0b\x1c\x85\u2028 µªºøØ×÷-_\\"
    texts = ["".join(g.choices(signs, k=g.randrange(25))) for _ in range(3000)] + ["<|startoftext|>a", "a<|endoftext|>.", "Can't I'LL", "w" * 200_000, "long text, " * 50_000]
    ids, bounds = encode(pa.array([*texts, None]), 1)
    for i, t in enumerate([*texts, ""]):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_leaks_against_brute_force(spark):
    g = random.Random(5)
    vocab = [f"v{i}" for i in range(4000)]
    items = [(k, " ".join(g.choice(vocab) for _ in range(g.choice([4, 9, 20, 40])))) for k in range(25)] + [(90, None), (91, " ")]
    docs, planted = [], set()
    for d in range(120):
        w = [g.choice(vocab) for _ in range(g.randrange(0, 150))]
        if d % 3 == 0:
            k, t = items[g.randrange(25)]
            part = t.split()
            for _ in range(g.randrange(0, len(part) // decontaminate.EVERY + 1)):
                part[g.randrange(len(part))] = g.choice(vocab)
            at = g.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in part]
            planted.add((d, k))
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, "")]
    got = decontaminate.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(planted & found) >= 0.97 * len(planted) and found <= planted
    texts, known = dict(docs), dict(items)
    for r in got:
        part = [decontaminate.plain(x) for x in texts[r["doc_id"]].split()[r["start_word"] : r["start_word"] + r["n_words"]]]
        assert edits(part, known[r["item_id"]].split()) == r["edits"] <= len(known[r["item_id"]].split()) // decontaminate.EVERY


def nearest(words, item):
    """Fewest edits from the item to any stretch of the words, the place being the first to end, then the longest."""
    row, start, best = list(range(len(item) + 1)), [0] * (len(item) + 1), (len(item) + 1, 0, 0)
    for j, w in enumerate(words, 1):
        new, origin = [0], [j]
        for i, x in enumerate(item, 1):
            c, s = min((row[i - 1] + (x != w), start[i - 1]), (row[i] + 1, start[i]), (new[i - 1] + 1, origin[i - 1]))
            new.append(c)
            origin.append(s)
        row, start = new, origin
        if row[-1] < best[0]:
            best = (row[-1], start[-1], j)
    return best


def test_best_match_against_the_whole_table():
    g = random.Random(12)
    for _ in range(300):
        item = np.array([g.randrange(5) for _ in range(g.randrange(1, 9))], np.uint64)
        stretch = np.array([g.randrange(5) for _ in range(g.randrange(0, 14))], np.uint64)
        assert decontaminate.best_match(stretch, item) == nearest(stretch.tolist(), item.tolist())


def test_recall_against_an_exhaustive_search(spark):
    """Insertions, deletions and substitutions up to the allowance, in items of all lengths, among near misses."""
    g = random.Random(13)
    vocab = [f"v{i}" for i in range(300)]
    items = [[g.choice(vocab) for _ in range(g.choice([3, 5, 7, 10, 15, 25, 60]))] for _ in range(40)]
    texts = []
    for _ in range(250):
        part = list(g.choice(items))
        for _ in range(g.randrange(0, len(part) // decontaminate.EVERY + 3)):
            kind, at = g.randrange(3), g.randrange(len(part))
            if kind == 0:
                part.insert(at, g.choice(vocab))
            elif kind == 1 and len(part) > 1:
                del part[at]
            else:
                part[at] = g.choice(vocab)
        texts.append([g.choice(vocab) for _ in range(g.randrange(20))] + part + [g.choice(vocab) for _ in range(g.randrange(20))])
    wanted = {(d, k): nearest(t, i)[0] for d, t in enumerate(texts) for k, i in enumerate(items) if nearest(t, i)[0] <= len(i) // decontaminate.EVERY}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], DOCS)
    got = decontaminate.leaks(docs, spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    assert set(found) <= set(wanted) and len(found) >= 0.95 * len(wanted) > 100
    assert sum(found[p] == wanted[p] for p in found) >= 0.95 * len(found)


def test_leaks_in_a_very_long_text(spark):
    item = [f"q{i}" for i in range(30)]
    text = " ".join(["w"] * 400_000 + item[:12] + ["x"] + item[13:] + ["w"] * 400_000)
    got = decontaminate.leaks(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["edits"], r["start_word"], r["n_words"]) for r in got] == [(1, 400_000, 30)]


def test_clean_texts_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (1, "another text"), (2, "x"), (None, "one two three four five"), (3, None)], DOCS).withColumn("row_name", F.lit("clash"))
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert rows_of(decontaminate.clean(docs, bench)) == sorted([(1, "another text", "clash"), (2, "x", "clash"), (3, None, "clash")], key=str)
    assert decontaminate.clean(docs, bench.limit(0)).count() == 5
    assert decontaminate.clean(docs.limit(0), bench).count() == 0


def test_targets_are_shared_out_again():
    assert source_mix.targets([10, 100, 10], [1, 1, 1]) == [30.0, 60.0, 30.0]
    assert source_mix.targets([0, 6], [1, 2]) == [0.0, 6.0]
    assert source_mix.targets([], []) == []


def test_budgets_are_fitted():
    g, slack = random.Random(8), 0
    for _ in range(200):
        counts = {g.randrange(0, 40): g.randrange(1, 5) for _ in range(g.randrange(1, 8))}
        total = sum(s * n for s, n in counts.items())
        budget = g.randrange(0, total + 1)
        taken = source_mix.fitted(counts, budget)
        assert all(0 <= n <= counts[s] for s, n in taken.items())
        reach = {0}
        for s, n in counts.items():
            reach |= {r + s * k for r in reach for k in range(n + 1)}
        best = max(r for r in reach if r <= budget)
        assert sum(s * n for s, n in taken.items()) <= budget
        slack = max(slack, best - sum(s * n for s, n in taken.items()))
    assert slack <= 40


def test_mix(spark):
    g = random.Random(9)
    rows = [(i, g.choice(["b", "a", None, "c"]) if i % 3 else "a", " ".join("w" for _ in range(g.randrange(1, 30)))) for i in range(400)] + [(900, "a", None), (901, "zero", ""), (5, "c", "w w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("s", F.lit(1)).withColumn("n", F.lit(2))
    got = source_mix.mix(docs, keep=("source",)).collect()
    assert len(got) == len(rows) and rows_of(source_mix.mix(docs)) == rows_of(source_mix.mix(docs.repartition(7)))
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5 and own[0]["source_size"] == sum(r["size"] for r in own)
    assert source_mix.mix(docs.limit(0)).count() == 0


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    g = random.Random(3)
    vocab = [f"u{i}" for i in range(900)]
    docs, labels = [], []
    for i in range(240):
        w = [g.choice(vocab) for _ in range(40)]
        if i % 6 == 0:
            w[5] = w[20] = "vilething"
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(1000, docs[1][1], "en", "s1", 1), (1001, docs[1][1] + " more", "en", "s1", 1), (1002, "x " + "item of the test set goes here ok " * 2, "en", "s2", 1), (1003, "", "en", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "item of the test set goes here ok")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = left.columns, {}
    for name, stage in pipeline.STAGES:
        left = pipeline.materialise(stage(spark, left, str(tmp_path)), name)
        seen[name] = [r["doc_id"] for r in left.select("doc_id").collect()]
        assert name == "tokens" or left.columns == columns
    toxic = {i for i in range(240) if i % 6 == 0}
    assert toxic.isdisjoint(seen["toxicity"]) and len(seen["toxicity"]) == len(docs) - len(toxic)
    assert set(seen["toxicity"]) - set(seen["near_copies"]) == {1000, 1001}
    assert set(seen["near_copies"]) - set(seen["leaks"]) == {1002}
    assert sorted(seen["mix"]) == sorted(seen["tokens"]) and set(seen["mix"]) <= set(seen["leaks"])


def test_a_stage_drops_what_the_one_before_wrote_on_its_way(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    there = lambda kind: {p for p in common.written(spark) if f"trailmap-{kind}-" in p}
    before = there("described")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(9)], "doc_id long, text string")
    lazy = pipeline.without_near_copies(spark, docs, "")
    own = there("described") - before
    again = pipeline.without_near_copies(spark, lazy, "")  # its plan leads through the tables of the one before
    assert own and own <= there("described") and again.count() == 9
    pipeline.without_near_copies(spark, docs, "")
    assert len(there("described") - before - own) == 1


def test_near_copies_keep_unlike_texts_of_one_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (1, text("a")), (2, text("b")), (3, text("c")), (0, text("c") + " more"), (5, None), (None, text("a"))]
    got = pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, text("a")), (1, text("b")), (0, text("c") + " more"), (5, None)], key=str)


def test_later_stages_keep_rows_of_one_id_apart(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "item of the test set goes here ok")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "x item of the test set goes here ok y", "a"), (1, "a clean text", "a"), (2, "one two three", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, pipeline.without_leaks(spark, docs, str(tmp_path)).collect())) == sorted(rows[1:])
    assert sorted(map(tuple, pipeline.mixed(spark, docs, "").collect())) == sorted(rows)


def test_kept_tables_stay_whatever_scheme_their_folder_was_given_with(spark, tmp_path, monkeypatch):
    from trailmap.llm import common

    for scheme in ("", "file:", "file://"):
        monkeypatch.setattr(common, "shared_dir", lambda _, scheme=scheme: f"{scheme}{tmp_path}")
        gone, kept = common.materialise(spark.range(3), "gone"), common.materialise(spark.range(5), "kept")
        common.drop_written(spark, common.path_of(kept))
        assert kept.count() == 5 and not os.path.exists(common.path_of(gone).removeprefix("file://"))


def test_all_labelled_texts_train_and_set_thresholds(spark, monkeypatch):
    """A word that only texts beyond the first model's tell of is learned, and thresholds see all texts."""
    for name, value in (("SAMPLE_TOXIC", 20), ("SAMPLE_CLEAN", 20), ("GROUP_TEXTS", 200), ("GROUP_EPOCHS", 1)):
        monkeypatch.setattr(toxicity, name, value)
    g, told = random.Random(8), []
    monkeypatch.setattr(toxicity, "gone_on", lambda texts, n, *more, f=toxicity.gone_on: told.append((texts.count(), n)) or f(texts, n, *more))
    monkeypatch.setattr(toxicity, "calibrated", lambda texts, *more, f=toxicity.calibrated: told.append(texts.count()) or f(texts, *more))
    rows, labels = [], []
    for i in range(1000):
        w = [f"u{g.randrange(60)}" for _ in range(20)]
        if i % 2:
            w[3] = "vilething"
        rows.append((i, " ".join(w), "en"))
        labels.append((i, i % 2))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert told[0][0] == told[0][1] and told[0][0] + told[1] == 1000 and "en" in model.thresholds
    got = toxicity.score(docs, model).select("doc_id", "toxicity.toxic").collect()
    assert sum(r["toxic"] == bool(r["doc_id"] % 2) for r in got) >= 990
