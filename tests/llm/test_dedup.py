"""Deduplication operators against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmap.llm import common, components, line_dedup, ngram_join, suffix_array, suffix_dedup

DOCS = "doc_id long, text string"
WORD = re.compile("[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def linked(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * len(a | sets[j]):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


@pytest.mark.parametrize(("n", "num", "few"), [(4, 85, 3), (5, 80, 32), (1, 50, 8)])
def test_ngram_join(spark, monkeypatch, n, num, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "MANY", few * 4)
    monkeypatch.setattr(ngram_join, "BLOCK", few * 8)
    g = random.Random(num)
    words = [f"W{i}" for i in range(50)] + ["É", "é"]
    base = [[g.choice(words) for _ in range(g.choice([1, 3, 9, 30, 120]))] for _ in range(8)]
    rows = []
    for i in range(300):
        w = list(g.choice(base))
        for _ in range(g.choice([0, 0, 1, 2, 4])):
            w[g.randrange(len(w))] = g.choice(words)
        rows.append((i, g.choice([" ", "\n", " \t"]).join(w)))
    rows += [(300, None), (301, ""), (302, " \x0b"), (303, rows[0][1].lower())]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("digest", F.lit(1)).withColumn("size", F.lit("clash"))
    assert rows_of(ngram_join.linked_classes(docs, n, num, 100)) == linked(rows, n, num, 100)


def test_ngram_join_sends_signatures_in_rounds_and_leaves_little_behind(spark, monkeypatch):
    g = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(g.choice(vocab) for _ in range(60))) for i in range(90)]
    rows += [(100 + i, t.replace(t.split()[3], "other", 1)) for i, t in rows[:40]]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(ngram_join, "BUCKET", 500)
    monkeypatch.setattr(ngram_join, "ROUND", 4)
    sent, signed = [], ngram_join.signed
    monkeypatch.setattr(ngram_join, "signed", lambda *a: sent.append(signed(*a).cache()) or sent[-1])
    before = set(common.written(spark))
    assert rows_of(ngram_join.linked_classes(docs, 4, 85, 100)) == linked(rows, 4, 85, 100)
    n = [sum(len(ngram_join.unpack_signed(bytes(r["rows"]))) for r in x.collect()) for x in sent]
    assert len(n) == ngram_join.ROUNDS and max(n) < sum(n) / 2
    left = {p.rsplit("/", 1)[-1].split("-")[1] for p in set(common.written(spark)) - before if os.path.isdir(p.removeprefix("file:"))}
    assert left <= {"described", "edges"}
    for x in sent:
        x.unpersist()


def test_ngram_join_of_nothing_and_of_rows_without_id(spark):
    assert ngram_join.linked_classes(spark.createDataFrame([], DOCS)).count() == 0
    got = rows_of(ngram_join.linked_classes(spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q")], DOCS)))
    assert got == [(5, 2, 5), (5, 2, 5), (None, 1, None), (None, 2, 5)]


def test_ngram_join_of_very_long_texts(spark):
    g = random.Random(11)
    words = [f"w{g.randrange(10**6)}" for _ in range(30_000)]
    near, far = list(words), list(words)
    for w, n in ((near, 500), (far, 2_300)):
        for p in g.sample(range(len(w)), n):
            w[p] = "other"
    rows = [(5, " ".join(words)), (6, " ".join(near)), (7, " ".join(far)), (8, "short text of words")]
    assert rows_of(ngram_join.linked_classes(spark.createDataFrame(rows, DOCS))) == linked(rows, 4, 85, 100)


def test_pairs_of_larger_groups(monkeypatch):
    """Pairs across components by sketch, some at a time, as one by one."""
    g = np.random.default_rng(1)
    for _ in range(20):
        monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", int(g.integers(1, 60)))
        lens = g.integers(2, 30, 5)
        ends, n = np.repeat(np.cumsum(lens), lens), int(lens.sum())
        doc, comp, size = np.arange(n) * 3, g.integers(0, 4, n), g.integers(80, 130, n)
        raw = [g.integers(0, 256, int(g.choice([16, 32]))).astype(np.uint8).tobytes() if g.random() < 0.5 else bytes(int(g.choice([16, 32]))) for _ in range(n)]
        got = {(int(p["a"]), int(p["b"])) for part in ngram_join.differing(doc, comp, size, ends, ngram_join.folded_rows(raw, 16), 85, 100) for p in part}
        short = [ngram_join.folded(r, 16).to_bytes(16, "little") for r in raw]
        assert got == {(int(doc[i]), int(doc[j])) for i in range(n) for j in range(i + 1, ends[i]) if comp[i] != comp[j] and ngram_join.may_link(short[i], int(size[i]), short[j], int(size[j]), 85, 100)}


def test_signatures_never_lose_a_pair():
    g = np.random.default_rng(3)
    for _ in range(400):
        size = int(g.integers(1, 600))
        a = np.unique(g.integers(0, 1 << 63, size).astype(np.uint64))
        drop = int(g.integers(0, len(a) * 15 // 100 + 1))
        b = np.sort(np.concatenate((a[drop:], g.integers(0, 1 << 63, int(g.integers(0, 1 + len(a) // 20))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if both < max(len(a), len(b)) and 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_join.signatures(a, 85, 100), ngram_join.signatures(b, 85, 100))) >= ngram_join.SHARED
            assert ngram_join.may_link(ngram_join.sketch(a, 85, 100).tobytes(), len(a), ngram_join.sketch(b, 85, 100).tobytes(), len(b), 85, 100)


def test_components_of_a_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["doc_id"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100}


def test_suffix_arrays():
    g = np.random.default_rng(0)
    for _ in range(60):
        texts = [np.append(g.integers(1, 2 + g.integers(1, 4), g.integers(0, 40)), 0) for _ in range(g.integers(1, 6))]
        bounds = np.cumsum([0, *map(len, texts)])
        got = suffix_array.suffix_arrays(np.concatenate(texts), bounds)
        for a, z, t in zip(bounds[:-1], bounds[1:], texts, strict=True):
            assert (got[a:z] - a).tolist() == sorted(range(len(t)), key=lambda i, t=t: t[i:].tolist())


def test_suffixes_ordered_as_far_as_some_symbols():
    g = np.random.default_rng(2)
    for _ in range(60):
        texts = [np.append(g.integers(1, 2 + g.integers(1, 4), g.integers(0, 90)), 0) for _ in range(g.integers(1, 6))]
        bounds, symbols = np.cumsum([0, *map(len, texts)]), int(g.integers(1, 60))
        got = suffix_array.ordered_to(np.concatenate(texts), bounds, symbols)
        for a, z, t in zip(bounds[:-1], bounds[1:], texts, strict=True):
            own = (got[a:z] - a).tolist()
            assert sorted(own) == list(range(len(t)))
            assert [t[i : i + symbols].tolist() for i in own] == sorted(t[i : i + symbols].tolist() for i in range(len(t)))


def cut(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49) if d is not None else ():
            first[b[p : p + 50]] = min(d, first.get(b[p : p + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49) if d is not None else ():
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((d, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [2, 32])
def test_suffix_dedup(spark, monkeypatch, few):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    g = random.Random(few)
    parts = ["".join(g.choice("abc é") for _ in range(g.choice([30, 49, 50, 51, 60, 90, 300]))) for _ in range(30)]
    rows = [(g.randrange(-5, 300), "".join(g.choice(parts) if g.random() < 0.6 else "".join(g.choice("abcdefgh") for _ in range(g.randrange(80))) for _ in range(g.randrange(1, 8)))) for _ in range(200)]
    rows += [(None, rows[0][1]), (7, None), (8, ""), (9, "a" * 400), (10, "a" * 200), (11, "ab" * 200), (12, "ab" * 300 + "c"), (13, rows[5][1]), (13, rows[5][1])]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("uid", F.lit("clash")).withColumn("bucket", F.lit(1))
    assert rows_of(suffix_dedup.dedup(docs)) == cut(rows)


def test_suffix_dedup_where_short_hashes_of_contexts_meet(spark):
    """Two windows with one anchor, unlike in bytes, whose contexts' hashes are equal in the 40 bits told of them before."""
    a, b = "xbeiadzdsjutylashamqibqmadstrveddbuijncfghoexregab", "xbeiadzdsjutylashamqhjvndkfkglzuykaymixbqrvplfantp"
    rows = [(1, a), (2, b), (3, a)]
    assert rows_of(suffix_dedup.dedup(spark.createDataFrame(rows, DOCS))) == cut(rows)


def letters(g, n, of=26):
    return g.integers(97, 97 + of, n).astype(np.uint8)


def contexts_of(*texts):
    """Contexts of texts whose ids are 0, 1, ... as rows of anchors."""
    found = suffix_dedup.contexts(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    rows = np.empty(len(found["k"]), suffix_dedup.ANCHORED)
    rows["k"], rows["c"], rows["doc"] = found["k"], found["c"], found["text"]
    return rows, found


def test_contexts_that_share_only_an_anchor_are_not_compared():
    g = np.random.default_rng(4)
    t = letters(g, 4000)
    _, found = contexts_of(t)
    q = found["last"][np.argmax(found["last"] - found["first"])]  # it is the least of 30 pieces on each side
    rows, _ = contexts_of(*(np.concatenate((letters(g, 100), t[q : q + 20], letters(g, 100))) for _ in range(3)))
    assert len(np.unique(rows["k"])) < len(rows) == len(np.unique(rows["c"]))
    assert list(suffix_dedup.decided(rows, np.zeros(0, np.uint64), False, 3)) == []


def test_contexts_with_a_window_in_common_are_compared_or_go_whole():
    g = np.random.default_rng(6)
    for _ in range(200):
        w = letters(g, 50)
        a, b = (np.concatenate((letters(g, int(g.integers(0, 70))), w, letters(g, int(g.integers(0, 70))))) for _ in range(2))
        rows, found = contexts_of(a, b)
        at = [i for i, d in enumerate(rows["doc"]) for p in range(found["first"][i], found["last"][i] + 1) if np.concatenate((a, b))[p : p + 50].tobytes() == w.tobytes()]
        fates = np.concatenate([suffix_dedup.unpack_fates(d) for p in suffix_dedup.decided(rows, np.zeros(0, np.uint64), False, 1) for d in p.column("data").to_pylist()])
        later = rows[at[1]]
        said = fates[(fates["doc"] == later["doc"]) & (fates["key"] == suffix_dedup.key_of(rows["k"], rows["c"])[at[1]])]["fate"].tolist()
        assert len(at) == 2 and said == [suffix_dedup.WHOLE if rows["c"][at[0]] == later["c"] else suffix_dedup.COMPARED]


def test_a_key_of_many_strings_takes_no_step_for_each_of_them(monkeypatch):
    g, asked, sorted_before = np.random.default_rng(8), [], suffix_dedup.suffix_arrays
    monkeypatch.setattr(suffix_dedup, "suffix_arrays", lambda text, bounds: asked.append(int(np.diff(bounds).max())) or sorted_before(text, bounds))
    start = letters(g, 55)
    key = np.repeat(np.array([7, 8, 9], np.uint64), [900, 5, 200])
    texts = [np.concatenate((start[int(k) - 7 :], letters(g, int(g.integers(1, 20)), 3))) for k in key]
    rows = np.empty(len(key), suffix_dedup.STRING)
    rows["key"], rows["doc"], rows["uid"], rows["start"], rows["size"] = key, g.permutation(len(key)), np.arange(len(key)), 10, [len(t) for t in texts]
    got = {(int(u), p) for uid, a, z in suffix_dedup.repeats(rows, np.concatenate(texts)) for u, s, e in zip(uid, a, z, strict=True) for p in range(s, e - 49)}
    first = {}
    windows = [(k, t[p : p + 50].tobytes(), d, u, p + 10) for k, t, d, u in zip(key.tolist(), texts, rows["doc"].tolist(), rows["uid"].tolist(), strict=True) for p in range(len(t) - 49)]
    for k, w, d, _, _ in windows:
        first[k, w] = min(d, first.get((k, w), d))
    assert got == {(u, p) for k, w, d, u, p in windows if d > first[k, w]}
    assert max(asked) < 5 * 80


def test_strings_and_cuts_travel_once_for_a_bucket_of_texts(spark):
    """Not once for each of the smaller parts that its texts are hashed in."""
    g = random.Random(12)
    parts = ["".join(g.choice("abcdefgh") for _ in range(300)) for _ in range(40)]
    rows = [(i, "".join(g.choice(parts)[g.randrange(100) :] + "".join(g.choice("abcdefgh") for _ in range(200)) for _ in range(12))) for i in range(1000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("uid", F.xxhash64("doc_id", "text")).repartition(2)
    n = 5
    assert sum(len(t) for _, t in rows) > 4 * n * suffix_dedup.HASHED_BYTES
    fates = suffix_dedup.fates(suffix_dedup.anchors(docs, n), n, n)
    found = suffix_dedup.candidates(suffix_dedup.meeting(fates, suffix_dedup.squeezed(docs, suffix_dedup.doc_bucket_column(F.col("doc_id"), n)), n), n, n)
    told = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    assert set(told) == {0, 1} and max(told.values()) <= n * n


def test_parts_of_long_texts_have_the_anchors_of_the_whole(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HASHED_BYTES", 120)
    g = np.random.default_rng(5)
    texts = [g.integers(97, 101, int(n)).astype(np.uint8) for n in (0, 10, 49, 50, 120, 168, 169, 170, 171, 400, 999, 3)]
    x, bounds = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))

    def told(found):
        return {(int(t), p): (int(k), int(found["w"][v + p - f])) for t, f, z, k, v in zip(found["text"], found["first"], found["last"], found["k"], found.get("within", found["first"]), strict=True) for p in range(int(f), int(z) + 1)}

    parts = [told(found) for found in suffix_dedup.in_parts(x, bounds)]
    whole = told(suffix_dedup.contexts(x, bounds))
    assert len(parts) > 5 and {k: v for part in parts for k, v in part.items()} == whole and sum(map(len, parts)) == len(whole)


def test_suffix_dedup_of_very_long_texts(spark):
    g = random.Random(9)
    text = "".join(g.choice("abcdefgh ") for _ in range(450_000))
    rows = [(1, text), (2, "x" * 60 + text[1000:300_000] + "other" + text[:5000]), (3, text)]
    assert rows_of(suffix_dedup.dedup(spark.createDataFrame(rows, DOCS))) == cut(rows)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def without_runs(rows):
    first = {}
    filled = [(d, [x for x in (t or "").split("\n") if x.strip(line_dedup.BLANK)]) for d, t in rows]
    for d, x in filled:
        for p in range(len(x) - 2) if d is not None else ():
            k = tuple(x[p : p + 3])
            first[k] = min((d, p), first.get(k, (d, p)))
    out = []
    for (d, x), (_, t) in zip(filled, rows, strict=True):
        gone = {q for p in range(len(x) - 2) if d is not None and first[tuple(x[p : p + 3])] < (d, p) for q in (p, p + 1, p + 2)}
        kept, q = [], -1
        for line in (t or "").split("\n"):
            q += bool(line.strip(line_dedup.BLANK))
            if not line.strip(line_dedup.BLANK) or q not in gone:
                kept.append(line)
        out.append((d, len(x), len(gone), sum(1 for i in gone if i - 1 not in gone), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_fewer_places_are_selected_than_lines(spark):
    g = np.random.default_rng(7)
    h = g.integers(0, 1 << 63, 3000).astype(np.uint64)
    at, fp, before, after = line_dedup.winnowed(h)
    chosen = set(at[before] - 1) | set(at[after])
    assert len(at) < 0.75 * len(h) and len(np.unique(at)) == len(at) and chosen == set(range(len(h) - 2))


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"line {i} of many" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new"] + lines[100:50_000] + ["end"])), (3, "w " * 500_000)]
    assert rows_of(line_dedup.dedup(spark.createDataFrame(rows, DOCS))) == without_runs(rows)


def test_line_dedup(spark):
    g = random.Random(4)
    lines = [f"line {i}" for i in range(12)] + ["", "  "]
    rows = [(i, "\n".join(g.choice(lines) for _ in range(g.randrange(0, 25)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, rows[3][1]), (202, "same\n" * 9), (203, "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("runs", F.lit(1)).withColumn("lines", F.lit(2))
    assert rows_of(line_dedup.dedup(docs)) == without_runs(rows)
    assert line_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def without_passages(rows, words):
    first, seeds = {}, []
    filled = [(d, [x for x in (t or "").split("\n") if x.strip(line_dedup.BLANK)]) for d, t in rows]
    for i, (d, x) in enumerate(filled):
        for p in range(len(x)) if d is not None else ():
            for n in (1, 2, 3):
                k = tuple(x[p : p + n])
                if len(k) == n and (n == 3 or sum(len(WORD.findall(y)) for y in k) >= words):
                    seeds.append((i, d, p, k))
                    first[k] = min((d, p), first.get(k, (d, p)))
    gone = {(i, q) for i, d, p, k in seeds if first[k] < (d, p) for q in range(p, p + len(k))}
    return [(d, [y for q, y in enumerate(x) if (i, q) not in gone]) for i, (d, x) in enumerate(filled)]


def test_line_dedup_of_long_passages(spark):
    g = random.Random(6)
    lines = [" ".join(g.choice("abcde") for _ in range(g.choice([1, 2, 4, 5, 6, 9, 10, 11]))) for _ in range(40)]
    rows = [(i, "\n".join(g.choice(lines) for _ in range(g.randrange(0, 9)))) for i in range(200)]
    rows += [(300, "p " * 10), (301, "p " * 10), (302, "q " * 4 + "\n" + "r " * 6), (303, "q " * 4 + "\n\n" + "r " * 6), (304, "p " * 9), (305, "p " * 9), (None, "p " * 10)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [(d, [x for x in t.split("\n") if x.strip(line_dedup.BLANK)]) for d, *_, t in line_dedup.dedup(docs, words=10).collect()]
    assert sorted(got, key=str) == sorted(without_passages(rows, 10), key=str)
    kept = dict(got)
    assert kept[301] == [] == kept[303] and kept[305]
    assert rows_of(line_dedup.dedup(docs)) == without_runs(rows)


def test_nearest_forest_keeps_the_nearest_pairs_that_join_all():
    pairs = np.array([(1, 2), (1, 3), (2, 3), (1, 4), (3, 4), (5, 6)], ngram_join.PAIR)
    far = np.array([0.3, 0.1, 0.2, 0.4, 0.1, 0.0])
    comp = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    kept, apart = ngram_join.nearest_forest(pairs, far, comp)
    assert [tuple(p) for p in kept.tolist()] == [(1, 3), (3, 4), (2, 3)] and apart.tolist() == [0.1, 0.1, 0.2]


def test_few_pairs_are_compared_in_a_large_group_of_near_copies(spark, monkeypatch):
    """Near copies of one text, not all of them linked: one class, found without comparing all pairs."""
    compared = []
    whole = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *more: compared.append(pairs.count()) or whole(pairs, *more))
    g = random.Random(5)
    base = [f"w{g.randrange(10**6)}" for _ in range(300)]
    docs = []
    for i in range(300):
        own = list(base)
        for k in g.sample(range(300), 6):
            own[k] = f"n{g.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    got = rows_of(ngram_join.linked_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 4, 85, 100))
    assert got == linked(docs, 4, 85, 100)
    assert sum(compared) <= 10 * len(docs)
