"""Benchmark decontamination by edit distance, on words.

A text leaks an item if some stretch of it is within a fifth of the item's words, in word
edits. Candidates come from item-sized windows: the CGK random walk embeds windows and items
so that few edits become few differing positions. Each walk makes a table of the items by a
few sampled positions of their embeddings; windows are looked up in the tables of all
walks, of which there are as many as the target recall needs. What they find is verified
by exact edit distance, with the best place of each item in each text.

Windows are embedded where they can be close at all: an item within t edits of a window has
one of its t + 1 pieces in it unchanged, so only windows about such a piece are looked
up, shifted by up to t words. That leaves nothing out; it spares most windows the walks.
Words are compared without case and surrounding punctuation.

The benchmark is written to the shared folder in blocks of BLOCK_BYTES at most, which tasks
read; each block is a pass over the texts. Whole texts are searched.

Defined cases: null or empty texts and items without words leak nothing; items and rows
that repeat each give their own rows of the result; null ids are kept as they are; empty
tables give an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix64, ragged, text_chunks, trimmed, word_codes, work_dir

#: Edits allowed: one in so many words.
EVERY = 5
RECALL, SAMPLED, SEED = 0.99, 2, 23
TRIMMED = ".,;:!?\"'()[]{}|#*$%&<>-_~`"
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
#: Windows that are embedded at once.
WINDOWS_AT_ONCE = 4096


def plain(word: str) -> str:
    return word.lower().strip(TRIMMED)


def hashes_of(distinct: list[str], seen: dict[str, int], most: int = 300_000) -> np.ndarray:
    if len(seen) > most:
        seen.clear()
    out = np.empty(len(distinct), np.uint64)
    for i, w in enumerate(distinct):
        h = seen.get(w)
        if h is None:
            seen[w] = h = xxhash.xxh3_64_intdigest(plain(w).encode("utf-8", "surrogatepass"))
        out[i] = h
    return out


def edits_of(n: int) -> int:
    return n // EVERY


def repeats_for(n: int, recall: float = RECALL, sampled: int = SAMPLED) -> int:
    """Tables needed for the recall, if t edits leave at least a third of an embedding's positions alike."""
    t = edits_of(n)
    alike = max(1 / 3, 1 - 2 * t / n) if t else 1.0
    return 1 if not t else math.ceil(math.log(1 - recall) / math.log(1 - alike**sampled))


def places_of(n: int, walk: int) -> np.ndarray:
    """Positions of the embedding of an item of n words that a walk's table looks at."""
    return (mix64(np.arange(SAMPLED, dtype=np.uint64) + np.uint64((SEED + walk) * 1009)) % np.uint64(3 * n)).astype(np.int64)


def embedded(words: np.ndarray, length: int, walk: int) -> np.ndarray:
    """CGK: copy the word at the place, then step on or stay by a random bit of (word, time); rows are texts.

    `words` has a text in each row; beyond its end stands 0.
    """
    m, n = words.shape
    padded = np.concatenate((words, np.zeros((m, 1), np.uint64)), axis=1)
    at, out = np.zeros(m, np.int64), np.empty((m, length), np.uint64)
    rows = np.arange(m)
    for j in range(length):
        w = padded[rows, at]
        out[:, j] = w
        at = np.minimum(at + (mix64(w ^ np.uint64((walk << 20) + j + 1)) & np.uint64(1)).astype(np.int64), n)
    return out


def bucket_keys(words: np.ndarray, walk: int) -> np.ndarray:
    """Each row's bucket in the table of a walk; the walk is not followed beyond the places looked at."""
    places = places_of(words.shape[1], walk)
    seen = embedded(words, int(places.max()) + 1, walk)[:, places]
    key = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(seen.shape[1]):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + seen[:, j])
    return key


def best_match(stretch: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of `stretch` nearest to the item; of equal ones the first to end, then the longest.

    Costs and starts are one number, so a row of the table of edits is a few array operations:
    what comes from the left is a running minimum.
    """
    n, unit = len(item), len(stretch) + 1
    steps = np.arange(n + 1, dtype=np.int64) * unit
    cost, best = steps.copy(), (n + 1, 0, 0)
    for j, w in enumerate(stretch, 1):
        new = cost + unit
        new[0] = j
        new[1:] = np.minimum(new[1:], cost[:-1] + (item != w) * unit)
        cost = np.minimum.accumulate(new - steps) + steps
        if cost[n] // unit < best[0]:
            best = (int(cost[n] // unit), int(cost[n] % unit), j)
    return best


class Benchmark:
    """Items as word hashes, and the pieces by which windows near them are found."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids, self.words, by_size = [], [], {}
        for ident, text in items:
            codes, _, distinct = word_codes(pa.array([text], pa.string()))
            words = hashes_of(distinct, {})[codes] if len(codes) else np.zeros(0, np.uint64)
            if not len(words):
                continue
            k = len(self.ids)
            self.ids.append(ident)
            self.words.append(words)
            t = edits_of(len(words))
            size = len(words) // (t + 1)
            for p in range(t + 1):
                by_size.setdefault(size, []).append((rolled(words[p * size : p * size + size], size)[0], k, p * size))
        self.pieces = {}
        for size, rows in by_size.items():
            h = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(h, kind="stable")
            told = np.zeros(1 << FILTER_BITS, bool)  # most places are told apart by a few bits
            told[h & np.uint64(len(told) - 1)] = True
            self.pieces[size] = (told, h[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order])

        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_length: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            by_length.setdefault(len(words), []).append(k)
        for n, ks in by_length.items():
            rows = np.stack([self.words[k] for k in ks])
            tables = []
            for walk in range(repeats_for(n)):
                keys = bucket_keys(rows, walk)
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], np.array(ks)[order]))
            self.tables[n] = tables

    def windows(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, np.ndarray]:
        """By length, where windows start that may be close to an item of that length: about its unchanged pieces."""
        found: dict[int, list[np.ndarray]] = {}
        lengths = np.array([len(w) for w in self.words])
        for size, (told, h, item, offset) in self.pieces.items():
            if len(words) < size:
                continue
            r = rolled(words, size)
            at = np.flatnonzero(told[r & np.uint64(len(told) - 1)])
            at = at[np.isin(r[at], h)]
            text = np.searchsorted(bounds, at, side="right") - 1
            inside = at + size <= bounds[text + 1]
            at, text = at[inside], text[inside]
            low, high = np.searchsorted(h, r[at], side="left"), np.searchsorted(h, r[at], side="right")
            which = ragged(low, high - low)
            at, text = np.repeat(at, high - low), np.repeat(text, high - low)
            n = lengths[item[which]]
            first = at - offset[which]
            for length in np.unique(n).tolist():
                own = n == length
                t = edits_of(length)
                starts = first[own][:, None] + np.arange(-t, t + 1)
                starts = np.clip(starts, bounds[text[own]][:, None], bounds[text[own] + 1][:, None] - 1)
                found.setdefault(length, []).append(np.unique(starts))
        return {n: np.unique(np.concatenate(s)) for n, s in found.items()}

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """By (text, item), starts of windows that fall with the item into a bucket of some table."""
        near: dict[tuple[int, int], set[int]] = {}
        for n, every in self.windows(words, bounds).items():
            for a in range(0, len(every), WINDOWS_AT_ONCE):
                starts = every[a : a + WINDOWS_AT_ONCE]
                text = np.searchsorted(bounds, starts, side="right") - 1
                grid = starts[:, None] + np.arange(n)
                high = bounds[text + 1][:, None]
                rows = np.where(grid < high, words[np.minimum(grid, high - 1)], np.uint64(0))
                for walk, (keys, items) in enumerate(self.tables[n]):
                    own = bucket_keys(rows, walk)
                    low, up = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
                    hit = np.flatnonzero(up > low)
                    which = ragged(low[hit], (up - low)[hit])
                    hit = np.repeat(hit, (up - low)[hit])
                    for d, k, s in zip(text[hit].tolist(), items[which].tolist(), starts[hit].tolist(), strict=True):
                        near.setdefault((d, k), set()).add(s)
        return {pair: sorted(s) for pair, s in sorted(near.items())}

    def search(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, words) for each text and item that it leaks, the best place of each."""
        for (d, k), starts in self.candidates(words, bounds).items():
            item, low, high = self.words[k], int(bounds[d]), int(bounds[d + 1])
            n, t = len(item), edits_of(len(item))
            best, reached = None, -1
            for s in starts:
                if s <= reached:  # the stretch that was compared last has room for it
                    continue
                a, z = max(low, s - t), min(high, s + n + 3 * t)
                reached = s + t
                edits, x, y = best_match(words[a:z], item)
                if edits <= t and (best is None or (edits, a + x - low) < best[:2]):
                    best = (edits, a + x - low, y - x)
                if best and not best[0]:  # nothing can be nearer
                    break
            if best:
                yield d, k, *best


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)]
    return out ^ (out >> np.uint64(32))


def leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", item_ident: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start_word, n_words): documents that leak an item, with the best place."""
    own = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_ident).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    path = work_dir(docs.sparkSession, "benchmark")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(path)
    found = [searched(own, f"{path}/block={b}") for b in range(blocks)]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def read_block(path: str) -> list[tuple[int | None, str | None]]:
    """Items of a block, from the files that were written; none where a block has none."""
    fs, folder = pafs.FileSystem.from_uri(path)
    listed = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    out = []
    for f in sorted(f.path for f in listed if f.path.endswith(".parquet")):
        with fs.open_input_file(f) as file:
            out += [(r["item_id"], r["text"]) for r in pq.ParquetFile(file).read(["item_id", "text"]).to_pylist()]
    return out


def searched(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, seen = Benchmark(read_block(path)), {}
        for batch in text_chunks(batches):
            codes, bounds, distinct = word_codes(batch.column("text"))
            rows = list(bench.search(hashes_of(distinct, seen)[codes], bounds)) if len(codes) and bench.ids else []
            if rows:
                ids = batch.column("doc_id").to_pylist()
                made = [[ids[r[0]] for r in rows], [bench.ids[r[1]] for r in rows], *([r[c] for r in rows] for c in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], ["doc_id", "item_id", "edits", "start_word", "n_words"])

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, item_id long, edits long, start_word long, n_words long")


def clean(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns; rows are told apart by id and text, so one without id goes like others."""
    name = free_name(docs.columns, "row_name")
    rows = docs.withColumn(name, F.xxhash64(ident, text))
    found = leaks(rows, benchmark, name, text).select(F.col("doc_id").alias(name)).distinct()
    return rows.join(found, name, "left_anti").select(*docs.columns)
