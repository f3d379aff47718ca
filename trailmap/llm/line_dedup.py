"""Removal of repeated runs of lines, by winnowing over line hashes.

Lines with a word are hashed; two neighbours make a gram. Of each window of two grams, which
is a run of RUN = 3 lines, the smaller gram hash is selected, the later of equal ones; so any
three lines that stand twice have a selected gram at the same place in them. Only selected
places travel, one row each, with the line before and the line after where a window that
reaches there chose them. Positions are joined on the gram: equal (gram, side, line) is a
match of three lines with their first place, which is then extended both ways over equal
lines, and of each match the later run is deleted. The result is exact: a line goes if some
three lines over it also stand at an earlier place, in the order of (id, line). With
`words`, a run of one or two lines that has so many words counts as three lines do, so a
repeated passage of that length is found however it is broken.

Defined cases: a null text has no lines; lines without a word count for nothing and stay;
overlapping repeats within a text count, so of a line said five times in a row three to
four go; rows with one id stand at one place and don't remove each other; rows without id
stay whole and remove nothing; an empty table gives an empty result; further columns of
the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, text_chunks, trimmed

RUN = 3
BLANK = " \t\n\x0b\x0c\r"


def has_word(line: str) -> bool:
    return bool(line.strip(BLANK))


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that have a word, and how many words they have."""
    filled = [x.encode("utf-8", "surrogatepass") for x in (text or "").split("\n") if has_word(x)]
    return np.array([xxhash.xxh3_64_intdigest(x) for x in filled], np.uint64), np.array([len(x.split()) for x in filled], np.int64)


def winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Selected grams: place, hash, and whether the window before and the window after chose them."""
    if len(h) < RUN:
        none = np.zeros(0, bool)
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), none, none
    with np.errstate(over="ignore"):
        grams = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    later = grams[1:] <= grams[:-1]  # of each window, whether its second gram is the one
    ends, begins = np.append(False, later), np.append(~later, False)
    at = np.flatnonzero(ends | begins)
    return at, grams[at], ends[at], begins[at]


def short_runs(h: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of one and of two lines that have `words` words."""
    one, two = np.flatnonzero(n >= words), np.flatnonzero(n[:-1] + n[1:] >= words)
    with np.errstate(over="ignore"):
        return np.concatenate((one, two)), np.concatenate((mix64(h[one]), mix64(h[two] * np.uint64(0x9E3779B97F4A7C15) + h[two + 1])))


def fingerprints(docs: DataFrame, words: int | None) -> DataFrame:
    """(doc_id, at, fp, before, after) of each selected place, and the document's line hashes at its first; short runs have neither side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            ids, ats, fps, befores, afters, lines = [], [], [], [], [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, n = line_hashes(t)
                at, fp, before, after = winnowed(h)
                line = h.view(np.int64)
                left = pa.array(line[np.maximum(at - 1, 0)], mask=~before)
                right = pa.array(line[np.minimum(at + 2, max(0, len(h) - 1))] if len(h) else line, mask=~after)
                if words is not None:
                    short, hashes = short_runs(h, n, words)
                    at, fp = np.concatenate((at, short)), np.concatenate((fp, hashes))
                    left, right = (pa.concat_arrays([x, pa.nulls(len(short), pa.int64())]) for x in (left, right))
                if i is None or not len(at):
                    continue
                ids.append(np.full(len(at), i, np.int64))
                ats.append(at)
                fps.append(fp)
                befores.append(left)
                afters.append(right)
                lines += [h.tobytes()] + [None] * (len(at) - 1)
            if ids:
                made = [pa.array(np.concatenate(ids)), pa.array(np.concatenate(ats), pa.int64()), pa.array(np.concatenate(fps).view(np.int64)), pa.concat_arrays(befores), pa.concat_arrays(afters), pa.array(lines, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "at", "fp", "before", "after", "lines"])

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, at long, fp long, before long, after long, lines binary")


def extended(rows: DataFrame) -> DataFrame:
    """(doc_id, start, end) in lines with a word: matches grown both ways over equal lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, at, first_doc, first_at, own, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "first_doc", "first_at", "own", "other")), strict=True):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                low, high = at, at + 1
                while low > 0 and first_at - (at - low) > 0 and a[low - 1] == b[first_at - (at - low) - 1]:
                    low -= 1
                while high < len(a) and first_at + high - at < len(b) and a[high] == b[first_at + high - at]:
                    high += 1
                ids.append(i)
                starts.append(low)
                ends.append(high)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start", "end"])

    return rows.mapInArrow(run, "doc_id long, start long, end long")


def kept(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, text) from texts and their runs as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            out: dict[str, list] = {"doc_id": batch.column("doc_id").to_pylist(), "n_lines": [], "n_removed": [], "n_runs": [], "text": []}
            for t, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                lines = t.split("\n") if t is not None else []
                full = [k for k, x in enumerate(lines) if has_word(x)]
                gone = np.zeros(len(full) + 1, bool)
                for r in runs or []:
                    gone[r["start"] : r["end"]] = True
                removed = {full[k] for k in np.flatnonzero(gone[:-1]).tolist()}
                out["n_lines"].append(len(full))
                out["n_removed"].append(len(removed))
                out["n_runs"].append(int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if full else 0)
                out["text"].append(None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in removed))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("text", pa.string())]))

    return docs.mapInArrow(run, "doc_id long, n_lines long, n_removed long, n_runs long, text string")


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, text) for every row of `docs`, text without the later runs.

    `words`: of so many words, runs of one and of two lines count too.
    """
    own = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = materialise(fingerprints(own, words), "fingerprints")
    again = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    # a side of a selected place is three lines, from the line before it or from its own; a short run is itself
    side = lambda n, at, line: F.struct(F.lit(n).alias("side"), at.alias("at"), line.alias("line"))
    sides = F.filter(F.array(side(1, F.col("at") - 1, F.col("before")), side(2, F.col("at"), F.col("after"))), lambda s: s["line"].isNotNull())
    sides = F.when(F.size(sides) > 0, sides).otherwise(F.array(side(0, F.col("at"), F.lit(0).cast("long"))))
    places = prints.select("doc_id", "at", "fp", "before", "after").join(again, "fp", "left_semi").select("doc_id", "fp", F.explode(sides).alias("s")).select("doc_id", "fp", "s.side", "s.line", "s.at")
    run = ["fp", "side", "line"]
    first = places.groupBy(*run).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*run, "first")
    later = places.join(first, run).where(F.struct("doc_id", "at") > F.col("first")).select("doc_id", "at", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"))
    # a match's places follow each other, and only the first of them is looked up
    key = [(F.col("at") - F.col("first_at")).alias("shift")]
    heads = later.select("doc_id", "first_doc", *key, "at").distinct()
    before = heads.select("doc_id", "first_doc", "shift", (F.col("at") + 1).alias("at"))
    heads = heads.join(before, ["doc_id", "first_doc", "shift", "at"], "left_anti").withColumn("first_at", F.col("at") - F.col("shift"))
    lines = prints.where("lines IS NOT NULL").groupBy("doc_id").agg(F.min("lines").alias("lines"))
    met = heads.join(lines.withColumnRenamed("lines", "own"), "doc_id").join(lines.select(F.col("doc_id").alias("first_doc"), F.col("lines").alias("other")), "first_doc")
    runs = extended(met.select("doc_id", "at", "first_doc", "first_at", "own", "other")).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    return kept(own.join(runs, "doc_id", "left").select("doc_id", "text", "runs"))


DUCKDB_SQL = """
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) k FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) p FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
w AS (SELECT r, doc_id, p, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o s FROM f WINDOW o AS (PARTITION BY r ORDER BY p)),
g AS (SELECT r, p FROM (SELECT r, p, doc_id, min({'d': doc_id, 'p': p}) OVER (PARTITION BY s) m FROM w WHERE s IS NOT NULL AND doc_id IS NOT NULL) WHERE {'d': doc_id, 'p': p} > m),
c AS (SELECT DISTINCT r, unnest([p, p + 1, p + 2]) p FROM g),
x AS (SELECT l.r, l.k, l.line, f.p IS NOT NULL filled, c.p IS NOT NULL gone, f.p FROM l LEFT JOIN f USING (r, k) LEFT JOIN c ON c.r = f.r AND c.p = f.p),
n AS (SELECT r, count(*) n_runs FROM (SELECT r, p FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.p = c.p - 1)) GROUP BY r)
SELECT d.doc_id, coalesce(sum(filled::INT), 0)::BIGINT n_lines, coalesce(sum(gone::INT), 0)::BIGINT n_removed, coalesce(any_value(n_runs), 0)::BIGINT n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) kept_sha256
FROM d JOIN x USING (r) LEFT JOIN n USING (r) GROUP BY d.r, d.doc_id"""

#: Words from which `PASSAGE_SQL` counts runs of one and of two lines.
PASSAGE = 50

PASSAGE_SQL = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) k FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) p, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) q FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
v AS (SELECT r, doc_id, p, line a, lead(line) OVER o b, lead(line, 2) OVER o c, q, lead(q) OVER o q2 FROM f WINDOW o AS (PARTITION BY r ORDER BY p)),
w AS (SELECT r, doc_id, p, 1 n, a s FROM v WHERE q >= {PASSAGE} UNION ALL SELECT r, doc_id, p, 2, a || chr(10) || b FROM v WHERE q + q2 >= {PASSAGE} UNION ALL SELECT r, doc_id, p, 3, a || chr(10) || b || chr(10) || c FROM v WHERE c IS NOT NULL),
g AS (SELECT r, p, n FROM (SELECT r, p, n, doc_id, min({{'d': doc_id, 'p': p}}) OVER (PARTITION BY s) m FROM w WHERE doc_id IS NOT NULL) WHERE {{'d': doc_id, 'p': p}} > m),
c AS (SELECT DISTINCT r, unnest(range(p, p + n)) p FROM g),
x AS (SELECT l.r, l.k, l.line, f.p IS NOT NULL filled, c.p IS NOT NULL gone, f.p FROM l LEFT JOIN f USING (r, k) LEFT JOIN c ON c.r = f.r AND c.p = f.p),
n AS (SELECT r, count(*) n_runs FROM (SELECT r, p FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.p = c.p - 1)) GROUP BY r)
SELECT d.doc_id, coalesce(sum(filled::INT), 0)::BIGINT n_lines, coalesce(sum(gone::INT), 0)::BIGINT n_removed, coalesce(any_value(n_runs), 0)::BIGINT n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) kept_sha256
FROM d JOIN x USING (r) LEFT JOIN n USING (r) GROUP BY d.r, d.doc_id"""
