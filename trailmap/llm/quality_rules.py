"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1) or bad (0), or abstains (null). Votes are counted by pattern, at
most 3 ** 8 of them whatever the corpus. Expectation-maximisation over the patterns
estimates how often each rule is right on good and on bad texts and how many texts are
good; it runs as one fold over an array of one row. A text's posterior probability of
being good then decides instead of all rules having to pass.

Defined cases: a null or empty text has no words, fails the base rules and gets no vote
that needs words; repeated rows and null ids are rows like others; an empty table gives an
empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, materialise, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_ended_lines", "n_capitals", "n_digits")


@dataclass(frozen=True)
class Rule:
    """`good` and `bad` are SQL conditions over BASE and MORE; neither holding means no vote."""

    name: str
    good: str
    bad: str


#: Whole-number conditions, so that every engine decides alike.
RULES = (
    Rule("length", "n_words >= 80", "n_words < 50"),
    Rule("word_length", "n_words > 0 AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)"),
    Rule("symbols", "n_words > 0 AND 100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 2 AND n_dup_lines = 0", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "n_words >= 50 AND 20 * n_repeat_words <= n_words", "n_words >= 10 AND 4 * n_repeat_words > n_words"),
    Rule("line_ends", "n_lines > 0 AND 10 * n_ended_lines >= 7 * n_lines", "n_lines >= 2 AND 5 * n_ended_lines < n_lines"),
    Rule("capitals", "n_words > 0 AND 10 * n_capitals <= word_chars", "3 * n_capitals > word_chars"),
    Rule("digits", "n_words > 0 AND 50 * n_digits <= word_chars", "5 * n_digits > word_chars"),
)

ROUNDS, START_PRIOR, START_RIGHT, SMOOTH = 20, 0.7, 0.8, 1.0
#: Posterior from which a text is kept.
KEEP_FROM = 0.5
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts that the rules use, a row per row of `docs`; no shuffle, and linear in a text but for one sort.

    n_repeat_words: windows of three words are hashed and sorted with their places; those
    with an equal neighbour repeat, and the words that they cover are counted.
    """
    body, hidden = F.coalesce(F.col(text), F.lit("")), lambda c: f"__{c}"
    out = docs.select(*[F.col(c) for c in keep], words(F.col(text)).alias(hidden("w")), body.alias(hidden("t")))
    w, t = F.col(hidden("w")), F.col(hidden("t"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)"))
    out = out.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("n_digits"),
        lines.alias(hidden("lines")),
        F.sort_array(windows).alias(hidden("s")),
    )
    s, lines = F.col(hidden("s")), F.col(hidden("lines"))
    twice = lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])
    out = out.select(
        *keep,
        *[c for c in (*BASE, *MORE) if c not in ("n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines")],
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("[.!?][ \\t-\\r]*$"))).cast("long").alias("n_ended_lines"),
        F.sort_array(F.filter(F.transform(s, twice), lambda x: x.isNotNull())).alias(hidden("at")),
    )
    at = F.col(hidden("at"))
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return out.select(*keep, *[c for c in (*BASE, *MORE) if c != "n_repeat_words"], covered.cast("long").alias("n_repeat_words"))


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.good), F.lit(1)).when(F.expr(rule.bad), F.lit(0))


def pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    """A text's votes as a string, a character for each rule: 1, 0 or - for none."""
    return F.concat(*[F.coalesce(vote(r).cast("string"), F.lit("-")) for r in rules])


def posteriors(counts: DataFrame, n_rules: int = len(RULES), rounds: int = ROUNDS) -> DataFrame:
    """Posterior probability of `good` for each (pattern, n): Dawid and Skene's model for two classes.

    A rule that abstains says nothing. The parameters are the share of good texts and, for
    each rule, the chance of a right vote on good and on bad texts, smoothed by SMOOTH.
    """
    one = counts.agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("ps"))
    js = range(n_rules)
    start = f"named_struct('pi', {START_PRIOR}D, 'a', array_repeat({START_RIGHT}D, {n_rules}), 'b', array_repeat({START_RIGHT}D, {n_rules}))"
    # log odds of good under parameters m for a pattern x
    odds = lambda m, x: " + ".join([f"ln({m}.pi / (1 - {m}.pi))", *[f"CASE substr({x}, {j + 1}, 1) WHEN '1' THEN ln({m}.a[{j}] / (1 - {m}.b[{j}])) WHEN '0' THEN ln((1 - {m}.a[{j}]) / {m}.b[{j}]) ELSE 0D END" for j in js]])
    rated = f"transform(ps, p -> named_struct('x', p.pattern, 'g', p.n / (1 + exp(-({odds('m', 'p.pattern')}))), 'n', double(p.n)))"
    total = lambda what: f"aggregate(e, 0D, (s, q) -> s + {what})"
    rate = lambda j, v, w: f"({total(f"CASE WHEN substr(q.x, {j + 1}, 1) = '{v}' THEN {w} ELSE 0D END")} + {SMOOTH}D) / ({total(f"CASE WHEN substr(q.x, {j + 1}, 1) <> '-' THEN {w} ELSE 0D END")} + {2 * SMOOTH}D)"
    fitted = f"named_struct('pi', ({total('q.g')} + {SMOOTH}D) / ({total('q.n')} + {2 * SMOOTH}D), 'a', array({', '.join(rate(j, 1, 'q.g') for j in js)}), 'b', array({', '.join(rate(j, 0, '(q.n - q.g)') for j in js)}))"
    model = one.select("ps", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (m, r) -> element_at(transform(array({rated}), e -> {fitted}), 1))").alias("m"))
    return model.select(F.explode("ps").alias("p"), "m").select(F.col("p.pattern").alias("pattern"), F.expr(f"1 / (1 + exp(-({odds('m', 'p.pattern')})))").alias("p_good"))


def quality(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`keep`, the counts, base_failed, p_good and kept for every row of `docs`.

    The counts are written once (a few numbers a row) and used twice: for the patterns and
    for the verdicts. The pattern table has at most 3 ** len(rules) rows, so it may be broadcast.
    """
    rows = materialise(features(docs, text, keep).withColumn("pattern", pattern(rules)), "quality")
    rated = posteriors(rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), len(rules))
    failed = F.expr(BASE_FAILED)
    return rows.join(F.broadcast(rated), "pattern").select(*keep, *BASE, *MORE, failed.alias("base_failed"), "p_good", (~failed & (F.col("p_good") >= KEEP_FROM)).alias("kept"))


def duckdb_sql(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB: a common table expression for each round."""
    n = len(rules)
    gap = "[ \\t\\n\\x0B\\f\\r]"
    vote = lambda r: f"CASE WHEN {r.good} THEN '1' WHEN {r.bad} THEN '0' ELSE '-' END"
    odds = lambda x: " + ".join(["ln(m.pi / (1 - m.pi))", *[f"CASE substr({x}, {j + 1}, 1) WHEN '1' THEN ln(m.a{j} / (1 - m.b{j})) WHEN '0' THEN ln((1 - m.a{j}) / m.b{j}) ELSE 0 END" for j in range(n)]])
    rate = lambda j, v, w: f"(sum(CASE WHEN substr(pattern, {j + 1}, 1) = '{v}' THEN {w} ELSE 0 END) + {SMOOTH}) / (sum(CASE WHEN substr(pattern, {j + 1}, 1) <> '-' THEN {w} ELSE 0 END) + {2 * SMOOTH})"
    steps = [f"m0 AS (SELECT {START_PRIOR}::DOUBLE pi, " + ", ".join(f"{START_RIGHT}::DOUBLE a{j}, {START_RIGHT}::DOUBLE b{j}" for j in range(n)) + ")"]
    for i in range(rounds):
        steps.append(f"e{i} AS (SELECT pattern, n::DOUBLE n, n / (1 + exp(-({odds('pattern')}))) g FROM ps, m{i} m)")
        steps.append(f"m{i + 1} AS (SELECT (sum(g) + {SMOOTH}) / (sum(n) + {2 * SMOOTH}) pi, " + ", ".join(f"{rate(j, 1, 'g')} a{j}, {rate(j, 0, '(n - g)')} b{j}" for j in range(n)) + f" FROM e{i})")
    return f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{gap}+'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) ls FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) p FROM again) GROUP BY r),
f AS (SELECT w.r, doc_id, len(w)::BIGINT n_words, length(list_aggregate(list_concat([''], w), 'string_agg', ''))::BIGINT word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT n_capitals, length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT n_digits,
  len(ls)::BIGINT n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, len(list_filter(ls, lambda x: regexp_matches(x, '[.!?]{gap}*$')))::BIGINT n_ended_lines, coalesce(n_repeat_words, 0)::BIGINT n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
v AS (SELECT *, {" || ".join(vote(r) for r in rules)} pattern FROM f),
ps AS (SELECT pattern, count(*) n FROM v GROUP BY pattern),
{", ".join(steps)},
q AS (SELECT pattern, 1 / (1 + exp(-({odds('pattern')}))) p_good FROM ps, m{rounds} m)
SELECT doc_id, {", ".join(BASE)}, ({BASE_FAILED}) base_failed, (NOT ({BASE_FAILED}) AND p_good >= {KEEP_FROM}) kept FROM v JOIN q USING (pattern)"""
