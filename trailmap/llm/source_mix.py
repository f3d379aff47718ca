"""Mixing sources to target weights by fitting each source's budget exactly.

A source's budget is so many whole passes over its documents and a rest. Its documents are
counted by exact size. The rest is spread over sizes in proportion, longest first with the
error carried on, but for some documents' worth, and what is then open is made up of left
documents by dynamic programming over a bounded knapsack. Documents are chosen within a
size by a seeded hash, as many as planned.

Defined cases: a null or empty text has size 0 and nothing is taken of it; null is a
source like others, the last; rows that repeat are documents of their own (which of equal
rows is taken makes no difference); an empty table gives an empty result; further columns
of the input are not looked at. There must be few enough sources for the driver to hold a
row for each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, words

WEIGHTS, MOST_PASSES, SEED = (1, 2, 3), 3, 11
#: Parts into which documents of one source and size are dealt to be ranked.
PARTS = 64
#: Times the longest document that is left to dynamic programming.
RESERVE = 4


def targets(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Shares of the sum of sizes by weight; none above `most` times its size, the excess shared out again."""
    goal, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                goal[i] = left * weights[i] / total
            break
        for i in over:
            goal[i] = float(most * sizes[i])
        left -= sum(goal[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return goal


def fitted(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each size sum up to `budget`, or as near below it as can be."""
    total = sum(s * n for s, n in counts.items())
    spread = max(0, budget - RESERVE * max(counts, default=0))
    taken, seen, used = {}, 0, 0
    for s in sorted((s for s in counts if s > 0), reverse=True):
        seen += s * counts[s]
        wanted = spread * seen // total if total else 0
        taken[s] = max(0, min(counts[s], (wanted - used) // s))
        used += s * taken[s]
    rest = budget - used
    left = [(s, min(counts[s] - taken[s], rest // s)) for s in sorted(taken, reverse=True) if s <= rest]
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for s, n in left:  # bit b of `reach`: sizes so far can sum up to b
        k = 1
        while n > 0 and not reach >> rest & 1:
            m = min(k, n)
            steps.append((s, m, reach))
            reach |= reach << (s * m) & mask
            n, k = n - m, 2 * k
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for s, m, before in reversed(steps):
        if not before >> at & 1:
            at -= s * m
            taken[s] += m
    return taken


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and `keep` for every row of `docs`.

    `taken` is a multiple of the size: in how many passes the document is used. Sizes are
    written once; the driver gets a row for each source, a task the sizes of one source.
    """
    spark = docs.sparkSession
    rows = materialise(docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("__source"), F.size(words(F.col(text))).cast("long").alias("size"), *keep), "sizes")
    by_size = rows.groupBy("__source", "size").agg(F.count(F.lit(1)).alias("n"))
    found = sorted(by_size.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect(), key=lambda r: (r["__source"] is None, (r["__source"] or "").encode("utf-8", "surrogatepass")))
    goals = targets([r["total"] for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    plan = []
    for i, (r, goal) in enumerate(zip(found, goals, strict=True)):
        passes = min(most, int(goal // r["total"])) if r["total"] else 0
        plan.append((i, r["__source"], r["total"], goal, passes, max(0, round(goal) - passes * r["total"]) if passes < most else 0))
    listed = F.broadcast(spark.createDataFrame(plan, "s int, __name string, source_size long, target double, passes int, budget long"))
    placed = rows.join(listed, F.col("__source").eqNullSafe(F.col("__name"))).drop("__source", "__name")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = fitted(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"s": pdf["s"].iloc[0], "size": list(taken), "chosen": list(taken.values())})

    hashed = placed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    parts = hashed.groupBy("s", "size", "budget", "part").agg(F.count(F.lit(1)).alias("n"))
    chosen = parts.groupBy("s", "size", "budget").agg(F.sum("n").alias("n")).groupBy("s").applyInPandas(fit, "s int, size long, chosen long")
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("s", "size", "part", "before")
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("s", "size", "part").orderBy("h", "doc_id")))
    out = ranked.join(before, ["s", "size", "part"]).join(chosen, ["s", "size"], "left")
    extra = (F.col("before") + F.col("rank") <= F.coalesce("chosen", F.lit(0))).cast("long")
    return out.select(F.col("doc_id").alias(ident), "size", "source_size", "target", (F.col("size") * (F.col("passes") + extra)).alias("taken"), *keep)
