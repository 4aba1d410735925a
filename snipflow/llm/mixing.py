"""Mix sources to target weights, hitting each budget by subset sums.

Every source has a target in words. Documents are counted by (source, exact
length); per source a share of each length is taken, and a bounded-knapsack
dynamic programme over the remaining lengths closes what is left of the budget
(a bit set of reachable sums, so a budget that lengths can reach is met
exactly). Which documents of a length are taken is decided by a seeded hash, so
reruns agree. A source whose target exceeds its size takes everything once and
the excess as second copies.

Scale: what is shuffled is one narrow row per document, the counts are summed
before the shuffle, and a length that holds a third of all documents is split
into ``parts`` hash ranges, each with a quota of its own. One task sees the
distinct lengths of one source, never its documents. The table of sources (one
row each) is ranked in one task; targets are found by aggregates over it.

Defined results: a null text has size 0; documents of size 0 take 0 words; a
null source is a source of its own, last in order; repeated rows are separate
documents; an empty table gives an empty table. Other columns stay aside.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from snipflow.llm.common import words_column
from snipflow.session import Scratch

WEIGHTS = (5, 2, 1)
SEED = 20250
PARTS = 64
EXACT_WORDS = 1 << 16


def fit_budget(sizes: list[int], counts: list[int], budget: int, exact: int = EXACT_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come as
    close below ``budget`` as the last ``exact`` words allow.

    A common share of every length goes first, single documents then bring the
    remainder under ``exact``, and a bounded knapsack closes it."""
    total = sum(s * c for s, c in zip(sizes, counts))
    budget = max(0, min(budget, total))
    if total == 0:
        return [0] * len(sizes)
    share = budget - min(budget, exact // 2)       # the rest stays open for the exact part
    take = [c * share // total if s else 0 for s, c in zip(sizes, counts)]
    left = budget - sum(s * t for s, t in zip(sizes, take))
    order = sorted((i for i, s in enumerate(sizes) if s), key=lambda i: (sizes[i] * 2654435761) % (1 << 32))
    while left > exact:
        before = left
        for i in order:
            if take[i] < counts[i] and sizes[i] <= left - exact:
                take[i] += 1
                left -= sizes[i]
        if left == before:
            break
    # Longest lengths first fill a gap that only they can; the rest is the knapsack.
    for i in sorted(order, key=lambda i: -sizes[i]):
        if left <= exact:
            break
        n = min(counts[i] - take[i], left // sizes[i], -(-(left - exact) // sizes[i]))
        take[i] += n
        left -= n * sizes[i]
    mask, reach, trail = (1 << (left + 1)) - 1, 1, []
    for i in order:
        spare = min(counts[i] - take[i], left // sizes[i])
        part = 1
        while spare > 0 and not reach >> left & 1:
            n = min(part, spare)
            spare -= n
            part *= 2
            trail.append((i, n, reach))
            reach |= (reach << (n * sizes[i])) & mask
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, n, before in reversed(trail):
        if not before >> at & 1:
            take[i] += n
            at -= n * sizes[i]
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    sizes, counts = pdf["size"].tolist(), pdf["n"].tolist()
    pdf["take"] = fit_budget(sizes, counts, int(pdf["budget"].iloc[0]))
    return pdf[["source", "size", "take"]]


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """Adds ``target`` to (source, source_size): weights by source order, null
    last, repeating; targets stop at ``limit`` times the size and the excess is
    shared anew by weight until none is above."""
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    src = sources.withColumn("weight", weight)
    cap, level = F.col("source_size") * float(limit), None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= cap
        row = src.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("used"),
                      F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        budget = share * float(row["all"] or 0) - float(row["used"] or 0)
        new = budget / row["open"] if row["open"] else level or 0.0
        if level is not None and new <= level:
            break
        level = new
    return src.select("source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = 1.5, limit: int = 2, seed: int = SEED,
                parts: int = PARTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies,
    taken (= copies x size), and the columns in ``keep``."""
    scratch = Scratch(df.sparkSession, "mix")
    others = [c for c in keep if c not in ("doc_id", "source")]
    docs = scratch.save(df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.size(words_column(F.col(text_col))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), *others)
        .withColumn("part", F.pmod(F.col("h"), F.lit(parts)).cast("int")), "docs")
    by_part = scratch.save(docs.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    targets = scratch.save(source_targets(
        by_part.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")),
        weights, share, limit), "targets")
    per_size = by_part.groupBy("source", "size").agg(F.sum("n").alias("n"))
    t = targets.withColumnRenamed("source", "s")
    over = F.col("target") >= F.col("source_size")
    budget = F.floor(F.when(over, F.col("target") - F.col("source_size")).otherwise(F.col("target")) + 0.5)
    takes = (per_size.join(t, F.col("source").eqNullSafe(F.col("s")))
             .select("source", "size", "n", budget.alias("budget"))
             .groupBy("source").applyInPandas(_fit_source, "source string, size bigint, take bigint"))
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("n")
    tk = takes.select(F.col("source").alias("s"), F.col("size").alias("z"), "take")
    quota = (by_part.withColumn("before", before)
             .join(tk, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
             .select(F.col("source").alias("qs"), F.col("size").alias("qz"), F.col("part").alias("qp"),
                     F.greatest(F.lit(0), F.least("n", F.col("take") - F.col("before"))).alias("quota")))
    quota = scratch.save(quota, "quota")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    out = (docs.withColumn("rank", rank)
           .join(quota, F.col("source").eqNullSafe(F.col("qs")) & (F.col("size") == F.col("qz"))
                 & (F.col("part") == F.col("qp")))
           .join(t, F.col("source").eqNullSafe(F.col("s")))
           .withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(
               over.cast("int") + (F.col("rank") <= F.col("quota")).cast("int")).cast("long")))
    out = scratch.save(out.select("doc_id", "source", *others, "size", "source_size", "target", "copies",
                                  (F.col("copies") * F.col("size")).alias("taken")), "out")
    scratch.drop("docs", "counts", "targets", "quota")
    return out
