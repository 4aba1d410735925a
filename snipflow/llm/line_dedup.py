"""Boilerplate lines by their frequency on one site.

For each host, the number of its pages that hold a line is divided by the
number of the host's pages; lines above ``max_ratio`` that at least
``min_pages`` pages of the host hold are boilerplate and leave every page of
that host. Lines are compared as they stand; lines without a word are never
boilerplate. A line counts once a page.

Only 128-bit line hashes are shuffled, never the lines: one row per page and
distinct line, summed per map task first, so a line on a third of all pages is
as cheap as any other. Pages whose text does not change never meet a join on
their text's content: the dropped hashes come back per page id.

Defined results: null hosts form one host of their own; null texts stay null
and count as a page; empty texts stay; a text that loses all its lines becomes
empty. Rows with repeated ids are told apart by their whole row. An empty table
gives an empty table. Columns of other names pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_RATIO = 0.1
MIN_PAGES = 5


def _line_hash(line):
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate_lines(df: DataFrame, text_col: str = "text", host_col: str = "source",
                      max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line hash a, b, pages, host_pages) of every boilerplate line."""
    pages = df.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = (pages.where("text IS NOT NULL")
            .select("host", F.explode(F.array_distinct(lines)).alias("line"))
            .select("host", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), F.col("line")).alias("b"))
            .groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("pages"))
            .where(F.col("pages") >= min_pages))
    return (held.join(totals, held.host.eqNullSafe(totals.host))
            .where(F.col("pages") > F.lit(max_ratio) * F.col("host_pages"))
            .select(held.host, "a", "b", "pages", "host_pages"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``df`` with boilerplate lines taken out of its text; adds ``n_lines`` and
    ``n_dropped`` (names of the input win, the counts then end in ``_``)."""
    found = boilerplate_lines(df, text_col, host_col, max_ratio, min_pages).select("host", "a", "b")
    split = F.split(F.col(text_col), "\n", -1)
    lines = (df.where(F.col(text_col).isNotNull())
             .select(F.col(id_col).alias("id"), F.col(host_col).alias("host"),
                     F.explode(F.array_distinct(split)).alias("line"))
             .select("id", "host", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), F.col("line")).alias("b")))
    # What a page loses depends on its host alone, so a repeated id does no harm.
    drops = (lines.alias("l").join(found.alias("f"), F.expr("l.a = f.a AND l.b = f.b AND l.host <=> f.host"))
             .groupBy("l.id", "l.host").agg(F.collect_set(F.struct("l.a", "l.b")).alias("drop"))
             .select(F.col("id").alias("__id"), F.col("host").alias("__host"), F.col("drop").alias("__drop")))
    joined = df.join(drops, F.col(id_col).eqNullSafe(F.col("__id")) & F.col(host_col).eqNullSafe(F.col("__host")), "left")
    kept = F.filter(split, lambda x: ~F.array_contains(F.col("__drop"), _line_hash(x)))
    names = [c if c not in df.columns else c + "_" for c in ("n_lines", "n_dropped")]
    joined = joined.withColumn("__kept", F.when(F.col("__drop").isNotNull(), kept))
    total = F.coalesce(F.size(split), F.lit(0))
    return joined.select(
        *[F.coalesce(F.array_join("__kept", "\n"), F.col(c)).alias(c) if c == text_col else F.col(c) for c in df.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(total).cast("long").alias(names[0]),
        F.when(F.col("__kept").isNull(), 0).otherwise(total - F.size("__kept")).cast("long").alias(names[1]))
