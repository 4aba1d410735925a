"""Quality rules learned as a decision list, in Spark expressions throughout.

Statistics of every text are computed by built-in functions. From labelled rows,
sequential covering learns rules: a rule grows by the threshold condition of
best information gain, is pruned back on rows kept apart for that, and is kept
if its precision there is high enough; the rows it covers leave, and the next
rule is grown. The list becomes one ordered ``CASE WHEN``. Growing needs, per
condition, the counts of each feature's bins only: one aggregate over narrow
rows, of fixed result size. No Python runs on the executors.

Words are ``[^\\x20\\x09-\\x0D]+``; equal 5-word windows are found by 64-bit
hashes of their words' 64-bit hashes, within one text.

Defined results: null and empty texts have zero statistics and fail the base
rule; without labelled rows of both classes the list is empty and the verdict
is "keep"; labels with null ids or classes are not used; repeated rows are
separate rows. Other columns pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from snipflow.llm.common import words_column
from snipflow.session import Scratch

SYMBOLS = r"[^#*$%&|<>]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BINS = 24
MIN_PRECISION = 0.9
MIN_COVER = 10
MAX_RULES = 6
MAX_CONDITIONS = 3


def text_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts in ``COUNTS`` plus n_chars, n_lines, n_distinct_words,
    n_digits, n_upper, n_stops; drops the text."""
    rest = [c for c in df.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def left(pattern):  # characters outside the class in the pattern are removed
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    a = df.select(*rest, words_column(F.col(text_col)).alias("w"), lines.alias("l"),
                  left(SYMBOLS).alias("n_symbols"), F.length(text).cast("long").alias("s_chars"),
                  left(r"[^0-9]+").alias("s_digits"), left(r"[^A-Z]+").alias("s_upper"),
                  left(r"[^.!?]+").alias("s_stops"))
    own = ["n_symbols", "s_chars", "s_digits", "s_upper", "s_stops"]
    b = a.select(*rest, *own, F.size("w").cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.size("l").cast("long").alias("s_lines"),
                 (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
                 F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    own += ["n_words", "word_chars", "s_lines", "n_dup_lines"]
    h = F.col("h")
    window = F.transform(F.sequence(F.lit(0), F.size(h) - 5),
                         lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
    c = b.select(*rest, *own, F.size(F.array_distinct("h")).cast("long").alias("s_distinct_words"),
                 F.when(F.size(h) >= 5, window).alias("v"))
    own += ["s_distinct_words"]
    v = F.col("v")
    d = c.select(*rest, *own, F.when(F.size(F.array_distinct(v)) < F.size(v), F.sort_array(
        F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    s = F.col("s")
    e = d.select(*rest, *own, F.sort_array(F.transform(
        F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
        lambda x: x["i"])).alias("p"))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))),
                          F.lit(0), lambda acc, x: acc + x)
    return e.select(*rest, *own, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def features() -> dict[str, Column]:
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "s_chars"),
        "dup_line_ratio": _ratio("n_dup_lines", "s_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "distinct_ratio": _ratio("s_distinct_words", "n_words"),
        "digit_ratio": _ratio("s_digits", "s_chars"),
        "upper_ratio": _ratio("s_upper", "s_chars"),
        "stop_ratio": _ratio("s_stops", "n_words"),
        "line_words": _ratio("n_words", "s_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _entropy_gain(p, n, p0, n0):
    if p == 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


class DecisionList:
    """Ordered rules; each is a list of (feature, ">=" or "<", threshold)."""

    def __init__(self, rules):
        self.rules = rules

    def expression(self) -> Column:
        """Number of the first rule that holds, 0 if none does."""
        feats, out = features(), None
        for k, rule in enumerate(self.rules, 1):
            hold = F.lit(True)
            for name, op, x in rule:
                hold = hold & (feats[name] >= x if op == ">=" else feats[name] < x)
            out = F.when(hold, F.lit(k)) if out is None else out.when(hold, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def describe(self) -> list[str]:
        return [" AND ".join(f"{n} {o} {x:.6g}" for n, o, x in r) for r in self.rules]


def learn(labelled: DataFrame, bad: str = "bad", fold: str = "fold", bins: int = BINS,
          min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER,
          max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> DecisionList:
    """Learn rules for rows with ``bad`` = 1 from statistics; ``fold`` = 0 rows prune.

    Thresholds are quantiles of each feature among all labelled rows and among
    the bad ones. The driver sees quantiles and bin counts only."""
    scratch = Scratch(labelled.sparkSession, "rules")
    feats = features()
    rows = scratch.save(labelled.select(F.col(bad).cast("int").alias("y"), F.col(fold).cast("int").alias("f"),
                                        *[c.alias(n) for n, c in feats.items()]), "rows")
    grid = [i / bins for i in range(1, bins)]
    q = rows.agg(*[F.percentile_approx(n, grid, 10000).alias(f"a_{n}") for n in feats],
                 *[F.percentile_approx(F.when(F.col("y") == 1, F.col(n)), grid, 10000).alias(f"b_{n}") for n in feats]).first()
    cuts = {n: sorted(set((q[f"a_{n}"] or []) + (q[f"b_{n}"] or []))) for n in feats}

    def bin_of(n):      # number of thresholds at or below the value
        return F.size(F.filter(F.lit(cuts[n]) if cuts[n] else F.array().cast("array<double>"), lambda t: t <= F.col(n)))

    binned = scratch.save(rows.select("y", "f", *[bin_of(n).alias(n) for n in feats]), "binned")

    def holds(rule):
        out = F.lit(True)
        for n, op, k in rule:
            out = out & (F.col(n) >= k if op == ">=" else F.col(n) < k)
        return out

    def best(frame, rule):
        """Condition of highest gain: from the counts of each feature's bins."""
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("b")) for n in feats])).alias("c")
        got = (frame.where(holds(rule)).select("y", pairs).groupBy("c.n", "c.b")
               .agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).collect())
        table = {n: {} for n in feats}
        for r in got:
            table[r["n"]][r["b"]] = (r["p"], r["q"])
        any_feature = next(iter(feats))
        p0, n0 = (sum(v[i] for v in table[any_feature].values()) for i in (0, 1))
        if p0 == 0 or n0 == 0:
            return None
        top = (1e-9, None)
        for n in sorted(feats):
            below = [0, 0]
            for k in range(1, len(cuts[n]) + 1):       # bin >= k means value >= cuts[k - 1]
                x = table[n].get(k - 1, (0, 0))
                below = [below[0] + x[0], below[1] + x[1]]
                for op, (p, m) in (("<", below), (">=", (p0 - below[0], n0 - below[1]))):
                    if p >= min_cover:
                        top = max(top, (_entropy_gain(p, m, p0, n0), (n, op, k)), key=lambda t: t[0])
        return top[1]

    rules, gone = [], F.lit(False)
    while len(rules) < max_rules:
        left = binned.where(~gone)
        grow, rule = left.where("f <> 0"), []
        while len(rule) < max_conditions:
            cond = best(grow, rule)
            if cond is None or cond in rule:
                break
            rule = [*rule, cond]
        if not rule:
            break
        cols = []
        for k in range(1, len(rule) + 1):
            cols += [F.sum(F.when(holds(rule[:k]), F.col("y"))).alias(f"p{k}"),
                     F.sum(F.when(holds(rule[:k]), 1 - F.col("y"))).alias(f"q{k}")]
        r = left.where("f = 0").agg(*cols).first()
        scored = [((p := r[f"p{k}"] or 0), (m := r[f"q{k}"] or 0), (p - m) / (p + m) if p + m else -1.0, k)
                  for k in range(1, len(rule) + 1)]
        p, m, _, k = max(scored, key=lambda t: (t[2], -t[3]))
        if p * 3 < min_cover or (p + 1) / (p + m + 2) < min_precision and p < min_precision * (p + m):
            break
        rules.append(rule[:k])
        gone = gone | holds(rule[:k])
    scratch.drop()
    return DecisionList([[(n, op, cuts[n][k - 1]) for n, op, k in rule] for rule in rules])


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", **options) -> tuple[DataFrame, DecisionList]:
    """Statistics, ``base_failed``, ``rule`` (first that fires, 0 if none) and
    ``kept`` of every row, and the list learned from the labelled rows."""
    scratch = Scratch(df.sparkSession, "quality-rules")
    stats = scratch.save(text_statistics(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "stats")
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("label IS NOT NULL")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    known = (stats.join(marked, "doc_id").where(~base_failed())
             .withColumn("bad", (F.col("label") == 0).cast("int")).withColumn("fold", fold))
    rules = learn(known, **options)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.expression().cast("int"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return out, rules
