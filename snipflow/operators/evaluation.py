"""Dataset summaries, stratified splits/folds and classifier evaluation.

Everything is an aggregate over (label, prediction) pairs, so the work is a
partial aggregation plus tiny per-class tables. Exact per-class ranks (for
stratified splits and folds) are computed without a per-class window, which
would put a dominant class into one task: rows are cut into key slices, the
rank is local to (class, slice) and shifted by the counts of earlier slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snipflow.schemas import FEATURE_NAMES

def class_labels(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct labels (one per class), for the wide confusion matrix, whose
    columns they are."""
    return sorted(r[0] for r in df.select(col).distinct().collect() if r[0] is not None)


# ------------------------------------------------------------------ M1 -----
def dataset_summary(df: DataFrame, label: str = "label") -> DataFrame:
    feats = [c for c in df.columns if c in FEATURE_NAMES]
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(feats)).alias("n_features"),
                  F.count_distinct(label).alias("n_classes"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Class sizes, largest first (ties by label) — a sort of a per-class table."""
    return (df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "label"))


# ------------------------------------------------------- exact group rank --
def group_rank(df: DataFrame, group: str, key: str, tiebreak: list[str],
               key_range: int = 2**31, n_slices: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by group order by key, tiebreak)``.

    ``key`` must be spread over ``[0, key_range)`` (a hash). Rows are cut into
    ``n_slices`` key slices; ranks are local to (group, slice) and offset by
    the row counts of the earlier slices of the group, so no task holds more
    than about 1/n_slices of a class. By default the slice count follows the
    session's shuffle partitions (a cluster sized for its data), at least 64;
    the offsets table is classes x slices rows.
    """
    if n_slices is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        n_slices = max(64, 2 * parts)
    sl = F.least(F.floor(F.col(key) * n_slices / key_range), F.lit(n_slices - 1)).cast("int")
    d = df.withColumn("_slice", sl)
    counts = d.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(group).orderBy("_slice")
         .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, "_slice",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(group)).alias("group_n"))
    lw = Window.partitionBy(group, "_slice").orderBy(key, *tiebreak)
    local = d.withColumn("_lr", F.row_number().over(lw))
    return (local.join(offsets, [group, "_slice"])
            .withColumn("group_rank", F.col("_offset") + F.col("_lr"))
            .drop("_slice", "_lr", "_offset"))


def stratified_split(df: DataFrame, key: str, tiebreak: list[str], label: str = "label",
                     test_fraction: float = 0.2) -> DataFrame:
    """M2: per class the first ceil(fraction * n) rows by key are the test rows."""
    r = group_rank(df, label, key, tiebreak)
    is_test = F.col("group_rank") <= F.ceil(F.col("group_n") * F.lit(test_fraction))
    return r.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("group_rank",
                                                                               "group_n")


def stratified_folds(df: DataFrame, key: str, tiebreak: list[str], label: str = "label",
                     k: int = 3) -> DataFrame:
    """fold = (rank - 1) mod k within each class."""
    r = group_rank(df, label, key, tiebreak)
    return r.withColumn("fold", F.pmod(F.col("group_rank") - 1, F.lit(k)).cast("int")) \
        .drop("group_rank", "group_n")


def group_split(df: DataFrame, group: str, key: str, label: str = "label",
                test_fraction: float = 0.2) -> DataFrame:
    """Group-aware stratified split (next to M2): whole groups (e.g. all
    renderings of one template) go to one side, so no group leaks across the
    split. Per class, the first ceil(fraction * groups) groups by ``key`` are
    test groups. Ranks are over the distinct (class, group) pairs — a small
    table — joined back by broadcast-free equi-join."""
    groups = df.select(label, group, key).distinct()
    r = group_rank(groups, label, key, [group])
    is_test = F.col("group_rank") <= F.ceil(F.col("group_n") * F.lit(test_fraction))
    sides = r.select(label, group, F.when(is_test, "test").otherwise("train").alias("split"))
    return df.join(sides, [label, group])


SHARE_UNITS = 100_000


def nearest_groups(sizes: list[int], share: float) -> list[bool]:
    """Which groups to take so that their sizes sum nearest to ``share`` of all (the
    smaller sum if two are as near), earlier groups first among equal sums.

    A subset sum by reachable totals: bit ``s`` of ``reach[i]`` says that groups from
    ``i`` on can make ``s``. Sizes count in units of 1 / SHARE_UNITS of the total
    (exactly, for fewer rows than that). With two groups or more, neither side is empty."""
    total = sum(sizes)
    unit = max(1, total // SHARE_UNITS)
    size = [round(x / unit) for x in sizes]
    reach = [1]
    for x in reversed(size):
        reach.append(reach[-1] | reach[-1] << x)
    reach.reverse()
    full, want = sum(size), share * sum(size)
    sums = [s for s in range(full + 1) if reach[0] >> s & 1 and (len(size) < 2 or 0 < s < full)]
    left = min(sums, key=lambda s: (round(abs(s - want), 6), s), default=0)
    taken = []
    for i, x in enumerate(size):
        taken.append(bool(left >= x and reach[i + 1] >> (left - x) & 1))
        left -= x if taken[-1] else 0
    return taken


def group_split_by_rows(df: DataFrame, group: str, label: str = "label", test_fraction: float = 0.2) -> DataFrame:
    """Whole groups go to one side, chosen per class so that the *rows* of the test
    side come nearest to the fraction. The choice sees one row per (class, group)."""
    sizes = df.groupBy(F.col(label).alias("cls"), F.col(group).cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("n"))

    def choose(pdf):
        pdf = pdf.sort_values("grp")
        pdf["split"] = ["test" if t else "train" for t in nearest_groups([int(x) for x in pdf["n"]], test_fraction)]
        return pdf[["cls", "grp", "split"]]

    sides = sizes.groupBy("cls").applyInPandas(choose, f"cls {df.schema[label].dataType.simpleString()}, grp long, split string")
    return (df.join(sides, df[label].eqNullSafe(sides["cls"]) & df[group].cast("long").eqNullSafe(sides["grp"])).drop("cls", "grp"))


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """M3: balanced weights n / (k * n_c), from the training rows only."""
    c = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()  # one row per class
    return c.select("label", "n_c",
                    (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                    .alias("weight"))


def with_class_weight(train: DataFrame, label: str = "label") -> DataFrame:
    """Attach ``weight`` to every training row (per-class table joined back)."""
    return train.join(class_weights(train, label).select(F.col("label").alias(label), "weight"),
                      label)


# ---------------------------------------------------------- M6 / M7 -------
def confidence(prob: Column) -> Column:
    """M6: max class probability rounded to 4."""
    return F.round(F.array_max(prob), 4)


def accuracy(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    hit = (F.col(y) == F.col(p)).cast("int")
    return pred.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"),
                    F.round(F.avg(hit), 6).alias("accuracy"))


# --------------------------------------------------------------- M8 -------
def classification_report(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Per-class precision/recall/f1/support over the union of true and
    predicted classes (zero division -> 0), then accuracy, macro and weighted
    average rows."""
    true_c = pred.groupBy(F.col(y).alias("cls")).agg(
        F.count(F.lit(1)).alias("support"),
        F.sum((F.col(y) == F.col(p)).cast("long")).alias("tp"))
    pred_c = pred.groupBy(F.col(p).alias("cls")).agg(F.count(F.lit(1)).alias("n_pred"))
    per = true_c.join(pred_c, "cls", "full_outer").select(
        "cls",
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("n_pred", F.lit(0)).alias("n_pred"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1_score", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                            F.col("precision") + F.col("recall")), F.lit(0.0)))
    rows = per.select(F.col("cls").alias("class"), "precision", "recall", "f1_score",
                      F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    summary = per.agg(
        tot.alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / tot).alias("wf"))
    acc = summary.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"),
                         (F.col("tp") / F.col("n")).alias("f1_score"), F.col("n").cast("long").alias("support"))
    macro = summary.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                           F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                           F.col("n").cast("long").alias("support"))
    weighted = summary.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                              F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                              F.col("n").cast("long").alias("support"))
    out = rows.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")],
                      "support")


# --------------------------------------------------------------- M9 -------
def confusion_wide(pred: DataFrame, y: str = "y", p: str = "pred",
                   labels: list[str] | None = None) -> DataFrame:
    """Rows = true label, one column per label (sorted labels of y), zeros dense.
    Predictions outside the label list are not counted."""
    labels = labels if labels is not None else class_labels(pred, y)
    counts = pred.where(F.col(p).isin(labels)).groupBy(F.col(y).alias("true_label"), F.col(p).alias("_p")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    wide = counts.groupBy("true_label").pivot("_p", labels).agg(F.first("_n"))
    # every true label that exists gets a row (y values are the labels)
    base = pred.select(F.col(y).alias("true_label")).distinct()
    return base.join(wide, "true_label", "left").fillna(0, subset=labels)


def confusion_long(pred: DataFrame, y: str = "y", p: str = "pred",
                   labels: list[str] | None = None) -> DataFrame:
    """(true_label, pred_label, n) of every pair of a true label and a label, zeros
    included; labels are data here, so any string may be one."""
    counts = (pred.groupBy(F.col(y).alias("_t"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")))
    true = counts.where("_t IS NOT NULL").select(F.col("_t").alias("true_label")).distinct()
    if labels is None:
        listed = true.agg(F.collect_list("true_label").alias("_l"))
    else:
        listed = true.limit(1).select(F.array(*[F.lit(x) for x in labels]).alias("_l"))
    # the result has a row per pair by definition: classes x classes, not rows x rows
    pairs = true.join(F.broadcast(listed)).select("true_label", F.explode("_l").alias("pred_label"))
    return (pairs.join(counts, (F.col("true_label") == F.col("_t")) & (F.col("pred_label") == F.col("_p")), "left")
            .select("true_label", "pred_label", F.coalesce("_n", F.lit(0)).cast("long").alias("n")))


# -------------------------------------------------------------- M12 -------
def cv_accuracy(pred: DataFrame, fold: str = "fold", y: str = "y", p: str = "pred") -> DataFrame:
    """Per-fold accuracy with the mean and population std over folds."""
    per = pred.groupBy(fold).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))
    w = Window.partitionBy()  # one row per fold
    return per.select(F.col(fold).cast("int").alias("fold"), F.round("accuracy", 6).alias("accuracy"),
                      F.round(F.avg("accuracy").over(w), 6).alias("mean_accuracy"),
                      F.round(F.stddev_pop("accuracy").over(w), 6).alias("std_accuracy"))


# -------------------------------------------------------- M13 / M15 -------
def heldout_status(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    return pred.withColumn("status", F.when(F.col(y) == F.col(p), "OK").otherwise("MISS"))


def confidence_summary(pred: DataFrame, p: str = "pred", conf: str = "confidence") -> DataFrame:
    return pred.groupBy(F.col(p).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(conf), 6).alias("avg_confidence"),
        F.round(F.min(conf), 6).alias("min_confidence"),
        F.round(F.max(conf), 6).alias("max_confidence"),
        F.round(F.percentile(conf, 0.5), 6).alias("median_confidence"))
