"""Corpus generation (J1): expand templates, assign styles and function names,
render, validate, label, report. Rendering is a chain of native ``replace``
calls (codegen) plus one higher-order function for left-over placeholders;
the template, style and name dimensions are fixed by code, so broadcasting
them is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snipflow.functions.text import json_text, py_lstrip, py_strip
from snipflow.session import literal_df
from snipflow.sources import templates as tp

RESIDUAL = r"__([A-Z0-9_]+)__"


def templates_df(spark: SparkSession) -> DataFrame:
    rows = [(i, key, label, name, body) for i, (key, label, name, body) in enumerate(tp.TEMPLATES)]
    return literal_df(spark, rows, "template_idx int, func_key string, label string, "
                                   "original_name string, body string")


def styles_df(spark: SparkSession) -> DataFrame:
    """One row per style, one column per role token."""
    toks = list(tp.ROLE_NAMES)
    rows = [tuple([s] + [tp.ROLE_NAMES[t][s] for t in toks]) for s in range(tp.STYLES)]
    schema = T.StructType([T.StructField("style_id", T.IntegerType(), False)]
                          + [T.StructField(f"tok_{t}", T.StringType(), False) for t in toks])
    return literal_df(spark, rows, schema)


def func_names_df(spark: SparkSession) -> DataFrame:
    rows = [(k, p, n) for k, names in tp.FUNC_NAMES.items() for p, n in enumerate(names)]
    return literal_df(spark, rows, "func_key string, func_pos int, func_name string")


def expand(templates: DataFrame, k: int = tp.VARIANTS_PER_TEMPLATE) -> DataFrame:
    """G1: every template x variants 0..k-1 (explode, no cross join)."""
    return templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def render(body: Column, func_name: Column, comment_on: Column) -> Column:
    """G4-G7 for columns from the style dimension (``tok_*``)."""
    c = F.when(func_name.isNotNull(), F.replace(body, F.lit("__FUNC__"), func_name)).otherwise(body)
    for tok in tp.ROLE_NAMES:
        c = F.replace(c, F.lit(f"__{tok}__"), F.col(f"tok_{tok}"))
    # Any other placeholder becomes its lower-cased name
    left = F.array_distinct(F.regexp_extract_all(c, F.lit(RESIDUAL), 1))
    c = F.aggregate(left, c, lambda acc, t: F.replace(acc, F.concat(F.lit("__"), t, F.lit("__")),
                                                      F.lower(t)))
    # Drop comment-only lines unless comments are on
    lines = F.split(c, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda ln: ~py_lstrip(ln).startswith("#")), "\n")
    c = F.when(comment_on, c).otherwise(kept)
    # Strip both ends, exactly one trailing newline
    return F.concat(py_strip(c), F.lit("\n"))


def prepared_templates(spark: SparkSession) -> DataFrame:
    """Per-template part of rendering, done once on the 51-row dimension:
    left-over placeholders lower-cased (G5), comment lines removed for the
    odd variants (G6), both ends stripped (G7). Role names and function names
    hold no '#', no whitespace and no placeholder, so doing these steps before
    the row-level replacements gives the same text as doing them after."""
    t = templates_df(spark)
    body = F.col("body")
    left = F.array_except(F.array_distinct(F.regexp_extract_all(body, F.lit(RESIDUAL), 1)),
                          F.array(*[F.lit(x) for x in list(tp.ROLE_NAMES) + ["FUNC"]]))
    low = F.aggregate(left, body, lambda acc, x: F.replace(acc, F.concat(F.lit("__"), x, F.lit("__")),
                                                           F.lower(x)))
    lines = F.split(low, "\n", -1)
    no_comments = F.array_join(F.filter(lines, lambda ln: ~py_lstrip(ln).startswith("#")), "\n")
    return t.select("*", py_strip(low).alias("body_c"), py_strip(no_comments).alias("body_nc"))


def render_prepared(rows: DataFrame) -> Column:
    """G4 on a prepared template: function name (default ``func``), then the
    role tokens — a chain of native replaces, no higher-order function."""
    c = F.when(F.col("variant") % 2 == 0, F.col("body_c")).otherwise(F.col("body_nc"))
    c = F.replace(c, F.lit("__FUNC__"), F.coalesce(F.col("func_name"), F.lit("func")))
    for tok in tp.ROLE_NAMES:
        c = F.replace(c, F.lit(f"__{tok}__"), F.col(f"tok_{tok}"))
    return F.concat(c, F.lit("\n"))


def assign(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """G2 + G3: style = (variant + t_idx) mod 5, name = pool[(variant + t_idx) mod 4]."""
    s = (F.col("variant") + F.col("template_idx"))
    rows = rows.withColumn("style_id", F.pmod(s, F.lit(tp.STYLES)).cast("int")) \
        .withColumn("func_pos", F.pmod(s, F.lit(4)).cast("int"))
    return (rows.join(F.broadcast(styles_df(spark)), "style_id")
            .join(F.broadcast(func_names_df(spark)), ["func_key", "func_pos"], "left"))


def render_rows(rows: DataFrame) -> DataFrame:
    """Rows with template_idx, variant and the prepared template -> code."""
    spark = rows.sparkSession
    return assign(rows, spark).withColumn("code", render_prepared(rows))


def generate(spark: SparkSession) -> DataFrame:
    """G1-G9 + G11: the canonical corpus (templates x 5 variants), debug columns
    kept; sort rows carry their original algorithm name (G9/G11)."""
    t = expand(prepared_templates(spark))
    r = render_rows(t)
    flat = r.where(F.col("func_key") != "sorting").select(
        "code", "label", F.col("template_idx").alias("source_template_idx"), "variant")
    sorts = r.where(F.col("func_key") == "sorting").select(
        "code", "label", F.col("template_idx").alias("source_template_idx"), "variant",
        F.col("original_name").alias("original_algorithm"))
    return flat.unionByName(sorts, allowMissingColumns=True)


def corpus_from_ids(ids: DataFrame, id_col: str = "doc_id", text_col: str | None = None) -> DataFrame:
    """X6 at scale: one rendering per input id; template = id mod n_templates,
    variant = (id div n_templates) mod 5. With ``text_col`` the snippet ends in that
    text, whole, as a string constant (JSON's escapes are Python's)."""
    spark = ids.sparkSession
    n = len(tp.TEMPLATES)
    rows = ids.select(F.col(id_col).alias("doc_id"),
                      F.pmod(F.col(id_col), F.lit(n)).cast("int").alias("template_idx"),
                      F.pmod(F.floor(F.col(id_col) / n), F.lit(tp.VARIANTS_PER_TEMPLATE))
                      .cast("int").alias("variant"),
                      (F.lit("") if text_col is None else F.concat(json_text(F.coalesce(text_col, F.lit(""))), F.lit("\n"))).alias("_tail"))
    rows = rows.join(F.broadcast(prepared_templates(spark)), "template_idx")
    return render_rows(rows).select("doc_id", "template_idx", "variant", "label", "original_name",
                                    F.concat("code", "_tail").alias("code"))


def generation_report(corpus: DataFrame) -> DataFrame:
    """Samples per label and a TOTAL row (rollup)."""
    r = corpus.rollup("label").agg(F.count(F.lit(1)).alias("n"))
    return r.select(F.coalesce(F.col("label"), F.lit("TOTAL")).alias("label"), "n")


def duplicate_report(corpus: DataFrame) -> DataFrame:
    """Texts that occur more than once (exact, by SHA-256)."""
    return (corpus.groupBy(F.sha2(F.col("code"), 256).alias("code_sha256"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_labels"))
            .where(F.col("n") > 1))


def template_leakage(split_rows: DataFrame) -> DataFrame:
    """Templates whose renderings sit on both sides of a train/test split."""
    return (split_rows.groupBy("template_idx")
            .agg(F.count_distinct("split").alias("n_sides"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n_sides") > 1))


def validated(corpus: DataFrame) -> DataFrame:
    """Corpus rows with ``sample_id`` and ``parse_error`` (null: it parses)."""
    from snipflow.operators.parse import only_errors, parse_nodes, sample_ids
    errs = parse_nodes(corpus, columns=["sample_id", "kind", "parse_error"], keep=only_errors).select("sample_id", "parse_error")
    return sample_ids(corpus).join(errs, "sample_id", "left")


def validate(corpus: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into those that parse and rejects (with the error)."""
    from snipflow.operators.parse import sample_ids
    errs = nodes.where(F.col("kind") == "ParseError").select("sample_id", "parse_error")
    c = sample_ids(corpus).join(errs, "sample_id", "left")
    return (c.where(F.col("parse_error").isNull()).drop("parse_error"),
            c.where(F.col("parse_error").isNotNull()))
