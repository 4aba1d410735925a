"""Registered queries over real code: X6 renderings parsed into the node table,
the 39 features (F1-F39, P1-P3), the cascade end to end (R24) and corpus
profiles (F40, F41, F44). DuckDB cannot parse Python, so these carry no
oracle SQL; they are checked by the golden snippets in tests/."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipflow.operators import features, profile, rules
from snipflow.operators.parse import PARSER_VERSION
from snipflow.schemas import FEATURE_NAMES
from snipflow.sources import fixtures as fx
from snipflow.sources.tables import table


def _good(spark, sf_dir):
    # the renderings are read twice (parse input, feature join): write once
    from snipflow.session import materialize
    good, _ = features.build_features(materialize(fx.x6_corpus(spark, sf_dir), "x6_corpus"))
    return good


def corpus_features(spark, sf_dir):
    return _good(spark, sf_dir).select("doc_id", "template_idx", "label", *FEATURE_NAMES,
                                       F.lit(PARSER_VERSION).alias("parser"))


def corpus_estimates(spark, sf_dir):
    est = rules.estimate(_good(spark, sf_dir))
    return est.select("doc_id", "label", "rule_id", "rule_name", "time_complexity",
                      "space_complexity", "confidence", "reasoning")


def corpus_rule_by_label(spark, sf_dir):
    est = rules.estimate(_good(spark, sf_dir))
    return est.groupBy("label", "rule_id", "rule_name").agg(F.count(F.lit(1)).alias("n"))


def corpus_feature_profile(spark, sf_dir):
    return profile.feature_profile(_good(spark, sf_dir))


def corpus_signature_collisions(spark, sf_dir):
    return profile.signature_collisions(_good(spark, sf_dir))


def corpus_naming_sensitivity(spark, sf_dir):
    return profile.naming_sensitivity(_good(spark, sf_dir), "template_idx")


def doc_parse_failures(spark, sf_dir):
    """P2 on document texts read as code: most are prose and fail to parse."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code"))
    _, rejects = features.build_features(docs)
    return features.failure_report(rejects.select("doc_id", "parse_error"), "doc_id")


def corpus_validate(spark, sf_dir):
    """Renderings that parse vs rejects; every 17th rendering is cut in
    half so some fail. Parse failures are reported, not dropped."""
    from snipflow.operators.corpus import validate
    from snipflow.operators.parse import only_errors, parse_nodes
    from snipflow.session import materialize
    c = fx.x6_corpus(spark, sf_dir)
    c = c.withColumn("code", F.when(F.col("doc_id") % 17 == 0,
                                    F.expr("substring(code, 1, length(code) div 2)"))
                     .otherwise(F.col("code")))
    nodes = parse_nodes(c, columns=["sample_id", "kind", "parse_error"], keep=only_errors)
    good, bad = validate(c, materialize(nodes, "nodes"))
    return (good.select("label", F.lit("ok").alias("status"))
            .unionByName(bad.select("label", F.lit("rejected").alias("status")))
            .groupBy("label", "status").agg(F.count(F.lit(1)).alias("n")))


def oracle():
    return {}


def queries():
    return {
        "corpus_features": corpus_features,
        "corpus_estimates": corpus_estimates,
        "corpus_rule_by_label": corpus_rule_by_label,
        "corpus_feature_profile": corpus_feature_profile,
        "corpus_signature_collisions": corpus_signature_collisions,
        "corpus_naming_sensitivity": corpus_naming_sensitivity,
        "doc_parse_failures": doc_parse_failures,
        "corpus_validate": corpus_validate,
    }
