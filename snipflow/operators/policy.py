"""Policy screening of snippets (static half of J7), over the node table.

Every rule is a filter over node rows; the first violation of a snippet is the
one met first in breadth-first order, which is ``(depth, node_id)`` on a
preorder-numbered tree (plus the alias position inside one import).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipflow.functions.text import is_blank, py_rstrip, py_strip
from snipflow.schemas import SYNTAX_ERRORS

# --- fixed values: screening lists and messages ------------------------------
BLOCKED_NAMES = ["open", "__import__", "exec", "eval", "compile", "input", "os", "sys",
                 "subprocess", "socket", "shutil", "pathlib"]
ALLOWED_IMPORTS = ["collections", "heapq"]
MSG_BLOCKED = "Use of restricted name '{}' is not allowed."
MSG_DUNDER = "Access to dunder attributes is not allowed."
MSG_RELATIVE = "Relative imports are not allowed."
MSG_IMPORT = "Import of '{}' is not allowed. Only collections and heapq are available."
MSG_NO_CALL = ("No executable sample call found. Add a call at the bottom, e.g. "
               "print(binary_search([1, 2, 3], 2)).")
MSG_SYNTAX = "Syntax error on line {}: {}"
DEF_KINDS = ["FunctionDef", "AsyncFunctionDef", "ClassDef"]
IMPORT_KINDS = ["Import", "ImportFrom"]
# -----------------------------------------------------------------------------


NODE_COLUMNS = ["sample_id", "node_id", "parent_id", "depth", "field", "pos", "kind", "name", "lineno", "parse_error",
                "error_type", "error_msg"]


def _msg(template: str, value) -> F.Column:
    a, b = template.split("{}")
    return F.concat(F.lit(a), value, F.lit(b))


def violations(nodes: DataFrame) -> DataFrame:
    """V1-V4: every violation with its breadth-first position.

    Import nodes without alias children (synthetic trees) carry the module
    in their own ``name``.
    """
    n = nodes.where(F.col("kind") != "ParseError")
    cols = ["sample_id", "depth", "node_id", "sub", "message"]
    v1 = (n.where((F.col("kind") == "Name") & F.col("name").isin(*BLOCKED_NAMES))
          .select("sample_id", "depth", "node_id", F.lit(0).alias("sub"),
                  _msg(MSG_BLOCKED, F.col("name")).alias("message")))
    v4 = (n.where((F.col("kind") == "Attribute") & F.col("name").startswith("__"))
          .select("sample_id", "depth", "node_id", F.lit(0).alias("sub"),
                  F.lit(MSG_DUNDER).alias("message")))
    aliases = n.where((F.col("kind") == "alias") & (F.col("field") == "names")).select(
        "sample_id", F.col("parent_id").alias("node_id"), F.col("pos").alias("sub"),
        F.col("name").alias("alias_name"))
    imp = (n.where(F.col("kind") == "Import").select("sample_id", "depth", "node_id", "name")
           .join(aliases, ["sample_id", "node_id"], "left"))
    mod = F.split(F.coalesce(F.col("alias_name"), F.col("name")), r"\.", 2)[0]
    v2 = (imp.where(~mod.isin(*ALLOWED_IMPORTS))
          .select("sample_id", "depth", "node_id", F.coalesce(F.col("sub"), F.lit(0)).alias("sub"),
                  _msg(MSG_IMPORT, mod).alias("message")))
    frm = n.where(F.col("kind") == "ImportFrom")
    fmod = F.split(F.col("name"), r"\.", 2)[0]
    v3 = (frm.where(F.col("name").isNull() | ~fmod.isin(*ALLOWED_IMPORTS))
          .select("sample_id", "depth", "node_id", F.lit(0).alias("sub"),
                  F.when(F.col("name").isNull(), F.lit(MSG_RELATIVE))
                  .otherwise(_msg(MSG_IMPORT, fmod)).alias("message")))
    return v1.select(*cols).unionByName(v4.select(*cols)).unionByName(v2.select(*cols)) \
        .unionByName(v3.select(*cols))


def first_violation(nodes: DataFrame) -> DataFrame:
    """V5: one row per violating snippet: the first message in walk order."""
    v = violations(nodes)
    return v.groupBy("sample_id").agg(
        F.min_by("message", F.struct("depth", "node_id", "sub")).alias("violation"),
        F.count(F.lit(1)).alias("n_violations"))


def only_definitions(nodes: DataFrame) -> DataFrame:
    """V6: module body made only of defs/classes/imports, with >= 1 def/class."""
    top = nodes.where((F.col("parent_id") == 0) & (F.col("kind") != "ParseError"))
    return top.groupBy("sample_id").agg(
        (F.bool_and(F.col("kind").isin(*DEF_KINDS, *IMPORT_KINDS))
         & F.bool_or(F.col("kind").isin(*DEF_KINDS))).alias("only_defs"))


def run_text(code: F.Column, entry_call: F.Column) -> F.Column:
    """V7: code with the sample call appended when one is given."""
    return F.when(is_blank(entry_call), code).otherwise(
        F.concat(py_rstrip(code), F.lit("\n\n"), py_strip(entry_call), F.lit("\n")))


def _parse_error(prefix: str) -> F.Column:
    """(kind, message) of a parse failure, as the run preparation reports it."""
    et = F.col(f"{prefix}_etype")
    syntax = F.concat(F.lit("Syntax error on line "),
                      F.coalesce(F.col(f"{prefix}_line").cast("string"), F.lit("None")),
                      F.lit(": "), F.col(f"{prefix}_emsg"))
    return (F.when(et.isin(*SYNTAX_ERRORS), F.struct(F.lit("syntax_error").alias("k"), syntax.alias("m")))
            .when(et == "ValueError", F.struct(F.lit("policy_error").alias("k"),
                                                F.col(f"{prefix}_emsg").alias("m")))
            .when(et.isNotNull(), F.struct(F.lit("prepare_error").alias("k"),
                                           F.col(f"{prefix}_perr").alias("m"))))


def screen(runs: DataFrame, code: str = "code", entry: str = "entry_call") -> DataFrame:
    """V5-V8 per run: status, message, and the text that would run.

    Adds ``syntax_error``, ``policy_error``, ``prepare_error`` (for the trace
    status of T15) and ``run_text``. Code and sample call are parsed in one
    pass over their distinct texts.
    """
    from snipflow.operators.parse import parse_nodes
    from snipflow.session import materialize
    if entry not in runs.columns:
        runs = runs.withColumn(entry, F.lit(None).cast("string"))
    texts = runs.select(F.col(code).alias("code")).unionByName(
        runs.where(~is_blank(F.col(entry))).select(F.col(entry).alias("code")))
    nodes = materialize(parse_nodes(texts, columns=NODE_COLUMNS))
    errs = nodes.where(F.col("kind") == "ParseError").select(
        "sample_id", F.col("error_type").alias("etype"), F.col("error_msg").alias("emsg"),
        F.col("lineno").alias("line"), F.col("parse_error").alias("perr"))
    fv = first_violation(nodes)
    od = only_definitions(nodes)

    def side(prefix):
        return (errs.select(F.col("sample_id").alias(f"{prefix}_sid"),
                            *[F.col(c).alias(f"{prefix}_{c}") for c in ("etype", "emsg", "line", "perr")]))

    r = runs.withColumn("code_sid", F.sha2(F.coalesce(F.col(code), F.lit("")), 256)) \
        .withColumn("entry_sid", F.when(~is_blank(F.col(entry)),
                                        F.sha2(F.col(entry), 256)))
    r = (r.join(side("c"), r["code_sid"] == F.col("c_sid"), "left")
         .join(side("e"), r["entry_sid"] == F.col("e_sid"), "left")
         .join(fv.select(F.col("sample_id").alias("code_sid"), F.col("violation").alias("c_viol")),
               "code_sid", "left")
         .join(fv.select(F.col("sample_id").alias("entry_sid"), F.col("violation").alias("e_viol")),
               "entry_sid", "left")
         .join(od.select(F.col("sample_id").alias("code_sid"), "only_defs"), "code_sid", "left"))
    has_entry = ~is_blank(F.col(entry))

    def pol(m):
        return F.struct(F.lit("policy_error").alias("k"), m.alias("m"))

    # the order in which a run is prepared: parse code, screen code, then
    # parse and screen the sample call, or require one
    first = F.coalesce(
        _parse_error("c"),
        F.when(F.col("c_viol").isNotNull(), pol(F.col("c_viol"))),
        F.when(has_entry, _parse_error("e")),
        F.when(has_entry & F.col("e_viol").isNotNull(), pol(F.col("e_viol"))),
        F.when(~has_entry & F.coalesce(F.col("only_defs"), F.lit(False)), pol(F.lit(MSG_NO_CALL))),
    )
    blank = is_blank(F.col(code))
    kind = F.when(blank, F.lit("empty")).otherwise(F.coalesce(first["k"], F.lit("ok")))
    msg = F.when(~blank, first["m"])
    status = kind
    keep = [c for c in runs.columns]
    return r.select(*keep,
                    status.alias("screen_status"),
                    msg.alias("screen_message"),
                    F.when(kind == "syntax_error", msg).alias("syntax_error"),
                    F.when(kind == "policy_error", msg).alias("policy_error"),
                    F.when(kind == "prepare_error", msg).alias("prepare_error"),
                    run_text(F.col(code), F.col(entry)).alias("run_text"))
