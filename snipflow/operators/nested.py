"""T5 + T6 for nested locals: values of any depth as Spark VARIANT.

A value is a JSON scalar (str, int, bool, None) or an object with a ``kind``:
``{"kind": "list", "items": [..]}`` (also tuple, set, deque),
``{"kind": "dict", "items": [[key, value], ..]}``, and for all else (floats,
modules, functions) ``{"kind": .., "repr": ".."}``.

Python's rule is recursive; here it is a level-by-level rewrite. Going down, each
level's collections are exploded into rows of their children, keyed by the step
and the child's path. Coming up, one aggregation per level puts a
collection and its children together: its repr, its bounded value and the text that it
would be as a dictionary key. A nested value is so many narrow rows, wherever it
nests; only a collection's first ``_SEEN`` children matter, since their reprs alone
exceed the limit, and reprs are carried up to one character beyond it.

Bounds: collections whose repr is longer than 1,000 characters and kinds that are
not data become their repr, cut at 1,000 characters; others keep 50 entries; below
depth 3 everything is its repr; strings are cut at 1,000 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipflow.functions.text import json_text
from snipflow.operators.dsops import (ENGINE_NAMES, MAX_ITEMS, MAX_REPR_LENGTH, MODULE_NAMES, TRUNCATED_SUFFIX,
                                      py_str_repr)
from snipflow.session import materialize

MAX_DEPTH = 3
_SEEN = MAX_REPR_LENGTH // 2 + 1       # children of one character and ", " each exceed the limit
_SEQUENCES = ["list", "tuple", "set", "deque"]


def _cut(c: Column) -> Column:
    return F.when(F.length(c) > MAX_REPR_LENGTH,
                  F.concat(F.substring(c, 1, MAX_REPR_LENGTH), F.lit(TRUNCATED_SUFFIX))).otherwise(c)


def _described(df: DataFrame) -> DataFrame:
    """What the value ``v`` of each row is: its kind and children if it is a collection
    (``inner``), else its text ``t`` (of another kind: its repr), ``form`` and whether it
    is ``none``. A value is read here once and not kept."""
    df = df.withColumn("kind", F.try_variant_get("v", "$.kind", "string"))
    kind = F.col("kind")
    entries = F.flatten(F.slice(F.try_variant_get("v", "$.items", "array<array<variant>>"), 1, _SEEN))
    items = F.slice(F.try_variant_get("v", "$.items", "array<variant>"), 1, _SEEN)
    df = df.withColumn("children", F.when(kind == "dict", entries).when(kind.isin(_SEQUENCES), items))
    df = df.withColumn("inner", F.col("children").isNotNull())
    t = (F.when(F.col("inner"), F.lit(None).cast("string")).when(kind.isNotNull(), F.try_variant_get("v", "$.repr", "string"))
         .otherwise(F.try_variant_get("v", "$", "string")))
    return (df.withColumn("none", F.is_variant_null("v") | F.col("v").isNull()).withColumn("t", t)
            .withColumn("form", F.when(kind.isNull(), F.schema_of_variant("v"))).drop("v"))


def _scalars(df: DataFrame) -> DataFrame:
    """r (repr), s (``str``), j (JSON), sr (repr of s) of the values that are no collections."""
    kind, t, null, form = F.col("kind"), F.col("t"), F.col("none"), F.col("form")
    df = df.withColumn("c", _cut(t))
    number = (F.coalesce(kind.isin("int", "float"), F.lit(False))
              & F.regexp_like(t, F.lit(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")))
    py = F.when(form == "BOOLEAN", F.initcap(t)).otherwise(t)
    string = ~null & kind.isNull() & (form == "STRING")
    other = kind.isNotNull() & ~number
    df = df.withColumn("r", F.when(null, "None").when(kind.isNotNull(), t).when(string, py_str_repr(t)).otherwise(py))
    s = F.when(null, "None").when(other, F.col("c")).when(kind.isNotNull(), t).when(string, F.col("c")).otherwise(py)
    j = F.when(null, "null").when(other, json_text(F.col("c"))).when(kind.isNotNull(), t).when(string, json_text(F.col("c"))).otherwise(t)
    whole = string & (F.length(t) <= MAX_REPR_LENGTH)
    sr = F.when(whole, F.col("r")).when(string | other, py_str_repr(F.col("c"))).otherwise(F.col("s"))
    return df.withColumn("s", s).withColumn("j", j).withColumn("sr", sr)


def _collections(df: DataFrame) -> DataFrame:
    """The same for collections, whose resolved children stand in ``kids`` in order."""
    kids = F.coalesce("kids", F.array().cast("array<struct<pos:int,r:string,s:string,j:string,sr:string>>"))
    df = df.withColumn("kids", kids)
    kind, kids = F.col("kind"), F.col("kids")
    # dictionary entries: keys and values alternate
    pairs = F.transform(F.filter(kids, lambda x: x["pos"] % 2 == 0),
                        lambda x, i: F.struct(x.alias("k"), F.get(kids, 2 * i + 1).alias("v")))
    df = df.withColumn("pairs", F.when(kind == "dict", pairs))
    pairs = F.col("pairs")
    reprs = F.array_join(F.transform(kids, lambda x: x["r"]), ", ")
    full = (F.when(kind == "tuple", F.concat(F.lit("("), reprs, F.when(F.size(kids) == 1, ",").otherwise(""), F.lit(")")))
            .when(kind == "set", F.when(F.size(kids) == 0, "set()").otherwise(F.concat(F.lit("{"), reprs, F.lit("}"))))
            .when(kind == "dict", F.concat(F.lit("{"), F.array_join(F.transform(
                pairs, lambda x: F.concat(x["k"]["r"], F.lit(": "), x["v"]["r"])), ", "), F.lit("}")))
            .when(kind == "deque", F.concat(F.lit("deque(["), reprs, F.lit("])")))
            .otherwise(F.concat(F.lit("["), reprs, F.lit("]"))))
    df = df.withColumn("r", full)
    first, entries = F.slice(kids, 1, MAX_ITEMS), F.slice(pairs, 1, MAX_ITEMS)
    # of entries whose keys become the same text the first place and the last value stay
    keys = F.array_distinct(F.transform(entries, lambda x: x["k"]["s"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(entries, lambda x: x["k"]["s"] == k), -1)["v"].alias("v")))
    df = df.withColumn("last", F.when(kind == "dict", last))
    as_repr = (kind == "deque") | (F.length("r") > MAX_REPR_LENGTH) | (F.col("depth") > MAX_DEPTH)
    is_dict, last = kind == "dict", F.col("last")
    j = F.when(is_dict, F.concat(F.lit("{"), F.array_join(F.transform(
            last, lambda x: F.concat(json_text(x["k"]), F.lit(": "), x["v"]["j"])), ", "), F.lit("}"))).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform(first, lambda x: x["j"]), ", "), F.lit("]")))
    sr = F.when(is_dict, F.concat(F.lit("{"), F.array_join(F.transform(
            last, lambda x: F.concat(py_str_repr(x["k"]), F.lit(": "), x["v"]["sr"])), ", "), F.lit("}"))).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform(first, lambda x: x["sr"]), ", "), F.lit("]")))
    text = _cut(F.col("r"))
    return (df.withColumn("j", F.when(as_repr, json_text(text)).otherwise(j)).withColumn("s", F.when(as_repr, text).otherwise(sr))
            .withColumn("sr", F.when(as_repr, py_str_repr(text)).otherwise(sr)))


def _resolved(level: DataFrame, below: DataFrame | None, keys: list[str]) -> DataFrame:
    own = ["parent", "pos", *(["name"] if "name" in level.columns else [])]
    columns = [*keys, "path", *own, "r", "s", "j", "sr"]
    deep = F.col("depth") > MAX_DEPTH
    out = _scalars(level.where("NOT inner"))
    text = _cut(F.col("r"))
    out = (out.withColumn("j", F.when(deep, json_text(text)).otherwise(F.col("j"))).withColumn("s", F.when(deep, text).otherwise(F.col("s")))
           .withColumn("sr", F.when(deep, py_str_repr(text)).otherwise(F.col("sr")))).select(*columns)
    if below is not None:
        # a collection and its children meet in one aggregation: no join, so nothing is broadcast
        kid, held = F.struct("pos", "r", "s", "j", "sr"), F.struct(*own, "depth", "kind")
        rows = (below.select(*keys, F.col("parent").alias("path"), kid.alias("kid"))
                .unionByName(level.where("inner").select(*keys, "path", held.alias("held")), allowMissingColumns=True))
        rows = rows.groupBy(*keys, "path").agg(F.max("held").alias("held"), F.array_sort(F.collect_list("kid")).alias("kids"))
        out = out.unionByName(_collections(rows.select(*keys, "path", "held.*", "kids")).select(*columns))
    return out.withColumn("r", F.substring("r", 1, MAX_REPR_LENGTH + 1))


def safe_locals(steps: DataFrame, keys: list[str], col: str = "locals") -> DataFrame:
    """One row per kept local of each step: ``keys``, pos (place among the step's
    locals), name, text (the bounded value as JSON, entries in order), value (the same
    as VARIANT).

    ``col`` is array<struct<name string, value variant>>; ``keys`` name a step and are
    not null. Engine names and the two module handles are dropped."""
    # not posexplode: Spark would test the array's size first, and build every value twice
    held = steps.select(*keys, F.posexplode_outer(col).alias("pos", "x")).where("pos IS NOT NULL")
    held = held.select(*keys, "pos", "x.name", F.col("x.value").alias("v"))
    module = F.coalesce(F.try_variant_get("v", "$.kind", "string") == "module", F.lit(False))
    held = held.where(~F.col("name").isin(ENGINE_NAMES) & ~(F.col("name").isin(MODULE_NAMES) & module))
    level = _described(held.withColumn("path", F.col("pos").cast("string")).withColumn("parent", F.lit("")).withColumn("depth", F.lit(0)))
    levels = [materialize(level, "locals")]
    while not (inner := levels[-1].where("inner")).isEmpty():
        child = (inner.select(*keys, F.col("path").alias("parent"), "depth", F.posexplode("children").alias("pos", "v"))
                 .withColumn("path", F.concat_ws("/", "parent", "pos")).withColumn("depth", F.col("depth") + 1))
        levels.append(materialize(_described(child), "locals"))
    out = None
    for level in reversed(levels):
        out = _resolved(level, out, keys)
    return out.select(*keys, "pos", "name", F.col("j").alias("text")).withColumn("value", F.parse_json("text"))
