"""Merkle manifest of a dataset by slot pivots.

Every row is a leaf: the hash of its fields, each as ``-`` if null, else its
UTF-8 byte count, ``:`` and the value. A group's leaves stand in order; runs of
``FANOUT`` consecutive nodes hash to their parent until one node, the group's
subroot, is left. The subroots, ordered by group, form a tree of the same kind
whose last node is the root. A hash is the lowercase hex SHA-256 of its inputs
concatenated, digests as hex text.

1. Leaves are hashed once and written without their texts. A range
   partitioning by (group, order, leaf) puts them in order; the row number in
   each sorted partition plus the counts of earlier partitions is the place of a
   leaf, so a group of any size is numbered without one task seeing all of it.
2. Slot pivot, a level at a time: conditional aggregates by parent spread its
   children into ``FANOUT`` columns. All columns concatenated hash to the parent;
   all but the own one are the siblings. The leaf level carries the leaves' other
   columns inside the slots, so leaves are never joined to the tree.
3. Paths go from the root down: a parent's row holds the sibling runs above it,
   its children add their own. Each level joins rows of parents only, an eighth of
   its nodes.

Work and rows per level shrink by the fanout; the depth is the logarithm of the
largest group. Nothing but the number of levels reaches the driver.

Defined results: null ids, groups and texts are fields like others (a null id or
group stands first); rows equal in group, order and leaf are leaves of their own,
interchangeable in order; an empty table gives an empty table; columns that are
not fields are not hashed and do not travel with the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from snipflow.session import Scratch

FANOUT = 8
PART_ROWS = 250_000
_ROW_BITS = 33                # of monotonically_increasing_id: rows within a partition

PATH = "array<struct<left:string,right:string>>"


def field_text(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in fields]).cast("binary"), 256)


def numbered(df: DataFrame, scratch: Scratch, step: str, order: list[str], group: list[str]) -> DataFrame:
    """``df`` with ``pos``, the place of a row in its group under ``order`` (which
    starts with the group's columns), and ``total``, the group's number of rows.

    Written sorted; a row's number within its partition is its id's lower bits."""
    rows = df.count()
    parts = max(1, math.ceil(rows / PART_ROWS), min(rows // 1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = scratch.save(ranged.withColumn("_at", F.monotonically_increasing_id()), step)
    ranged = (ranged.withColumn("_part", F.shiftrightunsigned("_at", _ROW_BITS))
              .withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))
    # one row per group and partition
    held = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"),
                       (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_n").over(Window.partitionBy(*group)).alias("total"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (ranged.join(held, same).withColumn("pos", F.col("_row") + F.col("_shift"))
            .drop("_at", "_part", "_row", "_shift", "_p", *[f"_g{i}" for i in range(len(group))]))


def _slots(value: Column) -> list[Column]:
    """One conditional aggregate per slot of a parent."""
    slot = F.pmod(F.col("pos"), F.lit(FANOUT))
    return [F.max(F.when(slot == k, value)).alias(f"c{k}") for k in range(FANOUT)]


def _levels(nodes: DataFrame, scratch: Scratch, name: str, most: int, payload: Column) -> tuple[list[DataFrame], DataFrame]:
    """Slot tables of the levels and the last node (g, digest) of each group.

    ``nodes``: g, total, pos, digest; ``payload`` is what leaf slots hold, a struct
    with a field ``digest``. ``most``: rows of the largest group."""
    tables, roots, value = [], nodes.where("total = 1").select("g", "digest"), payload
    digest = [F.col(f"c{k}").getField("digest") for k in range(FANOUT)]
    while most > 1:
        wide = (nodes.where("total > 1")
                .groupBy("g", F.expr(f"pos div {FANOUT}").alias("parent"), F.ceil(F.col("total") / FANOUT).alias("total"))
                .agg(*_slots(value)))
        wide = scratch.save(wide, f"{name}{len(tables)}")
        tables.append(wide)
        nodes = wide.select("g", "total", F.col("parent").alias("pos"),
                            F.sha2(F.concat_ws("", *digest).cast("binary"), 256).alias("digest"))
        roots = roots.unionAll(nodes.where("total = 1").select("g", "digest"))
        most, value = math.ceil(most / FANOUT), F.struct("digest")
    return tables, roots


def _children(wide: DataFrame, above: DataFrame) -> DataFrame:
    """Children of slot rows joined to what stands above their parent (g, pos, up, ...):
    each with its slot's content and its own path, siblings left and right first."""
    joined = wide.join(above.withColumnRenamed("pos", "parent"), ["g", "parent"])
    content = [F.col(f"c{k}").getField("digest") for k in range(FANOUT)]
    child = [F.struct(F.lit(k).alias("slot"), F.col(f"c{k}").alias("own"),
                      F.struct(F.concat_ws("", F.lit(""), *content[:k]).alias("left"),
                               F.concat_ws("", F.lit(""), *content[k + 1:]).alias("right")).alias("beside"))
             for k in range(FANOUT)]
    keep = [c for c in above.columns if c not in ("g", "pos", "up")]
    return (joined.select("g", "parent", "up", *keep, F.explode(F.array(*child)).alias("x")).where("x.own IS NOT NULL")
            .select("g", (F.col("parent") * FANOUT + F.col("x.slot")).alias("pos"), "x.own",
                    F.concat(F.array("x.beside"), "up").alias("up"), *keep))


def _descend(tables: list[DataFrame], top: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Leaf rows of a forest (g, pos, own, up, ...), from its roots ``top`` (g, up, ...) down."""
    at = top.withColumn("pos", F.lit(0).cast("long"))
    for level in reversed(range(len(tables))):
        # The roots of groups that end higher up join only the level where they have children.
        here = tables[level].select("g", "total").where("total = 1").distinct().select("g")
        rows = at if level == len(tables) - 1 else at.unionByName(
            top.join(here, "g", "left_semi").withColumn("pos", F.lit(0).cast("long")))
        at = _children(tables[level], rows)
        if level:
            at = scratch.save(at.drop("own"), f"{name}{level}")
    return at


def manifest(df: DataFrame, fields: list[Column], order: Column, group: Column, altered: Column | None = None) -> DataFrame:
    """One row per row of ``df``: id (``order``), leaf, subroot, root, path (sibling
    digests left and right of each node, from the leaf to the root), altered (the
    leaf digest ``altered`` where it is not null, else the leaf).

    ``order`` is a long column, ``group`` a string column."""
    scratch = Scratch(df.sparkSession, "merkle")
    altered = F.lit(None).cast("string") if altered is None else altered
    leaves = df.select(group.alias("grp"), order.cast("long").alias("id"), leaf_hash(*fields).alias("digest"), altered.alias("altered"))
    # "tie" splits rows that are equal in all else over range partitions.
    leaves = scratch.save(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    placed = numbered(leaves, scratch, "placed", ["grp", "id", "digest", "tie"], ["grp"])
    groups = scratch.save(placed.where("pos = 0").select("grp", "total"), "groups")
    ranked = numbered(groups.select("grp"), scratch, "ranked", ["grp"], [])
    ranked = scratch.save(ranked.select(F.col("grp").alias("own_grp"), F.col("pos").alias("g"), F.col("total").alias("groups")), "order")
    nodes = placed.join(ranked, F.col("grp").eqNullSafe(F.col("own_grp"))).select("g", "total", "pos", "id", "digest", "altered")
    nodes = scratch.save(nodes, "nodes")
    most = groups.agg(F.max("total")).first()[0] or 0
    tables, subroots = _levels(nodes, scratch, "level", most, F.struct("digest", "id", "altered"))

    # The tree over the subroots: one group of its own.
    subroots = scratch.save(subroots, "subroots")
    count = ranked.agg(F.max("groups")).first()[0] or 0
    top = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(count).cast("long").alias("total"), F.col("g").alias("pos"), "digest")
    high, root = _levels(top, scratch, "top", count, F.struct("digest"))
    root = root.select("g", F.array().cast(PATH).alias("up"), F.col("digest").alias("root"))
    if high:
        heads = _descend(high, root, scratch, "high").select(
            F.col("pos").alias("g"), F.col("own.digest").alias("subroot"), "up", "root")
    else:
        heads = subroots.select("g", F.col("digest").alias("subroot")).join(root, "g")
    heads = scratch.save(heads, "heads")

    # Leaves below the groups' trees, and groups of one leaf.
    columns = ["subroot", "root", F.col("up").alias("path")]
    out = (nodes.where("total = 1").join(heads, "g")
           .select("id", F.col("digest").alias("leaf"), *columns, F.coalesce("altered", "digest").alias("altered")))
    if tables:
        below = _descend(tables, heads, scratch, "below").select(
            "own.id", F.col("own.digest").alias("leaf"), *columns, F.coalesce("own.altered", "own.digest").alias("altered"))
        out = out.unionByName(below)
    scratch.drop("leaves", "placed", "groups", "ranked", "order", "subroots", *[f"top{k}" for k in range(len(high))],
                 *[f"high{k}" for k in range(1, len(high))], *[f"level{k}" for k in range(1, len(tables))],
                 *[f"below{k}" for k in range(2, len(tables))])
    return out


def folded(leaf: Column, path: Column) -> Column:
    """Root recomputed from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]).cast("binary"), 256))


def proof_hash(path: Column) -> Column:
    """Hash of the siblings, level by level."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"]))).cast("binary"), 256)
