"""Snippet text -> one row per syntax node (the only Python in the feature path).

Each distinct snippet (``sample_id = sha2(code, 256)``) is parsed once inside
``mapInArrow``; the rows describe the tree and nothing else — kind, the
parent field a node sits in, preorder ``node_id`` / ``end_id`` (the subtree of
x is ``node_id BETWEEN x.node_id AND x.end_id``), and the ancestor path: ids,
the field taken below each ancestor, each ancestor's kind, and the names of
ancestor definitions; and the direct children, each with its first child and that one's
first child. With these on the row, "inside a loop", "in the body of a For" or "the value
assigned" is an array expression, not a join. Every feature is a relational query over
this table (operators/features.py).

Operator and context nodes (Add, Load, ...) are folded into the ``op`` column
of their owner, not emitted. A snippet that does not parse yields one row with
``kind = 'ParseError'`` and the message.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIRST = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
                       T.StructField("op", T.StringType())])
CHILD = T.StructType([
    T.StructField("node_id", T.IntegerType()),
    T.StructField("field", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("const_num", T.DoubleType()),
    T.StructField("n_elts", T.IntegerType()),
    T.StructField("fc", _FIRST),            # its first child, and that one's
    T.StructField("fc2", _FIRST),
])
NODE_SCHEMA = T.StructType([
    T.StructField("sample_id", T.StringType(), False),
    T.StructField("node_id", T.IntegerType(), False),
    T.StructField("parent_id", T.IntegerType(), True),
    T.StructField("end_id", T.IntegerType(), False),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("field", T.StringType(), True),
    T.StructField("pos", T.IntegerType(), True),
    T.StructField("kind", T.StringType(), False),
    T.StructField("op", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("const_num", T.DoubleType(), True),
    T.StructField("n_args", T.IntegerType(), True),
    T.StructField("n_elts", T.IntegerType(), True),
    T.StructField("level", T.IntegerType(), True),
    T.StructField("lineno", T.IntegerType(), True),
    T.StructField("path", T.ArrayType(T.IntegerType()), True),
    T.StructField("path_fields", T.ArrayType(T.StringType()), True),
    T.StructField("path_kinds", T.ArrayType(T.StringType()), True),
    T.StructField("path_names", T.ArrayType(T.StringType()), True),
    T.StructField("parse_error", T.StringType(), True),
    T.StructField("error_type", T.StringType(), True),
    T.StructField("error_msg", T.StringType(), True),
    T.StructField("children", T.ArrayType(CHILD), True),
])
# What the tree tells of a node; arrays over a batch of whole snippets give it. The rest stands in its row of node_rows.
_PATHS = ["path", "path_fields", "path_kinds", "path_names"]
_OF_TREE = frozenset(["end_id", *_PATHS, "children"])
_FLAT = [f.name for f in NODE_SCHEMA.fields if f.name not in _OF_TREE]
_KIND, _NAME, _OP = (_FLAT.index(n) for n in ("kind", "name", "op"))

PARSER_VERSION = f"python-ast-{sys.version_info.major}.{sys.version_info.minor}"

_FOLDED = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)
_OPERATED = (ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.AugAssign, ast.Compare)
_DEFS = ["FunctionDef", "AsyncFunctionDef", "ClassDef"]
# Fields that never hold a node with a row of its own.
_BARE = frozenset(["ctx", "op", "ops", "id", "attr", "kind", "type_comment", "asname", "module", "level", "conversion", "is_async", "simple"])


# Where a node's name stands, by its type.
_NAMED = {ast.Name: "id", ast.Attribute: "attr", ast.FunctionDef: "name", ast.AsyncFunctionDef: "name", ast.ClassDef: "name",
          ast.alias: "name", ast.ImportFrom: "module", ast.arg: "arg", ast.keyword: "arg"}


def _op_of(node: ast.AST):
    op = getattr(node, "op", None)
    if isinstance(op, _FOLDED):
        return type(op).__name__
    if isinstance(node, ast.Compare):
        return ",".join(type(o).__name__ for o in node.ops)
    return None


def _const_num(node: ast.Constant):
    v = node.value
    try:
        if isinstance(v, (bool, int, float)):
            return float(v)
        if isinstance(v, complex) and v.imag == 0:
            return float(v.real)
    except (OverflowError, ValueError):
        return None
    return None


# n_args and n_elts, by type.
_SIZES = {
    ast.FunctionDef: lambda n: (len(n.args.args), None),
    ast.AsyncFunctionDef: lambda n: (len(n.args.args), None),
    ast.arguments: lambda n: (len(n.args), len(n.defaults)),
    ast.Tuple: lambda n: (None, len(n.elts)),
    ast.List: lambda n: (None, len(n.elts)),
    ast.Set: lambda n: (None, len(n.elts)),
    ast.Assign: lambda n: (None, len(n.targets)),
    ast.BoolOp: lambda n: (None, len(n.values)),
    ast.Compare: lambda n: (None, len(n.comparators)),
    ast.Call: lambda n: (len(n.args), None),
}


_ABOUT: dict[type, tuple] = {}


def _about(cls: type) -> tuple:
    """Of a node type: its name, where a node's name stands, the function of its sizes, whether
    it has an operator, and the fields that may hold nodes."""
    if cls not in _ABOUT:
        _ABOUT[cls] = (cls.__name__, _NAMED.get(cls), _SIZES.get(cls), cls in _OPERATED,
                       () if cls is ast.Constant else tuple(f for f in cls._fields if f not in _BARE))
    return _ABOUT[cls]


def node_rows(sample_id: str, code: str) -> list[tuple]:
    """Preorder rows of one snippet (iterative walk: deep trees are fine)."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError) as exc:
        msg = getattr(exc, "msg", None) if isinstance(exc, SyntaxError) else str(exc)
        line = getattr(exc, "lineno", None) if isinstance(exc, SyntaxError) else None
        return [(sample_id, -1, None, 0, None, None, "ParseError", None, None, None, None, None, None, line,
                 str(exc), type(exc).__name__, msg)]
    rows: list[tuple] = []
    stack: list = [(tree, None, None, None, 0)]      # node, parent_id, field, pos, depth
    while stack:
        node, parent, field, pos, depth = stack.pop()
        nid = len(rows)
        cls = type(node)
        kind, named, sizes, operated, fields = _about(cls)
        n_args, n_elts = sizes(node) if sizes else (None, None)
        rows.append((sample_id, nid, parent, depth, field, pos, kind, _op_of(node) if operated else None,
                     getattr(node, named) if named else None, _const_num(node) if cls is ast.Constant else None,
                     n_args, n_elts, node.level if cls is ast.ImportFrom else None, getattr(node, "lineno", None),
                     None, None, None))
        children = []
        for fname in fields:
            value = getattr(node, fname, None)
            if isinstance(value, list):
                children += [(v, nid, fname, i, depth + 1) for i, v in enumerate(value)
                             if isinstance(v, ast.AST) and not isinstance(v, _FOLDED)]
            elif isinstance(value, ast.AST) and not isinstance(value, _FOLDED):
                children.append((value, nid, fname, None, depth + 1))
        stack += reversed(children)
    return rows


BATCH_ROWS = 10_000            # node rows that a task holds before it hands them on
BATCH_CODES = 100              # snippets that it takes out of Arrow at once


def _above(flat: dict[str, pa.Array]) -> np.ndarray:
    """Each node's parent as a row of the batch, which holds whole snippets in preorder (-1: none)."""
    above = np.arange(len(flat["node_id"])) - flat["node_id"].to_numpy() + flat["parent_id"].fill_null(0).to_numpy()
    return np.where(flat["parent_id"].is_valid().to_numpy(zero_copy_only=False), above, -1)


def _ends(flat: dict[str, pa.Array], above: np.ndarray) -> pa.Array:
    """The last node id of each node's subtree, from the deepest nodes up."""
    ends, depth = flat["node_id"].to_numpy().copy(), flat["depth"].to_numpy()
    for d in range(depth.max(initial=0), 0, -1):
        at = np.flatnonzero(depth == d)
        np.maximum.at(ends, above[at], ends[at])
    return pa.array(ends, pa.int32())


def _paths(flat: dict[str, pa.Array], above: np.ndarray, kept: np.ndarray) -> dict[str, pa.Array]:
    """The ancestors of the nodes kept, from the root down: their ids, the field taken below
    each, their kinds, and their names if they are definitions (what scope rules need)."""
    depth = flat["depth"].to_numpy()[kept]
    offsets = np.concatenate([[0], np.cumsum(depth, dtype=np.int64)])
    ancestors, below = np.empty(offsets[-1], np.int64), np.empty(offsets[-1], np.int64)
    at, slot = kept, offsets[1:] - 1
    up = above[at]
    while len(at):
        more = up >= 0
        at, up, slot = at[more], up[more], slot[more]
        ancestors[slot], below[slot] = up, at
        at, up, slot = up, above[up], slot - 1
    fails = pc.equal(flat["kind"].take(pa.array(kept)), "ParseError")        # no tree, so no path
    offsets = pa.array(offsets, pa.int32(), mask=np.append(fails.to_numpy(zero_copy_only=False), False))
    names = pc.if_else(pc.is_in(flat["kind"], value_set=pa.array(_DEFS)), flat["name"], pa.scalar(None, pa.string()))
    values = [flat["node_id"].take(pa.array(ancestors)), flat["field"].take(pa.array(below)),
              flat["kind"].take(pa.array(ancestors)), names.take(pa.array(ancestors))]
    return {n: pa.ListArray.from_arrays(offsets, v) for n, v in zip(_PATHS, values)}


def _children(flat: dict[str, pa.Array], above: np.ndarray, kept: np.ndarray) -> pa.ListArray:
    """Direct children of the nodes kept, in order. A node's first child, if it has one, is the next row."""
    parents = np.zeros(len(above) + 1, bool)
    parents[kept] = True
    held = np.flatnonzero(parents[above])          # -1, no parent, is the last place
    held = held[np.argsort(above[held], kind="stable")]
    first = np.append(above[1:], -1) == np.arange(len(above))
    second = first & np.append(first[1:], False)

    def struct(form, columns, at, absent=None):
        at = pa.array(at, pa.int32(), mask=absent)
        return pa.StructArray.from_arrays([c if c is not None else flat[n].take(at) for n, c in columns], names=form.names,
                                          mask=None if absent is None else pa.array(absent))

    fc, fc2 = (struct(_FIRST, [(n, None) for n in _FIRST.names], held + k, ~has[held]) for k, has in ((1, first), (2, second)))
    values = struct(CHILD, [(n, {"fc": fc, "fc2": fc2}.get(n)) for n in CHILD.names], held)
    ends = np.concatenate([[0], np.cumsum(np.bincount(above[held], minlength=len(above))[kept])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _parse_batches(names: list[str], keep: Callable | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        form = to_arrow_schema(NODE_SCHEMA)
        schema = pa.schema([form.field(n) for n in names])
        whole = not _OF_TREE.isdisjoint(names)       # children and ancestors of the nodes kept are any nodes
        tree = {"node_id", "parent_id", "depth", "kind", "field", "name", *(CHILD.names[:-2] if "children" in names else [])}
        rows: list[tuple] = []

        def wanted(r):
            return keep(r[_KIND], r[_NAME], r[_OP])

        def arrays(of, only):
            return {n: pa.array(c, type=form.field(n).type) for n, c in zip(_FLAT, zip(*of) if of else [()] * len(_FLAT)) if n in only}

        def batch():
            if not whole:
                flat = arrays(rows, names)
            else:
                every = arrays(rows, tree)
                above = _above(every)
                kept = np.arange(len(rows)) if keep is None else np.flatnonzero([wanted(r) for r in rows])
                flat = arrays([rows[k] for k in kept], set(names) - tree) | {n: every[n].take(pa.array(kept)) for n in tree}
                if "children" in names:
                    flat["children"] = _children(every, above, kept).cast(form.field("children").type)
                if "end_id" in names:
                    flat["end_id"] = _ends(every, above).take(pa.array(kept))
                if not set(_PATHS).isdisjoint(names):
                    flat |= {n: c.cast(form.field(n).type) for n, c in _paths(every, above, kept).items()}
            return pa.RecordBatch.from_arrays([flat[n] for n in names], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, BATCH_CODES):
                part = b.slice(at, BATCH_CODES)
                for sid, code in zip(part.column("sample_id").to_pylist(), part.column("code").to_pylist()):
                    more = node_rows(sid, code if code is not None else "")
                    rows += more if keep is None or whole else filter(wanted, more)
                    if len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()
    return run


def only_errors(kind: str, name: str | None, op: str | None) -> bool:
    return kind == "ParseError"


def sample_ids(corpus: DataFrame, code: str = "code") -> DataFrame:
    return corpus.withColumn("sample_id", F.sha2(F.coalesce(F.col(code), F.lit("")), 256))


def parse_nodes(corpus: DataFrame, code: str = "code", columns: list[str] | None = None,
                keep: Callable[[str, str | None, str | None], bool] | None = None) -> DataFrame:
    """Node rows for every distinct snippet of ``corpus`` (incl. ParseError rows), with
    those of NODE_SCHEMA's columns that are asked for (all by default) and, with ``keep``,
    of nodes whose kind, name and op it accepts (paths and children name any node).

    Only ``sample_id, code`` enter the Python worker; duplicates are removed
    first (partial aggregation, so a snippet copied many times costs one row
    per map task).
    """
    distinct = (corpus.select(F.sha2(F.coalesce(F.col(code), F.lit("")), 256).alias("sample_id"),
                              F.coalesce(F.col(code), F.lit("")).alias("code"))
                .dropDuplicates(["sample_id"]))
    # Parsing costs far more per byte than the shuffle that precedes it, so
    # fix the task count to the cluster's parallelism instead of letting AQE
    # merge small partitions into a single Python task.
    # (keyed by a different hash than the dedupe's, so the planner keeps it)
    n = 2 * corpus.sparkSession.sparkContext.defaultParallelism
    names = columns or NODE_SCHEMA.names
    return (distinct.repartition(n, F.xxhash64("sample_id"))
            .mapInArrow(_parse_batches(names, keep), T.StructType([NODE_SCHEMA[n] for n in names])))


def conform(df: DataFrame) -> DataFrame:
    """Give a hand-built node table every column of NODE_SCHEMA (missing -> null)."""
    cols = []
    for f in NODE_SCHEMA.fields:
        cols.append(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
