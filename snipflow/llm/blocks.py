"""Documents dealt to blocks of bounded size, and co-grouping with them.

Some operators ask the whole corpus about a document's content and need the
answer beside the text. The texts are written once as a table bucketed by block,
so that each later step moves questions and answers only. At most one row per
block and distinct question crosses the network, whatever number of documents
ask it: that is what keeps very common content cheap.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snipflow.llm.common import buffers
from snipflow.session import Scratch

BLOCK_BYTES = 8 << 20
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")])


def empty(ddl: str) -> pa.Table:
    return arrow_schema(ddl).empty_table()


class BlockTable:
    """Bucketed copy of (doc_id, text); rows with a null id are left out.

    ``texts()`` groups it by block for ``cogroup``; ``copies`` holds, per block,
    the (doc_id, own) of documents equal to one with a smaller id."""

    def __init__(self, docs: DataFrame, scratch: Scratch, block_bytes: int, least_bytes: int):
        spark = docs.sparkSession
        self.spark, self.scratch = spark, scratch
        self.bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = self.blocks = max(1, math.ceil(self.bytes / block_bytes))
        if n > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
            spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(n))
        self.name = f"snipflow_{scratch.root.rsplit('-', 1)[1]}"
        placed = (docs.where("doc_id IS NOT NULL")
                  .withColumn("block", self.block_of("doc_id"))
                  .withColumn("own", F.xxhash64("text")).withColumn("own2", F.xxhash64(F.lit(7), F.col("text")))
                  .withColumn("n", F.octet_length("text")).withColumn("text", F.col("text").cast("binary")))
        (placed.repartition(n, "block").write.bucketBy(n, "block").format("parquet")
         .option("compression", "zstd").option("path", f"{scratch.root}/blocks").saveAsTable(self.name))
        table = spark.table(self.name)
        same = table.where(F.col("n") >= least_bytes).select("block", "doc_id", "own", "own2", "n")
        first = (same.groupBy("own", "own2", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("hi"))
                 .where("first < hi").drop("hi"))
        self.copies = scratch.save(same.join(first, ["own", "own2", "n"])
                                   .select("block", "doc_id", "own", "first").distinct(), "copies")
        self.marks = self.copies.where("doc_id > first").select("block", "doc_id", "own")

    def block_of(self, id_col: str):
        return F.pmod(F.xxhash64(id_col), F.lit(self.blocks)).cast("int").alias("block")

    def texts(self):
        return self.spark.table(self.name).select("block", "doc_id", "own", "text").groupBy("block")

    def step(self, right: DataFrame, fn, ddl: str) -> DataFrame:
        """``fn(block number, Block, rows of right of this block)`` on every block."""
        return self.texts().cogroup(right.groupBy("block")).applyInArrow(_on_block(fn, ddl), ddl)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.scratch.drop("blocks", "copies")


def _on_block(fn, ddl):
    def run(key, left, right):
        if left.num_rows == 0:
            return empty(ddl)
        return fn(key[0].as_py(), Block(left), right.combine_chunks())
    return run


class Block:
    """Documents of a block: bytes, byte offsets, ids, text hashes."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.data, self.off = buffers(table["text"])
        self.ids, self.own = table["doc_id"].to_numpy(), table["own"].to_numpy()

    def marked(self, marks: pa.Table) -> np.ndarray:
        """Which documents (doc_id, own) of ``marks`` name."""
        pairs = set(zip(marks["doc_id"].to_pylist(), marks["own"].to_pylist()))
        return np.array([p in pairs for p in zip(self.ids.tolist(), self.own.tolist())], bool)


# Which keys occur in more than one document, asked with four bytes a key.
# A bucket and 32 further bits name a key: a clash only lets a key pass that
# later steps find to be single, and bits grow with the number of buckets.

ASKED = "bucket int, block int, keys binary, info binary"
ANSWERED = "block int, bucket int, keys binary, hot binary"


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def ask(block: int, keys: np.ndarray, info: np.ndarray, buckets: int) -> pa.Table:
    """Question rows for sorted distinct 64-bit keys; info: a count shifted by one
    and whether several documents of this block hold the key."""
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    low, info = keys.astype(np.uint32), info.astype(np.uint16)
    return pa.table({
        "bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32()),
        "keys": pa.array([low[cut[k]:cut[k + 1]].tobytes() for k in full], pa.binary()),
        "info": pa.array([info[cut[k]:cut[k + 1]].tobytes() for k in full], pa.binary())}, schema=arrow_schema(ASKED))


def answer(hot: int):
    """Per question row, its keys that several documents hold, and which of them
    count more than ``hot`` in sum."""
    def run(key, table):
        keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
        info = np.concatenate([np.frombuffer(x, np.uint16) for x in table["info"].to_pylist()]).astype(np.int64)
        uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
        again = (np.bincount(inv, minlength=len(uniq)) > 1) | (np.bincount(inv, info & 1, len(uniq)) > 0)
        heavy = np.bincount(inv, info >> 1, len(uniq)) > hot
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        rows = []
        for k, own in enumerate(keys):
            mine = inv[cut[k]:cut[k + 1]]
            use = again[mine]
            rows.append((own[use].tobytes(), heavy[mine][use].astype(np.uint8).tobytes()))
        return pa.table({"block": table["block"], "bucket": table["bucket"],
                         "keys": pa.array([x for x, _ in rows], pa.binary()),
                         "hot": pa.array([y for _, y in rows], pa.binary())}, schema=arrow_schema(ANSWERED))
    return run


class Repeated:
    """Answer rows of one block: which of its keys repeat, and which are hot."""

    def __init__(self, rows: pa.Table, buckets: int):
        keys, heat = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for b, k, x in zip(rows["bucket"].to_pylist(), rows["keys"].to_pylist(), rows["hot"].to_pylist()):
            keys.append(np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b << 32))
            heat.append(np.frombuffer(x, np.uint8))
        keys, heat = np.concatenate(keys), np.concatenate(heat)
        order = np.argsort(keys)
        self.keys, self.heat, self.buckets = keys[order], heat[order] > 0, buckets

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(repeats, hot) of 64-bit keys."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), bool)
        k = (h & np.uint64(0xFFFFFFFF)) | (bucket_of(h, self.buckets).astype(np.uint64) << np.uint64(32))
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        found = self.keys[at] == k
        return found, found & self.heat[at]
