"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct word shingles (ASCII letters in lower case;
with fewer words than a shingle the whole sequence is one; without words it is
empty). ``2 x SIDE`` half keys of ``HALF`` minhashes each are computed, and
every pair of a left and a right half key forms the key of one of ``SIDE ** 2``
tables: 96 minhashes serve 144 tables that would take 1,152 one by one. A pair
at similarity 0.85 meets in some table with probability above 0.9997.

1. Equal sets are one class (128-bit digest of the set); its smallest id stands
   for it from here on.
2. (key, id) rows are aggregated per key; keys with one member go, and keys with
   the same members are kept once (count, minimum and xor of hashed ids).
3. Members are compared with their bucket's smallest and largest id by size (an
   exact bound) and by 4 bits of each minhash, which a true link fails with a
   probability below 1e-4. What passes ties candidate clusters.
4. The full sets of a cluster meet, and links are confirmed on them by counting
   common shingles through an inverted index. Each group first compares its
   documents with the cluster's smallest id; only those outside the component
   that forms are compared with all. A cluster of many shingles is cut into
   chunks, each with a copy of that first document. Documents of any chunk that
   do not reach it are then compared with every chunk, so no task holds more
   than two chunks: a group of true copies is read once, however large it is,
   and never more than one link per member leaves a task.
5. What the tables miss (pairs that share none, or meet only far from their bucket's
   smallest and largest id) is found by the exact join of ``jaccard_join``: it takes the
   links so far as known, and verifies on the full sets whatever shares one of its index
   keys and is not tied together yet. Links give components.

No candidate is capped or sampled away, and no link is left to chance.

Defined results: null ids are kept, linked with nothing; rows that repeat an id
with different texts link their classes, and rows of one id are kept or dropped
together; null and empty texts have zero shingles and stay alone; other columns
stay aside; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snipflow.llm.common import Words, buffers, mix, shingles, slices, text_frame
from snipflow.llm.components import connected_components
from snipflow.session import Scratch

HALF, SIDE = 4, 12
HASHES = 2 * SIDE * HALF
CHUNK_ITEMS = 200_000
LANES = HASHES // 16          # 16 minhashes of 4 bits in a long
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:HASHES], _SEEDS[HASHES:] | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row of a slice, and row bounds."""
    w = Words(data, off, lower=True)
    n = np.diff(w.first)
    rows = len(n)
    h = shingles(w.hash, width)
    doc = w.doc[:len(h)]
    whole = doc == w.doc[width - 1:] if len(h) else np.zeros(0, bool)
    h, doc = h[whole], doc[whole]
    for r in np.flatnonzero((n > 0) & (n < width)):       # the whole sequence as one shingle
        k = int(n[r])
        h = np.append(h, shingles(w.hash[w.first[r]:w.first[r] + k], k) ^ np.uint64(k))
        doc = np.append(doc, r)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(rows + 1))


def _signature_rows(width: int):
    def run(batches):
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in slices(off):
                h, cut = shingle_sets(data, off[i:j + 1], width)
                size = np.diff(cut)
                full = np.flatnonzero(size)
                a = b = np.zeros(j - i, np.uint64)
                half = np.zeros((j - i, 2 * SIDE), np.uint64)
                bits = np.zeros((j - i, LANES), np.uint64)
                if len(full):
                    starts = cut[:-1][full]
                    a, b = a.copy(), a.copy()
                    a[full] = np.add.reduceat(mix(h), starts)
                    b[full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    for k in range(HASHES):
                        low = mix(np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], starts))
                        half[full, k // HALF] = mix(half[full, k // HALF] * np.uint64(31) + low)
                        bits[full, k // 16] |= (low & np.uint64(15)) << np.uint64(4 * (k % 16))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(size.astype(np.int64)),
                     pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     pa.array([r.tobytes() for r in half], pa.binary()),
                     *[pa.array(np.ascontiguousarray(bits[:, x]).view(np.int64)) for x in range(LANES)]],
                    ["doc_id", "n", "da", "db", "half", *[f"s{x}" for x in range(LANES)]])
    return run


SIG_SCHEMA = ("doc_id bigint, n bigint, da bigint, db bigint, half binary, "
              + ", ".join(f"s{x} bigint" for x in range(LANES)))


def _key_rows(batches):
    """Every left half key with every right one."""
    table = np.arange(SIDE * SIDE, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            half = np.frombuffer(b"".join(part["half"].to_pylist()), np.uint64).reshape(-1, 2 * SIDE)
            key = mix((half[:, :SIDE, None] * np.uint64(0x9E3779B97F4A7C15)
                       + half[:, None, SIDE:]).reshape(len(half), -1) + table)
            ids = np.repeat(part["doc_id"].to_numpy(), SIDE * SIDE)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])


def _set_rows(width: int):
    def run(batches):
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in slices(off):
                h, cut = shingle_sets(data, off[i:j + 1], width)
                rest = batch.slice(i, j - i).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array([h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                    [*rest.schema.names, "items"])
    return run


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links_of(ids: np.ndarray, cluster: np.ndarray, sets: list[np.ndarray], threshold: int,
             tied: np.ndarray, asking: np.ndarray | None = None) -> tuple[list, np.ndarray]:
    """Links that tie together what is linked, a spanning forest of the similar pairs
    of each cluster, and the rows that do not reach the first tied row of theirs.

    Rows marked ``tied`` are known to be in one component (per cluster). With
    ``asking`` only pairs of a marked and an unmarked row count."""
    n = len(ids)
    size = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(n), size)
    item = np.concatenate(sets)
    order = np.lexsort((doc, item, cluster[doc]))
    d, x, c = doc[order], item[order], cluster[doc[order]]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (c[1:] != c[:-1])])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(d)))
    run = np.empty(len(d), np.int64)            # per item of each document: its run in the index
    run[order] = np.cumsum(new) - 1
    at = np.concatenate([[0], np.cumsum(size)])
    parent = np.arange(n)
    heads: dict = {}
    for k in np.flatnonzero(tied).tolist():
        parent[k] = heads.setdefault(cluster[k], k)

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []

    def compare(k):
        r = run[at[k]:at[k + 1]]
        m = length[r]
        if int(m.sum()) == len(r):              # nothing is shared
            return
        first = np.cumsum(m) - m
        others = d[np.repeat(start[r] - first, m) + np.arange(m.sum())]
        common = np.bincount(others, minlength=n)
        near = 100 * common >= threshold * (size + size[k] - common)
        if asking is not None:
            near &= ~asking
        for y in np.flatnonzero(near).tolist():
            p, q = find(k), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((ids[k], ids[y]))

    if asking is not None:
        for k in np.flatnonzero(asking).tolist():
            compare(k)
        return out, np.zeros(n, bool)
    for k in range(n):
        heads.setdefault(cluster[k], k)
    for k in heads.values():
        compare(k)
    for k in range(n):
        if find(k) != find(heads[cluster[k]]):
            compare(k)
    return out, np.array([find(k) != find(heads[cluster[k]]) for k in range(n)], bool)


def _link_group(threshold: int):
    """Links of a group of clusters, or of one chunk with the first document of its
    cluster; a row with a null ``b`` names a document that does not reach it."""
    def run(table):
        ids, cluster = table["id"].to_numpy(), table["component"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        got, outside = links_of(ids, cluster, sets, threshold, ids == cluster)
        alone = np.unique(ids[outside]).tolist()
        return pa.table([pa.array([x for x, _ in got] + alone, pa.int64()),
                         pa.array([y for _, y in got] + [None] * len(alone), pa.int64())], schema=LINKS)
    return run


def _link_outside(threshold: int):
    """Links between documents outside the main component and one chunk of their cluster."""
    def run(table):
        asking, outside = (np.array(table[c].to_pylist(), bool) for c in ("asking", "outside"))
        sets = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        got, _ = links_of(table["id"].to_numpy(), table["component"].to_numpy(), sets, threshold, ~outside, asking)
        return pa.table([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], schema=LINKS)
    return run


def _estimate_bound(threshold: int, sigmas: float = 4.0) -> int:
    """Most of the minhashes' 4-bit values that a link may differ in."""
    p = 1 - (threshold / 100 + (1 - threshold / 100) / 16)
    return int(HASHES * p + sigmas * (HASHES * p * (1 - p)) ** 0.5)


def _differing(x: str, y: str):
    """Number of 4-bit values that differ between two sketches."""
    out = F.lit(0)
    for k in range(LANES):
        d = F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        out = out + F.bit_count(d)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 3, threshold: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id linked,
    directly or through others), kept (the row is that one). ``threshold`` in percent."""
    from snipflow.llm.jaccard_join import similar_documents     # it uses this module's sets
    scratch = Scratch(df.sparkSession, "near-dup")
    docs = text_frame(df, id_col, text_col)
    sig = scratch.save(docs.mapInArrow(_signature_rows(width), SIG_SCHEMA), "sig")
    lanes = [f"s{x}" for x in range(LANES)]
    linkable = sig.where("doc_id IS NOT NULL AND n > 0")
    classes = scratch.save(linkable.groupBy("da", "db", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # Rows of the representatives: narrow, one per class; a repeated id counts once per class.
    reps = scratch.save(
        linkable.join(classes.select("da", "db", "n", F.col("rep").alias("doc_id")), ["da", "db", "n", "doc_id"], "left_semi")
        .dropDuplicates(["da", "db", "n", "doc_id"]).select("doc_id", "n", "half", *lanes), "reps")

    keys = reps.select("half", "doc_id").mapInArrow(_key_rows, "key bigint, id bigint")
    keys = scratch.save(_multiple(keys), "keys")
    member = (keys.join(reps.select(F.col("doc_id").alias("id"), "n", *lanes), "id"))
    member = scratch.save(member, "members")
    close = ((F.col("x.n") * 100 >= F.col("y.n") * threshold) & (F.col("y.n") * 100 >= F.col("x.n") * threshold)
             & (_differing("x", "y") <= _estimate_bound(threshold)))
    body = F.struct("id", "n", *lanes)
    hubs = member.groupBy("key").agg(F.min(body).alias("lo"), F.max(body).alias("hi"))
    hubs = hubs.select("key", F.explode(F.array("lo", "hi")).alias("h")).select("key", "h.*")
    ties = (member.alias("x").join(hubs.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & close)
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    cluster = scratch.save(connected_components(ties, scratch, "ties"), "cluster")

    weight = (cluster.join(reps.select(F.col("doc_id").alias("id"), "n"), "id").groupBy("component")
              .agg(F.ceil(F.sum("n") / CHUNK_ITEMS).cast("int").alias("chunks"), F.sum("n").alias("w")))
    weight = scratch.save(weight, "weight")
    groups = max(1, int((weight.where("chunks = 1").agg(F.sum("w")).first()[0] or 0) // CHUNK_ITEMS))
    member = cluster.join(weight, "component").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    items = (docs.join(member, docs.doc_id == member.id)
             .select("id", "component", "chunks", "chunk", "text")
             .mapInArrow(_set_rows(width), "id bigint, component bigint, chunks int, chunk int, items binary"))
    items = scratch.save(items.where("length(items) > 0"), "items")
    small = items.where("chunks = 1").withColumn("g", F.pmod(F.xxhash64("component"), F.lit(groups)))
    small = small.select("id", "component", "items", "g")
    # Large clusters, first round: each chunk with a copy of the cluster's first document.
    large = items.where("chunks > 1")
    copies = (large.where("id = component").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .where("to <> chunk").select("id", "component", "items", F.col("to").alias("chunk")))
    within = large.select("id", "component", "items", "chunk").unionAll(copies)
    first = scratch.save(small.groupBy("g").applyInArrow(_link_group(threshold), "a bigint, b bigint")
                         .withColumn("large", F.lit(False))
                         .unionAll(within.groupBy("component", "chunk").applyInArrow(_link_group(threshold), "a bigint, b bigint")
                                   .withColumn("large", F.lit(True))), "first")
    # Second round: what does not reach that document, against every chunk.
    outside = first.where("large AND b IS NULL").select(F.col("a").alias("out")).distinct()
    large = large.join(outside, F.col("id") == F.col("out"), "left").withColumn("outside", F.col("out").isNotNull())
    blocks = scratch.save(large.where("outside").groupBy("component")
                          .agg(F.ceil(F.sum(F.length("items")) / (8 * CHUNK_ITEMS)).cast("int").alias("blocks")), "blocks")
    large = large.join(blocks, "component").select("id", "component", "items", "chunk", "chunks", "blocks", "outside")
    asked = large.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asking", F.lit(False))
    asking = (large.where("outside").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).cast("int"))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asking", F.lit(True)))
    columns = ["id", "component", "items", "outside", "asking", "chunk", "block"]
    second = (asked.select(*columns).unionAll(asking.select(*columns)).groupBy("component", "chunk", "block")
              .applyInArrow(_link_outside(threshold), "a bigint, b bigint"))
    links = scratch.save(first.where("b IS NOT NULL").select("a", "b").unionAll(second), "links")
    scratch.drop("sig", "classes", "reps", "keys", "members", "cluster", "weight", "items", "first", "blocks")
    # The exact check: what shares a prefix token (or combination) without being tied yet.
    out = similar_documents(df, id_col, text_col, width, threshold, known=links)
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "out")
    scratch.drop("links")
    return out


def _multiple(keys: DataFrame) -> DataFrame:
    """Rows of keys that at least two ids share; of keys with the same ids, one.

    One exchange by key serves the aggregate and the join."""
    keys = keys.repartition("key")
    per_key = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("lo"),
                                      F.bit_xor(F.xxhash64("id")).alias("x")).where("k > 1")
    once = per_key.groupBy("k", "lo", "x").agg(F.min("key").alias("key")).select("key")
    return keys.join(once, "key", "left_semi")
