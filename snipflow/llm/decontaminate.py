"""Benchmark decontamination by spaced seeds that forgive substitutions.

Tokens are the runs between white space and ASCII punctuation, ASCII letters in
lower case. A mask selects token positions; tokens under its gaps may differ.
Hashes of the selected tokens of every benchmark position meet the same hashes
of every document position, and each hit is verified by aligning the item at
that offset without gaps.

A document is contaminated by an item if some aligned window of ``WINDOW`` tokens
agrees in at least 80 % of its positions. For 13 tokens that is at most two
substitutions; each of the 78 ways to place two leaves at least one of the two
masks free in some position, so no such window is missed. Items shorter than
the window must occur exactly, as a run of tokens.

The benchmark's hashes are broadcast only when a count of its tokens proves them
small (``BROADCAST_TOKENS``); beyond that, document and benchmark hashes meet in
a shuffle join, and the hits of a document come back to its text by id.

Defined results: null and empty texts are clean, null and empty items match
nothing; repeated rows are judged alike; an empty table on either side gives no
hits. Input columns pass through; clashing names get a trailing ``_``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snipflow.llm.common import Words, buffers, mix, slices

WINDOW = 13
AGREE = 0.8
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
BROADCAST_TOKENS = 1 << 20
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def token_words(data: np.ndarray, off: np.ndarray) -> Words:
    return Words(data, off, lower=True, also=PUNCTUATION)


def masked(h: np.ndarray, mask) -> np.ndarray:
    """Hash of the tokens that ``mask`` selects, at every position it fits."""
    m = len(h) - mask[-1]
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, sum(1 << i for i in mask), np.uint64)
    for i in mask:
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[i:i + m]
    return mix(out)


class Index:
    """Benchmark tokens with their masked hashes in sorted order."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw = [t.encode("utf-8") for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
        w = token_words(np.frombuffer(b"".join(raw), np.uint8), off)
        self.ids, self.first, self.token = np.array(ids, np.int64), w.first, w.hash
        n = np.diff(w.first)
        keys, places = [], []
        for mask in MASKS:
            k = masked(w.hash, mask)
            at = np.arange(len(k))
            fits = w.doc[at] == w.doc[at + mask[-1]] if len(k) else np.zeros(0, bool)
            fits &= n[w.doc[at]] >= WINDOW if len(k) else fits
            keys.append(k[fits])
            places.append(at[fits])
        for i in np.flatnonzero((n > 0) & (n < WINDOW)):       # short items: first token finds the place
            keys.append(mix(w.hash[w.first[i]:w.first[i] + 1] ^ np.uint64(0x5BD1E995)))
            places.append(np.array([w.first[i]]))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], np.concatenate(places)[order] if keys else np.zeros(0, int)
        self.short = bool(((n > 0) & (n < WINDOW)).any())
        self.item = np.searchsorted(w.first, self.place, "right") - 1
        # a bit per 24-bit prefix: most document positions end here
        self.bits = np.zeros(1 << 21, np.uint8)
        at = (self.key >> np.uint64(40)).astype(np.int64)
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def hits(self, h: np.ndarray):
        """(document position, index into places) of every equal hash."""
        pos, idx = [], []
        probes = [masked(h, m) for m in MASKS]
        if self.short:
            probes.append(mix(h ^ np.uint64(0x5BD1E995)))
        for k in probes:
            at = (k >> np.uint64(40)).astype(np.int64)
            cand = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            lo = np.searchsorted(self.key, k[cand], "left")
            n = np.searchsorted(self.key, k[cand], "right") - lo
            pos.append(np.repeat(cand, n))
            idx.append(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.concatenate(pos), np.concatenate(idx).astype(np.int64)

    def verify(self, w: Words, pos: np.ndarray, place: np.ndarray, item: np.ndarray):
        """Which hits lie in an aligned window that agrees well enough; the
        window may start up to a window before the hit."""
        if not len(pos):
            return np.zeros(0, bool)
        d0, d1 = w.first[w.doc[pos]], w.first[w.doc[pos] + 1]
        b0, b1 = self.first[item], self.first[item + 1]
        size = np.minimum(WINDOW, b1 - b0)
        need = np.where(size < WINDOW, size, np.ceil(AGREE * WINDOW - 1e-9)).astype(int)
        k = np.arange(-WINDOW, WINDOW + 1)
        dp, bp = pos[:, None] + k, place[:, None] + k
        inside = (dp >= d0[:, None]) & (dp < d1[:, None]) & (bp >= b0[:, None]) & (bp < b1[:, None])
        same = inside & (w.hash[np.clip(dp, 0, len(w.hash) - 1)] == self.token[np.clip(bp, 0, len(self.token) - 1)])
        sums = np.concatenate([np.zeros((len(pos), 1), int), np.cumsum(same, 1)], 1)
        ins = np.concatenate([np.zeros((len(pos), 1), int), np.cumsum(inside, 1)], 1)
        ok = np.zeros(len(pos), bool)
        for s in range(len(k)):
            e = np.minimum(s + size, len(k))
            row = np.arange(len(pos))
            whole = ins[row, e] - ins[row, s] == size
            ok |= whole & (sums[row, e] - sums[row, s] >= need)
        return ok


def _find(index: Index, data: np.ndarray, off: np.ndarray):
    """Sorted distinct (row, item index) pairs of verified hits in a slice."""
    w = token_words(data, off)
    if not len(w.hash) or not len(index.key):
        return np.zeros(0, int), np.zeros(0, int)
    pos, idx = index.hits(w.hash)
    found = []
    for at in range(0, len(pos), 50_000):
        p, i = pos[at:at + 50_000], idx[at:at + 50_000]
        ok = index.verify(w, p, index.place[i], index.item[i])
        found.append(np.stack([w.doc[p][ok], index.item[i][ok]], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), int)
    return pairs[:, 0], pairs[:, 1]


def _broadcast_hits(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            data, off = buffers(batch["text"])
            items: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for i, j in slices(off):
                for r, x in zip(*_find(index, data, off[i:j + 1])):
                    items[i + r].append(int(index.ids[x]))
            out = pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "__items"])
    return run


def _position_hashes(batches):
    """(key, id) of every masked position: document side of the shuffle join."""
    for batch in batches:
        data, off = buffers(batch["text"])
        ids = batch["id"].to_numpy()
        for i, j in slices(off, 1 << 18):
            w = token_words(data, off[i:j + 1])
            for mask in MASKS:
                k = masked(w.hash, mask)
                at = np.arange(len(k))
                ok = w.doc[at] == w.doc[at + mask[-1]] if len(k) else np.zeros(0, bool)
                yield _pairs(k[ok], ids[i:j][w.doc[at[ok]]])
            yield _pairs(mix(w.hash ^ np.uint64(0x5BD1E995)), ids[i:j][w.doc])


def _pairs(key, ids):
    pair = np.unique(np.stack([key.view(np.int64), ids], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["key", "id"])


def _item_hashes(batches):
    for batch in batches:
        index = Index(batch["id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()])
        yield _pairs(index.key, index.ids[index.item]) if len(index.key) else _pairs(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _verify_pairs(batches):
    for batch in batches:
        keep = []
        for t, x in zip(batch["text"].to_pylist(), batch["item_text"].to_pylist()):
            raw = t.encode("utf-8")
            rows, _ = _find(Index([0], [x]), np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
            keep.append(len(rows) > 0)
        yield pa.RecordBatch.from_arrays([batch["rid"], batch["item_id"]], ["rid", "item"]).filter(pa.array(keep, pa.bool_()))


def contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """``df`` with ``items`` (sorted ids of the items found) and ``contaminated``."""
    names = [c if c not in df.columns else c + "_" for c in ("items", "contaminated")]
    bench = (benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text"))
             .where("id IS NOT NULL AND length(text) > 0").distinct())
    tokens = bench.agg(F.sum(F.length("text"))).first()[0] or 0     # a token takes a character at least
    text = F.coalesce(F.col(text_col), F.lit(""))
    if tokens <= broadcast_tokens * 4:
        rows = bench.orderBy("id", "text").collect()                # bounded by the check above
        shared = df.sparkSession.sparkContext.broadcast(Index([r["id"] for r in rows], [r["text"] for r in rows]))
        rest = [c for c in df.columns if c != text_col]
        plain = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(rest)],
                          F.col(text_col).alias("raw"), text.alias("text"))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
        out = plain.mapInArrow(_broadcast_hits(shared), f"{fields}, __items array<bigint>")
        back = {c: f"c{k}" for k, c in enumerate(rest)} | {text_col: "raw"}
        return out.select(*[F.col(back[c]).alias(c) for c in df.columns], F.col("__items").alias(names[0]),
                          (F.size("__items") > 0).alias(names[1]))
    rid = F.xxhash64(text)                                          # rows with the same text share their hits
    docs = df.withColumn("__rid", rid)
    texts = docs.select(F.col("__rid").alias("rid"), text.alias("text")).where("length(text) > 0")
    hashed = texts.select(F.col("rid").alias("id"), "text").mapInArrow(_position_hashes, "key bigint, id bigint")
    items = bench.mapInArrow(_item_hashes, "key bigint, id bigint").distinct()
    cand = (hashed.join(items.withColumnRenamed("id", "item_id"), "key").select(F.col("id").alias("rid"), "item_id").distinct())
    found = (cand.join(texts.dropDuplicates(["rid"]), "rid")
             .join(bench.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id")
             .mapInArrow(_verify_pairs, "rid bigint, item bigint"))
    per = found.groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("__items")).withColumnRenamed("rid", "__rid")
    out = docs.join(per, "__rid", "left").withColumn("__items", F.coalesce("__items", F.array().cast("array<bigint>")))
    return out.select(*df.columns, F.col("__items").alias(names[0]), (F.size("__items") > 0).alias(names[1]))
