"""Exact removal of byte strings that an earlier document holds: sorted suffixes.

A byte is removed if some 50-byte string (``LENGTH``) that covers it also starts in
a document with a smaller id. Sorting every suffix of a corpus would shuffle
50 bytes per byte of text, so the suffix array is sparse: only suffixes at
anchors are kept. A position is an anchor if its 20-byte seed (``SEED``) has the
smallest hash of the 31 seeds in some 50-byte window. Equal windows have equal
anchors, so every match of 50 bytes holds one at the same place on both sides.

1. Texts are dealt to blocks of a few megabytes, written once as a bucketed
   table; later steps join by block without moving texts. Documents equal to
   one with a smaller id are set aside (all their bytes go).
2. Each block sends its distinct seed hashes; seeds of a single document end
   here. The answer tells a block which of its seeds repeat.
3. For repeated seeds, a block sends one suffix per distinct surrounding (30 bytes
   before the anchor, 50 from it on) with the block's smallest id: a passage on
   a third of all documents is one row a block. Spark range-partitions the
   suffixes by their leading bytes with sampled splitters and sorts each
   partition. A seed never straddles a splitter, so no comparison crosses a
   boundary. In a partition, runs of whole seeds are sorted locally word by
   word (most significant eight bytes first, ties by the next), common prefixes
   of neighbours give the classes of equal right parts, the same on reversed
   left parts, and a pair of classes is one window: if its smallest id is below
   the row's, the window is a repeat. Bytes are compared, not hashes.
4. Seeds with more surroundings than ``HOT`` (the edge of a very common passage)
   are split by their windows instead: one row per block and distinct window,
   keyed by 128 bits of its content.
5. Each block marks its windows and digests what is left.

Defined results: null texts are empty; texts under 50 bytes lose nothing; rows
with a null id lose nothing and remove nothing; rows that share an id do not
remove each other; an empty table gives an empty table; other columns stay
aside.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from snipflow.llm.blocks import (ANSWERED, ASKED, BLOCK_BYTES, Block, BlockTable, Repeated, answer, arrow_schema, ask, empty)
from snipflow.llm.common import buffers, mix, slices, text_frame
from snipflow.session import Scratch

LENGTH, SEED = 50, 20
REACH = LENGTH - SEED                  # windows around an anchor start up to here before it
WIDE = REACH + LENGTH
HOT = 4096
_MAX = np.uint64(2**64 - 1)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


def seed_hashes(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the seed at every position; the greatest value where it would cross
    a document's end."""
    m = len(b) - SEED + 1
    x = b.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x4 = x[:-2] | (x[2:] << np.uint64(16))
    x8 = x4[:-4] | (x4[4:] << np.uint64(32))
    h = x8[:m] * _C[0]
    h ^= h >> np.uint64(32)
    h += x8[8:8 + m]
    h *= _C[1]
    h ^= h >> np.uint64(29)
    h += x4[16:16 + m]
    h *= _C[2]
    h ^= h >> np.uint64(32)
    h[(h == _MAX) | (h == 0)] = 1          # both mark what is no seed
    h[_before(ends, SEED - 1, m)] = _MAX
    return h


def _before(ends: np.ndarray, n: int, m: int) -> np.ndarray:
    """Positions below ``m`` in the ``n`` places before each end."""
    at = (ends[:, None] - 1 - np.arange(n)).ravel()
    return at[(at >= 0) & (at < m)]


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and seed hashes of all anchors of concatenated documents."""
    if len(b) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = seed_hashes(b, ends)
    win = h
    for step in (1, 2, 4, 8):
        win = np.minimum(win[:-step], win[step:])
    win = np.minimum(win[:-15], win[15:])               # 31 seeds
    win[_before(ends, LENGTH - 1, len(win))] = 0        # no window crosses an end
    pad = np.zeros(REACH, np.uint64)
    top = np.concatenate([pad, win, pad])
    for step in (1, 2, 4, 8):
        top = np.maximum(top[:-step], top[step:])
    top = np.maximum(top[:-15], top[15:])
    at = np.flatnonzero((top == h) & (h != _MAX) & (h != 0))
    return at, h[at]


def block_anchors(block: Block, skip: np.ndarray):
    """(document, position, seed hash) of the anchors of documents not in ``skip``."""
    doc, pos, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in slices(block.off, 1 << 18):
        base = block.off[i]
        at, h = anchors(block.data[base:block.off[j]], block.off[i + 1:j + 1] - base)
        at = at + base
        d = np.searchsorted(block.off, at, "right") - 1
        use = ~skip[d]
        doc.append(d[use])
        pos.append(at[use])
        hashes.append(h[use])
    return np.concatenate(doc), np.concatenate(pos), np.concatenate(hashes)


def surroundings(block: Block, doc, pos):
    """Bytes around each anchor, zero beyond the document, and their extents."""
    left = np.minimum(REACH, pos - block.off[doc])
    right = np.minimum(LENGTH, block.off[doc + 1] - pos)
    out = np.empty((len(pos), WIDE), np.uint8)
    k = np.arange(-REACH, LENGTH)
    for a in range(0, len(pos), 8192):
        s = slice(a, a + 8192)
        at = pos[s, None] + k
        part = block.data[np.clip(at, 0, len(block.data) - 1)]
        part[(k < -left[s, None]) | (k >= right[s, None])] = 0
        out[s] = part
    return out, left, right


def _row_hash(m: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each row of a byte matrix whose width is a multiple of 8."""
    words = np.ascontiguousarray(m).view(np.uint64)
    out = np.full(len(m), seed, np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ (out >> np.uint64(30))) * _C[0] + words[:, k]
    return mix(out)


def _count_distinct(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Per value of ``first`` (0..n-1), the number of distinct ``second``."""
    pair = np.unique(np.stack([first.astype(np.int64), second.view(np.int64)], 1), axis=0)
    return np.bincount(pair[:, 0], minlength=n)


def _send_seeds(buckets: int):
    def run(t: int, block: Block, right: pa.Table) -> pa.Table:
        doc, pos, h = block_anchors(block, block.marked(right))
        uniq, inv = np.unique(h, return_inverse=True)
        ids = block.ids[doc]
        lo = np.full(len(uniq), np.iinfo(np.int64).max)
        hi = np.full(len(uniq), np.iinfo(np.int64).min)
        np.minimum.at(lo, inv, ids)
        np.maximum.at(hi, inv, ids)
        # surroundings per seed: only a seed with several occurrences can have several
        kinds = np.ones(len(uniq), np.int64)
        many = np.flatnonzero((np.bincount(inv, minlength=len(uniq)) > 1)[inv])
        if len(many):
            around, _, _ = surroundings(block, doc[many], pos[many])
            kinds = np.maximum(kinds, _count_distinct(inv[many], _row_hash(around, 1), len(uniq)))
        return ask(t, uniq, np.minimum(kinds, 32767) << 1 | (lo != hi), buckets)
    return run


SENT = ("kind int, block int, lead binary, around binary, doc bigint, idx int, ll int, rl int, "
        "wa bigint, wb bigint, blob binary")


def _binary(m: np.ndarray) -> pa.Array:
    """Arrow binary column from a byte matrix."""
    n, width = m.shape
    off = np.arange(n + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())


def _window_hashes(around, left, right):
    """Per window offset j: which rows have it, and 128 bits of its content."""
    for j in range(REACH + 1):
        rows = np.flatnonzero((left >= j) & (right >= LENGTH - j))
        if len(rows):
            w = np.zeros((len(rows), 56), np.uint8)
            w[:, :LENGTH] = around[rows, REACH - j:REACH - j + LENGTH]
            yield j, rows, _row_hash(w, 2), _row_hash(w, 3)


def _lowest(key_a, key_b, ids):
    """Distinct pairs of keys with the lowest id of each."""
    order = np.lexsort((ids, key_b, key_a))
    a, b = key_a[order], key_b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new], ids[order][new]


def _send_suffixes(buckets: int):
    def run(t, block, right):
        marks = right.filter(pa.compute.is_valid(right["doc_id"]))
        known = Repeated(right.filter(pa.compute.is_valid(right["keys"])), buckets)
        doc, pos, h = block_anchors(block, block.marked(marks))
        use, heat = known.look_up(h)
        return _suffix_rows(t, block, doc[use], pos[use], heat[use]) if use.any() else empty(SENT)
    return run


def _suffix_rows(t: int, block: Block, doc, pos, heat) -> pa.Table:
    around, ll, rl = surroundings(block, doc, pos)
    tag = _row_hash(around, 1) ^ mix((ll * 64 + rl).astype(np.uint64))
    ids = block.ids[doc]
    order = np.lexsort((pos, ids, tag))
    new = np.concatenate([[True], tag[order][1:] != tag[order][:-1]])
    idx = np.empty(len(tag), np.int64)
    idx[order] = np.cumsum(new) - 1
    rep = order[new]                                    # the lowest id of each surrounding
    blob = np.stack([doc, pos - block.off[doc], idx, ids[rep][idx], ll, rl, heat.astype(np.int64)], 1).astype(np.int64)
    cold = rep[~heat[rep]]
    warm = rep[heat[rep]]
    wa, wb, wd = [], [], []
    for _, rows, a, b in _window_hashes(around[warm], ll[warm], rl[warm]):
        wa.append(a)
        wb.append(b)
        wd.append(ids[warm][rows])
    a, b, d = _lowest(*(np.concatenate(x) if x else np.zeros(0, y) for x, y in ((wa, np.uint64), (wb, np.uint64), (wd, np.int64))))
    n, m = len(cold), len(a)
    nul = lambda k, ty: pa.nulls(k, ty)
    i32, i64, bi = pa.int32(), pa.int64(), pa.binary()
    total = [pa.array(np.concatenate([np.zeros(n), np.full(m, 2), [1]]).astype(np.int32)),
             pa.array(np.full(n + m + 1, t), i32),
             pa.concat_arrays([_binary(around[cold, REACH:REACH + SEED]), nul(m + 1, bi)]),
             pa.concat_arrays([_binary(around[cold]), nul(m + 1, bi)]),
             pa.concat_arrays([pa.array(ids[cold]), pa.array(d), nul(1, i64)]),
             pa.concat_arrays([pa.array(idx[cold], i32), nul(m + 1, i32)]),
             pa.concat_arrays([pa.array(ll[cold], i32), nul(m + 1, i32)]),
             pa.concat_arrays([pa.array(rl[cold], i32), nul(m + 1, i32)]),
             pa.concat_arrays([nul(n, i64), pa.array(a.view(np.int64)), nul(1, i64)]),
             pa.concat_arrays([nul(n, i64), pa.array(b.view(np.int64)), nul(1, i64)]),
             pa.concat_arrays([nul(n + m, bi), pa.array([blob.tobytes()], bi)])]
    return pa.Table.from_arrays(total, schema=arrow_schema(SENT))


def _multikey_order(m: np.ndarray) -> np.ndarray:
    """Order of byte rows: by their first eight bytes, ties by the next, and so on."""
    width = -(-m.shape[1] // 8) * 8
    wide = np.zeros((len(m), width), np.uint8)
    wide[:, :m.shape[1]] = m
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)])


def _common_prefix(m: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before (0 for the first)."""
    diff = m[1:] != m[:-1]
    n = np.where(diff.any(1), diff.argmax(1), m.shape[1])
    return np.concatenate([[0], n])


def repeated_windows(around: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bit j of a row's mask: the window that starts j bytes before its anchor is
    also in a row of a smaller id. All rows of a seed must be given together."""
    n = len(ids)
    tail, head = around[:, REACH:], around[:, :REACH][:, ::-1]
    order_r, order_l = _multikey_order(tail), _multikey_order(head)
    lcp_r, lcp_l = _common_prefix(tail[order_r]), _common_prefix(head[order_l])
    mask = np.zeros(n, np.uint32)
    for j in range(REACH + 1):
        rows = np.flatnonzero((left >= j) & (right >= LENGTH - j))
        if len(rows) < 2:
            continue
        class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
        class_r[order_r] = np.cumsum(lcp_r < LENGTH - j)
        class_l[order_l] = np.cumsum(lcp_l < j) if j else 0
        key = class_r[rows] * (n + 1) + class_l[rows]
        order = np.argsort(key, kind="stable")
        k = key[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        low = np.minimum.reduceat(ids[rows][order], starts)
        low = np.repeat(low, np.diff(np.append(starts, len(k))))
        hit = rows[order][low < ids[rows][order]]
        mask[hit] |= np.uint32(1 << j)
    return mask


def _compare_suffixes(batches):
    """Sorted suffixes of a range partition, taken in runs of whole seeds."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table):
        cols = {c: t[c].combine_chunks() for c in t.column_names}
        data, off = buffers(cols["around"])
        around = data[off[0]:off[-1]].reshape(-1, WIDE)
        mask = repeated_windows(around, cols["ll"].to_numpy().astype(np.int64), cols["rl"].to_numpy().astype(np.int64),
                                cols["doc"].to_numpy())
        hit = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays(
            [cols["block"].take(pa.array(hit)), cols["idx"].take(pa.array(hit)), pa.array(mask[hit].astype(np.int64))],
            ["block", "idx", "mask"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 20_000:
            continue
        t = pa.Table.from_batches(held)
        last = t["lead"][t.num_rows - 1].as_py()
        lead = t["lead"].to_pylist()
        cut = t.num_rows
        while cut and lead[cut - 1] == last:
            cut -= 1
        if cut:
            for a, b in _runs(lead, cut):
                yield flush(t.slice(a, b - a))
        held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        for a, b in _runs(t["lead"].to_pylist(), t.num_rows):
            yield flush(t.slice(a, b - a))


def _runs(lead, n, most=20_000):
    """Ranges of about ``most`` rows that end where the leading bytes change."""
    a = 0
    while a < n:
        b = min(n, a + most)
        while b < n and lead[b] == lead[b - 1]:
            b += 1
        yield a, b
        a = b


def _digest(raw: np.ndarray) -> str:
    return hashlib.sha256(raw.tobytes()).hexdigest()


OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _finish(t: int, block: Block, right: pa.Table) -> pa.Table:
    kinds = right["kind"].to_numpy()
    part = lambda k: right.filter(pa.array(kinds == k))
    copies = block.marked(part(3))
    edge = np.zeros(len(block.data) + 1, np.int32)
    blobs = [x for x in part(1)["blob"].to_pylist()]
    if blobs:
        occ = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 7)
        doc, pos, idx, low, ll, rl, hot = occ.T
        at, ids = pos + block.off[doc], block.ids[doc]
        answers, windows = part(0), part(2)
        mask = np.zeros(int(idx.max()) + 1, np.int64)
        mask[answers["idx"].to_numpy()] = answers["mask"].to_numpy()
        least: dict[tuple[int, int], int] = {}
        for a, b, d in zip(windows["wa"].to_pylist(), windows["wb"].to_pylist(), windows["doc"].to_pylist()):
            least[(a, b)] = min(d, least.get((a, b), d))
        rep = np.zeros(len(mask), np.int64)
        rep[idx] = np.arange(len(idx))
        warm = np.flatnonzero(hot[rep] > 0)
        # hot surroundings: the lowest id of each window, in this block and in all
        lows: dict[int, np.ndarray] = {}
        if len(warm):
            r = rep[warm]
            around, _, _ = surroundings(block, doc[r], at[r])
            mine = list(_window_hashes(around, ll[r], rl[r]))
            a, b, d = _lowest(np.concatenate([x[2] for x in mine]), np.concatenate([x[3] for x in mine]),
                              np.concatenate([low[r][x[1]] for x in mine]))
            for k in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), d.tolist()):
                least[k[:2]] = min(k[2], least.get(k[:2], k[2]))
            for j, rows, a, b in mine:
                got = np.full(len(mask), np.iinfo(np.int64).max)
                got[warm[rows]] = [least[k] for k in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist())]
                lows[j] = got
        for j in range(REACH + 1):
            ok = (ll >= j) & (rl >= LENGTH - j)
            hit = ok & ((ids > low) | ((mask[idx] >> j & 1) > 0))
            if j in lows:
                hit |= ok & (lows[j][idx] < ids)
            edge[at[hit] - j] += 1             # an anchor per position: no index twice
            edge[at[hit] - j + LENGTH] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    rows = []
    for k, d in enumerate(block.ids.tolist()):
        a, b = int(block.off[k]), int(block.off[k + 1])
        raw = block.data[a:b]
        if copies[k]:
            rows.append((d, b - a, b - a, 1, _digest(raw[:0])))
            continue
        g = gone[a:b]
        n = int(g.sum())
        spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
        rows.append((d, b - a, n, spans, _digest(raw[~g] if n else raw)))
    cols = list(zip(*rows))
    return pa.table({c.split()[0]: pa.array(v, pa.string() if k == 4 else pa.int64())
                     for k, (c, v) in enumerate(zip(OUT.split(", "), cols))})


def _plain(batches):
    for batch in batches:
        data, off = buffers(batch["text"])
        n = batch.num_rows
        z = pa.array(np.zeros(n, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(np.diff(off)), z, z, pa.array([_digest(data[a:b]) for a, b in zip(off[:-1], off[1:])])],
            [c.split()[0] for c in OUT.split(", ")])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what is left."""
    scratch = Scratch(df.sparkSession, "suffix")
    docs = text_frame(df, id_col, text_col)
    table = BlockTable(docs, scratch, block_bytes, LENGTH)
    try:
        buckets = max(1, table.bytes >> 22)
        return scratch.save(_remove(table, buckets, hot).unionAll(docs.where("doc_id IS NULL").mapInArrow(_plain, OUT)), "out")
    finally:
        table.drop()
        scratch.drop("seeds", "suffixes", "masks")


def _remove(table: BlockTable, buckets: int, hot: int) -> DataFrame:
    scratch, copies = table.scratch, table.marks
    asked = table.step(copies, _send_seeds(buckets), ASKED)
    told = scratch.save(asked.groupBy("bucket").applyInArrow(answer(hot), ANSWERED), "seeds")
    null = lambda t: F.lit(None).cast(t)
    right = (told.select("block", null("bigint").alias("doc_id"), null("bigint").alias("own"), "bucket", "keys", "hot")
             .unionAll(copies.select("block", "doc_id", "own", null("int"), null("binary"), null("binary"))))
    suffixes = scratch.save(table.step(right, _send_suffixes(buckets), SENT), "suffixes")

    cold = suffixes.where("kind = 0").select("lead", "around", "doc", "block", "idx", "ll", "rl")
    masks = scratch.save(cold.repartitionByRange("lead").sortWithinPartitions("lead")
                         .mapInArrow(_compare_suffixes, "block int, idx int, mask bigint"), "masks")
    warm = suffixes.where("kind = 2").select("block", "wa", "wb", "doc")
    # Only blocks whose own lowest id is not the lowest of all need an answer.
    lowest = warm.groupBy("wa", "wb").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    warm = (warm.join(lowest, ["wa", "wb"]).where("doc > low")
            .select("block", "wa", "wb", F.col("low").alias("doc")))
    types = dict(kind="int", block="int", doc_id="bigint", own="bigint", idx="int", mask="bigint", wa="bigint", wb="bigint",
                 doc="bigint", blob="binary")

    def shaped(frame, kind):
        return frame.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in frame.columns else null(t).alias(c)
                              for c, t in types.items()])

    right = (shaped(masks, 0).unionAll(shaped(suffixes.where("kind = 1").select("block", "blob"), 1))
             .unionAll(shaped(warm, 2)).unionAll(shaped(copies, 3)))
    return table.step(right, _finish, OUT)
