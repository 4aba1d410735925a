"""Near-duplicate passages by compact windows of token min-hashes.

Tokens are 5-word shingles (ASCII letters in lower case); passages of ``WORDS``
words, 46 tokens, are compared. For one hash function the token of smallest hash
of a passage is the root of its Cartesian tree. Moving a passage of fixed length
through a text changes that root rarely: every node whose subtree is long enough
owns one run of passage starts, its compact window. Windows of two hash
functions are joined on overlapping runs; each joint run is grouped under the
two minima as one signature, which stands for all its passages. ``PAIRS`` such
joins are kept. Two passages of similarity 0.8 share a given joint signature
with probability 0.64, some of five with 0.994; equal passages share all.

1. Texts are dealt to blocks (see ``blocks``); documents equal to one of smaller
   id take its class. Blocks ask which signatures several documents hold.
2. Of these, a block sends its smallest document (with place) per signature; the
   smallest of all, the hub, is told to every block that holds the signature. So
   a passage on a third of all documents is one row per block.
3. A block asks the hubs' blocks for the tokens of the passages in question, each
   once, and verifies its own aligned passages: Jaccard similarity of the token
   sets of at least 0.8, decided for every passage. A signature is open if it has
   windows besides the hub's that may be similar to each other and one of them has
   words outside its document's passages so far, or no link with the hub.
4. All windows of an open signature meet, each distinct text of them once, and are
   compared pair by pair, except where a pair can add neither words nor a link.
5. Verified links give classes; verified passages give each document's spans.

So aligned similar passages of two documents that share a signature are always
found, and their documents share a class.

Defined results: null and empty texts, and texts under ``WORDS`` words, have no
passage and form a class of their own; equal texts share a class whatever their
length, and are one whole passage if long enough; passages that repeat within one
document only are not reported; rows with a null id get no class; rows that share
an id share its class. An empty table gives an empty table; other columns stay
aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from snipflow.llm.blocks import (ANSWERED, ASKED, BLOCK_BYTES, Block, BlockTable, Repeated, answer, arrow_schema, ask,
                                 bucket_of, empty)
from snipflow.llm.common import Words, buffers, mix, powers, shingles, slices, text_frame
from snipflow.llm.components import connected_components
from snipflow.session import Scratch

SHINGLE, WORDS = 5, 50
TOKENS = WORDS - SHINGLE + 1
PAIRS = 5
PERCENT = 80
CHUNK = 256                 # distinct texts of a signature that are counted against as many others at once
PAIRS_AT_ONCE = 2048        # pairs of texts that are compared at once
NEAR_AT_ONCE = 1 << 22      # pairs of texts that share a rare token, listed at once
TOKENS_AT_ONCE = 1 << 15    # tokens of passages that are verified at once, or one range
_S = mix(np.arange(1, 4 * PAIRS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _S[:2 * PAIRS], _S[2 * PAIRS:] | np.uint64(1)
_LOW = np.uint64((1 << 28) - 1)
_TEXT = 0xD1342543DE82EF95
_TEXT_INV = pow(_TEXT, -1, 1 << 64)


def roots(tokens: np.ndarray, k: int) -> np.ndarray:
    """Position of the Cartesian-tree root of every run of ``TOKENS`` tokens under
    hash function ``k`` (leftmost of equal tokens)."""
    v = ((tokens ^ _XOR[k]) * _MUL[k]) & ~_LOW
    v |= np.arange(len(v), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16):
        v = np.minimum(v[:-step], v[step:])
    v = np.minimum(v[:-(TOKENS - 32)], v[TOKENS - 32:])
    return (v & _LOW).astype(np.int64)


def joint_windows(w: Words):
    """(signature, row, first start, last start, root) of the joint compact windows
    of all rows of a slice; starts and roots are token positions in the slice."""
    tokens = shingles(w.hash, SHINGLE)
    n = len(tokens) - TOKENS + 1
    out = [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64) for _ in range(4)]
    if n <= 0:
        return tokens, out
    whole = w.doc[:n] == w.doc[WORDS - 1:WORDS - 1 + n]
    parts = []
    for p in range(PAIRS):
        a, b = roots(tokens, 2 * p)[:n], roots(tokens, 2 * p + 1)[:n]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (w.doc[1:n] != w.doc[:n - 1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        use = whole[first]
        first, last = first[use], last[use]
        ra, rb = a[first], b[first]
        sig = mix(tokens[ra] * np.uint64(0xD6E8FEB86659FD93) + mix(tokens[rb]) + np.uint64(p + 1))
        parts.append((sig, w.doc[first], first, last, ra))
    return tokens, [np.concatenate(x) for x in zip(*parts)]


class _Block:
    """Joint windows of a block, in token positions within each document."""

    def __init__(self, block: Block, skip: np.ndarray):
        self.block, self.tokens = block, [None] * len(block.ids)
        sig, row, a, b, root = [np.zeros(0, np.uint64)], *[[np.zeros(0, np.int64)] for _ in range(4)]
        for i, j in slices(block.off):
            w = Words(block.data, block.off[i:j + 1], lower=True)
            tokens, (s, r, x, y, c) = joint_windows(w)
            use = ~skip[i + r]
            s, r, x, y, c = s[use], r[use], x[use], y[use], c[use]
            base = w.first[r]
            sig.append(s)
            row.append(i + r)
            a.append(x - base)
            b.append(y - base)
            root.append(c - base)
        self.sig, self.row, self.a, self.b, self.root = (np.concatenate(x) for x in (sig, row, a, b, root))

    def keep(self, use):
        for name in ("sig", "row", "a", "b", "root"):
            setattr(self, name, getattr(self, name)[use])


class _Tokens:
    """Tokens of a block's documents: those of row ``r`` are ``all[first[r]:first[r] + count[r]]``."""

    def __init__(self, block: Block):
        parts, first, n = [], [np.zeros(0, np.int64)], 0
        for i, j in slices(block.off):
            w = Words(block.data, block.off[i:j + 1], lower=True)
            parts += [shingles(w.hash, SHINGLE), np.zeros(min(SHINGLE - 1, len(w.hash)), np.uint64)]
            first.append(w.first[:-1] + n)
            n += len(w.hash)
        self.all = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.first = np.concatenate([*first, [n]])
        self.count = np.maximum(np.diff(self.first) - SHINGLE + 1, 0)
        self.first = self.first[:-1]

    def of(self, r: int) -> np.ndarray:
        return self.all[self.first[r]:self.first[r] + self.count[r]]


def _lowest_per_key(key, ids, *more):
    """Distinct keys with the lowest id and what goes with it; and the highest id."""
    order = np.lexsort((ids, key))
    k = key[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    end = np.append(new[1:], len(k)) - 1 if len(k) else new
    return k[new], ids[order][new], ids[order][end], *[m[order][new] for m in more]


def _ask_signatures(buckets):
    def run(t, block, right):
        x = _Block(block, block.marked(right))
        key, lo, hi = _lowest_per_key(x.sig, block.ids[x.row])
        return ask(t, key, (lo != hi).astype(np.int64) | 2, buckets)
    return run


HUBS = "bucket int, block int, keys binary, docs binary, roots binary, single binary"
TOLD = "bucket int, block int, keys binary, docs binary, hub_blocks binary, roots binary"


def _rows_per_bucket(t, buckets, key, doc, root, single):
    cut = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    pack = lambda x: pa.array([x[cut[k]:cut[k + 1]].tobytes() for k in full], pa.binary())
    return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), t), pa.int32()),
                     "keys": pack(key), "docs": pack(doc), "roots": pack(root.astype(np.int32)),
                     "single": pack(single.astype(np.uint8))}, schema=arrow_schema(HUBS))


def _offer_hubs(buckets):
    """The block's smallest document per repeated signature."""
    def run(t, block, right):
        marks = right.filter(pa.compute.is_valid(right["doc_id"]))
        x = _Block(block, block.marked(marks))
        x.keep(Repeated(right.filter(pa.compute.is_valid(right["keys"])), buckets).look_up(x.sig)[0])
        key, lo, hi, root = _lowest_per_key(x.sig, block.ids[x.row], x.root)
        return _rows_per_bucket(t, buckets, key, lo, root, lo == hi)
    return run


def _split(keys: np.ndarray, active: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, packed signatures and infos): twice the number of windows, two at
    most, and whether one is active."""
    keys, inv = np.unique(keys, return_inverse=True)
    info = (2 * np.minimum(np.bincount(inv, minlength=len(keys)), 2) + (np.bincount(inv, active, len(keys)) > 0)).astype(np.uint8)
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    return [(int(k), keys[cut[k]:cut[k + 1]].tobytes() + info[cut[k]:cut[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cut))]


def _tell_hubs(key, table):
    """For each block the signatures that some other document holds too: their hub."""
    load = lambda c, t: [np.frombuffer(x, t) for x in table[c].to_pylist()]
    keys, docs, roots_, single = load("keys", np.uint64), load("docs", np.int64), load("roots", np.int32), load("single", np.uint8)
    size = np.array([len(k) for k in keys])
    block = np.repeat(table["block"].to_numpy(), size)
    k, d, r, s = (np.concatenate(x) for x in (keys, docs, roots_, single))
    order = np.lexsort((d, k))
    first = np.flatnonzero(np.concatenate([[True], k[order][1:] != k[order][:-1]]))
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(np.isin(np.arange(len(k)), first)) - 1
    hub = order[first][group]
    shared = (np.bincount(group)[group] > 1) | (s == 0)
    cut = np.concatenate([[0], np.cumsum(size)])
    out = {c: [] for c in ("keys", "docs", "hub_blocks", "roots")}
    for i in range(len(size)):
        use = np.flatnonzero(shared[cut[i]:cut[i + 1]]) + cut[i]
        h = hub[use]
        for c, v in (("keys", k[use]), ("docs", d[h]), ("hub_blocks", block[h].astype(np.int32)), ("roots", r[h])):
            out[c].append(v.tobytes())
    return pa.table({"bucket": table["bucket"], "block": table["block"], **{c: pa.array(v, pa.binary()) for c, v in out.items()}}, schema=arrow_schema(TOLD))


def _merged(group: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Ranges of each group that meet or overlap, as one: group, start, end, and the
    number of one of its ranges; sorted."""
    order = np.lexsort((lo, group))
    g, lo, hi = group[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(g):
        return g, lo, hi, order
    number = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))
    width = int(hi.max()) + 1
    reach = np.maximum.accumulate(number * width + hi)
    start = np.flatnonzero(np.concatenate([[True], number[1:] * width + lo[1:] > reach[:-1]]))
    end = np.append(start[1:], len(g)) - 1
    return g[start], lo[start], reach[end] - number[end] * width, order[start]


# kind 0: a request to the hub's block; kind 1: the hits of this block, packed;
# kind 2: signatures of a bucket (under block) at further places of the hub
REQUESTS = "kind int, block int, asker int, hub bigint, lo int, hi int, hits binary"
_HIT = np.dtype([("row", np.int64), ("hub", np.int64), ("hub_block", np.int32), ("a", np.int32), ("b", np.int32),
                 ("shift", np.int32), ("sig", np.uint64)])


def _request(buckets):
    def run(t, block, right):
        marks = right.filter(pa.compute.is_valid(right["doc_id"]))
        told = right.filter(pa.compute.is_valid(right["keys"]))
        load = lambda c, ty: np.frombuffer(b"".join(told[c].to_pylist()), ty)
        key, hub, hub_block, root = load("keys", np.uint64), load("docs", np.int64), load("hub_blocks", np.int32), load("roots", np.int32)
        if not len(key):
            return empty(REQUESTS)
        order = np.argsort(key)
        return _requests(t, _Block(block, block.marked(marks)), buckets, key[order], hub[order], hub_block[order], root[order])
    return run


def _requests(t, x, buckets, key, hub, hub_block, root):
    at = np.minimum(np.searchsorted(key, x.sig), len(key) - 1)
    use, own = key[at] == x.sig, hub[at] == x.block.ids[x.row]
    again = x.sig[use & own & (root[at] != x.root)]     # further places in the hub
    again = _split(again, np.ones(len(again), bool), buckets)
    use &= ~own
    at = at[use]
    x.keep(use)
    hit = np.zeros(len(at), _HIT)
    hit["row"], hit["hub"], hit["hub_block"], hit["a"], hit["b"] = x.row, hub[at], hub_block[at], x.a, x.b
    hit["shift"], hit["sig"] = root[at] - x.root, x.sig
    # passages of one hub in question, as few ranges
    h, lo, hi, source = _merged(hit["hub"], np.maximum(x.a + hit["shift"], 0), x.b + hit["shift"] + TOKENS)
    of_hub = hit["hub_block"][source]
    n, m = len(h), len(again)
    i32 = pa.int32()
    return pa.table({
        "kind": pa.array(np.append(np.zeros(n), [1] + [2] * m).astype(np.int32)),
        "block": pa.array([*of_hub.tolist(), t, *[k for k, _ in again]], i32),
        "asker": pa.array(np.full(n + 1 + m, t), i32),
        "hub": pa.concat_arrays([pa.array(h), pa.nulls(1 + m, pa.int64())]),
        "lo": pa.concat_arrays([pa.array(lo, i32), pa.nulls(1 + m, i32)]),
        "hi": pa.concat_arrays([pa.array(hi, i32), pa.nulls(1 + m, i32)]),
        "hits": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([hit.tobytes(), *[v for _, v in again]], pa.binary())])},
        schema=arrow_schema(REQUESTS))


PASSAGES = "block int, hub bigint, lo int, tokens binary"


def _send_passages(t, block, right):
    """The tokens of requested ranges, to each block that asked."""
    marks = right.filter(pa.compute.is_valid(right["doc_id"]))
    ask_ = right.filter(pa.compute.is_valid(right["asker"]))
    tokens, skip, rows = _Tokens(block), block.marked(marks), {}
    for r in np.flatnonzero(~skip).tolist():
        rows.setdefault(int(block.ids[r]), r)
    out = {"block": [], "hub": [], "lo": [], "tokens": []}
    for to, hub, lo, hi in zip(*(ask_[c].to_pylist() for c in ("asker", "hub", "lo", "hi"))):
        out["block"].append(to)
        out["hub"].append(hub)
        out["lo"].append(lo)
        out["tokens"].append(tokens.of(rows[hub])[lo:hi].tobytes() if hub in rows else b"")
    return pa.table(out, schema=arrow_schema(PASSAGES))


# kind 0: span of a document (start and end word) and its partner; kind 1: signatures of a bucket (under block)
FOUND = "kind int, block int, doc bigint, other bigint, start int, stop int, open binary"


def _presence(s: np.ndarray, size: int, n: int):
    """Per sorted (token, place) key the first and last passage in which the place
    is the token's first."""
    at = s % size - TOKENS
    first = np.maximum(at - TOKENS + 1, 0)
    again = s[1:] // size == s[:-1] // size
    first[1:] = np.where(again, np.maximum(first[1:], at[:-1] + 1), first[1:])
    return first, np.minimum(at, n - 1)


def _count(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """How many of the ranges hold each of ``n`` passages."""
    use = first <= last
    return np.cumsum(np.bincount(first[use], minlength=n + 1) - np.bincount(last[use] + 1, minlength=n + 1))[:n]


def _keys(tokens: np.ndarray, number: np.ndarray, size: int) -> np.ndarray:
    return np.sort(number * size + np.arange(len(tokens)) + TOKENS)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Number of different tokens in every passage."""
    n, size = len(x) - TOKENS + 1, len(x) + 2 * TOKENS
    return _count(*_presence(_keys(x, np.unique(x, return_inverse=True)[1], size), size, n), n)


def similar_passages(x: np.ndarray, z: np.ndarray, percent: int) -> np.ndarray:
    """Whether each passage of ``x`` has a token set similar enough to that of the
    passage at the same place of ``z`` (of equal length)."""
    n, size = len(x) - TOKENS + 1, len(x) + 2 * TOKENS
    same = np.concatenate([[0], np.cumsum(x == z)])
    equal = same[TOKENS:] - same[:-TOKENS]
    if equal.min() == TOKENS:
        return np.ones(n, bool)
    names, number = np.unique(np.concatenate([x, z]), return_inverse=True)
    kx, kz = _keys(x, number[:len(x)], size), _keys(z, number[len(x):], size)
    nx, nz = (len(x) - np.count_nonzero(k[1:] // size == k[:-1] // size) for k in (kx, kz))
    if nx == nz == len(x):                  # nothing repeats
        least = -(-2 * percent * TOKENS // (100 + percent))
        if equal.min() >= least:
            return np.ones(n, bool)
        if nx + nz - len(names) < least:
            return np.zeros(n, bool)
    fx, lx = _presence(kx, size, n)
    fz, lz = _presence(kz, size, n)
    # places of one token near enough for one passage
    a, b = np.searchsorted(kz, kx - (TOKENS - 1)), np.searchsorted(kz, kx + (TOKENS - 1), "right")
    i = np.repeat(np.arange(len(kx)), b - a)
    j = np.arange(len(i)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[i]
    common = _count(np.maximum(fx[i], fz[j]), np.minimum(lx[i], lz[j]), n)
    return 100 * common >= percent * (_count(fx, lx, n) + _count(fz, lz, n) - common)


def similar_in_pairs(x: np.ndarray, z: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """The same of many pairs at once, whose tokens follow one another; ``size``: tokens of
    each (``TOKENS`` or more). Places where no whole passage of a pair starts are false."""
    total = len(x)
    start = np.cumsum(size) - size
    pair = np.repeat(np.arange(len(size)), size)
    low, high = start[pair], (start + size - TOKENS)[pair]       # first and last passage of a place's pair
    names, number = np.unique(np.concatenate([x, z]), return_inverse=True)
    number = np.unique(np.concatenate([pair, pair]) * len(names) + number, return_inverse=True)[1]
    width = total + 2 * TOKENS
    kx, kz = _keys(x, number[:total], width), _keys(z, number[total:], width)

    def presence(s):
        at = s % width - TOKENS
        first = np.maximum(at - TOKENS + 1, low[at])
        again = s[1:] // width == s[:-1] // width
        first[1:] = np.where(again, np.maximum(first[1:], at[:-1] + 1), first[1:])
        return first, np.minimum(at, high[at])

    (fx, lx), (fz, lz) = presence(kx), presence(kz)
    a, b = np.searchsorted(kz, kx - (TOKENS - 1)), np.searchsorted(kz, kx + (TOKENS - 1), "right")
    i = np.repeat(np.arange(total), b - a)
    j = np.arange(len(i)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[i]
    common = _count(np.maximum(fx[i], fz[j]), np.minimum(lx[i], lz[j]), total)
    good = 100 * common >= percent * (_count(fx, lx, total) + _count(fz, lz, total) - common)
    return good & (np.arange(total) <= high)


def _runs(good: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _agreeing(tokens: _Tokens, hits: np.ndarray, theirs: tuple, percent: int):
    """Of hits (sorted by row, hub, shift and place): the word ranges of documents whose
    passages are similar enough to the hub's (number of the first hit of the pair, start,
    end, shift), and which hits have a passage that is not. ``theirs``: hub, place, offset
    and count of the passages' tokens (sorted), and the tokens."""
    hub_of, los, offs, counts, hub_tokens = theirs
    new = np.concatenate([[True], (hits["row"][1:] != hits["row"][:-1]) | (hits["hub"][1:] != hits["hub"][:-1])])
    pair_at = np.flatnonzero(new)[np.cumsum(new) - 1]
    new |= np.concatenate([[True], hits["shift"][1:] != hits["shift"][:-1]])
    line = np.cumsum(new) - 1
    _, first, last, at = _merged(line, hits["a"], hits["b"] + 1)
    range_of = np.zeros(len(hits), np.int64)
    range_of[at] = 1                                    # a range begins at the smallest place of its line
    range_of = np.cumsum(range_of) - 1
    shift, row = hits["shift"][at].astype(np.int64), hits["row"][at]
    first = np.maximum(first, -shift)
    # the hub's passage that holds the range: the last one that starts before it
    hubs = np.unique(hub_of)
    width = max(int(los.max(initial=0)), int((first + shift).max(initial=0))) + 1
    held = np.searchsorted(np.searchsorted(hubs, hub_of) * width + los,
                           np.searchsorted(hubs, hits["hub"][at]) * width + first + shift, "right") - 1
    inside = (held >= 0) & (hub_of[held] == hits["hub"][at])
    z_at = first + shift - los[held]
    size = np.minimum(np.minimum(last - first + TOKENS - 1, counts[held] - z_at), tokens.count[row] - first)
    size = np.where(inside & (first < last) & (size >= TOKENS), size, 0)
    x_from, z_from = tokens.first[row] + first, offs[held] + z_at
    spans, left = [], np.ones(len(hits), bool)
    todo = np.flatnonzero(size)
    ends = np.cumsum(size[todo])
    i = 0
    while i < len(todo):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOKENS_AT_ONCE, "right")))
        part = todo[i:j]
        n = size[part]
        which, x_place = _ranges(x_from[part], n)
        x, z = tokens.all[x_place], hub_tokens[_ranges(z_from[part], n)[1]]
        off = np.cumsum(n) - n
        within = np.arange(len(which)) - off[which]
        good = within <= (n - TOKENS)[which]            # the usual case: a copied passage
        differ = np.zeros(len(part), bool)
        differ[which[x != z]] = True
        if differ.any():
            use = differ[which]
            good[use] = similar_in_pairs(x[use], z[use], n[differ], percent)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))   # a range ends in false
        p, q = edge[::2], edge[1::2]
        k = which[p]
        start = first[part][k] + p - off[k]
        spans.append((pair_at[at[part]][k], start, start + q - p - 1 + WORDS, shift[part][k]))
        sums = np.concatenate([[0], np.cumsum(good)])
        mine = np.arange(at[part[0]], at[part[-1] + 1] if part[-1] + 1 < len(at) else len(hits))
        slot = np.searchsorted(part, range_of[mine])
        known = (slot < len(part)) & (part[np.minimum(slot, len(part) - 1)] == range_of[mine])
        mine, slot = mine[known], slot[known]
        a, b = hits["a"][mine] - first[part][slot], hits["b"][mine] + 1 - first[part][slot]
        ok = (a >= 0) & (b <= n[slot] - TOKENS + 1)
        mine, slot, a, b = mine[ok], slot[ok], a[ok], b[ok]
        left[mine] = sums[off[slot] + b] - sums[off[slot] + a] < b - a
        i = j
    if not spans:
        return [np.zeros(0, np.int64)] * 4, left
    return [np.concatenate(v) for v in zip(*spans)], left


def _verify(percent, buckets):
    def run(t, block, right):
        hits = [np.frombuffer(x, _HIT) for x in right["hits"].to_pylist() if x]
        if not hits:
            return empty(FOUND)
        hits = np.concatenate(hits)
        if not len(hits):
            return empty(FOUND)
        hits = hits[np.lexsort((hits["a"], hits["shift"], hits["hub"], hits["row"]))]
        sent = right.filter(pa.compute.is_valid(right["tokens"]))
        sent = sent.take(pa.compute.sort_indices(sent, [("hub", "ascending"), ("lo", "ascending")]))
        data, off = buffers(sent["tokens"])
        data = data[off[0]:off[-1]].view(np.uint64)
        off = (off - off[0]) // 8
        theirs = sent["hub"].to_numpy(), sent["lo"].to_numpy().astype(np.int64), off[:-1], np.diff(off), data
        found, active = ([np.zeros(0, np.int64)] * 4, np.ones(len(hits), bool))
        if sent.num_rows:
            found, active = _agreeing(_Tokens(block), hits, theirs, percent)
        pair, start, stop, shift = found
        # of each pair the document's spans, then the hub's
        side, lo, hi, _ = _merged(np.concatenate([2 * pair, 2 * pair + 1]), np.concatenate([start, start + shift]),
                                  np.concatenate([stop, stop + shift]))
        docs, hubs = block.ids[hits["row"][side // 2]], hits["hub"][side // 2]
        # a hub's spans once per block; the link itself is in the member's rows
        seen, rows = set(), []
        member = set(block.ids[hits["row"]].tolist())
        for doc, other, x, y in zip(*(v.tolist() for v in (np.where(side % 2, hubs, docs), np.where(side % 2, docs, hubs), lo, hi))):
            if (doc, x, y) in seen and doc not in member:
                continue
            seen.add((doc, x, y))
            rows.append((0, t, doc, other, x, y, None))
        if len(pair):                       # passages of linked hits within the document's spans so far
            same = np.concatenate([[True], (hits["row"][1:] != hits["row"][:-1]) | (hits["hub"][1:] != hits["hub"][:-1])])
            linked = np.isin(np.flatnonzero(same)[np.cumsum(same) - 1], pair)
            row, lo, hi, _ = _merged(hits["row"][pair], start, stop)
            width = max(int(hi.max()), int(hits["b"].max()) + WORDS) + 1
            at = np.searchsorted(row * width + lo, hits["row"] * width + hits["a"], "right") - 1
            active &= ~(linked & (at >= 0) & (row[at] == hits["row"]) & (hi[at] >= hits["b"] + WORDS))
        rows += [(1, k, None, None, None, None, v) for k, v in _split(hits["sig"], active, buckets)]
        if not rows:
            return empty(FOUND)
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(arrow_schema(FOUND), zip(*rows))}, schema=arrow_schema(FOUND))
    return run


OPEN = "block int, keys binary, docs binary"
MEMBERS = ("bucket int, sigs binary, docs binary, starts binary, befores binary, linked binary, covers binary, "
           "sizes binary, texts binary, tokens binary")


def _tell_open(key, told, opened):
    """For each block its signatures that are open, and their hubs."""
    if not (told.num_rows and opened.num_rows):
        return empty(OPEN)
    packed = opened["open"].to_pylist()
    keys, inv = np.unique(np.concatenate([np.frombuffer(v, np.uint64, len(v) // 9) for v in packed]), return_inverse=True)
    info = np.concatenate([np.frombuffer(v, np.uint8, offset=len(v) // 9 * 8) for v in packed])
    keys = keys[(np.bincount(inv, info >> 1, len(keys)) > 1) & (np.bincount(inv, info & 1, len(keys)) > 0)]
    out = []
    for block, own, hub in zip(*(told[c].to_pylist() for c in ("block", "keys", "docs"))):
        own, hub = np.frombuffer(own, np.uint64), np.frombuffer(hub, np.int64)
        use = np.isin(own, keys)
        if use.any():
            out.append((block, own[use].tobytes(), hub[use].tobytes()))
    schema = arrow_schema(OPEN)
    return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


def _covered(tokens: _Tokens, ids: np.ndarray, known: pa.Table) -> np.ndarray:
    """Per token of a block whether the passage that starts there lies in a known span (0 or 1)."""
    order = np.argsort(ids, kind="stable")
    spans = [known[c].to_numpy() for c in ("doc", "start", "stop")]
    doc, start, stop, _ = _merged(*spans)
    edge = np.zeros(len(tokens.all) + 1, np.int64)
    lo, hi = np.searchsorted(ids[order], doc), np.searchsorted(ids[order], doc, "right")
    which, at = _ranges(lo, hi - lo)                    # rows that share an id have its spans
    row = order[at]
    begin = np.minimum(start[which], tokens.count[row])
    end = np.minimum(np.maximum(stop[which] - WORDS + 1, begin), tokens.count[row])
    np.add.at(edge, tokens.first[row] + begin, 1)
    np.add.at(edge, tokens.first[row] + end, -1)
    return (np.cumsum(edge[:-1]) > 0).astype(np.uint8)


def _worth_sending(tokens, cover, x, doc, linked, from_, to) -> np.ndarray:
    """Windows to send, by row: all but those that can find nothing (all passages in known
    spans and a link with the hub) and are no partner that another window lacks: of equal
    texts of a signature, the first window of the two smallest documents stays."""
    sums = np.concatenate([[0], np.cumsum(cover)])
    idle = np.flatnonzero(linked & (sums[to] - sums[from_] == to - from_))
    stays = np.ones(len(doc), bool)
    stays[idle] = False
    # a text by a hash of its tokens, whatever its place
    up, down = powers(_TEXT, len(tokens)), powers(_TEXT_INV, len(tokens))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[:len(tokens)])])
    text = (total[to[idle] + TOKENS - 1] - total[from_[idle]]) * down[from_[idle]]
    columns = [x.sig[idle], text, (x.root - x.a)[idle], (to - from_)[idle], doc[idle], x.a[idle]]
    order = np.lexsort(columns[::-1])
    idle, columns = idle[order], [c[order] for c in columns]
    other = np.ones(len(idle), bool)
    other[1:] = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0) if len(idle) else False
    first = other.copy()                                # of its document
    first[1:] |= columns[4][1:] != columns[4][:-1]
    rank = np.cumsum(first)
    rank -= rank[np.flatnonzero(other)][np.cumsum(other) - 1] if len(idle) else 0
    stays[idle[first & (rank < 2)]] = True
    stays = np.flatnonzero(stays)
    return stays[np.argsort(x.row[stays], kind="stable")]


def _send_members(buckets):
    """The block's windows of open signatures by bucket, each distinct text of a
    signature once; which passages lie in known spans, and links with the hub. Of windows
    that can find nothing themselves only the partners that others need are sent."""
    def run(t, block, right):
        told = right.filter(pa.compute.is_valid(right["keys"]))
        if not told.num_rows:
            return empty(MEMBERS)
        load = lambda c, ty: np.frombuffer(b"".join(told[c].to_pylist()), ty)
        keys, hubs = load("keys", np.uint64), load("docs", np.int64)
        order = np.argsort(keys)
        keys, hubs = keys[order], hubs[order]
        known = right.filter(pa.compute.is_valid(right["doc"]))
        links = set(zip(known["doc"].to_pylist(), known["other"].to_pylist()))
        x = _Block(block, block.marked(right.filter(pa.compute.is_valid(right["doc_id"]))))
        x.keep(keys[np.minimum(np.searchsorted(keys, x.sig), len(keys) - 1)] == x.sig)
        doc, hub = block.ids[x.row], hubs[np.searchsorted(keys, x.sig)]
        both, inv = np.unique(np.stack([doc, hub]), axis=1, return_inverse=True)
        linked = np.array([d == h or (d, h) in links or (h, d) in links for d, h in both.T.tolist()], bool)[inv.ravel()]
        tokens = _Tokens(block)
        cover = _covered(tokens, block.ids, known)
        from_, to = tokens.first[x.row] + x.a, tokens.first[x.row] + x.b + 1
        kept = _worth_sending(tokens.all, cover, x, doc, linked, from_, to)
        into: dict[int, tuple] = {}
        at = bucket_of(x.sig, buckets)
        for k, sig, d, a, root, tied, i, j in zip(*(v[kept].tolist() for v in (at, x.sig, doc, x.a, x.root, linked, from_, to))):
            texts, rows, covers = into.setdefault(k, ({}, [], []))
            text = tokens.all[i:j + TOKENS - 1].tobytes()
            rows.append((sig, d, a, root - a, tied, texts.setdefault(text, len(texts))))
            covers.append(cover[i:j].tobytes())
        out = []
        for k, (texts, rows, covers) in into.items():
            sig, doc, a, before, linked, text = zip(*rows)
            pack = lambda v, ty: np.array(v, ty).tobytes()
            out.append((k, pack(sig, np.uint64), pack(doc, np.int64), pack(a, np.int32), pack(before, np.int32),
                        pack(linked, np.uint8), b"".join(covers), pack([len(v) // 8 for v in texts], np.int32),
                        pack(text, np.int32), b"".join(texts)))
        if not out:
            return empty(MEMBERS)
        schema = arrow_schema(MEMBERS)
        return pa.table([pa.array(c, f.type) for f, c in zip(schema, zip(*out))], schema=schema)
    return run


def _ranges(first: np.ndarray, size: np.ndarray):
    """Which range and which place each element of several ranges has."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + np.repeat(first - np.cumsum(size) + size, size)


def _least(t: np.ndarray) -> int:
    """Fewest different tokens of a passage."""
    return TOKENS if len(np.unique(t)) == len(t) else int(_distinct(t).min())


def _similar_somewhere(there, low, high, percent: int) -> np.ndarray:
    """Whether pairs of texts without repeated tokens have a similar passage at the same
    place. A row of ``there`` has, per column of one text, the column of the same token in
    the other text, or -1; passages may start in columns ``low`` to ``high`` - 1."""
    own, starts = np.arange(there.shape[1]), np.arange(TOKENS)
    # passages from column max - TOKENS + 1 to column min hold the token in both texts
    first = np.maximum(np.maximum(own, there) - TOKENS + 1, 0)
    last = np.minimum(np.minimum(own, there), TOKENS - 1)
    r, c = np.nonzero((there >= 0) & (first <= last))
    size = len(there) * (TOKENS + 1)
    edge = (np.bincount(r * (TOKENS + 1) + first[r, c], minlength=size)
            - np.bincount(r * (TOKENS + 1) + last[r, c] + 1, minlength=size))
    common = np.cumsum(edge.reshape(-1, TOKENS + 1), axis=1)[:, :TOKENS]
    good = (100 + percent) * common >= 2 * percent * TOKENS
    return (good & (starts >= low[:, None]) & (starts < high[:, None])).any(axis=1)


def _rarest(row, token, rank, need):
    """Of each row's different tokens those of lowest rank, so many that two rows with
    ``need`` tokens in common have one of them in common."""
    order = np.lexsort((rank[token], row))
    row, token = row[order], token[order]
    count = np.bincount(row, minlength=len(need))
    use = np.arange(len(row)) - (np.cumsum(count) - count)[row] <= (count - need)[row]
    return row[use], token[use]


def _maybe_similar(parts: list, texts: list, befores: list, only: np.ndarray, percent: int):
    """Pairs of a part (text, first passage, end) and another text that have a similar
    passage at the same place; pairs in which a text repeats a token are told apart by their
    common tokens first, then compared many at once. Texts of equal ``only`` are not compared. Of many texts only those are counted
    that share one of a part's rarest tokens: similar passages have ``percent`` of either's tokens in common, so that
    unrelated texts under a common signature cost what they hold, not their square. All passages of a signature
    hold its root, so a text has fewer than ``2 * TOKENS`` columns when the root has the
    same column in all texts."""
    size = np.array([len(t) for t in texts])
    off = np.cumsum(size) - size
    names, number = np.unique(np.concatenate(texts), return_inverse=True)
    row, _ = _ranges(off, size)
    key = np.sort(row * len(names) + number)
    once = np.ones(len(texts), bool)
    once[key[1:][key[1:] == key[:-1]] // len(names)] = False
    least = np.full(len(texts), TOKENS)
    for k in np.flatnonzero(~once).tolist():
        least[k] = _least(texts[k])
    begin = TOKENS - 1 - np.array(befores)
    column = np.arange(len(row)) - off[row] + begin[row]
    end = begin + size - TOKENS + 1
    few = int(least.min())

    def needed(n):
        return np.maximum(-(-percent * n // 100), -(-percent * (n + few) // (100 + percent)))

    many = len(texts) > CHUNK
    if many:
        key = np.unique(key)
        of, token = key // len(names), key % len(names)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(np.bincount(token, minlength=len(names)), kind="stable")] = np.arange(len(names))
        rare_of, rare = _rarest(of, token, rank, needed(least))
        order = np.argsort(rare, kind="stable")
        rare_of, rare = rare_of[order], rare[order]
    for i in range(0, len(parts), CHUNK):
        who, p, q = (np.array(v) for v in zip(*parts[i:i + CHUNK]))
        low = np.array([TOKENS if once[k] else _least(texts[k][x:y + TOKENS - 1]) for k, x, y in parts[i:i + CHUNK]])
        part, at = _ranges(off[who] + p, q - p + TOKENS - 1)
        used, local = np.unique(number[at], return_inverse=True)
        grid = np.full((len(who), 2 * TOKENS - 1), len(used))
        grid[part, column[at]] = local
        left = np.zeros((len(who), len(used) + 1), np.float32)
        left[part, local] = 1
        mine = np.full(len(names), len(used))
        mine[used] = np.arange(len(used))
        near = np.arange(len(texts))
        if many:
            k, held = np.nonzero(left)
            k, held = _rarest(k, used[held], rank, needed(low))
            from_, to = np.searchsorted(rare, held), np.searchsorted(rare, held, "right")
            if (to - from_).sum() <= NEAR_AT_ONCE:
                of, at = _ranges(from_, to - from_)
                near = np.unique(rare_of[at][only[who[k[of]]] != only[rare_of[at]]])
        j = 0
        while j < len(near):                            # whole ranges of CHUNK texts
            stop = int(np.searchsorted(near, (near[min(j + CHUNK, len(near)) - 1] // CHUNK + 1) * CHUNK))
            some, j = near[j:stop], stop
            of, at = _ranges(off[some], size[some])
            token = mine[number[at]]
            hit = token < len(used)
            place = np.full((len(some), len(used) + 1), -1, np.int8)
            place[of[hit], token[hit]] = column[at][hit]
            need = percent * (low[:, None] + least[None, some])
            a, b = np.nonzero((100 + percent) * (left @ (place >= 0).astype(np.float32).T) >= need)
            other = only[who[a]] != only[some[b]]
            a, b = a[other], b[other]
            keep = np.ones(len(a), bool)
            sure = np.flatnonzero(once[who[a]] & once[some[b]])
            x, y = a[sure], b[sure]
            for k in range(0, len(sure), PAIRS_AT_ONCE):
                m, o = x[k:k + PAIRS_AT_ONCE], y[k:k + PAIRS_AT_ONCE]
                keep[sure[k:k + PAIRS_AT_ONCE]] = _similar_somewhere(
                    place[o[:, None], grid[m]], np.maximum(begin[who[m]] + p[m], begin[some[o]]),
                    np.minimum(begin[who[m]] + q[m], end[some[o]]), percent)
            open_ = np.flatnonzero(~(once[who[a]] & once[some[b]]))
            keep[open_] = _similar_in_part(number, off, size, np.array(befores), who[a[open_]], p[a[open_]], q[a[open_]], some[b[open_]], percent)
            a, b = a[keep], some[b[keep]]
            order = np.lexsort((b, a, b // CHUNK))
            yield from zip((a[order] + i).tolist(), b[order].tolist())


def _similar_in_part(tokens, off, size, befores, i, low, high, j, percent: int) -> np.ndarray:
    """Whether texts ``i`` have, among passages ``low`` to ``high`` - 1, one similar to that
    at the same place of texts ``j``."""
    first = np.maximum(low - befores[i], -befores[j])
    a, b = first + befores[i], first + befores[j]
    n = np.minimum(high - a, size[j] - TOKENS + 1 - b) + TOKENS - 1
    out = np.zeros(len(i), bool)
    todo = np.flatnonzero(n >= TOKENS)
    ends = np.cumsum(n[todo])
    k = 0
    while k < len(todo):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + TOKENS_AT_ONCE, "right")))
        part = todo[k:stop]
        which, x = _ranges((off[i] + a)[part], n[part])
        z = _ranges((off[j] + b)[part], n[part])[1]
        good = similar_in_pairs(tokens[x], tokens[z], n[part], percent)
        out[part[which[good]]] = True
        k = stop
    return out


def _compare_all(texts, befores, places, percent):
    """Spans (doc, partner, start, end) of one signature's distinct texts, whose
    first passage lies ``before`` tokens ahead of the root; ``places``: (doc, start,
    passages in known spans, link with the hub) of each text."""
    out = []
    group: dict[int, int] = {}

    def top(d):
        while group.setdefault(d, d) != d:
            group[d] = group[group[d]]
            d = group[d]
        return d

    main = None
    for p in places:
        for d, _, _, linked in p:
            if linked:
                main = d if main is None else main
                group[top(d)] = top(main)
    docs = [sorted({d for d, *_ in p}) for p in places]
    covered = []
    for k, p in enumerate(places):
        n = len(texts[k]) - TOKENS + 1
        if len(docs[k]) == 1:
            covered.append(np.all([c for _, _, c, _ in p], axis=0))
            continue
        covered.append(np.ones(n, bool))
        for d, a, c, _ in p:
            if not c.all() or top(d) != top(docs[k][0]):
                group[top(d)] = top(docs[k][0])
                out.append((d, docs[k][0] if d != docs[k][0] else docs[k][1], a, a + n - 1 + WORDS))
    # what may still find something: texts without a link, and uncovered passages
    parts = []
    for k, c in enumerate(covered):
        apart = main is None or top(docs[k][0]) != top(main)
        parts += [(k, p, q) for p, q in ([(0, len(c))] if apart else _runs(~c))]
    if not parts or len(texts) < 2:
        return out
    # the number of a text's document, or a number of its own if it is in several
    only = np.unique([d[0] for d in docs], return_inverse=True)[1]
    only = np.where([len(d) > 1 for d in docs], len(docs) + np.arange(len(docs)), only)
    met: dict[tuple, list] = {}             # places at which a pair of texts has been compared
    for part, j in _maybe_similar(parts, texts, befores, only, percent):
        i, p0, p1 = parts[part]
        first = max(p0 - befores[i], -befores[j])
        a, b = first + befores[i], first + befores[j]
        n = min(p1 - a, len(covered[j]) - b)
        before = met.setdefault((min(i, j), max(i, j)), [])
        if n <= 0 or any(x <= first and first + n <= y for x, y in before):
            continue
        before.append((first, first + n))
        tied = top(docs[i][0]) == top(docs[j][0])
        if tied:
            need = np.flatnonzero(~(covered[i][a:a + n] & covered[j][b:b + n]))
            if not len(need):
                continue
            a, b, n = a + int(need[0]), b + int(need[0]), int(need[-1] - need[0]) + 1
        good = similar_passages(texts[i][a:a + n + TOKENS - 1], texts[j][b:b + n + TOKENS - 1], percent)
        if not good.any():
            continue
        for k, at, other in ((i, a, j), (j, b, i)):
            fresh = good & ~covered[k][at:at + n]
            covered[k][at:at + n] |= good
            for d, start, *_ in places[k]:
                partner = next((o for o in docs[other] if o != d), None)
                if partner is not None:
                    out += [(d, partner, start + at + p, start + at + q - 1 + WORDS) for p, q in _runs(fresh)]
        if not tied:
            d, start = places[i][0][:2]
            partner = next((o for o in docs[j] if o != d), None)
            p, q = _runs(good)[0]
            if partner is not None:
                out.append((d, partner, start + a + p, start + a + q - 1 + WORDS))
            group[top(docs[j][0])] = top(docs[i][0])
    return out


def _settle(percent):
    def run(key, table):
        groups: dict[int, dict] = {}
        for k in range(table.num_rows):         # one block's rows in Python at a time
            row = table.slice(k, 1).to_pylist()[0]
            load = lambda c, ty: np.frombuffer(row[c], ty).tolist()
            cut = np.concatenate([[0], np.cumsum(load("sizes", np.int32))]) * 8
            texts = [row["tokens"][a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            covers, at = np.frombuffer(row["covers"], np.uint8) > 0, 0
            for sig, doc, a, before, linked, text in zip(
                    load("sigs", np.uint64), load("docs", np.int64), load("starts", np.int32), load("befores", np.int32),
                    load("linked", np.uint8), load("texts", np.int32)):
                n = len(texts[text]) // 8 - TOKENS + 1
                groups.setdefault(sig, {}).setdefault((texts[text], before), []).append((doc, a, covers[at:at + n], linked))
                at += n
        found = set()
        for members in groups.values():
            members = {m: sorted(members[m], key=lambda p: p[:2]) for m in sorted(members)}
            found.update(_compare_all([np.frombuffer(t, np.uint64) for t, _ in members], [b for _, b in members],
                                      list(members.values()), percent))
        if not found:
            return empty(FOUND)
        schema = arrow_schema(FOUND)
        rows = [(0, None, *f, None) for f in sorted(found)]
        return pa.table([pa.array(c, f.type) for f, c in zip(schema, zip(*rows))], schema=schema)
    return run


def _count_words(batches):
    for batch in batches:
        data, off = buffers(batch["text"])
        n = np.concatenate([np.diff(Words(data, off[i:j + 1]).first) for i, j in slices(off)] or [np.zeros(0, int)])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["own"], pa.array(n.astype(np.int64))], ["doc_id", "own", "n_words"])


def shared_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, class_id (smallest id of its class), n_links (hubs
    and members verified with it), n_spans, n_shared_words, spans ("first:end" word
    offsets of the passages shared with other documents)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "passages")
    docs = text_frame(df, id_col, text_col)
    table = BlockTable(docs, scratch, block_bytes, 1)
    try:
        out = _classes(table, scratch, docs, percent)
        return scratch.save(out, "out")
    finally:
        table.drop()
        scratch.drop("steps")


def _null(t):
    return F.lit(None).cast(t)


def _with_marks(frame: DataFrame, marks: DataFrame, ddl: str) -> DataFrame:
    """Rows of ``frame`` and of ``marks``, each with nulls for the other's columns."""
    cols = [tuple(c.split()) for c in ddl.split(", ")]
    return (frame.select("block", _null("bigint").alias("doc_id"), _null("bigint").alias("own"),
                         *[F.col(c) if c in frame.columns else _null(t).alias(c) for c, t in cols])
            .unionAll(marks.select("block", "doc_id", "own", *[_null(t).alias(c) for c, t in cols])))


def _classes(table: BlockTable, scratch: Scratch, docs: DataFrame, percent: int) -> DataFrame:
    buckets = max(1, table.bytes >> 22)
    marks = table.marks
    told = scratch.save(table.step(marks, _ask_signatures(buckets), ASKED).groupBy("bucket")
                        .applyInArrow(answer(1 << 62), ANSWERED), "steps/asked")
    offers = table.step(_with_marks(told, marks, "bucket int, keys binary, hot binary"), _offer_hubs(buckets), HUBS)
    hubs = scratch.save(offers.groupBy("bucket").applyInArrow(_tell_hubs, TOLD), "steps/hubs")
    cols = "keys binary, docs binary, hub_blocks binary, roots binary"
    requests = scratch.save(table.step(_with_marks(hubs, marks, cols), _request(buckets), REQUESTS), "steps/requests")
    sent = table.step(_with_marks(requests.where("kind = 0"), marks, "asker int, hub bigint, lo int, hi int"),
                      _send_passages, PASSAGES)
    got = (sent.withColumn("hits", _null("binary"))
           .unionAll(requests.where("kind = 1").select("block", _null("bigint"), _null("int"), _null("binary"), "hits")))
    result = scratch.save(table.step(got, _verify(percent, buckets), FOUND), "steps/found")
    opened = (result.where("kind = 1").select(F.col("block").alias("bucket"), "open")
              .unionAll(requests.where("kind = 2").select("block", "hits")))
    asked = hubs.select("bucket", "block", "keys", "docs").groupBy("bucket").cogroup(opened.groupBy("bucket")).applyInArrow(_tell_open, OPEN)
    known = result.where("kind = 0").select(table.block_of("doc"), "doc", "other", "start", "stop").distinct()
    cols = "keys binary, docs binary, doc bigint, other bigint, start int, stop int"
    members = table.step(_with_marks(asked.unionByName(known, allowMissingColumns=True), marks, cols), _send_members(buckets), MEMBERS)
    settled = scratch.save(members.groupBy("bucket").applyInArrow(_settle(percent), FOUND), "steps/settled")
    spans = result.where("kind = 0").unionAll(settled)
    links = spans.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()
    comp = connected_components(links, scratch, "steps/cc")
    merged = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "stop"))), F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["stop"] >= x["start"]),
                              F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                                       F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"),
                                                        F.greatest(F.get(acc, F.size(acc) - 1)["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(x))))
    per = spans.groupBy("doc").agg(merged.alias("spans"))
    degree = (links.select(F.col("a").alias("doc")).unionAll(links.select(F.col("b").alias("doc")))
              .groupBy("doc").agg(F.count(F.lit(1)).alias("n_links")))
    # every document, and the one that stands for its text
    words = docs.withColumn("own", F.xxhash64("text")).mapInArrow(_count_words, "doc_id bigint, own bigint, n_words bigint")
    words = scratch.save(words, "steps/words")
    copies = table.copies.select("doc_id", "own", "first").distinct()
    every = words.join(copies, ["doc_id", "own"], "left").withColumn("rep", F.coalesce("first", "doc_id"))
    # an id that several texts carry, or a copy of several classes, ties them
    ties = every.where("first < doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    shared_ids = words.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.countDistinct("own").alias("k")).where("k > 1")
    ties = ties.join(shared_ids.select(F.col("doc_id").alias("a")), "a", "left_semi")
    if not ties.isEmpty():
        comp = connected_components(links.unionAll(ties), scratch, "steps/ties")
    comp = comp.withColumnRenamed("id", "rep")
    whole = F.col("first").isNotNull() & (F.col("n_words") >= WORDS)
    one = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    own_spans = per.withColumnRenamed("doc", "rep")
    out = (every.join(own_spans, "rep", "left").join(comp, "rep", "left")
           .join(degree.withColumnRenamed("doc", "rep"), "rep", "left"))
    sp = F.when(whole, one).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")))
    out = out.select("doc_id", "n_words", F.coalesce("component", "rep").alias("class_id"),
                     F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), sp.alias("sp"))
    return out.select(
        "doc_id", "n_words", "class_id", "n_links", F.size("sp").cast("long").alias("n_spans"),
        F.aggregate("sp", F.lit(0), lambda acc, x: acc + x["stop"] - x["start"]).cast("long").alias("n_shared_words"),
        F.array_join(F.transform("sp", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("spans"))
