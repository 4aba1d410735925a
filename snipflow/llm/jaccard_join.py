"""Similar documents by a Jaccard join on word n-grams, with token-combination prefixes.

A document is its set of distinct word shingles (ASCII letters in lower case; with
fewer words than a shingle the whole sequence is one). Two sets link when their
Jaccard similarity reaches the threshold; documents get the component of the links.

Tokens (shingles) stand in one global order: by document frequency, then by hash. A
set of ``n`` tokens may lack ``slack = n - ceil(t * n)`` of them in a partner. A token
class of ``k`` holds the tokens of a range of frequencies: rare ones (``k`` = 1) are
index keys by themselves, frequent ones (``k`` = 2 or 3) only as combinations of ``k``
tokens. The first ``k - 1`` tokens of a class may be shared without a shared
combination, so the prefix is extended by them: it ends at the ``slack + 1``-th token
that is not among the first ``k - 1`` of its class. A linked pair then shares, in the
shorter prefix, at least one token more than all classes allow, hence ``k`` tokens of
some class, hence a key. Classes are split by hash into subclasses whose number
follows the set's size (``SUBCLASS`` tokens each), so combinations stay linear in it; a
set whose partners may fall into the next power of two gives keys for both.

1. Texts are dealt to blocks. Blocks send their distinct tokens, packed, to buckets
   that sum document frequencies and send back those of 2 and more. One exchange of
   the texts serves both steps. Tokens of one document only match nothing but use up
   slack: a set with more than ``slack`` of them has no partner and leaves here.
2. Equal sets (128-bit digest) are one class with its smallest id as representative.
3. Keys of at least two classes give candidates; of keys with the same classes one is
   kept. First every member of a key is verified against the key's first member on the
   full sets; components of these links settle groups of near copies with one
   comparison per member.
4. For keys that hold several components, what stands outside the key's largest one is
   verified against that component, and against all else outside, on the full sets:
   they meet in chunks of bounded size, which count common tokens through an inverted
   index and give out links only. No key, candidate or partner is capped.

Blocks grow with the input (``_block_bytes``), which keeps packed rows long.

Defined results: null ids are kept, linked with nothing, and have a null component;
rows that repeat an id with different texts link their classes; null and empty texts
have zero shingles and stay alone; other columns stay aside; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snipflow.llm.blocks import arrow_schema, bucket_of, empty
from snipflow.llm.common import buffers, mix, slices, text_frame
from snipflow.llm.components import connected_components
from snipflow.llm.minhash_dedup import LINKS, links_of, shingle_sets
from snipflow.session import Scratch

RARE, COMMON = 64, 4096       # document frequencies up to which k is 1, and 2
SUBCLASS = 16
BUCKET_BYTES = 32 << 20       # of text whose tokens one bucket counts
CHUNK_ITEMS = 200_000         # tokens of documents that a task compares with as many others

ASKED = "bucket int, block int, keys binary, counts binary"
ANSWERED = "block int, keys binary, high binary, dfs binary"
SETS = "doc_id bigint, n bigint, cls binary, keys binary, items binary"


def _block_bytes(total: int) -> int:
    """Bytes of text in a block: 8 MB, growing with the input to 64 MB."""
    return min(64 << 20, max(8 << 20, total >> 18))


def slack_of(n, threshold: int):
    return n - (threshold * n + 99) // 100


def can_link(n, threshold: int):
    """Whether a set of this size can reach the threshold with a different one."""
    return 100 * n >= threshold * (n + 1)


class _Sets:
    """Token sets of a block's rows; ``lead``: rows with an id that come first among equal sets."""

    def __init__(self, table: pa.Table, width: int, threshold: int):
        table = table.combine_chunks()
        data, off = buffers(table["text"])
        parts = [shingle_sets(data, off[i:j + 1], width) for i, j in slices(off)]
        self.items = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.n = np.concatenate([np.diff(c) for _, c in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        rows = len(self.n)
        self.ids = table["doc_id"]
        valid = ~np.asarray(self.ids.is_null().to_numpy(zero_copy_only=False), bool)
        full = np.flatnonzero(self.n)
        self.digest = np.zeros((rows, 2), np.uint64)
        if len(full):
            starts = self.first[:-1][full]
            self.digest[full, 0] = np.add.reduceat(mix(self.items), starts)
            self.digest[full, 1] = np.add.reduceat(mix(self.items ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
            self.digest[full, 1] ^= mix(self.n[full].astype(np.uint64))
        self.named = valid & (self.n > 0)
        self.lead = np.zeros(rows, bool)
        some = np.flatnonzero(self.named)
        ids = self.ids.fill_null(0).to_numpy()
        order = some[np.lexsort((ids[some], self.digest[some, 1], self.digest[some, 0]))]
        if len(order):
            d = self.digest[order]
            self.lead[order[np.concatenate([[True], (d[1:] != d[:-1]).any(1)])]] = True
        self.lead &= can_link(self.n, threshold)

    def rows(self):
        return [self.items[a:b] for a, b in zip(self.first[:-1], self.first[1:])]


def _ask(width: int, threshold: int, buckets: int):
    def run(key, table):
        s = _Sets(table, width, threshold)
        tokens, count = np.unique(s.items[np.repeat(s.lead, s.n)], return_counts=True)
        cut = np.searchsorted(bucket_of(tokens, buckets), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        low, count = tokens.astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "block": pa.array(np.full(len(some), key[0].as_py()), pa.int32()),
            "keys": pa.array([low[cut[k]:cut[k + 1]].tobytes() for k in some], pa.binary()),
            "counts": pa.array([count[cut[k]:cut[k + 1]].tobytes() for k in some], pa.binary())}, schema=arrow_schema(ASKED))
    return run


def _answer(key, table):
    """Keys that occur more than once, with their frequency, to each block that asked for them."""
    keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table["counts"].to_pylist()])
    uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(inv, counts, len(uniq)).astype(np.uint32)
    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    out = []
    for k, own in enumerate(keys):
        mine = df[inv[cut[k]:cut[k + 1]]]
        use = mine > 1
        out.append((own[use].tobytes(), np.full(int(use.sum()), key[0].as_py(), np.uint32).tobytes(), mine[use].tobytes()))
    return pa.table({"block": table["block"], **{c: pa.array([x[i] for x in out], pa.binary())
                                                 for i, c in enumerate(("keys", "high", "dfs"))}}, schema=arrow_schema(ANSWERED))


def _frequencies(items: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    low, high, df = (np.concatenate([np.frombuffer(x, np.uint32) for x in answers[c].to_pylist()] or [np.zeros(0, np.uint32)])
                     for c in ("keys", "high", "dfs"))
    out = np.ones(len(items), np.int64)
    if len(low):
        known = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        order = np.argsort(known)
        known, df = known[order], df[order]
        k = (items & np.uint64(0xFFFFFFFF)) | (bucket_of(items, buckets).astype(np.uint64) << np.uint64(32))
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        hit = known[at] == k
        out[hit] = df[at[hit]]
    return out


_SALT = mix(np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def index_keys(tokens: np.ndarray, df: np.ndarray, threshold: int) -> np.ndarray:
    """Index keys of a set: single tokens and combinations of its extended prefix.

    Two sets that reach the threshold share a key if ``df`` is the same function of
    the token for both and no token of theirs in common has a ``df`` of 1."""
    n = len(tokens)
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    k = 1 + (df > RARE) + (df > COMMON)
    need = slack_of(n, threshold) + 1
    out = []
    band = n.bit_length() - 1
    for b in {band, (100 * n // threshold).bit_length() - 1}:
        groups = max(1, (1 << b) // SUBCLASS)
        sub = np.where(k == 1, np.uint64(0), (k - 1).astype(np.uint64) * np.uint64(groups) + tokens % np.uint64(groups) + np.uint64(1))
        by_sub = np.argsort(sub, kind="stable")
        start = np.concatenate([[True], sub[by_sub][1:] != sub[by_sub][:-1]])
        rank = np.empty(n, np.int64)
        rank[by_sub] = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
        end = int(np.searchsorted(np.cumsum((k == 1) | (rank >= k - 1)), need)) + 1
        single = (k[:end] == 1) & (df[:end] > 1)
        out.append(mix(tokens[:end][single] ^ _SALT[0]))
        inside = by_sub[(by_sub < end) & (k[by_sub] > 1)]       # by subclass, in token order
        if len(inside):
            cut = np.flatnonzero(np.concatenate([[True], sub[inside][1:] != sub[inside][:-1]]))
            salted = mix(tokens ^ _SALT[1 + b])
            for part in np.split(inside, cut[1:]):
                size = int(k[part[0]])
                if len(part) >= size:
                    pick = np.array(list(combinations(range(len(part)), size)))
                    key = salted[part[pick[:, 0]]]
                    for c in range(1, size):
                        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + salted[part[pick[:, c]]])
                    out.append(key)
    # Sets so small that their classes may use up the whole set: single tokens only.
    least = 400 // threshold                    # t * n >= 4 leaves a token beyond 0 + 1 + 2
    if n <= 100 * least // threshold:
        plain = tokens[:need]
        out.append(mix(plain[df[:need] > 1] ^ _SALT[-1]))
    return np.unique(np.concatenate(out))


def _set_rows(width: int, threshold: int, buckets: int):
    def run(key, left, right):
        if left.num_rows == 0:
            return empty(SETS)
        s = _Sets(left, width, threshold)
        df = _frequencies(s.items, right.combine_chunks(), buckets)
        doc = np.repeat(np.arange(len(s.n)), s.n)
        single = np.bincount(doc, df == 1, len(s.n))
        alive = s.lead & (single <= slack_of(s.n, threshold))
        keys, items = [None] * len(s.n), [None] * len(s.n)
        for r in np.flatnonzero(alive):
            own = slice(s.first[r], s.first[r + 1])
            keys[r] = index_keys(s.items[own], df[own], threshold).tobytes()
            items[r] = s.items[own].tobytes()
        return pa.table({"doc_id": s.ids, "n": pa.array(s.n.astype(np.int64)),
                         "cls": pa.array([d.tobytes() if k else None for d, k in zip(s.digest, s.named)], pa.binary()),
                         "keys": pa.array(keys, pa.binary()), "items": pa.array(items, pa.binary())}, schema=arrow_schema(SETS))
    return run


KEYS = "key bigint, cls binary, rep bigint, n bigint"


def _key_rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            keys = [np.frombuffer(x, np.int64) for x in part["keys"].to_pylist()]
            to = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[part[c].take(to) for c in ("cls", "rep", "n")]],
                                             ["key", "cls", "rep", "n"])


def _verified(threshold: int):
    """Ids (a, b) of pairs whose sets reach the threshold."""
    def run(batches):
        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            near = np.zeros(len(a), bool)
            for r, (x, y) in enumerate(zip(batch["x_items"].to_pylist(), batch["y_items"].to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                near[r] = 100 * common >= threshold * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])
    return run


def _chunks(weight):
    return F.ceil(weight / CHUNK_ITEMS).cast("int")


def _bundled(rows: DataFrame, cluster: str, whole, a: str, b: str) -> DataFrame:
    """Group columns: small clusters share groups of about a chunk, others have one per (a, b)."""
    w = rows.where(whole).agg(F.sum("n")).first()[0] or 0
    share = F.pmod(F.xxhash64(cluster), F.lit(int(w // CHUNK_ITEMS) + 1))
    return (rows.withColumn("g", F.when(whole, share).otherwise(F.lit(-1))).withColumn("g0", F.when(whole, F.lit(None)).otherwise(F.col(cluster)))
            .withColumn("g1", F.col(a)).withColumn("g2", F.col(b)))


def _among_outside(outside: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """Links between members of a key that all stand outside its main component.

    A key with many of them is cut into chunks that meet in pairs."""
    per_key = (outside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), _chunks(F.sum("n")).alias("chunks"))
               .where("lo <> hi").select("key", "chunks"))
    rows = outside.join(per_key, "key").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunks = 1 OR other <> chunk")
    rows = rows.withColumn("one", F.least("chunk", "other")).withColumn("two", F.greatest("chunk", "other"))
    rows = _bundled(rows, "key", F.col("chunks") == 1, "one", "two").join(items, "cls")
    return (rows.select("g", "g0", "g1", "g2", F.col("key").alias("cluster"), "rep", "items", F.lit(False).alias("asking"))
            .groupBy("g", "g0", "g1", "g2").applyInArrow(_counted(threshold, False), "a bigint, b bigint"))


def _against_main(outside: DataFrame, member: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """Links between members outside a key's main component and that component, whose
    members and those outside are both cut into chunks."""
    asking = outside.select("cls", "rep", "n", F.col("main").alias("cluster")).distinct()
    askers = asking.groupBy("cluster").agg(_chunks(F.sum("n")).alias("blocks"))
    size = (member.join(askers, F.col("comp") == F.col("cluster")).groupBy("cluster", "blocks")
            .agg(_chunks(F.sum("n")).alias("chunks")))
    own = (member.join(size, F.col("comp") == F.col("cluster"))
           .withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
           .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asking", F.lit(False)))
    asking = (asking.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asking", F.lit(True)))
    columns = ["cls", "rep", "n", "cluster", "chunk", "block", "chunks", "blocks", "asking"]
    rows = own.select(*columns).unionByName(asking.select(*columns))
    rows = _bundled(rows, "cluster", (F.col("chunks") == 1) & (F.col("blocks") == 1), "chunk", "block").join(items, "cls")
    return (rows.select("g", "g0", "g1", "g2", "cluster", "rep", "items", "asking")
            .groupBy("g", "g0", "g1", "g2").applyInArrow(_counted(threshold, True), "a bigint, b bigint"))


def _counted(threshold: int, asked: bool):
    """Links within each cluster of a group by counting common tokens; with ``asked``
    only between rows that ask and rows that do not."""
    def run(table):
        table = table.combine_chunks()
        asking = np.array(table["asking"].to_pylist(), bool)
        sets = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        tied = ~asking if asked else np.zeros(len(asking), bool)
        got, _ = links_of(table["rep"].to_numpy(), table["cluster"].to_numpy(), sets, threshold, tied, asking if asked else None)
        return pa.table([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], schema=LINKS)
    return run


def _multiple(keys: DataFrame) -> DataFrame:
    """Rows of keys that at least two classes share; of keys with the same classes, one."""
    keys = keys.repartition("key")
    per_key = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x1"),
                                      F.bit_xor(F.xxhash64(F.lit(1), F.col("cls"))).alias("x2")).where("m > 1")
    once = per_key.groupBy("m", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    return keys.join(once, "key", "left_semi")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      width: int = 4, threshold: int = 85, known: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id linked,
    directly or through others, itself included). ``threshold`` in percent.

    ``known``: links (a, b) that are confirmed already, between smallest ids of equal
    sets; only pairs that they do not tie together are verified."""
    scratch = Scratch(df.sparkSession, "jaccard")
    docs = text_frame(df, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = math.ceil(total / _block_bytes(total)) + 1, math.ceil(total / BUCKET_BYTES) + 1
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    asked = texts.groupBy("block").applyInArrow(_ask(width, threshold, buckets), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(_answer, ANSWERED)
    sets = texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_set_rows(width, threshold, buckets), SETS)
    sets = scratch.save(sets, "sets")

    classes = scratch.save(sets.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep")), "classes")
    reps = (sets.where("items IS NOT NULL").join(classes.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"], "left_semi")
            .dropDuplicates(["cls"]).select("cls", F.col("doc_id").alias("rep"), "n", "keys", "items"))
    reps = scratch.save(reps, "reps")
    keys = scratch.save(_multiple(reps.where("length(keys) > 0").mapInArrow(_key_rows, KEYS)), "keys")
    items = reps.select("cls", "items")

    def links(pairs: DataFrame) -> DataFrame:
        """Verified (a, b) of candidate pairs (x, y: classes; a, b: their ids)."""
        full = (pairs.join(items.select(F.col("cls").alias("x"), F.col("items").alias("x_items")), "x")
                .join(items.select(F.col("cls").alias("y"), F.col("items").alias("y_items")), "y"))
        return full.select("a", "b", "x_items", "y_items").mapInArrow(_verified(threshold), "a bigint, b bigint")

    def sized(x: str, y: str):
        return ((F.col(f"{x}.n") * 100 >= F.col(f"{y}.n") * threshold) & (F.col(f"{y}.n") * 100 >= F.col(f"{x}.n") * threshold))

    def pair(x: str, y: str):
        """The pair under one order of its classes."""
        swap = F.col(f"{x}.cls") > F.col(f"{y}.cls")
        both = [(f"{x}.{c}", f"{y}.{c}") for c in ("cls", "rep")]
        return [F.when(swap, F.col(c[1 - k])).otherwise(F.col(c[k])).alias(name)
                for c, names in zip(both, ("xy", "ab")) for k, name in enumerate(names)]

    def with_component(rows: DataFrame, settled: DataFrame) -> DataFrame:
        return (rows.join(settled, F.col("rep") == F.col("id"), "left")
                .withColumn("comp", F.coalesce("component", "rep")).drop("id", "component"))

    # First: every member of a key with the key's first member.
    held = keys.withColumn("comp", F.col("rep"))
    if known is not None:
        tied = scratch.save(connected_components(known, scratch, "known"), "tied")
        held = scratch.save(with_component(keys, tied), "held")
    hubs = held.groupBy("key").agg(F.min(F.struct("rep", "cls", "n", "comp")).alias("h")).select("key", "h.*")
    tried = (held.alias("x").join(hubs.alias("y"), "key").where((F.col("x.comp") != F.col("y.comp")) & sized("x", "y"))
             .select(*pair("x", "y")).distinct())
    first = links(tried)
    first = scratch.save(first if known is None else first.unionByName(known.select("a", "b")), "first")
    settled = scratch.save(connected_components(first, scratch, "settled"), "settled")

    # Then: what stands outside the largest component of its key, the main one.
    member = scratch.save(with_component(keys, settled), "members")
    held = member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = held.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    outside = scratch.save(member.join(main, "key").where("comp <> main").select("key", "cls", "rep", "n", "comp", "main"), "outside")
    found = first.unionByName(_among_outside(outside, items, threshold)).unionByName(
        _against_main(outside, with_component(reps.select("cls", "rep", "n"), settled), items, threshold))
    found = scratch.save(found, "links")

    # Ids with several texts tie their classes.
    several = (sets.where("cls IS NOT NULL").groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
               .where("lo <> hi").select("doc_id"))
    ties = (sets.where("cls IS NOT NULL").select("doc_id", "cls").join(several, "doc_id").join(classes, "cls")
            .where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = connected_components(found.unionByName(ties), scratch, "final")
    named = (classes.join(final, F.col("rep") == F.col("id"), "left")
             .select("cls", F.coalesce("component", "rep").alias("component_id")))
    out = sets.select("doc_id", "n", "cls").join(named, "cls", "left")
    out = scratch.save(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "out")
    scratch.drop("sets", "classes", "reps", "keys", "first", "settled", "members", "outside", "links", "tied", "held")
    return out
