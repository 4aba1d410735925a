"""Ranked lexical search by the Best Position Algorithm.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, ASCII
letters in lower case. A document's score for an item is the sum, over the item's
terms with repeats, of the term's weight times the document's impact for it; both
are whole numbers (see ``impact`` and ``weight``).

1. One pass over the texts keeps each document's number of terms and its counts of
   the items' terms. The corpus figures (documents, terms, documents per term) are
   aggregates of that table.
2. Blocks of documents are inverted into impact lists: per term, its documents by
   falling impact. Each item runs over a block's lists in rounds of doubling depth.
   A document met in one list is looked up in all others (direct access) and its
   places there are marked as seen. A list's best position is the last place up to
   which all are seen, whether by reading or by direct access. An unseen document
   scores at most the weighted sum of the impacts at the best positions; reading
   stops when that is strictly below the k-th score, so ties are never cut. The k
   best of a partition's earlier blocks set the bar for its later ones.
3. The k best of each partition meet in two aggregations by item.

Blocks are documents as they stand in the files, so a term that every document
holds is as spread out as the documents. Items are dealt by hash to passes of about
``PASS_BYTES`` of item texts; only a pass's items and their vocabulary are broadcast.

A document's words meet the vocabulary by a 64-bit hash; an occurrence of each term
found in a document is then compared byte by byte.

Defined results: null and empty texts have no terms; items without terms have no
rows; items that repeat an id with another text are searched by their own, and both
keep the id, equal ones once; rows that repeat a document's id are documents of
their own; a null document id stands last among equal scores; other columns do not
matter; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from snipflow.llm.common import _LOWER, Words, buffers, slices, text_frame
from snipflow.session import Scratch

K = 20
PASS_BYTES = 16 << 20
BLOCK_POSTINGS = 1 << 20      # postings that a task inverts at a time
FIRST_DEPTH = 16
SHARDS = 64
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())

# --- fixed values: parameters of the score ------------------------------------
IMPACT_SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE, WEIGHT_SCALE = 1_000_000_000, 1000, 12, 25, 1000
# ------------------------------------------------------------------------------

POSTINGS = "doc_id bigint, n bigint, terms binary, tfs binary"
FOUND = "item int, doc_id bigint, score bigint"


def weight(docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Impact of a term that a document of ``n`` terms holds ``tf`` times."""
    if len(n) and int(n.max()) * LENGTH_SHARE * docs >= 1 << 63:
        n = n.astype(object)
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * docs * n // total).astype(np.int64)
    return IMPACT_SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m)


class Vocabulary:
    """Distinct terms of some items in hash order, and the items as term counts."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8") for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        w = Words(data, off, also=SEPARATORS)
        self.hash, first, term = np.unique(w.hash, return_index=True, return_inverse=True)
        self.start, self.size, self.data = w.start[first], (w.end - w.start)[first], data
        pair, self.count = np.unique(w.doc * max(1, len(self.hash)) + term, return_counts=True)
        item, self.term = np.divmod(pair, max(1, len(self.hash)))
        self.first = np.searchsorted(item, np.arange(len(texts) + 1))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .., in one array."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _term_counts(data: np.ndarray, off: np.ndarray, vocab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each row of a slice, and (row, term, count) of the vocabulary's."""
    hashes, v_start, v_size, v_data, bits = vocab
    low = _LOWER[data[int(off[0]):int(off[-1])]]
    w = Words(low, off - off[0], also=SEPARATORS)
    n = np.diff(w.first)
    at = (w.hash >> np.uint64(44)).astype(np.int64)
    cand = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
    term = np.minimum(np.searchsorted(hashes, w.hash[cand]), max(0, len(hashes) - 1))
    hit = hashes[term] == w.hash[cand] if len(hashes) else np.zeros(len(cand), bool)
    cand, term = cand[hit], term[hit]
    pair, first, count = np.unique(w.doc[cand] * max(1, len(hashes)) + term, return_index=True, return_counts=True)
    row, term = np.divmod(pair, max(1, len(hashes)))
    begin, size = w.start[cand[first]], (w.end - w.start)[cand[first]]
    same = size == v_size[term]
    row, term, count, begin, size = row[same], term[same], count[same], begin[same], size[same]
    if len(size):
        differ = low[_ranges(begin, size)] != v_data[_ranges(v_start[term], size)]
        same = np.add.reduceat(differ, np.cumsum(size) - size) == 0
        row, term, count = row[same], term[same], count[same]
    return n, row, term, count


def _posting_rows(vocab):
    def run(batches):
        v = vocab.value
        for batch in batches:
            data, off = buffers(batch["text"])
            for i, j in slices(off):
                n, row, term, count = _term_counts(data, off[i:j + 1], v)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                term, count = term.astype(np.uint32), count.astype(np.uint32)
                full = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i).take(pa.array(full)), pa.array(n[full]),
                     pa.array([term[cut[k]:cut[k + 1]].tobytes() for k in full], pa.binary()),
                     pa.array([count[cut[k]:cut[k + 1]].tobytes() for k in full], pa.binary())],
                    ["doc_id", "n", "terms", "tfs"])
    return run


def _joined(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).astype(np.int64)


def _document_counts(size: int):
    """(term, number of documents) per partition."""
    def run(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(_joined(batch["terms"]), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "df"])
    return run


class ImpactLists:
    """Impact lists of a block of documents: places ``first[t] .. first[t + 1]`` hold
    the documents of term ``t`` by falling impact."""

    def __init__(self, doc_at: np.ndarray, term: np.ndarray, impacts: np.ndarray, docs: int, terms: int):
        order = np.lexsort((doc_at, -impacts, term))
        self.doc, self.impact = doc_at[order], impacts[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        # direct access: the places of a document in all lists
        by_doc = np.argsort(self.doc, kind="stable")
        self.place, self.term = by_doc, term[order][by_doc]
        self.doc_first = np.searchsorted(self.doc[by_doc], np.arange(docs + 1))
        self.seen, self.met = np.zeros(len(order), bool), np.zeros(docs, bool)
        self.factor = np.zeros(terms, np.int64)

    def search(self, terms: np.ndarray, factors: np.ndarray, ids: np.ndarray, best, k: int):
        """The ``k`` best of ``best`` (scores, ids) and this block for a weighted set
        of terms, and the number of places read. ``ids``: ids by document row."""
        start, end = self.first[terms], self.first[terms + 1]
        some = (end > start) & (factors > 0)
        terms, factors, start, end = terms[some], factors[some], start[some], end[some]
        self.factor[terms] = factors
        position, depth, step, read = start.copy(), 0, FIRST_DEPTH, 0
        touched, met = [], []
        while len(terms):
            lo, hi = np.minimum(start + depth, end), np.minimum(start + depth + step, end)
            docs = np.unique(self.doc[_ranges(lo, hi - lo)])
            read += int((hi - lo).sum())
            docs = docs[~self.met[docs]]
            if len(docs):
                self.met[docs] = True
                met.append(docs)
                # direct accesses: all places of these documents in the item's lists
                n = self.doc_first[docs + 1] - self.doc_first[docs]
                at = _ranges(self.doc_first[docs], n)
                owner = np.repeat(np.arange(len(docs)), n)
                use = self.factor[self.term[at]] > 0
                at, owner = at[use], owner[use]
                place = self.place[at]
                score = np.zeros(len(docs), np.int64)
                np.add.at(score, owner, self.factor[self.term[at]] * self.impact[place])
                self.seen[place] = True
                touched.append(place)
                best = top(np.concatenate([best[0], score]), np.concatenate([best[1], ids[docs]]), k)
            depth, step = depth + step, step * 2
            bound = 0
            for t in range(len(terms)):
                p, e = position[t], end[t]
                if p < e:
                    ahead = self.seen[p:e]
                    gap = int(ahead.argmin())
                    position[t] = p = e if ahead[gap] else p + gap
                if p < e:                       # the list goes on: nothing unseen in it beats its best position
                    bound += int(factors[t]) * int(self.impact[max(p - 1, start[t])])
            if bound == 0 or (len(best[0]) == k and best[0][-1] > bound):
                break
        self.factor[terms] = 0
        for place in touched:
            self.seen[place] = False
        for docs in met:
            self.met[docs] = False
        return best, read


def top(score: np.ndarray, ids: np.ndarray, k: int):
    """The k highest scores above 0, equal ones by id."""
    order = np.lexsort((ids, -score))[:k]
    order = order[score[order] > 0]
    return score[order], ids[order]


_NULL = np.iinfo(np.int64).max


def _best_rows(shared, docs: int, total: int, k: int):
    def run(batches):
        first, terms, factors, size = shared.value
        items = len(first) - 1
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items
        held, postings = [], 0

        def block():
            ids = np.concatenate([b["doc_id"].fill_null(_NULL).to_numpy() for b in held])
            n = np.concatenate([b["n"].to_numpy() for b in held])
            term, tf = (np.concatenate([_joined(b[c]) for b in held]) for c in ("terms", "tfs"))
            sizes = np.concatenate([[len(x) // 4 for x in b["terms"].to_pylist()] for b in held]).astype(np.int64)
            at = np.repeat(np.arange(len(ids)), sizes)
            lists = ImpactLists(at, term, impact(tf, n[at], docs, total), len(ids), size)
            for i in range(items):
                mine = slice(first[i], first[i + 1])
                best[i], _ = lists.search(terms[mine], factors[mine], ids, best[i], k)

        for batch in batches:
            held.append(batch)
            postings += batch["terms"].nbytes // 4
            if postings >= BLOCK_POSTINGS:
                block()
                held, postings = [], 0
        if held:
            block()
        for at in range(0, items, 1000):
            part = best[at:at + 1000]
            ids = np.concatenate([x for _, x in part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(at, at + len(part)), [len(x) for x, _ in part]).astype(np.int32)),
                 pa.array(ids, mask=ids == _NULL), pa.array(np.concatenate([x for x, _ in part]))], ["item", "doc_id", "score"])
    return run


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit per 20-bit prefix: most words end here."""
    bits = np.zeros(1 << 17, np.uint8)
    at = (hashes >> np.uint64(44)).astype(np.int64)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", k: int = K) -> DataFrame:
    """Each item's ``k`` highest-scoring documents with a score above 0:
    item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    items = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct()
    passes = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PASS_BYTES))
    items = items.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    out = None
    for p in range(passes):
        found = _search_pass(text_frame(docs, id_col, text_col), items.where(F.col("pass") == p).select("item_id", "text"), k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_pass(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    rows = items.collect()
    vocab = Vocabulary([r["text"] for r in rows])
    shared = spark.sparkContext.broadcast((vocab.hash, vocab.start, vocab.size, vocab.data, _bitmap(vocab.hash)))
    postings = scratch.save(docs.mapInArrow(_posting_rows(shared), POSTINGS), "postings")
    held, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = (postings.select("terms").mapInArrow(_document_counts(len(vocab.hash)), "term int, df bigint")
          .groupBy("term").agg(F.sum("df").alias("df")).collect())      # a row per term of the pass
    weights = np.zeros(len(vocab.hash), np.int64)
    for r in df:
        weights[r["term"]] = weight(held, r["df"])
    query = spark.sparkContext.broadcast((vocab.first, vocab.term, vocab.count * weights[vocab.term], len(vocab.hash)))
    best = postings.where("length(terms) > 0").mapInArrow(_best_rows(query, held, total or 1, k), FOUND)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))
    best = (best.withColumn("r", F.row_number().over(Window.partitionBy("item", shard).orderBy(*order))).where(F.col("r") <= k)
            .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k))
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                  f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
