"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

N-grams of 3, 4 and 5 code points (ASCII letters in lower case, runs of white
space as they stand) are indicators scaled by class log-count ratios under a
hinge-loss model; see ``linear``. Defined results: texts under three characters,
empty and null ones have no n-gram and get the score of the bias; repeated rows
score alike; without labelled rows of both classes the score is the share of
class 1 (0.5 if nothing is labelled). Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from snipflow.llm import linear

BITS = 18
SIZES = (3, 4, 5)
THRESHOLD = 0.3


def char_ngrams(data: np.ndarray, off: np.ndarray):
    """Distinct (row, hashed n-gram), sorted by row."""
    seen = np.zeros(1 << BITS, bool)
    docs, feats = [], []
    for r in range(len(off) - 1):
        raw = data[off[r]:off[r + 1]]
        if not len(raw):
            continue
        if (raw < 128).all():
            c = raw.astype(np.uint32)
        else:
            c = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        c = c + (((c >= 65) & (c <= 90)).astype(np.uint32) << np.uint32(5))
        h, n = c * np.uint32(0x9E3779B1), 1
        for size in SIZES:
            while n < size and len(h) > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n:] * np.uint32(0xC2B2AE35)
                n += 1
            if n == size and len(c) >= size:
                m = h ^ (h >> np.uint32(13))
                seen[(m * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)] = True
        got = np.flatnonzero(seen)
        seen[got] = False
        feats.append(got)
        docs.append(np.full(len(got), r))
    if not feats:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(feats)


def score_toxicity(df: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "toxic", per_class: int = linear.PER_CLASS) -> DataFrame:
    """(doc_id, score): probability that ``label_col`` is 1, learned from the
    labels where ``usable`` (a condition on the label table) holds."""
    usable = F.lit(True) if usable is None else usable
    model = linear.train(df, labels, char_ngrams, 1 << BITS, label_col, usable, id_col, text_col, per_class)
    return linear.score(df, model, char_ngrams, id_col, text_col)
