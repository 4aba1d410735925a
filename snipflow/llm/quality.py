"""Quality classifier: naive Bayes support vectors on word n-grams.

Indicators of words (case kept) and word pairs (a word twice running is the
same pair for all words), scaled by class log-count
ratios, then a linear hinge-loss model by dual coordinate descent; see
``linear``. Defined results: null and empty texts have no n-gram and get the
score of the bias; repeated rows score alike; without labelled rows of both
classes the score is the share of class 1 (0.5 if nothing is labelled); an
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from snipflow.llm import linear
from snipflow.llm.common import Words

BITS = 18
THRESHOLD = 0.3


def word_ngrams(data: np.ndarray, off: np.ndarray):
    """Distinct (row, hashed word or word pair), sorted by row."""
    w = Words(data, off)
    pair = (w.hash[:-1] * np.uint64(3) + w.hash[1:]) * np.uint64(0x9E3779B97F4A7C15)
    same = w.doc[1:] == w.doc[:-1]
    shift = np.uint64(64 - BITS)
    pair[w.hash[1:] == w.hash[:-1]] = 0        # any word twice running is one pair
    key = np.concatenate([(w.doc << BITS) | (w.hash >> shift).astype(np.int64),
                          ((w.doc[1:] << BITS) | (pair >> shift).astype(np.int64))[same]])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key >> BITS, key & ((1 << BITS) - 1)


def score_quality(df: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality", per_class: int = linear.PER_CLASS) -> DataFrame:
    """(doc_id, score): probability that ``label_col`` is 1, learned from the
    labels where ``usable`` (a condition on the label table) holds."""
    usable = F.lit(True) if usable is None else usable
    model = linear.train(df, labels, word_ngrams, 1 << BITS, label_col, usable, id_col, text_col, per_class)
    return linear.score(df, model, word_ngrams, id_col, text_col)
