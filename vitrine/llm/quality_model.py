"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Each text gives four lists of hashed features: its words, its word pairs, and the
words and pairs of their shapes (letters folded to x or X, digits to 9, runs cut to
one sign for letters and digits). A feature's value is its share of its list, so a
text's score is a sparse dot product: the mean weight of each list, plus three more
features, the share of 4-word windows that repeat earlier ones, the share of words
equal to the word before, and one over the length. Training follows the regularised leader (per-coordinate rates, L1 and L2),
a few passes in numpy over a bounded sample: at most ``TRAIN_DOCS`` labelled rows
outside the held-out fold, texts of at most ``TRAIN_CHARS`` characters, in the order
of a seeded hash of the id. Inputs of a score are words only; language, source, id
and label are not.

Defined cases: null and empty texts have no features but the length and score by
the bias; labels that are null, or neither 0 nor 1, are not learned from; repeated
labels or documents count each, within the bound; without labels every score is one
half; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import fold, ship_by_value, text_blocks

ship_by_value(__name__)

FOLDS, HELD_OUT = 5, 0
BITS = 18
TRAIN_DOCS = 6000
TRAIN_CHARS = 20_000
PASSES = 3
SEED = 11
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
#: Distinct words remembered by a task before it starts afresh.
MEMO = 200_000
N_EXTRA = 4  # bias, repeated windows, repeated words, shortness
REPEAT = 4


def shape(word: str) -> str:
    word = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else ("x" if m[0].islower() else "Xx"), word)
    return re.sub(r"\d+", "9", word)


class Words:
    """Hashes of words and their shapes, remembered while few enough."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.hashes = np.zeros((0, 2), dtype=np.uint64)

    def block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Per text: an array of (word hash, shape hash) rows."""
        words = [t.split() for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
            self.hashes = self.hashes[:0]
        new = list(set().union(*words) - self.known.keys())
        if new:
            def crc(s: str) -> int:
                return zlib.crc32(s.encode("utf-8", "replace"))
            rows = np.array([(crc(w.lower()), crc("shape " + shape(w))) for w in new], dtype=np.uint64)
            self.known.update(zip(new, range(len(self.hashes), len(self.hashes) + len(new))))
            self.hashes = np.concatenate([self.hashes, rows])
        for w in words:
            yield self.hashes[np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))]


def _slots(h: np.ndarray, salt: int) -> np.ndarray:
    mixed = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64) + N_EXTRA


def features(rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The lists of hashed features of one text, and the values of the extra features."""
    pair = np.uint64(0xD6E8FEB86659FD93)
    lists = []
    for view in (0, 1):
        h = rows[:, view]
        lists += [_slots(h, 1 + view), _slots(h[:-1] * pair + h[1:], 3 + view)]
    again = 0.0
    if len(rows) > REPEAT:
        h = rows[:, 0]
        windows = h[:len(h) - REPEAT + 1].copy()
        for k in range(1, REPEAT):
            windows = windows * pair + h[k:len(h) - REPEAT + 1 + k]
        again = 1 - len(np.unique(windows)) / len(windows)
    stutter = float((rows[1:, 0] == rows[:-1, 0]).mean()) if len(rows) > 1 else 0.0
    return lists, np.array([1.0, again, stutter, 1 / (1 + len(rows))])


def _sigmoid(z: float) -> float:
    return 1 / (1 + np.exp(-max(-35.0, min(35.0, z))))


def train(texts: list[str], quality: list[int], passes: int = PASSES, seed: int = SEED) -> np.ndarray:
    """Weights; all zero without examples."""
    size = (1 << BITS) + N_EXTRA
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    words, examples = Words(), []
    for block in text_blocks(texts):
        for rows in words.block(block):
            lists, extra = features(rows)
            index = np.concatenate([np.arange(N_EXTRA), *lists])
            value = np.concatenate([extra, *[np.full(len(x), 1 / max(1, len(x))) for x in lists]])
            slots, place = np.unique(index, return_inverse=True)
            examples.append((slots, np.bincount(place, weights=value)))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(examples)):
            at, x = examples[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (_sigmoid(float(wi @ x)) - quality[i]) * x
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * wi
            n[at] = grown
    live = np.abs(z) > L1
    w[live] = -(z[live] - np.sign(z[live]) * L1) / ((BETA + np.sqrt(n[live])) / ALPHA + L2)
    return w


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS,
                    max_chars: int = TRAIN_CHARS) -> DataFrame:
    """At most ``max_docs`` rows text, quality."""
    order = F.xxhash64("__id", F.lit(SEED))
    chosen = (labels.select(F.col("doc_id").alias("__id"), "quality")
              .filter(F.col("quality").isin(0, 1) & (fold(F.col("__id"), FOLDS) != HELD_OUT))
              .orderBy(order, "__id", "quality").limit(max_docs))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # max_docs rows
    short = found.filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    return short.orderBy(order, "__id", "quality", "text").limit(max_docs).select("text", "quality")


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    rows = training_sample(docs, labels).collect()  # at most TRAIN_DOCS * TRAIN_CHARS characters
    return train([r["text"] for r in rows], [r["quality"] for r in rows])


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, words = shared.value, Words()
        for texts in batches:
            out = []
            for block in text_blocks(texts.tolist()):
                for rows in words.block(block):
                    lists, extra = features(rows)
                    out.append(_sigmoid(float(extra @ w[:N_EXTRA]) + sum(float(w[x].mean()) for x in lists if len(x))))
            yield pd.Series(out, dtype="float64")

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held, scores(F.coalesce(F.col("text"), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
