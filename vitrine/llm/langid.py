"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word is its lower-cased form without outer punctuation, between two marks; its
features are the marked word and its character n-grams, hashed to ``BUCKETS`` rows of
an embedding table. A text is the mean of the embeddings of all its features; a
linear layer and a softmax give the languages. Both are trained together by
stochastic gradient descent in numpy, on a bounded sample: at most ``TRAIN_DOCS``
labelled texts of at most ``TRAIN_CHARS`` characters each, taken in the order of a
seeded hash of the id. Every fourth of them is held back to fit one temperature, so
that the score is a calibrated probability, and to set the rejection bound: the
conformal quantile that rejects at most ``REJECT`` of such texts, never above one half;
fewer than 499 held-back texts prove no bound, and it is 0.

Because the model is linear, each task scores with a table of word sums: the text's
logits are the sum of its words' rows over the count of their features. Whole
texts are scored, in blocks.

Defined cases: null texts and texts without a letter get ``und``, score 0, rejected;
without any labelled text every document does; repeated rows are scored alike; rows
whose language or id is null are never learned from; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import fold, ship_by_value, shipped, text_blocks

ship_by_value(__name__)

FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 16
DIM = 16
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.5
SEED = 7
TRAIN_DOCS = 2000
TRAIN_CHARS = 16_000
REJECT = 0.002
UND = "und"
#: Distinct words remembered by a task before it starts afresh.
MEMO = 200_000
OUTER = ".,;:!?\"'()[]{}«»„“”…-"


def subwords(word: str) -> list[int]:
    """Hashed features of a word."""
    marked = f"<{word.strip(OUTER)}>"
    parts = [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    parts.append(marked)
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], languages: list[str], seed: int = SEED) -> LanguageModel | None:
    """Fit on the given texts; None without any."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    known: dict[str, array] = {}
    bags = []
    for text in texts:
        features: list[int] = []
        for word in text.lower().split():
            if word not in known:
                known[word] = array("i", subwords(word))
            features.extend(known[word])
        index, counts = np.unique(np.array(features, dtype=np.int64), return_counts=True)
        bags.append((index, (counts / max(1, counts.sum())).astype(np.float32)))
    target = np.array([names.index(x) for x in languages])
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    held = np.arange(len(texts)) % 4 == 3
    fit = np.flatnonzero(~held)
    steps = EPOCHS * len(fit)
    for epoch in range(EPOCHS):
        for k, i in enumerate(rng.permutation(fit)):
            rate = RATE * (1 - (epoch * len(fit) + k) / steps)
            index, share = bags[i]
            mean = share @ emb[index]
            error = _softmax(mean @ layer + bias)
            error[target[i]] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * error
            # a feature's part of the mean is small, so its row moves by the share's square root
            emb[index] -= rate * np.outer(np.sqrt(share), back)
    model = LanguageModel(names, emb @ layer, bias)
    check = np.flatnonzero(held)
    if len(check) and len(names) > 1:
        logits = np.stack([bags[i][1] @ model.table[bags[i][0]] + bias for i in check])
        right = target[check]

        def loss(t: float) -> float:
            return float(-np.log(_softmax(logits / t)[np.arange(len(check)), right] + 1e-12).mean())

        model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        top = np.sort(_softmax(logits / model.temperature).max(axis=1))
        k = int(REJECT * (len(top) + 1)) - 1
        model.reject_below = float(min(0.5, top[k])) if k >= 0 else 0.0
    return model


def training_sample(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> DataFrame:
    """At most ``max_docs`` labelled texts outside the held-out fold, in seeded hash order.

    Ids are chosen first, so that no more than ``max_docs`` texts leave the executors.
    """
    fitting = (docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
               .filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
               .filter(F.length("text") <= max_chars)
               .select("doc_id", "text", "lang", F.xxhash64("doc_id", F.lit(SEED)).alias("__h")))
    chosen = (fitting.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__order"))
              .orderBy("__order", "__id").limit(max_docs).distinct())
    found = fitting.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # at most max_docs ids
    return found.orderBy("__h", "doc_id", "text", "lang").limit(max_docs).select("text", "lang")


def fit(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> LanguageModel | None:
    rows = training_sample(docs, max_docs, max_chars).collect()  # at most max_docs * max_chars characters
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(text: Column, model: LanguageModel | None, spark: SparkSession) -> Column:
    """Struct column lang_pred, score, rejected."""
    shared = shipped(spark, model)  # at most BUCKETS x languages numbers

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared()
        known: dict[str, int] = {}
        sums = np.zeros((0, len(model.languages) + 1))
        for texts in batches:
            out = []
            for block in text_blocks(texts.tolist()):
                words = [t.lower().split() for t in block]
                if len(known) > MEMO:
                    known.clear()
                    sums = sums[:0]
                new = list(set().union(*words) - known.keys())
                if new:
                    features = [subwords(w) for w in new]
                    sizes = np.array([len(f) for f in features])
                    rows = model.table[np.concatenate([np.array(f) for f in features])]
                    total = np.add.reduceat(rows, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
                    known.update(zip(new, range(len(sums), len(sums) + len(new))))
                    sums = np.concatenate([sums, np.column_stack([total, sizes])])
                for w in words:
                    row = sums[np.fromiter(map(known.__getitem__, w), np.int64, len(w))].sum(axis=0)
                    share = _softmax((row[:-1] / max(row[-1], 1) + model.bias) / model.temperature)
                    best = int(share.argmax())
                    out.append((model.languages[best], float(share[best]), bool(share[best] < model.reject_below)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    def answer(lang: Column, score: Column, rejected: Column) -> Column:
        return F.struct(lang.alias("lang_pred"), score.alias("score"), rejected.alias("rejected"))

    unknown = answer(F.lit(UND), F.lit(0.0), F.lit(True))
    if model is None:
        return unknown
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.rlike(r"\p{L}"), classify(whole)).otherwise(unknown)


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    if model is None:
        model = fit(docs)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    got = docs.select("doc_id", held, predict(F.col("text"), model, docs.sparkSession).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def kept_documents(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The documents that are not rejected, columns unchanged."""
    if model is None:
        model = fit(docs.select("doc_id", "text", "lang"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = rows.withColumn("p", predict(F.col("row.text"), model, docs.sparkSession)).filter("not p.rejected")
    return judged.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
