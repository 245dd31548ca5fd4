"""Toxicity by a chain of linear classifiers.

The categories are the 0/1 columns of a table of labels, in chain order. Each has
a logistic model on hashed words (lower-cased, cut at white space and ASCII
punctuation, each once a document) and on the log-odds that the models of the
categories before it give. While training, these come out of fold: a document's
earlier probabilities are those of models that have not seen it, so a later model
learns how far the earlier ones can be trusted on new documents. To predict, the
models trained on the whole sample follow one another.

Models are fitted on at most ``SAMPLE`` labelled documents, those whose ids hash
lowest; every document is classified, in one pass, where it is read.

Defined cases: null and empty texts have no words and get the models' base rates;
labels that are null count for no category; of several labels of one document the
largest counts; documents that occur twice under one id are two examples; without
labelled documents all probabilities are 0.5 and nothing is toxic; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlog.llm import kernels
from kvlog.llm.shared import arrow_schema, hashed_lowest, without

#: Chain order: what low quality a text has helps to tell what is toxic in it.
CATEGORIES = ("quality", "toxic")
SAMPLE = 8000
FOLDS = 3
BITS = 18
#: A document counts as toxic above this probability of the last category (few documents are, and weights are kept small).
TOXIC_FROM = 0.15
_CUT = kernels.SPACE.copy()
_CUT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_KINDS = [np.array([test(chr(c)) if c < 128 else False for c in range(256)]) for test in (str.isupper, lambda c: c.isprintable() and not c.isalnum() and c != " ", str.isdigit)]
SLOTS = (1 << BITS) + 32 * (len(_KINDS) + 1)
#: Log-likelihood ratio from which a slot counts.
G2 = 12.0


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct slots of each text: words, and steps of what shares its bytes have."""
    starts, ends, first = kernels.words(data, offs, _CUT)
    slots = (kernels.span_hashes(data, starts, ends, fold=True) >> kernels.U64(64 - BITS)).astype(np.int32)
    size = np.maximum(1, np.diff(offs))
    shares = [kernels.per_text(kind[data], offs) / size for kind in _KINDS]
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own = np.unique(slots[a:b])
        steps = [int(20 * x[i]) for x in (*shares,)] + [int(20 * len(own) / max(1, b - a))]
        yield np.concatenate([own, np.array([(1 << BITS) + 32 * k + x for k, x in enumerate(steps)], np.int32)])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


def _telling(slots: np.ndarray, ends: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which slots are in documents of one class more than chance would have it (G-test)."""
    there = [np.bincount(slots[np.repeat(y == c, np.diff(ends))], minlength=SLOTS).astype(float) for c in (1, 0)]
    size = [float((y == 1).sum()), float((y == 0).sum())]
    share = (there[0] + there[1]) / max(1.0, sum(size))
    out = np.zeros(SLOTS)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n, total in zip(there, size, strict=True):
            for seen, expected in ((n, share * total), (total - n, (1 - share) * total)):
                out += np.where((seen > 0) & (expected > 0), 2 * seen * np.log(seen / expected), 0)
    return out >= G2


class Linear:
    """Logistic regression on slots and a few dense columns."""

    def __init__(self, n_dense: int) -> None:
        self.words, self.dense, self.bias = np.zeros(SLOTS), np.zeros(n_dense), 0.0

    def odds(self, slots: np.ndarray, ends: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return _sums(self.words[slots], ends) + dense @ self.dense + self.bias

    def fit(self, slots: np.ndarray, ends: np.ndarray, dense: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.3, decay: float = 1e-5) -> Linear:
        """Full gradients with a step for each weight that shrinks with its gradients."""
        if not len(y):
            return self
        on = _telling(slots, ends, y)[slots]
        owner = np.repeat(np.arange(len(y)), np.diff(ends))[on]
        used, slots = np.unique(slots[on], return_inverse=True)
        small = Linear(dense.shape[1])
        small.words = np.zeros(len(used))
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(y)))])
        rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        small.bias = float(np.log(rate_of / (1 - rate_of)))
        weights = [small.words, small.dense]
        squares = [np.full(w.shape, 1e-8) for w in weights]
        for _ in range(rounds):
            error = (y - 1 / (1 + np.exp(-np.clip(small.odds(slots, ends, dense), -30, 30)))) / len(y)
            gradients = [np.bincount(slots, weights=error[owner], minlength=len(used)), error @ dense]
            for w, g, s in zip(weights, gradients, squares, strict=True):
                g = g - decay * w
                s += g * g
                w += rate * g / np.sqrt(s)
            small.bias += float(error.sum())
        self.words[used], self.dense, self.bias = small.words, small.dense, small.bias
        return self


class Chain:
    def __init__(self, categories: Sequence[str]) -> None:
        self.categories = list(categories)
        self.models = [Linear(i) for i in range(len(self.categories))]

    def fit(self, slots: np.ndarray, ends: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> Chain:
        """labels: documents by categories, nan where unknown; fold: of each document."""
        dense = np.zeros((len(labels), 0))
        for i in range(len(self.categories)):
            y = labels[:, i]
            unseen = np.zeros(len(y))
            for k in range(folds if i + 1 < len(self.categories) else 0):
                train, test = (fold != k) & ~np.isnan(y), fold == k
                model = Linear(i).fit(*_rows(slots, ends, train), dense[train], y[train])
                unseen[test] = model.odds(*_rows(slots, ends, test), dense[test])
            known = ~np.isnan(y)
            self.models[i].fit(*_rows(slots, ends, known), dense[known], y[known])
            dense = np.column_stack([dense, np.clip(unseen, -8, 8)])
        return self

    def predict(self, slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities, documents by categories."""
        odds = np.zeros((len(ends) - 1, 0))
        for model in self.models:
            odds = np.column_stack([odds, np.clip(model.odds(slots, ends, odds), -8, 8)])
        return 1 / (1 + np.exp(-odds))


def _rows(slots: np.ndarray, ends: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(ends)
    return slots[np.repeat(on, size)], np.concatenate([[0], np.cumsum(size[on])])


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """A chain fitted on the sample."""
    one = labels.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max(c).cast("double").alias(c) for c in categories))
    chosen = hashed_lowest(one, sample, key)
    rows = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(chosen), key).select("__text", F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(FOLDS)).cast("int").alias("fold"), F.array(*categories).alias("labels"))

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in kernels.blocks(batch, "__text"):
                yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in features(data, offs)], pa.binary()), part.column(1), part.column(2).cast(pa.list_(pa.float64()))], ["slots", "fold", "labels"])

    found = rows.mapInArrow(slots_of, "slots binary, fold int, labels array<double>").collect()  # at most `sample` documents
    found.sort(key=lambda r: (bytes(r["slots"]), r["fold"]))
    slots = [np.frombuffer(r["slots"], np.int32) for r in found]
    y = np.array([[np.nan if x is None else x for x in r["labels"]] for r in found], float).reshape(len(found), len(categories))
    return Chain(categories).fit(np.concatenate(slots) if slots else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum([len(s) for s in slots], dtype=np.int64)]), y, np.array([r["fold"] for r in found], np.int64))


def classify(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """docs with p_<category> for each category, and is_toxic by the last one."""
    spark = docs.sparkSession
    output = [*((f"p_{c}", T.DoubleType()) for c in categories), ("is_toxic", T.BooleanType())]
    docs = without(docs, *(c for c, _ in output))
    sent = spark.sparkContext.broadcast(train(docs, labels, categories, key, text, sample))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in output)])
    arrow = arrow_schema(spark, schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in kernels.blocks(batch, text):
                slots = list(features(data, offs))
                p = sent.value.predict(np.concatenate(slots), np.concatenate([[0], np.cumsum([len(s) for s in slots], dtype=np.int64)]))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, -1] > toxic_from)], schema=arrow)

    return docs.mapInArrow(score, schema)
