"""Operator 1: toxicity by a classifier chain.

The categories are predicted one after the other, each by a sparse logistic model
over the words of a text (whole and by their beginnings) and the probabilities of the
categories before it.  In training those come from models that have not seen the row
(out of fold), as the chain will see them when it scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from gaugeworks.llm.arrowtext import column_bytes, pieces
from gaugeworks.llm.cluster import carried, fields, ready
from gaugeworks.llm.hashed import Sparse, logistic, word_counts
from gaugeworks.llm.sampling import example_texts, first_rows, per_class

BITS = 20
FOLDS = 4
#: L1 term for each training row, and its most.
SPARSITY = 0.002
MOST_SPARSITY = 4.0


@dataclass
class Linear:
    """A logistic model with few weights: hashed words and the chain's probabilities."""

    index: np.ndarray
    weight: np.ndarray
    chain: np.ndarray
    bias: float

    def probability(self, rows: Sparse, earlier: np.ndarray) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.index] = self.weight
        return logistic(rows.times(dense) + earlier @ self.chain + self.bias)


def fit_linear(rows: Sparse, earlier: np.ndarray, target: np.ndarray, use: np.ndarray, epochs: int = 3, rate: float = 0.3, ridge: float = 0.1, seed: int = 5) -> Linear:
    """Follow-the-regularised-leader with an L1 term, over the rows in ``use``."""
    size, links = 1 << BITS, earlier.shape[1]
    z, n = np.zeros(size + links + 1), np.zeros(size + links + 1)
    penalty = np.full(size + links + 1, min(MOST_SPARSITY, SPARSITY * len(use)))
    penalty[size:] = 0
    rng = np.random.default_rng(seed)
    ones = {}

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= penalty[at], 0.0, -(zz - np.sign(zz) * penalty[at]) / ((1 + np.sqrt(n[at])) / rate + ridge))

    for _ in range(epochs):
        for i in rng.permutation(use):
            index, _ = rows.row(i)
            at = np.concatenate([index, np.arange(size, size + links + 1)])
            x = ones.get(len(at))
            if x is None:
                x = ones[len(at)] = np.ones(len(at))
            if links:
                x = x.copy()
                x[-1 - links : -1] = earlier[i]
            w = weights(at)
            g = (logistic(np.array(w @ x)) - target[i]) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(size + links + 1))
    index = np.flatnonzero(w[:size])
    return Linear(index, w[index].astype(np.float32), w[size : size + links], float(w[-1]))


@dataclass
class ToxicityChain:
    categories: list[str]
    models: list[Linear]
    threshold: float

    def probabilities(self, rows: Sparse) -> np.ndarray:
        found = np.zeros((len(rows.at) - 1, 0))
        for model in self.models:
            found = np.column_stack([found, model.probability(rows, found)])
        return found


def presence(raw: np.ndarray, at: np.ndarray) -> Sparse:
    rows, _, _ = word_counts(raw, at, BITS, prefixes=True)
    return Sparse(rows.index, np.ones(len(rows.index), np.float32), rows.at)


def train_chain(texts: Sequence[str], targets: np.ndarray, categories: Sequence[str], folds: int = FOLDS) -> ToxicityChain:
    """``targets`` has a 0/1 column for each category, in chain order."""
    raw, at = column_bytes(pa.array(texts, pa.string()))
    rows = presence(raw, at)
    n = len(texts)
    everything = np.arange(n)
    fold = np.random.default_rng(11).permutation(n) % folds
    earlier, models = np.zeros((n, 0)), []
    for k in range(len(categories)):
        target = targets[:, k].astype(float)
        models.append(fit_linear(rows, earlier, target, everything))
        unseen = np.zeros(n)
        for f in range(folds):
            model = fit_linear(rows, earlier, target, everything[fold != f])
            unseen[fold == f] = model.probability(rows, earlier)[fold == f]
        earlier = np.column_stack([earlier, unseen])
    return ToxicityChain(list(categories), models, best_threshold(earlier[:, -1], targets[:, -1]))


def best_threshold(score: np.ndarray, target: np.ndarray) -> float:
    """The middle of the gap at which hits and misses balance best (F1), within 0.25
    to 0.9; a half without positive rows."""
    rank = np.argsort(-score, kind="stable")
    hits = np.cumsum(target[rank])
    if not len(rank) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(rank) + 1) + hits[-1])
    last = int(np.argmax(f1))
    below = score[rank[last + 1]] if last + 1 < len(rank) else 0.0
    return float(np.clip((score[rank[last]] + below) / 2, 0.25, 0.9))


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str], each: int = 1500, text: str = "text", key: str = "doc_id") -> ToxicityChain:
    """Train on about ``each`` labelled documents of every combination of the 0/1
    label columns ``categories`` (at most ``2 * each`` times the combinations, of texts
    up to ``sampling.MOST_BYTES``).  Rows with a null label are no examples; repeated
    rows are one example."""
    rows = labels.select(labels[f"`{key}`"].alias("key"), *(labels[f"`{c}`"].cast("int").alias(f"y{i}") for i, c in enumerate(categories))).dropna()
    rows = rows.withColumn("combined", F.concat_ws("", *(F.col(f"y{i}").cast("string") for i in range(len(categories)))))
    chosen = per_class(rows, "combined", each).drop("combined")
    found = example_texts(docs, text, key).join(F.broadcast(chosen), "key")
    sample = first_rows(found, 2 * each * 2 ** len(categories)).collect()
    sample.sort(key=lambda r: (str(r.key), r.text))
    targets = np.array([[r[f"y{i}"] for i in range(len(categories))] for r in sample]).reshape(-1, len(categories))
    return train_chain([r.text for r in sample], targets, categories)


def score_toxicity(docs: DataFrame, chain: ToxicityChain, text: str = "text", threshold: float | None = None) -> DataFrame:
    """All columns of ``docs``, a probability ``p_<category>`` for each category and
    ``toxic``: the last category's probability is at least ``threshold`` (by default
    the chain's own, set on training rows scored unseen).

    Null and empty texts are scored as texts without words; long texts are scored
    whole; repeated rows give repeated rows, an empty table an empty one.  Columns of
    these names, in any case, are replaced."""
    made = fields(**{f"p_{c}": DoubleType() for c in chain.categories}, toxic=BooleanType())
    shipped = ready(docs.sparkSession).sparkContext.broadcast(chain)
    source, schema, kept = carried(docs, made, text)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        least = model.threshold if threshold is None else threshold
        for batch in batches:
            raw, at = column_bytes(batch.column(kept))
            for i, j in pieces(at):
                p = model.probabilities(presence(raw[at[i] : at[j]], at[i : j + 1] - at[i]))
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(kept)), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= least)], names=names)

    return source.mapInArrow(run, schema)
