"""Operator 7: quality by a factorisation machine.

The features of a text are its hashed words (relative to the text), its structure
(shares of letters, marks, repeats, line and word lengths, each as one of some bins)
and its size as metadata.  The pairwise interactions are products of low-rank factors
and cost linear time: half of (sum of factors)^2 - sum of squares.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from gaugeworks.llm.arrowtext import IS_WORD, LOWER, by_text, column_bytes, pieces
from gaugeworks.llm.cluster import carried, fields, ready
from gaugeworks.llm.hashed import Sparse, logistic, word_counts
from gaugeworks.llm.sampling import example_texts, first_rows, per_class

BITS = 18
BINS = 12
FACTORS = 8
PASS = 0.7
STATISTICS = ("n_words", "word_length", "upper", "digits", "marks", "line_length", "distinct_words", "same_neighbour", "commonest_mark", "n_bytes")


def structure(raw: np.ndarray, at: np.ndarray, counts: Sparse, hashes: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """The statistics of each text, a column each in the order of ``STATISTICS``."""
    size = np.diff(at).astype(float)
    n_words = np.diff(word_at).astype(float)

    def share(flags: np.ndarray) -> np.ndarray:
        return by_text(flags.astype(np.int64), at) / np.maximum(size, 1)

    upper = share((raw >= 65) & (raw <= 90))
    digits = share((raw >= 48) & (raw <= 57))
    word = share(IS_WORD[LOWER[raw]])
    blank = share((raw == 32) | ((raw >= 9) & (raw <= 13)))
    lines = by_text((raw == 10).astype(np.int64), at) + 1
    same = np.zeros(len(hashes), np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    inner = word_at[:-1][word_at[:-1] < len(hashes)]
    same[inner] = 0
    distinct = np.diff(counts.at)
    marks = np.stack([share(raw == m) for m in b"!*$%&#|.,"], axis=1)
    return np.column_stack(
        [
            np.log1p(n_words),
            word * size / np.maximum(n_words, 1),
            upper,
            digits,
            1 - word - blank,
            np.log1p(size / lines),
            distinct / np.maximum(n_words, 1),
            by_text(same, word_at) / np.maximum(n_words, 1),
            marks[:, :7].max(axis=1),
            np.log1p(size),
        ]
    )


def features(raw: np.ndarray, at: np.ndarray, edges: np.ndarray | None) -> tuple[Sparse, np.ndarray]:
    """Sparse rows (words, then one bin of each statistic) and the statistics."""
    counts, hashes, word_at = word_counts(raw, at, BITS)
    stats = structure(raw, at, counts, hashes, word_at)
    if edges is None:
        return counts, stats
    n = len(at) - 1
    norm = np.sqrt(np.maximum(by_text(counts.value**2, counts.at), 1))
    value = counts.value / np.repeat(norm, np.diff(counts.at))
    bins = np.stack([np.searchsorted(edges[k], stats[:, k], "right") + k * BINS for k in range(len(STATISTICS))], axis=1) + (1 << BITS)
    extra = bins.shape[1]
    total = counts.at + np.arange(n + 1) * extra
    index, values = np.empty(total[-1], np.int64), np.empty(total[-1], np.float32)
    place = np.arange(len(counts.index)) + np.repeat(np.arange(n) * extra, np.diff(counts.at))
    index[place], values[place] = counts.index, value
    tail = (total[1:, None] - extra) + np.arange(extra)
    index[tail], values[tail] = bins, 1.0
    return Sparse(index, values, total), stats


@dataclass
class FactorMachine:
    edges: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, rows: Sparse) -> np.ndarray:
        linear = by_text(self.weight[rows.index] * rows.value, rows.at)
        part = self.factor[rows.index] * rows.value[:, None]
        pairs = by_text(part, rows.at) ** 2 - by_text(part**2, rows.at)
        return logistic((self.bias + linear + 0.5 * pairs.sum(axis=1)).astype(float))


def train(texts: Sequence[str], target: Sequence[int], epochs: int = 6, rate: float = 0.1, ridge: float = 1e-4, seed: int = 3) -> FactorMachine:
    """Adaptive stochastic gradient descent on the logistic loss."""
    raw, at = column_bytes(pa.array(texts, pa.string()))
    _, stats = features(raw, at, None)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(stats, quantiles, axis=0).T if len(texts) else np.zeros((len(STATISTICS), BINS - 1))
    rows, _ = features(raw, at, edges)
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + len(STATISTICS) * BINS
    weight, factor = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)
    seen_w, seen_v = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32)
    share = min(0.999, max(0.001, float(np.mean(target)))) if len(texts) else 0.5
    bias = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            index, x = rows.row(i)
            v = factor[index]
            part = v * x[:, None]
            total = part.sum(axis=0)
            y = bias + float(weight[index] @ x) + 0.5 * float((total**2 - (part**2).sum(axis=0)).sum())
            g = float(logistic(np.array(y))) - target[i]
            gw = g * x + ridge * weight[index]
            gv = g * x[:, None] * (total - part) + ridge * v
            seen_w[index] += gw * gw
            seen_v[index] += gv * gv
            weight[index] -= rate * gw / np.sqrt(seen_w[index])
            factor[index] -= rate * gv / np.sqrt(seen_v[index])
            bias -= 0.01 * g
    return FactorMachine(edges, bias, weight, factor)


def fit_quality(docs: DataFrame, labels: DataFrame, each: int = 2500, text: str = "text", label: str = "quality", key: str = "doc_id") -> FactorMachine:
    """Train on about ``each`` labelled documents of either label (at most four times
    as many in all, of texts up to ``sampling.MOST_BYTES``).  Null labels and texts are
    no examples; repeated rows are one example."""
    rows = labels.select(labels[f"`{key}`"].alias("key"), labels[f"`{label}`"].cast("int").alias("label")).where("label in (0, 1)")
    found = example_texts(docs, text, key).join(F.broadcast(per_class(rows, "label", each)), "key")
    sample = first_rows(found, 4 * each).collect()
    sample.sort(key=lambda r: (str(r.key), r.text))
    return train([r.text for r in sample], [r.label for r in sample])


def score_quality(docs: DataFrame, model: FactorMachine, text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on).

    Null texts count as empty and are scored like any text; long texts are scored
    whole; repeated rows give repeated rows, an empty table an empty one.  Columns of
    these names, in any case, are replaced."""
    made = fields(score=DoubleType(), predicted=IntegerType())
    shipped = ready(docs.sparkSession).sparkContext.broadcast(model)
    source, schema, kept = carried(docs, made, text)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shipped.value
        for batch in batches:
            raw, at = column_bytes(batch.column(kept))
            for i, j in pieces(at, 2 << 20):
                rows, _ = features(raw[at[i] : at[j]], at[i : j + 1] - at[i], machine.edges)
                score = machine.scores(rows)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(kept)), pa.array(score), pa.array((score >= PASS).astype(np.int32))], names=names)

    return source.mapInArrow(run, schema)
