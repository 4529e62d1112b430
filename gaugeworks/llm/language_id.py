"""Operator 2: language identification.

A text is the average of the embeddings of its hashed subwords (byte runs of three
and four, word ends included), a linear softmax over it gives the language, and both
are trained by stochastic gradient descent in numpy on a bounded sample.

What is set on rows the training has not seen: a temperature; the least probability of
an answer that stands; and the greatest share of subwords never trained, above which a
text is of no language taught.  That share is told apart from outside text, the same
rows with their bytes shuffled.

As average and softmax input are linear, a scored subword needs only the product of
its embedding and the weights: one row of a small table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from gaugeworks.llm.arrowtext import LOWER, by_text, column_bytes, eights, pieces
from gaugeworks.llm.cluster import carried, fields, ready
from gaugeworks.llm.sampling import example_texts, per_class

BITS = 16
SIZES = (3, 4)
#: Bits by which a subword is known as trained: finer than its bucket, so that few
#: strange ones are taken for known.
FINE = 20
UNKNOWN = "und"
#: Subwords' worth of ordinary text that every text is given before its share of
#: strange ones is judged: a text of one word says little.
PATIENCE = 20


def hashed_subwords(raw: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each subword size the ``FINE`` first bits of the subwords' hashes and their
    n+1 text offsets.  A text shorter than the size has one subword, itself."""
    view = eights(LOWER[raw])
    out = []
    for size in SIZES:
        count = np.diff(at)
        made = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
        own_at = np.concatenate([[0], np.cumsum(made)])
        keep = np.ones(len(raw), bool)
        for back in range(1, size):  # the last places of a text begin no whole subword
            place = at[1:] - back
            keep[place[(place > at[:-1])]] = False
        begin = np.flatnonzero(keep)
        gram = view[begin] & np.uint64((1 << (8 * size)) - 1)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            gram[own_at[short]] &= (np.uint64(1) << (count[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out.append((((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FINE)).astype(np.int64), own_at))
    return out


def subwords(raw: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same by buckets, those of a size after those of the one before."""
    return [((fine >> (FINE - BITS)) + (order << BITS), own_at) for order, (fine, own_at) in enumerate(hashed_subwords(raw, at))]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times weights
    bias: np.ndarray
    temperature: float
    reject_below: float
    known: np.ndarray  # size x fine hash: whether such a subword was trained
    usual: float  # share of strange subwords in text of the languages taught
    most_strange: float

    def judged(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages' probabilities, share of strange subwords) of every text."""
        n = len(at) - 1
        if not self.languages:
            return np.zeros((n, 0)), np.zeros(n)
        total, count, strange = 0.0, np.zeros(n), np.zeros(n)
        for order, (fine, own_at) in enumerate(hashed_subwords(raw, at)):
            count = count + np.diff(own_at)
            total = total + by_text(self.table[(fine >> (FINE - BITS)) + (order << BITS)], own_at)
            strange = strange + by_text((~self.known[order][fine]).astype(np.int64), own_at)
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), strangeness(strange, count, self.usual)


def strangeness(strange: np.ndarray, count: np.ndarray, usual: float) -> np.ndarray:
    return (strange + PATIENCE * usual) / (count + PATIENCE)


def train(texts: list[str], labels: list[str], dim: int = 16, steps: int = 20_000, rate: float = 0.5, max_error: float = 0.01, max_loss: float = 0.001, seed: int = 7) -> LanguageModel:
    """Fit on four fifths of the rows and calibrate on the rest.

    ``max_error``: the threshold is the least at which the answers kept on the
    calibration rows are wrong no more often than this; but it never rejects more than
    half of ``max_loss`` of the right ones.  ``most_strange`` lies between the share of
    strange subwords that as many calibration rows stay below and that of nearly all
    outside text.
    """
    languages = sorted(set(labels))
    table_size = len(SIZES) << BITS
    if not languages:
        return LanguageModel([], np.zeros((table_size, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros((len(SIZES), 1 << FINE), bool), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        found = subwords(raw, np.array([0, len(raw)]))
        bucket, count = np.unique(np.concatenate([b for b, _ in found]), return_counts=True)
        rows.append((bucket, (count / max(1, count.sum())).astype(np.float32)))
    embed = rng.normal(0, 0.1, (table_size, dim)).astype(np.float32)
    weight, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    if not len(held):
        held = fit
    epochs = max(6, -(-steps // max(1, len(fit))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            bucket, share = rows[i]
            mean = share @ embed[bucket]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = weight @ p
            weight -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            embed[bucket] -= (step * 4) * share[:, None] * back
    table = embed @ weight
    logits = np.array([share @ table[bucket] + bias for bucket, share in rows])

    def softmax(scale: float) -> np.ndarray:
        z = logits[held] / scale
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    scales = np.geomspace(0.05, 5, 60)
    doubt = 1 / (len(held) + 2)  # no more sure than so many rows can tell
    told = [np.clip(softmax(s)[np.arange(len(held)), target[held]], 1e-9, 1 - 1e-9) for s in scales]
    loss = [-((1 - doubt) * np.log(p) + doubt * np.log(1 - p)).mean() for p in told]
    temperature = float(scales[int(np.argmin(loss))])
    p = softmax(temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == target[held]
    rank = np.argsort(-top)
    error = np.cumsum(~right[rank]) / np.arange(1, len(rank) + 1)
    fine = np.flatnonzero(error <= max_error)
    if len(fine) and fine[-1] == len(rank) - 1:
        reject = 0.0  # all answers together are right often enough
    else:
        reject = float(top[rank[fine[-1]]]) if len(fine) else 1.0
        reject = min(reject, float(np.quantile(top[right], max_loss / 2, method="lower")) if right.any() else reject)
    known, usual, most_strange = outside_limit(texts, fit, held, max_loss / 2, rng)
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, reject, known, usual, most_strange)


def outside_limit(texts: list[str], fit: np.ndarray, held: np.ndarray, max_loss: float, rng: np.random.Generator) -> tuple[np.ndarray, float, float]:
    """(subwords trained, usual share of strange ones, the share that is too much)."""
    known = np.zeros((len(SIZES), 1 << FINE), bool)

    def fine(raw: np.ndarray) -> list[np.ndarray]:
        return [f for f, _ in hashed_subwords(raw, np.array([0, len(raw)]))]

    def counted(raws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found = [[(np.count_nonzero(~known[k][f]), len(f)) for k, f in enumerate(fine(r))] for r in raws]
        return tuple(np.array(found).reshape(len(raws), -1, 2).sum(axis=1).T)

    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    for i in fit:
        for k, f in enumerate(fine(raws[i])):
            known[k][f] = True
    inside = [raws[i] for i in held if len(raws[i])]
    if not inside:
        return known, 0.0, 1.0
    strange, count = counted(inside)
    usual = float(strange.sum() / count.sum())
    own = float(np.quantile(strangeness(strange, count, usual), 1 - max_loss, method="higher"))
    outside = float(np.quantile(strangeness(*counted([rng.permutation(r) for r in inside]), usual), 0.05, method="lower"))
    for r in inside:
        for k, f in enumerate(fine(r)):
            known[k][f] = True
    return known, usual, own + max(0.0, outside - own) / 2


def fit_language_model(labelled: DataFrame, each: int = 1000, text: str = "text", label: str = "lang", key: str = "doc_id", **settings) -> LanguageModel:
    """Train on a sample of at most about ``each`` rows a language (bounded by
    ``2 * each`` times the languages, of texts up to ``sampling.MOST_BYTES``), every
    language among them.  Rows without text or label are no examples; repeated rows are
    one."""
    own = labelled.select(labelled[f"`{key}`"].alias("key"), labelled[f"`{text}`"].alias("text"), labelled[f"`{label}`"].alias("label"))
    rows = example_texts(own, "text", "key", "label").where("text rlike '\\\\p{L}' and label is not null")
    sample = per_class(rows, "label", each).collect()
    sample.sort(key=lambda r: (str(r.key), r.text))
    return train([r.text for r in sample], [r.label for r in sample], **settings)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``, ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and is rejected;
    other texts get a learned language and its calibrated probability as score, and
    are rejected where that is below the model's threshold or where too many of their
    subwords were never trained.  A model without languages answers ``und``.  Long
    texts are judged whole; repeated rows give repeated rows, an empty table an empty
    one.  Columns of these names, in any case, are replaced.
    """
    made = fields(lang_pred=StringType(), score=DoubleType(), rejected=BooleanType())
    shipped = ready(docs.sparkSession).sparkContext.broadcast(model)
    source, schema, kept = carried(docs, made, text)
    source = source.select("*", F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False)))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            letters = batch.column(kept + 1).to_numpy(zero_copy_only=False).astype(bool)
            raw, at = column_bytes(batch.column(kept))
            for i, j in pieces(at, 1 << 20):
                p, strange = m.judged(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                known = letters[i:j] & bool(m.languages)
                best = p.argmax(axis=1) if m.languages else np.zeros(j - i, int)
                score = np.where(known, p.max(axis=1) if m.languages else 0.0, 0.0)
                lang = [m.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                own = batch.slice(i, j - i)
                rejected = ~known | (score < m.reject_below) | (strange > m.most_strange)
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(kept)), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=names)

    return source.mapInArrow(run, schema)
