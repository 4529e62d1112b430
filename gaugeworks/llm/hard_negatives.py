"""Operator 11: hard negatives by branch and bound over ball trees.

1. Vectors become whole numbers and are dealt by ranges of (label, vector) into parts of
   bounded size, so parts hold few labels and near vectors.
2. A task builds the ball tree of a part and streams queries through it, all queries of a
   batch level by level: a ball's centre and radius bound the inner product with a query
   from above and from below.  A ball is left out if it has no row of an admitted label, if
   its bounds lie outside the query's score window, or if its upper bound is strictly
   beneath the query's k-th score so far (at the k-th score itself ties may still win).
   The ball of the greatest upper bound is scored first, for a high k-th score early.
3. A part returns at most k rows a query; ranks over the parts keep the first k.

Positives are the k best of the anchor's label without a window; each gives the window in
which the negatives are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.cluster import discard, ready, whole_key, written
from gaugeworks.llm.vectors import by_size, lists, sound

#: Rows of a part: a 64th of all within these bounds, so that a tree fits in a worker.
PART_ROWS = (2048, 65536)
LEAF_ROWS = 64
#: Queries that pass through a tree together.
QUERIES = 512
WIDE = 1 << 62


@dataclass
class Tree:
    """A ball tree in level order: nodes of level k are ``cuts[k]`` to ``cuts[k + 1]``,
    ``first`` and ``last`` their rows; children of the i-th node of a level are the
    2i-th and the one after it of the next.  Every level halves all nodes."""

    x: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    centre: list[np.ndarray]
    radius: list[np.ndarray]
    labels: list[tuple[np.ndarray, np.ndarray]]
    norm: float

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, label: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        order = np.arange(len(x))
        edges = np.array([0, len(x)])
        levels = [edges]
        while (edges[1:] - edges[:-1]).max() > leaf:
            middle = (edges[1:] + edges[:-1]) // 2
            for a, m, b in zip(edges[:-1], middle, edges[1:]):
                own = x[order[a:b]]
                axis = np.argmax(own.max(axis=0) - own.min(axis=0)) if own.shape[1] else None
                if axis is not None:
                    order[a:b] = order[a:b][np.argpartition(own[:, axis], m - a)]
            edges = np.sort(np.concatenate([edges, middle]))
            levels.append(edges)
        x, ids, label = x[order], ids[order], label[order]
        exact, spans, centres, radii, labels = x.astype(np.float64), [], [], [], []
        for edges in levels:
            first, size = edges[:-1], np.diff(edges)
            own = np.repeat(np.arange(len(size)), size)
            centre = np.add.reduceat(exact, first, axis=0) / size[:, None]
            away = np.sqrt(np.square(exact - centre[own]).sum(axis=1))
            spans.append((first, edges[1:]))
            centres.append(centre)
            radii.append(np.maximum.reduceat(away, first))
            labels.append((np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)))
        norm = float(np.sqrt(np.square(exact).sum(axis=1)).max())
        return cls(x, ids, label, spans, centres, radii, labels, norm)

    def bounds(self, level: int, q: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the queries with any row of each ball lie between these, with
        room for the rounding of doubles."""
        middle, away = q @ self.centre[level].T, norm[:, None] * self.radius[level][None, :]
        room = 1e-9 * (norm[:, None] * self.norm) + 1e-6
        return middle - away - room, middle + away + room

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the first ``k`` rows a query by score, then id, within
        ``low`` to ``high``; ``same``: rows of the query's label but not of its id, else rows
        of other labels.  Places without a row have the score ``-WIDE``."""
        n, d = q.shape
        real = q.astype(np.float64)
        norm = np.sqrt(np.square(real).sum(axis=1))
        alive = np.ones((n, 1), bool)
        for level, (least, most) in enumerate(self.labels):
            if level:
                alive = np.repeat(alive, 2, axis=1)
            under, over = self.bounds(level, real, norm)
            fits = (least <= label[:, None]) & (label[:, None] <= most) if same else ~((least == label[:, None]) & (most == label[:, None]))
            alive &= fits & (over >= low[:, None]) & (under <= high[:, None])
        over = np.where(alive, over, -np.inf)
        scores, ids = np.full((n, k), -WIDE), np.full((n, k), WIDE)
        exact = float(norm.max(initial=0)) * self.norm < 2**52
        first, last = self.levels[-1]

        def score(leaf: int, rows: np.ndarray) -> None:
            part = slice(first[leaf], last[leaf])
            found = (real[rows] @ self.x[part].astype(np.float64).T).astype(np.int64) if exact else q[rows] @ self.x[part].T
            other = self.label[part][None, :] != label[rows][:, None]
            good = ~other & (self.ids[part][None, :] != own[rows][:, None]) if same else other
            good &= (found >= np.maximum(low[rows], scores[rows, -1])[:, None]) & (found <= high[rows][:, None])
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                return
            rows = rows[some]
            s = np.concatenate([scores[rows], np.where(good, found, -WIDE)[some]], axis=1)
            i = np.concatenate([ids[rows], np.where(good[some], self.ids[part][None, :], WIDE)], axis=1)
            place = np.lexsort((i, -s), axis=-1)[:, :k]
            scores[rows], ids[rows] = np.take_along_axis(s, place, 1), np.take_along_axis(i, place, 1)

        best = over.argmax(axis=1)
        live = np.flatnonzero(over[np.arange(n), best] > -np.inf)
        by = live[np.argsort(best[live], kind="stable")]
        for rows in np.split(by, np.flatnonzero(np.diff(best[by])) + 1) if len(by) else []:
            score(best[rows[0]], rows)
        over[live, best[live]] = -np.inf
        for leaf in np.flatnonzero((over > -np.inf).any(axis=0)):
            rows = np.flatnonzero((over[:, leaf] >= scores[:, -1]) & (over[:, leaf] > -np.inf))
            if len(rows):
                score(leaf, rows)
        return scores, ids


def _expanded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, low, high) of every window of a batch of queries."""
    low, at = lists(batch.column("low"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
    return row, np.arange(len(row)) - at[:-1][row], low, lists(batch.column("high"))[0]


def searched(points: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(q, w, id, score): the first ``k`` rows a part for window ``w`` of query ``q``.
    ``points`` are (part, id, label, x), ``queries`` (part, q, id, label, x, low, high) with
    as many windows as ``low`` and ``high`` have values."""
    ready(points.sparkSession)
    windows = F.array().cast("array<long>")
    rows = points.select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("q"), "id", "label", "x", windows.alias("low"), windows.alias("high"))
    both = rows.unionByName(queries.select("part", F.lit(1).alias("kind"), "q", "id", "label", "x", "low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, trees = None, [], None
        for whole in batches:
            mark = whole.column("part").to_numpy() * 2 + whole.column("kind").to_numpy()
            for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist()], [*edges[1:], len(mark)]):
                batch = whole.slice(a, b - a)
                if not batch.num_rows:
                    continue
                if part != (now := batch.column("part")[0].as_py()):
                    part, held, trees = now, [], None
                if batch.column("kind")[0].as_py() == 0:
                    held.append(batch)
                    continue
                if trees is None:
                    table = pa.Table.from_batches(held) if held else None
                    ids, label = (table.column(c).to_numpy() for c in ("id", "label")) if held else (None, None)
                    trees = {x.shape[1]: Tree.of(x, ids[r], label[r]) for r, x in by_size(table.column("x"))} if held else {}
                    held = []
                for first in range(0, batch.num_rows, QUERIES):
                    yield from answered(batch.slice(first, QUERIES), trees)

    def answered(batch: pa.RecordBatch, trees: dict[int, Tree]) -> Iterator[pa.RecordBatch]:
        row, number, low, high = _expanded(batch)
        q, own, label = (batch.column(c).to_numpy() for c in ("q", "id", "label"))
        for rows, x in by_size(batch.column("x")):
            if (tree := trees.get(x.shape[1])) is None:
                continue
            place = np.full(batch.num_rows, -1)
            place[rows] = np.arange(len(rows))
            mine = np.flatnonzero(place[row] >= 0)
            r = row[mine]
            scores, ids = tree.search(x[place[r]], own[r], label[r], low[mine], high[mine], k, same)
            some, nth = np.nonzero(scores > -WIDE)
            yield pa.RecordBatch.from_arrays([pa.array(q[r[some]]), pa.array(number[mine[some]].astype(np.int32)), pa.array(ids[some, nth]), pa.array(scores[some, nth])], names=["q", "w", "id", "score"])

    sorted_rows = both.repartition("part").sortWithinPartitions("part", "kind")
    return sorted_rows.mapInArrow(run, "q long, w int, id long, score long")


def first_of(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each (q, w), with their ``rank``."""
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for
    every row where ``anchor`` holds and each of its first ``positives`` rows of the same
    label but another key, the first ``negatives`` rows of other labels whose score is from
    ``window[0]`` to ``window[1]`` hundredths of the positive's.  The score is the inner product
    of the components times ``scale``, rounded down; higher scores come first, ties by
    the smaller key.  Positives without a negative in their window give no row; so do those
    of a negative score, whose window is empty.

    Rows with a null key, label or vector, with null or non-finite components, or with a
    scaled vector whose squared length reaches 2^62 (its score would be no long) take no
    part.  Vectors of different lengths do not meet.  Rows that repeat are rows of their
    own: a repeated anchor gives its rows again.  Keys and labels are integers.  Other columns
    are not read.  An empty table gives an empty one."""
    own = vectors.select(whole_key(vectors, key).alias("id"), whole_key(vectors, label).alias("label"), vectors[f"`{vector}`"].alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound(F.col("v")))
    real = F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    own = own.withColumn("r", real).where(F.aggregate("r", F.lit(0.0), lambda s, c: s + c * c) < 2.0**62)
    rows = written(own.select("id", "label", F.transform("r", lambda c: c.cast("long")).alias("x"), "anchor"), "vectors")
    n = rows.count()
    parts = max(1, -(-n // min(PART_ROWS[1], max(PART_ROWS[0], n // 64))))
    dealt = rows.repartitionByRange(parts, "label", F.size("x"), "x", "id", F.monotonically_increasing_id())
    points = written(dealt.withColumn("part", F.spark_partition_id().cast("long")).withColumn("q", F.monotonically_increasing_id()), "parts")
    anchors = points.where("anchor").select("q", "id", "label", "x")

    of_label = points.groupBy("label", "part").agg(F.count("*").alias("n")).select("label", "part")
    least = F.array(F.lit(-WIDE))
    asked = anchors.join(of_label, "label").withColumns({"low": least, "high": F.array(F.lit(WIDE))})
    found = first_of(searched(points, asked, positives, True), positives)
    best = written(found.select("q", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    low, high = window
    score = F.col("positive_score")
    limits = best.where(score >= 0).withColumn("low", F.expr(f"positive_score div 100 * {low} + (positive_score % 100 * {low} + 99) div 100")).withColumn("high", F.expr(f"positive_score div 100 * {high} + positive_score % 100 * {high} div 100"))
    limits = limits.where("low <= high").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("windows"))
    several = anchors.join(limits, "q").select("q", "id", "label", "x", F.col("windows.low").alias("low"), F.col("windows.high").alias("high"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    kept = first_of(searched(points, several, negatives, False), negatives)
    # the windows of a query stand in the order of its positives that have one
    numbered = best.where(score >= 0).join(limits.select("q", F.posexplode("windows").alias("w", "of")).select("q", "w", F.col("of.p").alias("p")), ["q", "p"])
    named = numbered.join(anchors.select("q", F.col("id").alias("anchor_id")), "q")
    out = kept.select("q", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["q", "w"])
    out = written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
    discard(rows, points, best)
    return out
