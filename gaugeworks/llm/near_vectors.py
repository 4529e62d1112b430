"""Operator 13: embedding near-duplicates by collision-counting projections.

1. Equal vectors of a label become one class.  Every class is projected on many random
   directions; projections are whole numbers, so that every task finds the same ones.
2. Two vectors collide on a projection if one lies in the window of half width ``reach``
   centred on the other.  A pair at the threshold collides on a projection with a known
   probability, from which the number of collisions that a pair needs is calibrated.
3. To bring colliding vectors together, a few projections are cut into slices of a
   sorted line; the slices on ``cuts`` projections name a cell.  A vector enters every
   cell that half a window around it touches, so two vectors whose windows collide on all
   cuts meet in the cell of their midpoint, whatever borders lie between them.  The more
   vectors a label has, the more cuts; ``tables`` independent sets of cuts keep the recall.
4. In a cell (or two chunks of a large one) a projection is sorted and windows over it
   give the pairs that collide there; their collisions on the other projections are counted,
   and pairs that collide on all cuts and pass the count are verified by their cosine.
   A pair is verified once: in the first table in whose windows it collides, in the cell
   of its midpoint.  A group returns counts and a spanning forest, never the pairs.
5. Components of the forests are the classes of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil, comb, erf, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.arrowtext import MIX, SHINGLE_STEP, column_bytes, mixed, span_hashes
from gaugeworks.llm.cluster import discard, join_with_hot, ready, whole_key, written
from gaugeworks.llm.components import connected_components
from gaugeworks.llm.vectors import by_size, runs, sound, unit

COSINE = 0.98
RECALL = 0.9999
PROJECTIONS = 32
#: Half a window in standard deviations of the difference of a pair at the threshold.
SPREAD = 3.2
#: Vectors that a cell may be expected to hold; a larger one is compared chunk by chunk.
CELL_ROWS = 1024
CHUNK_ROWS = 2048
MOST_CUTS = 12
ONE = 1 << 32


@dataclass(frozen=True)
class Plan:
    """How vectors meet: ``reach`` and the slices' width as whole numbers, ``ONE`` for 1."""

    reach: int
    width: int
    cuts: int
    tables: int
    projections: int
    least: int

    def columns(self, table: int) -> slice:
        return slice(table * self.cuts, (table + 1) * self.cuts)


def plan_for(rows: int, cosine: float = COSINE, recall: float = RECALL) -> Plan:
    """Windows of ``SPREAD`` deviations; so many cuts that ``rows`` evenly spread vectors
    of one label fill cells of about ``CELL_ROWS``; so many tables that a pair at the
    threshold collides on all cuts of one with half the allowed loss; the largest count
    that such a pair reaches with the other half."""
    apart = sqrt(max(2 - 2 * cosine, 1e-9))
    reach = SPREAD * apart
    within = lambda a, b: (erf(b / sqrt(2)) - erf(a / sqrt(2))) / 2
    width = 2 * reach
    share = sum(within(k * width, (k + 1) * width) * within(k * width - reach / 2, (k + 1) * width + reach / 2) for k in range(-50, 50))
    cuts = min(MOST_CUTS, max(1, ceil(log(max(1.0, rows / CELL_ROWS)) / -log(share)))) if share < 0.95 else 1
    hit = erf(SPREAD / sqrt(2))
    lost = (1 - recall) / 2
    tables = max(1, ceil(log(lost) / log1p(-(hit**cuts))))
    m = max(PROJECTIONS, tables * cuts)
    missed, least = 0.0, 0
    for count in range(m + 1):
        missed += comb(m, count) * hit**count * (1 - hit) ** (m - count)
        if missed > lost:
            break
        least = count + 1
    return Plan(int(reach * ONE), int(width * ONE), cuts, tables, m, least)


@cache
def directions(size: int, projections: int) -> np.ndarray:
    return np.rint(np.random.default_rng(size).standard_normal((size, projections)) * 4096)


def projected(x: np.ndarray, projections: int) -> np.ndarray:
    """Projections of unit rows as whole numbers: all products and sums are whole and
    below 2^53, so the order of the sum does not matter."""
    return (np.rint(x * (1 << 20)) @ directions(x.shape[1], projections)).astype(np.int64)


def begun(label: np.ndarray, table: int) -> np.ndarray:
    return mixed(label + np.full(1, table + 1, np.uint64) * MIX)


def step(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    return mixed(h * SHINGLE_STEP + part.astype(np.uint64))


def cell_rows(p: np.ndarray, label: np.ndarray, plan: Plan, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cells they enter): all cells within half a window on every cut."""
    half = plan.reach // 2 + 1
    row, h = np.arange(len(p)), begun(label, table)
    for k in range(plan.columns(table).start, plan.columns(table).stop):
        low, high = (p[row, k] - half) // plan.width, (p[row, k] + half) // plan.width
        two = np.flatnonzero(high > low)
        h, row = np.concatenate([step(h, low), step(h[two], high[two])]), np.concatenate([row, row[two]])
    return row, h.view(np.int64)


def entered_cells(classes: DataFrame, plan: Plan) -> DataFrame:
    """(lab, id, t, cell) of every class."""
    ready(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(0))
            label = span_hashes(raw, at[:-1], at[1:])
            for rows, x in by_size(batch.column(2)):
                p = projected(unit(x), plan.projections)
                for t in range(plan.tables):
                    row, cell = cell_rows(p, label[rows], plan, t)
                    own = pa.array(rows[row])
                    table = pa.array(np.full(len(row), t, np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), table, pa.array(cell)], names=["lab", "id", "t", "cell"])

    return classes.select("lab", "id", "vector").mapInArrow(run, "lab string, id long, t int, cell long")


def colliding(left: np.ndarray, right: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) places that collide on one projection: the right ones are sorted,
    every left one takes what lies in the window around it."""
    order = np.argsort(right, kind="stable")
    low = np.searchsorted(right[order], left - reach, "left")
    size = np.searchsorted(right[order], left + reach, "right") - low
    row = np.repeat(np.arange(len(left)), size)
    return row, order[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]]


def counted(lines: np.ndarray, u: np.ndarray, v: np.ndarray, plan: Plan, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (u, v) those that collide on all cuts of the table and on ``least``
    projections (rows of ``lines``) in all.  A pair goes as soon as it has missed too many."""
    cuts = plan.columns(table)
    for k in range(cuts.start + 1, cuts.stop):
        hit = np.abs(lines[k][u] - lines[k][v]) <= plan.reach
        u, v = u[hit], v[hit]
    missed, allowed = np.zeros(len(u), np.int16), plan.projections - plan.least
    for n, k in enumerate(k for k in range(plan.projections) if not cuts.start <= k < cuts.stop):
        missed += np.abs(lines[k][u] - lines[k][v]) > plan.reach
        if n % 4 == 3:
            live = missed <= allowed
            u, v, missed = u[live], v[live], missed[live]
    live = missed <= allowed
    return u[live], v[live]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of ``n`` rows is connected with by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def verified(x: np.ndarray, copies: np.ndarray, chunk: np.ndarray, i: int, j: int, label: np.ndarray, table: int, cell: int, plan: Plan, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows linked with each member, a root of each) among the pairs of chunk ``i`` with
    chunk ``j``, or within one, that are counted in this cell of this table."""
    n = len(x)
    lines = np.ascontiguousarray(projected(x, plan.projections).T)
    rows = np.flatnonzero(chunk == i)
    columns = rows if i == j else np.flatnonzero(chunk == j)
    cuts = plan.columns(table)
    links = np.zeros(n)
    us, vs = [], []
    for r in range(0, len(rows), 256):
        part = rows[r : r + 256]
        a, b = colliding(lines[cuts.start][part], lines[cuts.start][columns], plan.reach)
        a, b = part[a], columns[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        u, v = counted(lines, a, b, plan, table)
        for t in range(table):  # pairs that an earlier table has
            earlier = (np.abs(lines[plan.columns(t)][:, u] - lines[plan.columns(t)][:, v]) <= plan.reach).all(axis=0)
            u, v = u[~earlier], v[~earlier]
        h = np.repeat(begun(label, table), len(u))
        for c in range(cuts.start, cuts.stop):
            h = step(h, ((lines[c][u] + lines[c][v]) >> 1) // plan.width)
        mine = h.view(np.int64) == cell
        u, v = u[mine], v[mine]
        for k in range(0, len(u), 1 << 15):
            p, q = u[k : k + (1 << 15)], v[k : k + (1 << 15)]
            alike = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            p, q = p[alike], q[alike]
            links += np.bincount(p, copies[q], n) + np.bincount(q, copies[p], n)
            us.append(p)
            vs.append(q)
    none = np.zeros(0, np.int64)
    return links.astype(np.int64), forest(n, np.concatenate([none, *us]), np.concatenate([none, *vs]))


def checked_cells(paired: DataFrame, plan: Plan, cosine: float) -> DataFrame:
    """(id, root, links) of the members of all groups that have a link."""
    keys = ["lab", "t", "cell", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            t, cell, i, j = (group.column(k)[0].as_py() for k in keys[1:])
            raw, at = column_bytes(group.column("lab").slice(0, 1))
            x = next(by_size(group.column("vector")))[1]
            ids = group.column("id").to_numpy()
            links, root = verified(unit(x), group.column("copies").to_numpy(), group.column("chunk").to_numpy(), i, j, span_hashes(raw, at[:-1], at[1:]), t, cell, plan, cosine)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some])], names=["id", "root", "links"])

    dealt = paired.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "chunk", "id", "copies", "vector").mapInArrow(run, "id long, root long, links long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """One row a row of ``vectors``: ``key``, ``n_links`` (other rows of the same label
    whose cosine is at least ``cosine``, equal vectors included), ``component_id``
    (least key reachable by links, own one included) and ``kept`` (key = component_id).
    ``recall`` is the least probability that a pair at the threshold is found; closer
    pairs are found surer, and no pair below the threshold is ever linked.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows
    of a null label, link with nothing; nor do vectors of different lengths.  Rows of equal
    label and vector are copies: links of one another.  A null key is above all others: a
    component without any other key has a null id, and rows of null keys are not kept.
    Rows that repeat a key are rows of their own.  Keys are integers.  Other columns are
    not read.  An empty table gives an empty one."""
    own = vectors.select(whole_key(vectors, key).alias("key"), vectors[f"`{vector}`"].alias("vector"), vectors[f"`{label}`"].alias("label"))
    good = F.col("label").isNotNull() & sound(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    named = own.withColumn("lab", F.when(good, F.concat_ws(":", F.size("vector").cast("string"), F.col("label").cast("string"))))
    named = named.select("key", "lab", F.when(good, F.col("vector")).alias("vector"))
    valid = named.where("lab is not null")
    classes = valid.groupBy("lab", "vector").agg(F.count("*").alias("copies"), F.min("key").alias("low")).withColumn("id", F.monotonically_increasing_id())
    classes = written(classes, "classes")
    sizes = classes.groupBy("lab").count().agg(F.max("count"), F.sum("count")).first()
    plan = plan_for(sizes[0] or 0, cosine, recall)

    cells = written(entered_cells(classes, plan).distinct(), "cells")
    met = written(cells.groupBy("lab", "t", "cell").agg(F.count("*").alias("n")).where("n > 1"), "met")
    placed = join_with_hot(cells, met, ["lab", "t", "cell"], "n", (sizes[1] or 0) * plan.tables)
    placed = placed.withColumn("chunks", F.ceil(F.col("n") / CHUNK_ROWS).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    placed = placed.select("lab", "id", "t", "cell", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("x"))
    paired = placed.select("id", "t", "cell", "chunk", F.least("chunk", "x").alias("i"), F.greatest("chunk", "x").alias("j")).join(classes.select("id", "lab", "vector", "copies"), "id")
    checked = written(checked_cells(paired, plan, cosine), "checked")

    roots = connected_components(checked.where("id <> root").select("id", "root"), "id", "root")
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("lab", "vector", "copies", "low", "id").join(roots.toDF("id", "comp"), "id", "left").join(links, "id", "left")
    known = written(known.withColumn("comp", F.coalesce("comp", "id")), "known")
    least = written(known.groupBy("comp").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "least")
    rated = join_with_hot(known, least, ["comp"], "n", sizes[1] or 0)
    rated = written(rated.select("lab", "vector", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rated")
    total = rated.agg(F.sum("copies")).first()[0] or 0
    linked = join_with_hot(valid, rated, ["lab", "vector"], "copies", total).select("key", "n_links", "component_id")
    alone = named.where("lab is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False))).withColumnRenamed("key", key)
    out = written(out, "near-vectors")
    discard(classes, cells, met, checked, roots, known, least, rated)
    return out
