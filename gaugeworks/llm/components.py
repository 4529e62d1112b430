"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations and two joins on the links; rounds grow with the
logarithm of the longest chain.  Links live in tables of the shared folder between
rounds and never reach the driver, which sees a count and whether they are settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.cluster import discard, join_with_hot, written

MOST_ROUNDS = 60


def _neighbours(links: DataFrame, loops: DataFrame) -> DataFrame:
    """(u, m, n, below, above) of every node: the least of itself and its neighbours, and
    how many links it has, to smaller nodes and to larger ones."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(loops)
    return both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Every node's smaller neighbours and itself, linked with the least of them."""
    few = written(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    moved = join_with_hot(links, few, ["u"], "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.unionByName(few.select("u", F.col("m").alias("v"))).distinct(), "links")
    discard(few)
    return out


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of a link; root is the least node it is connected
    with.  Links may repeat, run either way or join a node with itself; nulls are
    no nodes.  No links, no rows.

    The links are settled when each node has one smaller neighbour or only larger ones:
    the table that a round begins with tells, and then it is the result.  A node with very
    many links, the centre of a star, gets its least neighbour by an aggregation that
    combines before it shuffles and gives it to its links by ``join_with_hot``, so no task
    takes all of them."""
    given = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(f"`{u}` is not null and `{v}` is not null").distinct()
    given = written(given, "links")
    loops, proper = given.where("u = v"), given.where("u <> v")
    total = proper.count()
    now = _small_star(proper, total) if total else proper
    for _ in range(MOST_ROUNDS):
        least = written(_neighbours(now, loops), "least")
        if least.where("below > 1 or (below = 1 and above > 0)").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_with_hot(both.where("v > u"), least, ["u"], "n", 2 * total)
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        last, now = now, _small_star(large, total)
        discard(last, least, large)
    else:
        raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
    out = written(least.select(F.col("u").alias("node"), F.col("m").alias("root")), "components")
    discard(now, given, least)
    return out
