"""Connected components over an edge table, by alternating large-star and small-star steps.

Both steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) are a group-by with a
map-side minimum and an equi-join, so a node with very many neighbours is split by Spark's skew join and
never gathered into one task. The minima are written out before they are joined: both sides of the join are
then plain scans, which is what lets the adaptive planner split a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import discard, materialise, scratch


#: The edges shrink from step to step; a step has a task for so many of them, whatever the session's number of partitions.
ROWS_A_TASK, LEAST_TASKS = 50_000, 8


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node that has an edge to another one with the smallest node it can reach.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type (ids, or names such as URLs), in any order, repeats and self-loops allowed; rows with a
    null end are no edge. Returns ``node``, ``component``; the smallest node of a component is included. An
    empty edge table gives an empty result.
    """
    with scratch() as tables:
        pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now, mark = _kept(pairs)
        while mark[0]:
            with scratch() as step:
                tasks = max(LEAST_TASKS, mark[0] // ROWS_A_TASK)
                after = step.result(_small_star(_large_star(now, tasks), tasks).coalesce(tasks))
            discard(now)
            now, before, mark = after, mark, _mark(after)
            if mark == before:
                break
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        return tables.result(out.coalesce(2 * max(LEAST_TASKS, mark[0] // ROWS_A_TASK)))


def _kept(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    table = materialise(pairs)
    return table, _mark(table)


def _mark(table: DataFrame) -> tuple:
    """Number of rows and a sum of their hashes: equal marks mean that a step changed nothing."""
    return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(pairs: DataFrame, tasks: int) -> DataFrame:
    """Hang the larger neighbours of each node on the smallest node next to it."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).coalesce(tasks))
    out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return materialise(out.distinct().coalesce(tasks))


def _small_star(pairs: DataFrame, tasks: int) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them. ``a`` is larger than ``b`` in every row."""
    least = materialise(pairs.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks))
    rest = pairs.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return rest.union(least.select("a", F.col("least").alias("b"))).distinct()
