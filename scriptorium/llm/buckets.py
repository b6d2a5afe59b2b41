"""Blocks of hash buckets: all pairs of a bucket get compared, yet no task holds an unbounded bucket.

Rows that share ``(tab, key)`` form a bucket. A bucket that may hold more than ``block_rows`` rows is dealt into
blocks, and every two of its blocks meet in one group of their own, so that a hot bucket is worked on by many
tasks. Rows are repeated once per block of their bucket only; pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import materialise


def dealt(rows: DataFrame, n_rows: int, block_rows: int, spread: str, near: int = 0) -> DataFrame:
    """Add ``block`` and ``meet`` to ``rows`` and bring the rows of each ``(tab, key, meet)`` together, sorted.

    ``n_rows`` is about how many rows there are; it sets how many counters are used to find hot buckets. A
    counter may be shared by several buckets, which can only lead to more blocks than needed. ``spread`` is the
    column whose hash deals a hot bucket's rows into blocks. ``meet`` is -2 for a bucket that isn't cut, else it
    numbers a pair of blocks; it is odd if the blocks differ, so that only pairs of rows across them are due there.
    Keys that differ in their last ``near`` bits only go to one partition: rows that one document sends to neighbouring
    keys then stand together in the shuffle files and compress well.
    """
    counters = 1 << max(10, int(8 * n_rows / block_rows).bit_length())
    slot = F.pmod(F.xxhash64("tab", "key"), F.lit(counters))
    heavy = rows.groupBy(slot.alias("slot")).count().where(F.col("count") > block_rows)
    heavy = materialise(heavy.select("slot", F.ceil(F.col("count") / block_rows).cast("int").alias("n_blocks")))
    if not heavy.head(1):
        out = rows.withColumns({"block": F.lit(0), "meet": F.lit(-2).cast("long")})
    else:
        cut = rows.withColumn("slot", slot).join(heavy, "slot", "left").drop("slot")
        n = F.col("n_blocks")
        cut = cut.withColumn("block", F.when(n.isNull(), 0).otherwise(F.pmod(F.hash(spread), n)))
        pair = lambda j: F.least("block", j).cast("long") * n + F.greatest("block", j)
        meets = F.transform(F.sequence(F.lit(0), n - 1), lambda j: 2 * pair(j) + (j != F.col("block")).cast("int"))
        out = cut.withColumn("meet", F.explode(F.when(n.isNull(), F.array(F.lit(-2).cast("long"))).otherwise(meets))).drop("n_blocks")
    return out.repartition("tab", F.shiftright("key", near), "meet").sortWithinPartitions("tab", "key", "meet")


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup sorted Arrow batches so that no ``(tab, key, meet)`` group is cut; also give each group's first row.

    ``rows`` is about how many rows are regrouped at a time.
    """
    held: list[pa.Table] = []
    for table in _larger(batches, rows):
        starts = _starts(table)
        if held and not _same(held[-1], table):
            yield _joined(held)
            held = []
        if len(starts) > 1 or not held:
            last = int(starts[-1])
            if last:
                yield _joined([*held, table.slice(0, last)])
                held = []
            held.append(table.slice(last))
        else:
            held.append(table)
    if held:
        yield _joined(held)


def _larger(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def chained(ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the rows of each label in a chain: fewer edges than rows, and no node with many."""
    order = np.argsort(labels, kind="stable")
    same = labels[order][1:] == labels[order][:-1]
    return ids[order][:-1][same], ids[order][1:][same]


def join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Components of rows after adding the links ``left[i] - right[i]``; a label is the smallest row of its component."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def _joined(tables: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
    table = pa.concat_tables(tables).combine_chunks()
    return table, _starts(table)


def _starts(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in ("tab", "key", "meet"):
        column = table.column(name).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _same(one: pa.Table, two: pa.Table) -> bool:
    return all(one.column(n)[-1].as_py() == two.column(n)[0].as_py() for n in ("tab", "key", "meet"))
