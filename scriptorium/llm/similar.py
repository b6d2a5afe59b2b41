"""Exact shingle similarity (Jaccard) within groups of candidates.

Candidates come as components, such as those of SimHash links, which may be loose: two texts of one component are linked
here only if the sets of their shingles have at least the wanted similarity. Texts with one and the same set
are collapsed first. The sets of a component then stand together, in blocks of bounded size if it is large (see
``buckets``), and leave as chains of links, never as all pairs. Texts that are linked already are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.buckets import chained, dealt, join_labels, whole_groups
from scriptorium.llm.components import connected_components
from scriptorium.llm.simhash import NO_ID, SimHashParams, fingerprints, grouped, planned, shingles, text_digest
from scriptorium.llm.storage import bounded_batches, materialise, scratch


@dataclass(frozen=True)
class SimilarParams:
    """``shingle`` words to a shingle; links at a similarity of ``least[0] / least[1]`` or more."""

    shingle: int = 5
    least: tuple[int, int] = (4, 5)
    block_rows: int = 256


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The different shingles of one UTF-8 text as sorted 64-bit hashes."""
    import xxhash

    return np.array(sorted({xxhash.xxh64_intdigest(p) for p in shingles(text, shingle)}), np.uint64)


def verified(texts: DataFrame, params: SimilarParams = SimilarParams()) -> DataFrame:
    """``node, component`` of all nodes with a link, from ``key, node, text``: only texts of one ``key`` can link (see ``connected_components``)."""
    with scratch() as tables:
        bounded_batches(texts.sparkSession)
        rows = texts.select("key", "node", F.col("text").cast("string").cast("binary").alias("text"))
        sets = materialise(rows.mapInArrow(_sets(params.shingle), "key long, node long, digest binary, shingles binary"))
        reps = materialise(sets.groupBy("key", "digest").agg(F.min("node").alias("rep"), F.min_by("shingles", "node").alias("shingles")))
        # by merge joins at every size: candidates grow with the corpus
        copies = sets.select("key", "digest", "node").join(reps.select("key", "digest", "rep").hint("merge"), ["key", "digest"])
        copies = copies.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        groups = dealt(reps.select(F.lit(0).alias("tab"), "key", "rep", "shingles"), reps.count(), params.block_rows, "rep")
        least, block_rows = params.least, params.block_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, starts in whole_groups(batches, 4 * block_rows):
                ids = table.column("rep").to_numpy()
                block, meet = table.column("block").to_numpy(), table.column("meet").to_numpy()
                held = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
                labels = np.arange(len(ids))
                for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                    across = block[at:end] if meet[at] % 2 else None
                    labels[at:end] = at + linked(held[at:end], least, across)
                a, b = chained(ids, labels)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        links = materialise(groups.mapInArrow(run, "a long, b long").where("a <> b").union(copies))
        return tables.result(connected_components(links))


def distinct_documents(docs: DataFrame, params: SimilarParams = SimilarParams(), near: SimHashParams | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of texts that links connect, the row with the smallest id.

    A document is an id with a text. Nodes are the distinct texts, named by the smallest id that has them; a text that has no
    id, or only ids whose first text (by MD5) is another one, gets a name beyond all ids, made from a hash. Of repeated rows
    (one id, one text) the least stays, compared column by column. SimHash tables give the candidates (``near``, by default
    planned for the number of rows).
    """
    near = near or planned(docs.count(), params.shingle)
    names = [f"f{i}" for i in range(near.words)]
    with scratch() as tables:
        about = materialise(fingerprints(docs, near, digest=True).groupBy("doc_id", "digest").agg(F.count("*").alias("n"), *(F.min(f).alias(f) for f in names)))
        first = about.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("first"))
        own = F.xxhash64("doc_id", "digest").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
        named = about.join(first.hint("merge"), "doc_id", "left").withColumn("node", F.when(F.col("digest") == F.col("first"), F.col("doc_id")).otherwise(own))
        least = F.min_by(F.struct("doc_id", "n", *names), "node").alias("of")
        texts = materialise(named.groupBy("digest").agg(F.min("node").alias("node"), least).select("digest", "node", "of.*"))
        found = grouped(texts.select(F.col("node").alias("doc_id"), *names), near)
        found = materialise(found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("key")))
        shared = found.where("node <> key").select("key").distinct()
        found = found.join(shared.hint("merge"), "key", "left_semi").join(texts.select("node", "doc_id", "digest").hint("merge"), "node")
        # by merge joins at every size: candidates grow with the corpus
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
        some = rows.alias("r").join(found.alias("f").hint("merge"), _same_document("r", "f")).select("f.key", "f.node", "r.text")
        members = verified(some, params)
        stay = texts.join(members.hint("merge"), "node", "left").where("component IS NULL OR component = node").select("doc_id", "digest", "n")
        stay = tables.result(stay)
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    kept = held.alias("r").join(stay.alias("f").hint("merge"), _same_document("r", "f")).select("r.*", "f.n")
    out = kept.where("n = 1").select("row.*")
    if stay.where("n > 1").head(1):  # otherwise there is nothing to be read for the second half
        out = out.unionByName(kept.where("n > 1").groupBy("doc_id", "digest").agg(F.min("row").alias("row")).select("row.*"))
    return out


def _same_document(one: str, two: str) -> Column:
    return (F.col(f"{one}.digest") == F.col(f"{two}.digest")) & F.col(f"{one}.doc_id").eqNullSafe(F.col(f"{two}.doc_id"))


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            held = [shingle_set(t.as_py() or b"", shingle).tobytes() for t in batch.column(2)]
            digests = [xxhash.xxh3_128_digest(x) for x in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(held, pa.binary())], ["key", "node", "digest", "shingles"])

    return run


def linked(sets: Sequence[np.ndarray], least: tuple[int, int], block: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components that links of ``least`` similarity make; with ``block``, of links across blocks alone."""
    n = len(sets)
    labels = np.arange(n)
    if n < 2:
        return labels
    size = np.array([len(s) for s in sets], np.int64)
    known, code = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(code, np.cumsum(size)[:-1])
    mine = np.zeros(len(known), bool)
    up, down = least
    for i in range(n - 1):
        rest = slice(i + 1, n)
        fits = (labels[rest] != labels[i]) & (down * np.minimum(size[rest], size[i]) >= up * np.maximum(size[rest], size[i]))
        if block is not None:
            fits &= block[rest] != block[i]
        others = np.flatnonzero(fits) + i + 1
        if not len(others):
            continue
        mine[codes[i]] = True
        both = np.array([np.count_nonzero(mine[codes[j]]) for j in others.tolist()], np.int64)
        mine[codes[i]] = False
        near = others[down * both >= up * (size[others] + size[i] - both)]
        labels = join_labels(labels, np.full(len(near), i), near)
    return labels
