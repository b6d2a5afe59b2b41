"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most ``distance`` bits and the radii of the
segments satisfy ``sum(radius + 1) > distance``, then in some segment they differ in at most that segment's
radius (the general pigeonhole principle), so looking up every value of a small Hamming ball around each segment
in that segment's table finds every pair. The complete distance is then computed for whatever the tables return.

Radii are 0 or 1. Of two values that differ in one bit, exactly one has a 0 there, so only flips of 0 to 1 are
enumerated: each pair is met once and the balls halve.

Equal fingerprints are collapsed first, so copies cost nothing. What the tables return is compared in blocks of
bounded size (see ``buckets``) and leaves them as chains of links, never as all pairs.

Defined results: a null or blank text has no shingles and fingerprint zero, which links like any other. Repeated
rows get equal results; rows with one ``doc_id`` count as one document. A row without a ``doc_id`` links like any other, but
names no component: that of rows without an id alone is null. Ids must be smaller than 2**62. An empty table gives an empty
result. Columns beyond ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.buckets import chained, dealt, join_labels, whole_groups
from scriptorium.llm.components import connected_components
from scriptorium.llm.storage import bounded_batches, materialise, scratch

#: Byte value to eight bytes that hold its bits, the most significant first.
#: Names of nodes that have no id of their own begin here, so that a component with an id is named by one.
NO_ID = 1 << 62
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


@dataclass(frozen=True)
class SimHashParams:
    """``shingle`` words to a shingle; ``words`` 64-bit words to a fingerprint; links at ``distance`` bits or fewer.

    ``segments`` lists ``(width, radius)`` from the most significant bit on; one that doesn't fit into the rest of a word begins
    in the next. ``exhaustive`` demands that they cover all bits and meet the pigeonhole bound, so that no link is missed. ``near``: see ``buckets.dealt``.
    ``distinct`` counts each different shingle of a text once, so that the fingerprint is one of a set.
    """

    shingle: int = 3
    words: int = 1
    distance: int = 3
    segments: Sequence[tuple[int, int]] = ((32, 1), (32, 1))
    exhaustive: bool = True
    block_rows: int = 4096
    near: int = 0
    distinct: bool = False

    def __post_init__(self) -> None:
        if self.exhaustive and sum(w for w, _ in self.segments) != 64 * self.words:
            raise ValueError("the segments must cover the fingerprint")
        if any(r not in (0, 1) for _, r in self.segments):
            raise ValueError("a segment's radius is 0 or 1")
        if self.exhaustive and sum(r + 1 for _, r in self.segments) <= self.distance:
            raise ValueError("these segments can miss links within the distance")


#: Share of bits in which fingerprints of sets of a similarity of 0.8 differ.
APART = 0.1524


def planned(n: int, shingle: int = 5, recall: float = 0.994, bucket: int = 64) -> SimHashParams:
    """Parameters that make pairs of a similarity of 0.8 candidates with probability ``recall``, whatever the number of texts.

    Segments are as wide as leaves about ``bucket`` unrelated texts to a value (16 bits at least), and there are as many as
    the recall needs; so what is compared for a text doesn't grow with the corpus, and what is shuffled grows slowly.
    """
    width = min(32, max(16, math.ceil(math.log2(max(2, n) / bucket))))
    met = (1 - APART) ** width + width * APART * (1 - APART) ** (width - 1)
    segments = math.ceil(math.log(1 - recall) / math.log(1 - met))
    words = max(4, math.ceil(segments / (64 // width)))
    bits = 64 * words
    distance = math.floor(APART * bits + 3.3 * math.sqrt(APART * (1 - APART) * bits))
    return SimHashParams(shingle=shingle, words=words, distance=distance, segments=((width, 1),) * segments, exhaustive=False, near=8, distinct=True)


def shingles(text: bytes, shingle: int) -> list[bytes]:
    """Each run of ``shingle`` words of one UTF-8 text, in order; all its words as one if there are fewer."""
    parts = text.lower().split()
    if not parts:
        return []
    flat = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    span = min(shingle, len(parts))
    first, last = starts[: len(parts) - span + 1].tolist(), ends[span - 1 :].tolist()
    return [flat[a:b] for a, b in zip(first, last)]


def fingerprint(text: bytes, shingle: int = 3, words: int = 1, distinct: bool = False) -> list[int]:
    """The fingerprint of one UTF-8 text, as ``words`` unsigned 64-bit integers."""
    import xxhash

    pieces = shingles(text, shingle)
    if not pieces:
        return [0] * words
    if distinct:
        pieces = list(dict.fromkeys(pieces))
    n = len(pieces)
    bits = np.zeros(64 * words, np.int64)
    for at in range(0, n, 1 << 13):
        some = pieces[at : at + (1 << 13)]
        digest = np.empty((len(some), words), ">u8")
        digest[:, 0] = first = np.array([xxhash.xxh64_intdigest(p, 42) for p in some], np.uint64)
        for w in range(1, words):
            digest[:, w] = _mixed(first, w)
        lanes = _SPREAD[digest.view(np.uint8).reshape(len(some), -1)]
        for row in range(0, len(some), 255):
            bits += lanes[row : row + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    packed = np.packbits(2 * bits > n).view(">u8")
    return [int(x) for x in packed]


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from each hash, by the finalizer of splitmix64."""
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, params: SimHashParams, digest: bool = False) -> DataFrame:
    """``doc_id`` and the words ``f0``, ``f1``, ... of the fingerprint (as signed LONGs) of each row's whole text; ``digest`` adds its MD5."""
    bounded_batches(docs.sparkSession)
    names = [f"f{i}" for i in range(params.words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            rows = np.array([fingerprint(t.as_py() or b"", params.shingle, params.words, params.distinct) for t in texts], np.uint64)
            rows = rows.reshape(batch.num_rows, params.words).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(rows[:, i]) for i in range(params.words))], [*batch.schema.names[:-1], *names])

    some = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")]
    if digest:
        some.insert(1, text_digest(F.col("text")).alias("digest"))
    return docs.select(*some).mapInArrow(run, "doc_id long, " + ("digest binary, " if digest else "") + ", ".join(f"{n} long" for n in names))


def text_digest(text: Column) -> Column:
    """16 bytes that tell a text from any other; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the fingerprint's words and ``component_id``, the smallest reachable id."""
    with scratch() as tables:
        found = grouped(materialise(fingerprints(docs, params)), params)
        return tables.result(found.withColumn("component_id", F.when(F.col("component_id") < NO_ID, F.col("component_id"))))


def grouped(prints: DataFrame, params: SimHashParams) -> DataFrame:
    """``prints`` (a table of ``doc_id`` and the fingerprint's words) with ``component_id``, from ``NO_ID`` on if no id is in it."""
    names = [f"f{i}" for i in range(params.words)]
    own = F.xxhash64(*names).bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    reps = materialise(prints.groupBy(*names).agg(F.min("doc_id").alias("rep")).withColumn("rep", F.coalesce("rep", own)))
    members = connected_components(links(reps, params)).withColumnRenamed("node", "rep")
    named = reps.join(members, "rep", "left").select(*names, F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, names)


def links(reps: DataFrame, params: SimHashParams) -> DataFrame:
    """Edges ``a``, ``b`` between ids ``rep`` that connect whatever fingerprints lie within the distance, directly or not."""
    spark = reps.sparkSession
    names = [f"f{i}" for i in range(params.words)]
    probes = sum(1 + r * w // 2 for w, r in params.segments)
    n = reps.count()
    rows = reps.select("rep", *names, F.explode(_entries(params, names)).alias("e"))
    rows = rows.select(F.col("e.tab").alias("tab"), F.col("e.key").alias("key"), F.col("e.probe").alias("probe"), "rep", *names)
    groups = dealt(rows, n * probes, params.block_rows, "rep", params.near)
    bounded_batches(spark)
    distance = params.distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            ids, labels = _linked(table, starts, names, distance)
            a, b = chained(ids, labels)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return materialise(groups.mapInArrow(run, "a long, b long").where("a <> b"))


def _entries(params: SimHashParams, names: list[str]) -> Column:
    """All table entries of a fingerprint, and all probes of its segments' balls."""
    out, bit = [], 0
    for tab, (width, radius) in enumerate(params.segments):
        if bit % 64 + width > 64:
            bit += 64 - bit % 64
        word, shift = names[bit // 64], 64 - bit % 64 - width
        out.extend(_ball(F.col(word), tab, width, shift, radius))
        bit += width
    return F.concat(*out)


def _ball(word: Column, tab: int, width: int, shift: int, radius: int) -> list[Column]:
    """A segment's table entry, and its probes: the values with one more bit set."""

    def entry(key: Column, probe: bool) -> Column:
        return F.struct(F.lit(tab).alias("tab"), key.alias("key"), F.lit(probe).alias("probe"))

    value = F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    stored = F.array(entry(value, False))
    if not radius:
        return [stored]
    flips = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(width)))
    free = F.filter(flips, lambda flip: value.bitwiseAND(flip) == 0)
    return [stored, F.transform(free, lambda flip: entry(value.bitwiseOR(flip), True))]


def _linked(table: pa.Table, starts: np.ndarray, names: list[str], distance: int, chunk: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the rows and the labels of their components, from links between a group's entries and all its rows."""
    ids = table.column("rep").to_numpy()
    prints = np.stack([table.column(n).to_numpy() for n in names]).view(np.uint64)
    probe = table.column("probe").to_numpy(zero_copy_only=False)
    block, meet = table.column("block").to_numpy(), table.column("meet").to_numpy()
    sizes = np.diff(np.append(starts, len(ids)))
    size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    stored = np.flatnonzero(~probe & (size > 1))
    labels = np.arange(len(ids))
    upto = np.cumsum(size[stored])
    at = 0
    while at < len(stored):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chunk, "right")))
        some = stored[at:end]
        n = size[some]
        left = np.repeat(some, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[some], n)
        new = ((right > left) | probe[right]) & ((meet[left] % 2 == 0) | (block[left] != block[right]))
        left, right = left[new], right[new]
        apart = np.zeros(len(left), np.uint16)
        for word in prints:
            apart += np.bitwise_count(word[left] ^ word[right])
        near = apart <= distance
        labels = join_labels(labels, left[near], right[near])
        at = end
    return ids, labels
