"""Near-duplicate vectors by random-hyperplane sign hashing in several tables, exact cosines and connected components.

Equal vectors are collapsed first, by a 128-bit hash. Each distinct vector is rotated at random and coded with one byte
a component; the angle between a vector and its code is kept with the code. Each code gets one key for each table: the
signs of its products with that table's hyperplanes. Codes, not vectors, go to the tables. Codes that share a key are
compared in blocks of bounded size (see ``buckets``): the angle of two codes and the angles that coding lost bound the angle of
the vectors, so that most pairs are decided for sure. What isn't, a band of about a hundredth of a radian around the
threshold, is compared again, exactly, in double precision, for which only the rows in such pairs fetch their vectors.

A pair that shares keys in several tables counts in the first of them only, which the codes tell; products of codes and
hyperplanes are products of whole numbers, so that they come out alike wherever they are computed. So links are counted
without pairs ever being rows.

The number of planes follows the number of distinct vectors, and the number of tables follows from the planes: a
pair at the threshold itself is missed with probability at most ``1 - recall``, closer pairs less often.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do
vectors of different lengths; each is its own component. Repeated rows (equal ``vec_id``) count as vectors of their
own in ``n_links``. A row without a ``vec_id`` links like any other but names no component: that of rows without an id alone
is null. Ids must be smaller than 2**62. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.buckets import chained, dealt, join_labels, whole_groups
from scriptorium.llm.components import connected_components
from scriptorium.llm.simhash import NO_ID
from scriptorium.llm.storage import bounded_batches, materialise, scratch

#: What coding may add to the angle of two vectors, as the number of tables allows for it.
SLACK = 0.02


def plan_tables(n: int, threshold: float, recall: float, bucket: int = 512) -> tuple[int, int]:
    """Planes to a table and number of tables: about ``bucket`` unrelated vectors share a key."""
    planes = min(30, max(4, math.ceil(math.log2(max(2, n) / bucket))))
    agree = (1 - min(1.0, (math.acos(threshold) + SLACK) / math.pi)) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.9999, block_rows: int = 2048, seed: int = 7
) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``): ``vec_id, n_links, component_id, kept``."""
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))
    usable = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    digest = [F.when(usable, F.xxhash64(F.lit(k), "embedding")).alias(f"d{k}") for k in (1, 2)]
    keyed = some.select("vec_id", "embedding", *digest)
    with scratch() as tables:
        own = F.col("d1").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
        reps = keyed.where("d1 IS NOT NULL").groupBy("d1", "d2", F.size("embedding").alias("dim"))
        reps = reps.agg(F.coalesce(F.min("vec_id"), own).alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        reps = materialise(reps)
        compared = _compared(reps, reps.count(), threshold, recall, block_rows, seed)
        totals = compared.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
        edges = compared.where("next IS NOT NULL").select(F.col("rep").alias("a"), F.col("next").alias("b"))
        members = connected_components(edges).withColumnRenamed("node", "rep")
        component = F.coalesce("component", "rep")
        named = reps.drop("embedding").join(totals, "rep", "left").join(members, "rep", "left").select(
            "d1", "d2", "dim",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.when(component < NO_ID, component).alias("component_id"),
        )
        linked = keyed.where("d1 IS NOT NULL").select("vec_id", "d1", "d2", F.size("embedding").alias("dim")).join(named, ["d1", "d2", "dim"])
        alone = keyed.where("d1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = linked.select("vec_id", "n_links", "component_id").union(alone)
        return tables.result(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


# ------------------------------------------------------------------------------------------------ codes


_ROTATIONS: dict[tuple[int, int], list] = {}


def _rotation(d: int, seed: int) -> list:
    """A random order of components, and a random rotation of each run of at most 256 of them."""
    if (d, seed) not in _ROTATIONS:
        random = np.random.default_rng([seed, d, 1])
        order = random.permutation(d)
        turns = [np.linalg.qr(random.standard_normal((n, n)))[0] for n in (min(256, d - a) for a in range(0, d, 256))]
        _ROTATIONS[d, seed] = [order, turns]
    return _ROTATIONS[d, seed]


def coded(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each component of the rotated rows of ``x``, and the angle between each row and its code."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    order, turns = _rotation(x.shape[1], seed)
    x = x[:, order]
    y = np.concatenate([x[:, 256 * i : 256 * i + len(t)] @ t for i, t in enumerate(turns)], axis=1)
    code = np.rint(y * (127 / np.abs(y).max(axis=1, keepdims=True)))
    cosine = (y * code).sum(axis=1) / np.sqrt((code * code).sum(axis=1) * (y * y).sum(axis=1))
    return code.astype(np.int8), np.arccos(np.minimum(cosine, 1)) + 1e-7


_PLANES: dict[tuple[int, int, int], np.ndarray] = {}


def _keys(code: np.ndarray, tables: int, planes: int, seed: int) -> np.ndarray:
    """The key of each code in each table."""
    d = code.shape[1]
    if (d, tables * planes, seed) not in _PLANES:
        _PLANES[d, tables * planes, seed] = np.rint(np.random.default_rng([seed, d, 2]).standard_normal((d, tables * planes)) * 1000)
    signs = (code.astype(np.float64) @ _PLANES[d, tables * planes, seed] > 0).reshape(len(code), tables, planes)
    return (signs * (1 << np.arange(planes))).sum(axis=2).astype(np.int32)


# ------------------------------------------------------------------------------------------------ comparison


ENTRY = "rep long, copies long, code binary, slack float"
GROUP = "tab int, key long, meet long, block int"


def _compared(reps: DataFrame, n: int, threshold: float, recall: float, block_rows: int, seed: int) -> DataFrame:
    """Rows ``rep, links, next``: newly counted links of a vector in one group, and a link to another one in it."""
    planes, tables = plan_tables(n, threshold, recall)
    bounded_batches(reps.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = batch.column(2).to_numpy()
            ends = np.cumsum(sizes)
            keys, slack = np.empty((len(sizes), tables), np.int32), np.empty(len(sizes))
            raw: list[bytes] = [b""] * len(sizes)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                code, slack[rows] = coded(flat[(ends[rows] - d)[:, None] + np.arange(d)], seed)
                keys[rows] = _keys(code, tables, planes, seed)
                for r, c in zip(rows.tolist(), code):
                    raw[r] = c.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            # never smaller than the angle that was lost
            lost = pa.array(np.nextafter(slack.astype(np.float32), np.float32(4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), lost, lists], ["rep", "copies", "code", "slack", "keys"])

    signed = reps.select("rep", "copies", "dim", "embedding").mapInArrow(hashed, ENTRY + ", keys array<int>")
    entries = signed.select("rep", "copies", "code", "slack", F.posexplode("keys").alias("tab", "sign"))
    # a vector's length goes into the key, so that only vectors of one length meet
    entries = entries.withColumn("key", F.octet_length("code").cast("long") * (1 << 32) + F.col("sign")).drop("sign")
    groups = dealt(entries, n * tables, block_rows, "rep")

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            yield from _links(table, starts, tables, planes, seed, threshold, exact=False)

    out = ", ".join(["links long, next long, again boolean", ENTRY, GROUP])
    first = materialise(groups.select(*(f.split()[0] for f in f"{ENTRY}, {GROUP}".split(", "))).mapInArrow(decided, out))
    again = first.where("again").drop("links", "next", "again").join(reps.select("rep", "embedding").hint("merge"), "rep")
    again = again.repartition("tab", "key", "meet").sortWithinPartitions("tab", "key", "meet")

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 1 << 13):
            yield from _links(table, starts, tables, planes, seed, threshold, exact=True)

    last = again.mapInArrow(exactly, out)
    return materialise(first.where("NOT again").select("rep", "links", "next").union(last.select("rep", "links", "next")))


def _links(table: pa.Table, starts: np.ndarray, tables: int, planes: int, seed: int, threshold: float, exact: bool) -> Iterator[pa.RecordBatch]:
    """Links of the pairs that codes decide, and the rows of those that they don't; with ``exact``, links of the latter."""
    ids, copies, slack = (table.column(c).to_numpy() for c in ("rep", "copies", "slack"))
    tab, meet, block = (table.column(c).to_numpy() for c in ("tab", "meet", "block"))
    raw = table.column("code")
    slack, most = slack.astype(np.float64), math.acos(threshold)
    links, open_ = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    labels = np.arange(len(ids))
    for start, end in zip(starts.tolist(), np.append(starts[1:], len(ids)).tolist()):
        if end - start < 2:
            continue
        code = np.frombuffer(b"".join(raw[start:end].to_pylist()), np.int8).reshape(end - start, -1)
        # products of codes are whole numbers below 2**24 up to a thousand components: exact as floats
        x = code.astype(np.float32 if code.shape[1] <= 1000 else np.float64)
        norm = np.sqrt((code.astype(np.float64) ** 2).sum(axis=1))
        inverse = (1 / norm).astype(np.float32)
        lost = slack[start:end]
        spread = 2 * float(lost.max())
        # beyond these cosines of codes no pair is a link, and every pair is; the margin is that of single precision
        low = np.float32(math.cos(min(math.pi, most + spread)) - 2e-6)
        high = np.float32(math.cos(max(0.0, most - spread)) + 2e-6) if most > spread else np.float32(2)
        between = meet[start] % 2 == 1
        mine = block[start:end]
        vectors = keys = None
        for at in range(0, end - start, 512):
            cosine = x[at : at + 512] @ x.T
            dots = cosine.copy()
            cosine *= inverse[at : at + 512, None]
            cosine *= inverse[None, :]
            due = cosine >= low
            due &= np.arange(end - start)[None, :] > np.arange(at, at + len(cosine))[:, None]
            if between:  # the pairs within a block have a group of their own
                due &= mine[at : at + 512, None] != mine[None, :]
            number = int(np.count_nonzero(due))
            if not number:
                continue
            if tab[start]:
                if keys is None:
                    keys = np.ascontiguousarray(_keys(code, tables, planes, seed)[:, : int(tab[start])].T)
                if number > due.size // 32:
                    for key in keys:
                        due &= key[at : at + 512, None] != key[None, :]
                else:
                    left, right = np.nonzero(due)
                    first = np.ones(len(left), bool)
                    for key in keys:
                        first &= key[left + at] != key[right]
                    due[left[~first], right[~first]] = False
            sure = due & (cosine >= high)
            left, right = np.nonzero(due & ~sure)
            dot = dots[left, right].astype(np.float64)
            left += at
            angle = np.arccos(np.clip(dot / (norm[left] * norm[right]), -1, 1))
            spare = lost[left] + lost[right]
            near = angle + spare <= most - 1e-9
            unsure = ~near & (angle - spare <= most + 1e-9)
            if exact:
                left, right = left[unsure], right[unsure]
                if vectors is None and len(left):
                    vectors = np.stack([np.asarray(v, np.float64) for v in table.column("embedding")[start:end].to_pylist()])
                    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
                    vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                near = np.empty(len(left), bool)
                for a in range(0, len(left), 1 << 14):
                    near[a : a + (1 << 14)] = (vectors[left[a : a + (1 << 14)]] * vectors[right[a : a + (1 << 14)]]).sum(axis=1) >= threshold
                left, right = left[near], right[near]
            else:
                open_[start + left[unsure]] = open_[start + right[unsure]] = True
                certain = np.nonzero(sure)
                left, right = np.concatenate([left[near], certain[0] + at]), np.concatenate([right[near], certain[1]])
            left, right = left + start, right + start
            labels = join_labels(labels, left, right)
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
    a, b = chained(ids, labels)
    counted = np.flatnonzero(links)
    rest = np.flatnonzero(open_)
    n, m = len(counted) + len(a), len(rest)
    if not n + m:
        return
    none = lambda k, kind: pa.nulls(k, kind)
    columns = {
        "links": pa.concat_arrays([pa.array(np.concatenate([links[counted], np.zeros(len(a), np.int64)])), none(m, pa.int64())]),
        "next": pa.concat_arrays([none(len(counted), pa.int64()), pa.array(b, pa.int64()), none(m, pa.int64())]),
        "again": pa.array(np.arange(n + m) >= n),
        "rep": pa.array(np.concatenate([ids[counted], a, ids[rest]])),
    }
    chosen = table.take(pa.array(rest)).combine_chunks()
    for name in ("copies", "code", "slack", "tab", "key", "meet", "block"):
        kind = table.schema.field(name).type
        held = chosen.column(name).combine_chunks() if m else none(0, kind)
        columns[name] = pa.concat_arrays([none(n, kind), held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)])
    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
