"""Quality classifier: a generalised additive model with pairwise interactions, grown by cyclic boosting.

Each document becomes a short vector of counts and shares, from one pass over its bytes and one over its words.
Boosting goes round the features: each round grows one shallow tree on one feature's bins and adds it to that
feature's lookup table. Then the pairs of features that explain most of what is left get two-dimensional tables, grown
in the same way. A score is the sum of the tables' entries, one vectorised addition for each table.

The model is fitted on at most ``max_rows`` labelled rows, taken in the order of a hash of their id (a documented
bound); only their feature vectors reach the driver. Scoring covers every row and whole texts.

Defined results: a null text counts as empty, and empty texts get a score like any other. Labels that are null, or
ids without a label, are not learned from. Without any label, or with one class only, each score is the share of
label 1 (0.5 without labels). Ids with several labels count each. A null ``doc_id`` is scored and not learned from.
Repeated rows get equal scores. An empty table gives an empty result. Extra columns pass through ``score`` and
``accepted``, whatever their names; ``score`` replaces one that has the name of its result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.storage import bounded_batches

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "newline", "pipe", "bang", "symbol", "punctuation",
    "high_byte", "distinct_words", "same_as_before", "top_word", "upper_words", "symbol_words", "digit_words", "entropy", "lines_distinct",
)


@dataclass(frozen=True)
class GamParams:
    max_rows: int = 20_000
    bins: int = 48
    rounds: int = 120
    leaves: int = 4
    rate: float = 0.15
    pairs: int = 6
    pair_bins: int = 12
    pair_rounds: int = 40
    least_rows: int = 8


@dataclass
class Gam:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], x[:, i], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*<>=@\\^_`{}~+[]"]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:?'\"()-"]] = True


def features(text: bytes) -> list[float]:
    """The values of ``FEATURES`` for one UTF-8 text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.zeros(256, np.int64)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, n, 1 << 20):
        counts += np.bincount(data[at : at + (1 << 20)], minlength=256)
    words = text.split()
    w = max(1, len(words))
    tally: dict[bytes, int] = {}
    same = upper = symbol = digit = 0
    before = b""
    for x in words:
        if x == before:
            same += 1
        before = x
        tally[x] = tally.get(x, 0) + 1
    for x, k in tally.items():
        if x.isupper() and len(x) > 1:
            upper += k
        last = x[-1]
        if last < 128 and _SYMBOL[last]:
            symbol += k
        if x[:1].isdigit():
            digit += k
    share = counts[counts > 0] / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(len(words)), (n - counts[32]) / w, counts[_UPPER].sum() / n, counts[48:58].sum() / n, counts[32] / n, counts[10] / n,
        counts[124] / w, counts[33] / w, counts[_SYMBOL].sum() / n, counts[_PUNCTUATION].sum() / n, counts[128:].sum() / n, len(tally) / w, same / w,
        max(tally.values(), default=0) / w, upper / w, symbol / w, digit / w, float(-(share * np.log2(share)).sum()), len(set(lines)) / max(1, len(lines)),
    ]


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Bounds between bins, at quantiles of the distinct values."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: np.ndarray, least_rows: int) -> np.ndarray:
    """Values of a regression tree with a few leaves over bins in order, by Newton steps; best gain is split first."""
    out = np.zeros(len(grad))
    g, h, n = (np.concatenate([[0.0], np.cumsum(v)]) for v in (grad, hess, least))

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        at = np.arange(a + 1, b)
        gl, hl, nl = g[at] - g[a], h[at] - h[a], n[at] - n[a]
        gr, hr, nr = g[b] - g[at], h[b] - h[at], n[b] - n[at]
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
        gain[(nl < least_rows) | (nr < least_rows)] = 0
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    parts = [(0, len(grad), *best(0, len(grad)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, gain, at = parts[k]
        if gain <= 1e-9:
            break
        parts[k : k + 1] = [(a, at, *best(a, at)), (at, b, *best(at, b))]
    if len(parts) > 1:
        for a, b, _, _ in parts:
            out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, params: GamParams = GamParams()) -> Gam:
    """Fit the tables to rows of features and labels 0 or 1."""
    if not len(y):
        return Gam()
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Gam(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    m = x.shape[1]
    model.edges = [_edges(x[:, i], params.bins) for i in range(m)]
    model.pair_edges = [_edges(x[:, i], params.pair_bins) for i in range(m)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(model.edges[i], x[:, i], "right") for i in range(m)]
    coarse = [np.searchsorted(model.pair_edges[i], x[:, i], "right") for i in range(m)]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(params.rounds):
        for i in range(m):
            grad, hess = slopes()
            size = len(model.tables[i])
            step = params.rate * _shallow_tree(np.bincount(bins[i], grad, size), np.bincount(bins[i], hess, size), params.leaves, rows[i], params.least_rows)
            model.tables[i] += step
            total += step[bins[i]]
    grad, hess = slopes()
    gains = []
    for i in range(m):
        for j in range(i):
            shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
            cell = coarse[i] * shape[1] + coarse[j]
            g, h = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (grad, hess))
            gains.append((float((g**2 / (h + 5)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[: params.pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)))
    for _ in range(params.pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            grad, hess = slopes()
            cell = coarse[i] * table.shape[1] + coarse[j]
            g, h, n = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (grad, hess, np.ones(len(y))))
            step = params.rate * _shallow_pair_tree(g, h, n, params.least_rows)
            table += step
            total += step.ravel()[cell]
    return model


def _shallow_pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least_rows: int) -> np.ndarray:
    """A tree of two levels: the rows are cut once, and each part's columns once."""
    rows, best, out = g.shape[0], 0.0, np.zeros_like(g)
    for cut in range(1, rows):
        step, gain = np.zeros_like(g), 0.0
        for part in (slice(0, cut), slice(cut, rows)):
            gp, hp, np_ = g[part].sum(axis=0), h[part].sum(axis=0), n[part].sum(axis=0)
            leaf = _shallow_tree(gp, hp, 2, np_, least_rows)
            step[part] = leaf
            gain += float((leaf * gp).sum())
        if gain > best:
            best, out = gain, step
    return out


def feature_rows(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``x``, the features of each row's whole text."""
    bounded_batches(docs.sparkSession)
    kept = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t.as_py() or b"") for t in batch.column(len(keep))], float).reshape(batch.num_rows, len(FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], [*keep, "x"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "x array<double>"])
    return docs.select(*keep, F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, params: GamParams = GamParams()) -> Gam:
    """Fit on labelled rows whose crc32 of the id as text leaves a remainder other than 1 by 3."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    taught = taught.where("quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), "doc_id", "quality"]
    some = F.broadcast(taught.orderBy(*order).limit(params.max_rows))  # at most max_rows short rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id")
    rows = feature_rows(texts, ("doc_id", "quality")).orderBy(*order).limit(params.max_rows).collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["quality"] for r in rows], float), params)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _scored(docs: DataFrame, model: Gam) -> DataFrame:
    """``row``, the whole row of ``docs`` as one column, so that no name can clash, and ``score``."""
    bounded_batches(docs.sparkSession)
    held = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = T.StructType([held.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or b"") for t in batch.column(1)], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["row", "score"])

    return held.mapInArrow(run, schema)


def score(docs: DataFrame, model: Gam, name: str = "quality_score") -> DataFrame:
    """``docs`` with its columns, plus ``name`` (0 to 1): the probability of label 1. A column that has the name already is replaced."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    return _scored(docs, model).select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("score").alias(name))


def accepted(docs: DataFrame, model: Gam, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose probability of label 1 is ``least`` or more."""
    return _scored(docs, model).where(F.col("score") >= least).select("row.*")
