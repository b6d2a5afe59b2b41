"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) by tokens. Raking multiplies the cells' weights until
their sums over each margin reach the targets; documents of a cell are then kept with one probability each, scaled
so that the expected tokens are the budget and none exceeds one. The corpus is read by one group-by with map-side
sums; only the cells come to the driver, and their number is checked against ``max_cells`` (a product of category
counts, which doesn't grow with the corpus). Beyond that bound the operator raises, rather than drop cells.

Whether a document stays follows from a hash of its id and the seed, so it doesn't depend on the partitioning.

Defined results: a null source, language or topic is a category of its own, kept apart from any real value. A null or
blank text has no tokens: its cell's probability applies, and is 1 in a cell without tokens. Repeated rows share
their fate. A row without a ``doc_id`` is drawn by its text. An empty table gives an empty result. Extra columns pass through
``sample`` untouched, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.storage import bounded_batches, materialise, scratch

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixParams:
    """``targets`` has shares by category for a dimension; where missing, shares of tokens to the power ``temper``.

    Categories that the corpus lacks are dropped from a target and those that the target lacks get no weight; shares
    are scaled to sum to one. ``budget`` is the expected share of all tokens that stays.
    """

    targets: Mapping[str, Mapping[str | None, float]] | None = None
    temper: float = 0.7
    budget: float = 0.5
    seed: int = 11
    tolerance: float = 1e-9
    rounds: int = 500
    max_cells: int = 1_000_000


def text_form(text: bytes) -> tuple[int, str]:
    """The number of words of a UTF-8 text, and a topic by its form, for tables that have no topic column."""
    tokens = len(text.split())
    size = max(1, len(text))
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    if not tokens:
        return 0, "empty"
    if share(b"|\t") > 0.02:
        return tokens, "table"
    if share(b"#$%&*<>{}=_") > 0.05:
        return tokens, "markup"
    if share(b"0123456789") > 0.1:
        return tokens, "figures"
    return tokens, "note" if tokens < 60 else "article" if tokens < 600 else "long read"


def _with_form(rows: DataFrame, topic: str | None) -> DataFrame:
    """``rows``, whose last column is ``text``, with ``n_tokens`` and ``topic`` in its place."""
    bounded_batches(rows.sparkSession)
    kept = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    out = T.StructType([*kept.fields, T.StructField("n_tokens", T.LongType()), *([] if topic else [T.StructField("topic", T.StringType())])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_form(t.as_py() or b"") for t in batch.column(batch.num_columns - 1)]
            more = [pa.array([m[0] for m in made], pa.int64()), *([] if topic else [pa.array([m[1] for m in made], pa.string())])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], out.names)

    return rows.mapInArrow(run, out)


def _about(topic: str | None) -> list[Column]:
    """What decides on a row: its id, a number to draw by, its categories and, last, its text."""
    names = ["source", "lang"] + ([topic] if topic else [])
    doc_id = F.col("doc_id").cast("long")
    return [
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(F.lit("no id"), F.col("text").cast("string"))).alias("draw_key"),
        *(F.col(c).cast("string").alias("topic" if c == topic else c) for c in names), F.col("text").cast("string").cast("binary").alias("text"),
    ]


def described(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """``doc_id``, ``draw_key``, the three categories and ``n_tokens`` of each row; ``topic`` names a column, else it follows from the text."""
    return _with_form(docs.select(*_about(topic)), topic).select("doc_id", "draw_key", *DIMENSIONS, "n_tokens")


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """Weights of cells whose weighted shares of ``tokens`` match each margin's target shares, as far as they can.

    Margins that no weights can meet together are warned of, with the largest difference that is left.
    """
    weight, worst = np.ones(len(tokens)), 0.0
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, weight * tokens, len(target))
            total = now.sum()
            if not total:
                return weight
            ratio = np.divide(target * total, now, out=np.zeros(len(target)), where=now > 0)
            worst = max(worst, float(np.abs(now / total - target)[now > 0].max(initial=0)))
            weight = weight * ratio[code]
        if worst < tolerance:
            return weight
    if worst > 1e-4:
        warnings.warn(f"raking left a margin {worst:.2g} off its target after {rounds} rounds", stacklevel=2)
    return weight


def calibrated(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, scale * weight) whose expected tokens are ``budget``, or all that have weight if that is less."""
    open_ = (weight > 0) & (tokens > 0)
    if not open_.any():
        return np.ones(len(tokens))
    if tokens[open_].sum() <= budget:
        return np.where(open_ | (tokens == 0), 1.0, 0.0)
    order = np.argsort(-weight[open_], kind="stable")
    w, t = weight[open_][order], tokens[open_][order].astype(float)
    full = np.concatenate([[0.0], np.cumsum(t)[:-1]])
    rest = np.cumsum((w * t)[::-1])[::-1]
    scale = (budget - full) / rest  # if all before a cell are certain
    k = int(np.argmax(scale * w <= 1.0))
    out = np.minimum(1.0, max(0.0, scale[k]) * weight)
    out[tokens == 0] = 1.0
    return out


def mix(described_docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Add ``weight``, ``probability`` and ``selected`` to what ``described`` gives, which is written out first."""
    with scratch() as tables:
        described_docs = materialise(described_docs)
        chances = F.broadcast(_chances(described_docs, params))
        out = described_docs.join(chances, _same_cell(), "inner").withColumn("selected", _selected(params))
        return tables.result(out.drop("draw_key", *(f"{d}_" for d in DIMENSIONS)))


def _same_cell() -> list[Column]:
    return [F.col(d).eqNullSafe(F.col(f"{d}_")) for d in DIMENSIONS]


def _selected(params: MixParams) -> Column:
    return chosen(F.col("draw_key"), params.seed) < F.col("probability")


def _chances(described_docs: DataFrame, params: MixParams) -> DataFrame:
    """A weight and a probability for each cell: at most ``max_cells`` rows, so that they can be broadcast."""
    spark = described_docs.sparkSession
    cells = described_docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).limit(params.max_cells + 1).collect()
    if len(cells) > params.max_cells:
        raise ValueError(f"more than {params.max_cells} cells of {', '.join(DIMENSIONS)}")
    cells = sorted(cells, key=lambda r: tuple((r[d] is not None, r[d] or "") for d in DIMENSIONS))
    tokens = np.array([r["tokens"] or 0 for r in cells], np.int64)
    codes, targets = [], []
    for d in DIMENSIONS:
        names = list(dict.fromkeys(r[d] for r in cells))
        code = np.array([names.index(r[d]) for r in cells], np.int64) if len(names) < 50 else np.array([{n: i for i, n in enumerate(names)}[r[d]] for r in cells])
        given = (params.targets or {}).get(d)
        share = np.bincount(code, tokens, len(names)) ** params.temper if given is None else np.array([given.get(n, 0.0) for n in names])
        codes.append(code)
        targets.append(share / share.sum() if share.sum() else np.full(len(names), 1 / max(1, len(names))))
    weight = rake(tokens, codes, targets, params.rounds, params.tolerance) if cells else np.empty(0)
    if tokens.sum() and (weight * tokens).sum():
        weight = weight * tokens.sum() / (weight * tokens).sum()
    chance = calibrated(tokens, weight, params.budget * tokens.sum()) if cells else weight
    rows = [(*(r[d] for d in DIMENSIONS), float(w), float(p)) for r, w, p in zip(cells, weight, chance)]
    schema = ", ".join(f"{d}_ string" for d in DIMENSIONS) + ", weight double, probability double"
    return spark.createDataFrame(rows, schema)


def chosen(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def sample(docs: DataFrame, params: MixParams = MixParams(), topic: str | None = None) -> DataFrame:
    """The rows of ``docs`` that are selected, with all their columns.

    The cells' probabilities come from a first pass over the texts, which writes ids, categories and counts only.
    """
    with scratch():
        chances = F.broadcast(_chances(materialise(described(docs, topic)), params))
    # a row travels as one column, so that no column of it can clash with those that are added
    held = docs.select(F.struct("*").alias("row"), *_about(topic))
    return _with_form(held, topic).join(chances, _same_cell()).where(_selected(params)).select("row.*")
