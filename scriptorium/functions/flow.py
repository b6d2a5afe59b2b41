"""Steps of named SQL expressions, where each step sees the columns of the steps before it.

Applied to a DataFrame a flow is a chain of projections without a shuffle; columns that no later step or result needs
are pruned by Catalyst. As text it is a nest of subqueries for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.dialect import DUCK, SPARK, Dialect

Steps = Callable[[Dialect], Sequence[dict[str, str]]]


def apply(df: DataFrame, steps: Steps, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the flow's columns added; only those in ``keep`` if given."""
    for step in steps(SPARK):
        df = df.select("*", *(F.expr(e).alias(n) for n, e in step.items()))
    return df.select(*keep) if keep is not None else df


def sql(source: str, steps: Steps, keep: Sequence[str]) -> str:
    """The same as a DuckDB query over ``source``, a table or a parenthesised query."""
    out = source
    for step in steps(DUCK):
        out = "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM {out})"
    return f"SELECT {', '.join(keep)} FROM {out}"
