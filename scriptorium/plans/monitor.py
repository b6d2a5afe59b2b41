"""What a run reports of itself: counts taken while it runs, without a pass of their own."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def measured(df: DataFrame, name: str, column: str = "text") -> tuple[DataFrame, Observation]:
    """``df``, and counts that are there once it was read: rows, missing and blank texts, characters."""
    seen = Observation(name)
    text = F.col(column)
    counts = {
        "rows": F.count(F.lit(1)), "missing": F.count_if(text.isNull()), "blank": F.count_if(F.trim(text) == ""), "characters": F.coalesce(F.sum(F.length(text)), F.lit(0)), "longest": F.coalesce(F.max(F.length(text)), F.lit(0)),
    }
    return df.observe(seen, *(c.alias(k) for k, c in counts.items())), seen


def timed(run: Callable[[], DataFrame], name: str) -> dict[str, object]:
    """Seconds, rows and rows a second of a query, run without keeping its result."""
    began = time.time()
    seen = Observation(name)
    run().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    seconds = time.time() - began
    rows = seen.get["rows"]
    return {"name": name, "seconds": round(seconds, 3), "rows": rows, "rows_a_second": round(rows / seconds, 1) if seconds else None}
