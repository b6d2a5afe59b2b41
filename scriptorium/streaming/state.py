"""The pattern cache and rate limits as Structured Streaming queries.

State is one short row for each signature, with running sums instead of lists, and leaves after a time without use. The
pattern cache sees a batch's rows in the order of their ids; late requests are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as L
from scriptorium.sources import readers

OUT = "signature string, doc_id long, cache_hit boolean, detected string, confidence double"
STATE = "use_count long, total double, stored long, detected string"


def pattern_cache(detections: DataFrame, uses: int = 3, least: float = 0.7, idle: str | None = None) -> DataFrame:
    """Replays the cache over a stream of ``doc_id, signature, detected, confidence``.

    A signature that was stored ``uses`` times with a mean confidence of ``least`` answers with its first result; any
    other sighting is stored. A signature is forgotten after ``idle`` without use, or never; forgetting by the clock
    keeps a query busy with empty batches.
    """

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, total, stored, detected = state.get if state.exists else (0, 0.0, 0, None)
        rows = pd.concat(list(frames)).sort_values("doc_id")
        out = []
        for row in rows.itertuples(index=False):
            if getattr(row, "corrected", False):
                used, total, stored, detected = 0, 0.0, 0, None
                continue
            hit = used >= uses and stored > 0 and total / stored >= least
            if not hit:
                total, stored = total + row.confidence, stored + 1
                detected = row.detected if detected is None else detected
            used += 1
            out.append((key[0], row.doc_id, hit, detected if hit else row.detected, total / stored if hit else row.confidence))
        state.update((used, total, stored, detected))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["signature", "doc_id", "cache_hit", "detected", "confidence"])

    return detections.groupBy("signature").applyInPandasWithState(step, OUT, STATE, "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def rate_limits(requests: DataFrame, window: str = "1 minute", most: int = 30, late: str = "10 minutes") -> DataFrame:
    """Requests of each client in each window, and whether they are over the limit."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("requests"))
    return counted.select("user_id", F.col("window.start").alias("start"), "requests", (F.col("requests") > most).alias("over_limit"))


def failures(detections: DataFrame) -> DataFrame:
    """The stream's failures, with their reasons and an id from time and text; texts are kept as hashes only."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("confidence") < 0.5, "low_confidence"),
            F.when(F.col("detected").isin(*L.OBSCURE[:8], "eo"), "obscure_language"),
            F.when(F.col("detected") == "unknown", "unknown_language"),
            F.when(F.col("reported") & (F.col("expected") != F.col("detected")), "user_reported") if {"reported", "expected"} <= set(detections.columns) else F.lit(None).cast("string"),
            F.when((F.col("confidence") > 0.6) & F.contains("method", F.lit("fallback")), "suspicious_confidence"),
        )
    )
    marked = detections.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return marked.withColumn("failure_id", F.concat_ws("_", F.lit("fail"), stamp, F.substring("text_hash", 1, 8), "doc_id"))


def autosave(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Keep a stream's rows in a Parquet table, every so often (``every``), or all that there is and then stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upserted(stream: DataFrame, key: str, order: str, save: Callable[[DataFrame], None], load: Callable[[], DataFrame | None], checkpoint: str):
    """Keep the newest row of each key and how many there were, batch by batch: what was kept is loaded, joined with the batch and saved."""

    def step(batch: DataFrame, _: int) -> None:
        save(readers.upsert(load(), batch, key, order))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_log(stream: DataFrame, path: str, checkpoint: str):
    """A stream's failures appended to a log, of which ``newest_failures`` shows the last ones."""
    return autosave(failures(stream), path, checkpoint)


def newest_failures(spark: SparkSession, path: str, last: int = 500) -> DataFrame:
    return readers.last_rows(spark.read.parquet(path), last, "ts")
