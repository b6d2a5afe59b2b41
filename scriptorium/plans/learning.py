"""Failure logs, statistics, caches and rate limits as aggregations and windows over logs.

A log is a table of detections; here the documents' detections by rules stand for it, with ``doc_id`` as the order of
arrival. Requests come from ``events``. Rows of a kind are counted with ``count_if`` instead of a filter below the
aggregation: a filter on a ladder's result would be pushed through the ladder's steps and inline them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import flow
from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import Dialect
from scriptorium.operators import language, text


def observed(d: Dialect) -> list[dict[str, str]]:
    """Detections by rules, with the text's signature and the reasons to count one as a failure."""
    reasons = [
        "CASE WHEN confidence < 0.5e0 THEN 'low_confidence' ELSE '' END",
        f"CASE WHEN {d.among('language', (*L.OBSCURE[:8], 'eo'))} THEN 'obscure_language' ELSE '' END",
        "CASE WHEN language = 'unknown' THEN 'unknown_language' ELSE '' END",
        "CASE WHEN confidence > 0.6e0 AND contains(method, 'fallback') THEN 'suspicious_confidence' ELSE '' END",
    ]
    return [*language.signals(d), *language.detect(d, ngram=False), *text.signature(d), {"reasons": d.filter(d.array(reasons), "r_", "r_ <> ''")}, {"is_failure": f"{d.size('reasons')} > 0"}]


#: The run of rows without an id: the last.
_LAST = (1 << 63) - 1
_OBSCURE = "(" + ", ".join(f"'{x}'" for x in (*L.OBSCURE[:8], "eo")) + ")"
_DOCS = ["doc_id", "text", "lang"]
_TRUTH = "CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE lang END"


def _requests(d: Dialect) -> list[dict[str, str]]:
    return [{"seen_at": "cast(ts AS timestamp)"}, {"at_minute": "date_trunc('minute', seen_at)", "at_hour": "date_trunc('hour', seen_at)"}]


def _with_hash(d: Dialect) -> list[dict[str, str]]:
    return text.hashes(d)


_EVENTS = ["event_id", "ts", "user_id", "event_type", "value"]

#: name: (table, columns, steps, SQL over {src} in the words that both dialects share)
LOG_QUERIES: dict[str, tuple] = {
    "failure_reasons": (
        "documents", _DOCS, observed,
        "SELECT method, count(*) AS detections, cast(count_if(is_failure) AS bigint) AS failures, cast(count_if(confidence < 0.5e0) AS bigint) AS low_confidence, cast(count_if(language = 'unknown') AS bigint) AS unknown_language, "
        f"cast(count_if(language IN {_OBSCURE}) AS bigint) AS obscure_language, "
        "cast(count_if(confidence > 0.6e0 AND contains(method, 'fallback')) AS bigint) AS suspicious_confidence FROM {src} GROUP BY method",
    ),
    "failure_topk": (
        "documents", _DOCS, observed,
        # the filter stands above the limit, so that it isn't pushed into the ladder and expanded there
        "SELECT doc_id, language, method, confidence, signature FROM (SELECT doc_id, language, method, confidence, signature, is_failure FROM {src} "
        "ORDER BY CASE WHEN is_failure THEN 0 ELSE 1 END, doc_id DESC LIMIT 50) t WHERE is_failure",
    ),
    "language_distribution": (
        "documents", _DOCS, observed,
        "SELECT language, method, count(*) AS n, cast(count_if(is_failure) AS bigint) AS failures FROM {src} GROUP BY language, method",
    ),
    "avg_confidence_by_language": (
        "documents", _DOCS, observed,
        "SELECT language, count(*) AS n, round(avg(confidence), 9) AS avg_confidence, round(min(confidence), 9) AS least, round(max(confidence), 9) AS most, "
        "cast(count_if(confidence < 0.6e0) AS bigint) AS low FROM {src} GROUP BY language",
    ),
    "misdetection_topk": (
        "documents", _DOCS, observed,
        f"SELECT detected, expected, n FROM (SELECT language AS detected, {_TRUTH} AS expected, cast(count_if(language <> {_TRUTH}) AS bigint) AS n FROM {{src}} GROUP BY 1, 2) x "
        "WHERE n > 0 ORDER BY n DESC, detected, expected LIMIT 10",
    ),
    "correction_suggestions": (
        "documents", _DOCS, observed,
        f"SELECT signature, suggestion, n FROM (SELECT signature, {_TRUTH} AS suggestion, cast(count_if(language <> {_TRUTH}) AS bigint) AS n FROM {{src}} GROUP BY 1, 2) x WHERE n >= 2",
    ),
    "request_cache_latest": (
        "documents", _DOCS, _with_hash,
        "SELECT text_hash, max(doc_id) AS latest, min(doc_id) AS first, count(*) AS request_count FROM {src} GROUP BY text_hash",
    ),
    "request_cache_stats": (
        "documents", _DOCS, _with_hash,
        "SELECT count(*) AS entries, cast(sum(request_count - 1) AS bigint) AS hits, max(request_count) AS most FROM (SELECT text_hash, count(*) AS request_count FROM {src} GROUP BY text_hash) x",
    ),
    "cache_eviction_topk": (
        "documents", _DOCS, observed,
        "SELECT signature, use_count, avg_confidence FROM (SELECT signature, count(*) AS use_count, round(avg(confidence), 9) AS avg_confidence FROM {src} GROUP BY signature) x "
        "ORDER BY use_count DESC, avg_confidence DESC, signature LIMIT 10000",
    ),
    "request_cache_top": (
        "documents", _DOCS, _with_hash,
        "SELECT text_hash, count(*) AS request_count FROM {src} GROUP BY text_hash ORDER BY request_count DESC, text_hash LIMIT 5",
    ),
    "cache_hit_rate": (
        "documents", _DOCS, observed,
        "SELECT cast(sum(n - 1) AS bigint) AS hits, count(*) AS misses, round(coalesce(cast(sum(n - 1) AS double) / nullif(sum(n), 0), 0e0), 9) AS hit_rate FROM (SELECT signature, count(*) AS n FROM {src} GROUP BY signature) x",
    ),
    "cache_keys_by_prefix": (
        "documents", _DOCS, lambda d: [*text.hashes(d), {"lang_key": text.key(d, "lang:", "text")}],
        "SELECT prefix, count(*) AS live_keys FROM (SELECT DISTINCT split_part(analysis_key, ':', 1) AS prefix, analysis_key AS k FROM {src} UNION SELECT DISTINCT split_part(lang_key, ':', 1), lang_key FROM {src}) x GROUP BY prefix",
    ),
    "ttl_by_kind": (
        "events", _EVENTS, _requests,
        "SELECT event_type, ttl, count(*) AS live FROM (SELECT user_id, event_type, ttl, max(seen_at) AS last_set FROM {src} CROSS JOIN (SELECT 3600 AS ttl UNION ALL SELECT 7200 UNION ALL SELECT 86400) t GROUP BY user_id, event_type, ttl) x "
        "WHERE last_set > (SELECT max(seen_at) FROM {src} y) - ttl * INTERVAL '1' SECOND GROUP BY event_type, ttl",
    ),
    "rate_limit_minute": (
        "events", _EVENTS, _requests,
        "SELECT user_id, at_minute, count(*) AS requests, count(*) > 30 AS over_limit FROM {src} GROUP BY user_id, at_minute",
    ),
    "rate_limit_hour": (
        "events", _EVENTS, _requests,
        "SELECT user_id, at_hour, count(*) AS requests, count(*) > 500 AS over_limit FROM {src} GROUP BY user_id, at_hour",
    ),
    "ttl_live_keys": (
        "events", _EVENTS, _requests,
        "SELECT event_type, count(*) AS live FROM (SELECT user_id, event_type, max(seen_at) AS last_set FROM {src} GROUP BY user_id, event_type) x "
        "WHERE last_set > (SELECT max(seen_at) FROM {src} y) - INTERVAL '24' HOUR GROUP BY event_type",
    ),
}


#: Dimensions of a failure that are counted, and the column that each is read from.
DIMENSIONS = {"detected": "language", "expected": "expected", "script": "dominant_script", "method": "method"}


def recent_failures(seen: DataFrame, last: int = 50) -> DataFrame:
    """The newest failures by order of arrival: a top-n. ``seen`` has ``doc_id, language, method, confidence, dominant_script, reasons, lang``."""
    expected = F.expr(f"CASE WHEN language <> {_TRUTH} THEN {_TRUTH} END")
    # the filter on a ladder's result stands above the limit, so that it isn't pushed into the ladder
    newest = seen.withColumn("expected", expected).orderBy(F.expr("CASE WHEN is_failure THEN 0 ELSE 1 END"), F.desc("doc_id")).limit(last)
    return newest.where("is_failure").select("doc_id", "language", "expected", "dominant_script", "method", "confidence", "reasons")


def failure_patterns(seen: DataFrame, last: int = 50, top: int = 5) -> DataFrame:
    """``dimension, value, n, place``: the five most frequent values of reasons (each counted by itself), languages, scripts and methods."""
    recent = recent_failures(seen, last)
    pairs = [F.struct(F.lit(k).alias("dimension"), F.col(c).alias("value")) for k, c in DIMENSIONS.items()]
    reasons = F.transform("reasons", lambda r: F.struct(F.lit("reason").alias("dimension"), r.alias("value")))
    counted = recent.select(F.explode(F.concat(F.array(*pairs), reasons)).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def recommendations(seen: DataFrame, last: int = 50) -> DataFrame:
    """``issue, solution, priority`` for what the newest failures show."""
    figures = recent_failures(seen, last).agg(
        F.count("*").alias("failures"), F.count_if(F.array_contains("reasons", "obscure_language") & (F.col("language") == "ido")).alias("ido"),
        F.count_if(F.array_contains("reasons", "low_confidence")).alias("low"), F.count_if(F.col("dominant_script") == "latin").alias("latin"),
    )
    advice = [
        (F.col("ido") > 3, "Frequent 'ido' detection for romanized Indic languages", "Add romanized Indic language detection before the model", "HIGH"),
        (F.col("low") > 0, "Many low-confidence detections", "Consider fallback to script-based detection or user prompt", "MEDIUM"),
        (F.col("latin") > F.col("failures") * 0.5, "Over 50% failures are Latin script (likely romanized Indic)", "Implement romanized Indic language detector", "HIGH"),
    ]
    rows = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(a).alias("issue"), F.lit(b).alias("solution"), F.lit(c).alias("priority"))) for test, a, b, c in advice)))
    return figures.select(F.explode(rows).alias("r")).select("r.*")


def _recent_sql(last: int = 50) -> str:
    seen = flow.sql("documents", observed, ["doc_id", "language", "method", "confidence", "dominant_script", "reasons", "lang"])
    return f"(SELECT *, CASE WHEN language <> {_TRUTH} THEN {_TRUTH} END AS expected FROM ({seen}) WHERE len(reasons) > 0 ORDER BY doc_id DESC LIMIT {last})"


def failure_patterns_sql(last: int = 50, top: int = 5) -> str:
    parts = [f"SELECT '{k}' AS dimension, {c} AS value FROM r" for k, c in DIMENSIONS.items()] + ["SELECT 'reason', unnest(reasons) FROM r"]
    return f"""WITH r AS {_recent_sql(last)}, p AS ({" UNION ALL ".join(parts)}), c AS (SELECT dimension, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS integer) AS place FROM c) WHERE place <= {top}"""


def recommendations_sql(last: int = 50) -> str:
    return f"""WITH r AS {_recent_sql(last)}
    SELECT 'Frequent ''ido'' detection for romanized Indic languages' AS issue, 'Add romanized Indic language detection before the model' AS solution, 'HIGH' AS priority FROM r WHERE language = 'ido' HAVING count(*) > 3
    UNION ALL SELECT 'Many low-confidence detections', 'Consider fallback to script-based detection or user prompt', 'MEDIUM' FROM r HAVING count(*) FILTER (WHERE confidence < 0.5) > 0
    UNION ALL SELECT 'Over 50% failures are Latin script (likely romanized Indic)', 'Implement romanized Indic language detector', 'HIGH' FROM r HAVING count(*) FILTER (WHERE dominant_script = 'latin') * 2 > count(*)"""


def cache_replay(seen: DataFrame, uses: int = 3, least: float = 0.7, width: int = 100_000) -> DataFrame:
    """The pattern cache replayed in the order of ids: a text is a hit if its signature was stored often and well enough.

    A hit neither stores nor changes the average, so once a signature hits it keeps hitting, and until then every sighting is
    stored: the mean of all before is the cache's mean. Sums run within runs of ``width`` ids, on top of the sums of the runs
    before, so that no task has all sightings of a signature that a third of all texts share. The cache starts empty.

    Detections are made once: they are dealt by signature and run, and the three looks at them read that one shuffle. For that each
    look needs all four columns, and no column that rows are joined or grouped by may be null: a filter for nulls would go down
    into the detections and make a shuffle of its own. Rows without a signature or an id are a signature and the last ids.
    """
    run = F.coalesce(F.floor(F.col("doc_id") / width), F.lit(_LAST))
    cut = seen.select("doc_id", F.coalesce("signature", F.lit("")).alias("signature"), "confidence", run.alias("run")).repartition("signature", "run")
    key = ["signature", "run"]
    before_run = lambda order: Window.partitionBy("signature").orderBy(F.asc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, -1)
    # runs are runs of ids, so their first ids order them; merged joins leave rows where they were dealt, a broadcast of them could bring a signature together
    earlier = before_run("first_id")
    runs = cut.groupBy(*key).agg(F.count("*").alias("n"), F.sum("confidence").alias("total"), F.min("doc_id").alias("first_id"))
    base = runs.select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("total0"))
    within = Window.partitionBy(*key).orderBy(F.asc_nulls_last("doc_id"))
    mine = F.coalesce(F.sum("confidence").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = cut.withColumn("mine", mine).withColumn("nth", F.row_number().over(within) - 1).join(base.hint("merge"), key)
    before = F.col("n0") + F.col("nth")
    good = F.coalesce((before >= uses) & (F.round((F.col("total0") + F.col("mine")) / F.nullif(before, F.lit(0)), 9) >= least), F.lit(False))
    hits = ranked.withColumn("hit", F.max(good).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    since = hits.groupBy(*key).agg(F.max("hit").alias("hit")).select(*key, F.coalesce(F.max("hit").over(before_run("run")), F.lit(False)).alias("hit_before"))
    out = hits.join(since.hint("merge"), key)
    return out.select("doc_id", F.nullif("signature", F.lit("")).alias("signature"), (F.col("hit") | F.col("hit_before")).alias("cache_hit"))


def cache_replay_sql(uses: int = 3, least: float = 0.7) -> str:
    seen = flow.sql("documents", observed, ["doc_id", "signature", "confidence"])
    return f"""
    SELECT doc_id, signature, max(CASE WHEN before >= {uses} AND round(mean_before, 9) >= {least}e0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY signature ORDER BY doc_id ROWS UNBOUNDED PRECEDING) = 1 AS cache_hit
    FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY doc_id) - 1 AS before,
        avg(confidence) OVER (PARTITION BY signature ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_before FROM ({seen}))
    """


def occurrences(requests: DataFrame, key: str = "text_hash", order: str = "doc_id") -> DataFrame:
    """Each request with how often its key was asked for before, and whether it is the newest of its key."""
    by = Window.partitionBy(key)
    return requests.withColumn("occurrence", F.row_number().over(by.orderBy(order))).withColumn("is_latest", F.col(order) == F.max(order).over(by))


def evicted(cache: DataFrame, trigger: int = 12_000, keep: int = 10_000) -> DataFrame:
    """A pattern cache (``signature, use_count, avg_confidence``) after eviction, which begins beyond ``trigger`` entries."""
    if len(cache.select("signature").limit(trigger + 1).collect()) <= trigger:  # at most trigger + 1 signatures
        return cache
    return cache.orderBy(F.desc("use_count"), F.desc("avg_confidence"), "signature").limit(keep)


def invalidated(cache: DataFrame, corrections: DataFrame) -> DataFrame:
    """A pattern cache without the signatures that users corrected."""
    return cache.join(corrections.select("signature").distinct(), "signature", "left_anti")


def suggestions(detections: DataFrame, corrections: DataFrame) -> DataFrame:
    """``detections``, a table or a stream, with the corrections that users made to their signatures before."""
    known = corrections.groupBy("signature").agg(F.array_sort(F.collect_set("correct_language")).alias("suggestions"))
    return detections.join(known, "signature", "left")


def with_cache(requests: DataFrame, responses: DataFrame, key: str = "text_hash") -> tuple[DataFrame, DataFrame]:
    """Requests that a cache answers, with its response, and those that it doesn't."""
    return requests.join(responses, key), requests.join(responses.select(key), key, "left_anti")
