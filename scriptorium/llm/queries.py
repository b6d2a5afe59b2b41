"""The queries of the training-data operators, by the names that ``__spark_entry__`` registers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.license_scan import scan_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.crf_langid import held_out, identify, learn

    docs = _table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs), segments=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.quality_gam import held_out, learn, score

    docs = _table(spark, sf_dir, "documents")
    model = learn(docs, _table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted")
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


#: The rules of op5's contract: verdict, then host and path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.pii import KINDS, find, joined

    out = find(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def _is_kind(number: int):
    return lambda span: span["kind"] == number


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("f0")), 16, "0")
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.media import media_columns

    out = media_columns(_table(spark, sf_dir, "documents"), keep_media=False)
    pairs = F.transform("fingerprint", lambda p: F.concat_ws(":", p["frame"], p["code"]))
    feature = F.concat(F.size("fingerprint").cast("string"), F.lit("-"), F.sha2(F.array_join(pairs, ","), 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.mixing import described, mix

    return mix(described(_table(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scriptorium.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_pii": op6_pii,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_media_columns": op8_media_columns,
    "op9_source_mixing": op9_source_mixing,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES: dict[str, str] = {"op1_license_scan": scan_sql()}
