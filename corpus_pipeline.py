"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``docs``, whatever others there are and whatever their names (but map columns, which can't be compared).

Defined results: rows with a null ``doc_id`` are scored, redacted, sampled (by their text) and packed like any other, and
near-duplicate removal tells them apart by their text. A null text counts as empty; empty texts are scored by their
features, link with blank texts, and are one token when packed. Repeated rows are one document: one of them stays, the least
column by column; rows with one id and different texts are different documents. Very long texts go through whole.
An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import mixing, packing, pii, quality_gam, similar
from scriptorium.llm.storage import discard, materialise, scratch

#: Texts link if their sets of five-word shingles have a similarity of 0.8 or more.
NEAR = similar.SimilarParams(shingle=5, least=(4, 5))
MIX = mixing.MixParams(budget=0.8)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier holds to be of low quality."""
    model = quality_gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.accepted(docs, model, 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of texts that links of a similarity of 0.8 connect."""
    return similar.distinct_documents(docs, NEAR)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind, and count characters anew."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics come nearer to even shares of tokens."""
    return mixing.sample(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack all documents: one row for each piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", redact), ("mix", mix), ("pack", pack)]

#: No SQL: the first stage is a learned classifier. The tests hold near-duplicate removal and packing against brute force, base spans
#: against plain patterns, and the classifier against labels that were held out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that are left of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as tables:
        for _, stage in STAGES[:-1]:
            done, docs = docs, materialise(stage(spark, docs, sf_dir))
            discard(done)
        return tables.result(STAGES[-1][1](spark, docs, sf_dir))
