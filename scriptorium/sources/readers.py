"""Sources and sinks. All of them are Spark readers and writers, so that any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with an id from the file's name and the line's place in the file's partition.

    Ids don't depend on which task reads what, so that a task that runs again gives the ids that it gave before.
    """
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("seen"))
    numbered = lines.withColumn("seen", F.monotonically_increasing_id()).withColumn("place", place)
    return numbered.select(F.xxhash64("file", "block", "place").alias("doc_id"), "text")


def resources(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A table of a resource from CSV files with a header (spellings, phonetic properties, sounds)."""
    return spark.read.option("header", True).schema(columns).csv(path)


def write_texts(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """Romanized dictionaries, a JSON file each: ``{language, iso_code, categories: {category: {roman: native}}}``.

    Returns ``iso_code, category, roman, native``; of a word in several categories the last one in the file counts.
    """
    raw = spark.read.text(path, wholetext=True)
    top = F.from_json("value", "struct<iso_code:string,categories:map<string,map<string,string>>>")
    files = raw.select(top.alias("f")).select("f.iso_code", F.posexplode("f.categories").alias("place", "category", "words"))
    words = files.select("iso_code", "place", "category", F.explode("words").alias("roman", "native"))
    last = Window.partitionBy("iso_code", "roman").orderBy(F.desc("place"))
    return words.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "place")


def lexicon(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A profanity lexicon, ``{language: {severity: [words]}}`` as JSON, in the form that ``safety.profanity`` takes. A small file."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m")).first()["m"]
    out: dict[str, list[str]] = {"extreme": [], "moderate": [], "mild": []}
    for levels in raw.values():
        for level, words in levels.items():
            out[level].extend(words)
    return out


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log or state table of known schema."""
    return spark.read.schema(schema).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def last_rows(log: DataFrame, n: int, order: str) -> DataFrame:
    """The newest ``n`` rows of an append-only log: a top-n, without a sort of the whole log."""
    return log.orderBy(F.desc(order)).limit(n)


def upsert(table: DataFrame | None, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """A keyed table after an append: the newest row of each key, and how many there were."""
    both = fresh.withColumn("request_count", F.lit(1).cast("long"))
    both = both if table is None else table.unionByName(both)
    row = F.struct(*[c for c in both.columns if c != "request_count"])
    return both.groupBy(key).agg(F.max_by(row, F.col(order)).alias("row"), F.sum("request_count").alias("request_count")).select("row.*", "request_count")


def live(table: DataFrame, stored_at: str, ttl_seconds: int, now) -> DataFrame:
    """Rows of a cache that are not too old at ``now``."""
    return table.where(F.col(stored_at) > F.lit(now) - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """An n-gram model that ``write_profiles`` kept: ``lang, place, ngram, freq``."""
    return spark.read.parquet(path)


def write_profiles(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def without(table: DataFrame, key: str, prefix: str | None = None) -> DataFrame:
    """A keyed table after clearing: without the keys that begin with ``prefix``, or without any rows."""
    return table.limit(0) if prefix is None else table.where(~F.startswith(F.col(key), F.lit(prefix)))


def keys_by_prefix(table: DataFrame, key: str, separator: str = ":") -> DataFrame:
    """How many keys each kind has, by what stands before the first separator."""
    return table.groupBy(F.substring_index(key, separator, 1).alias("prefix")).agg(F.count("*").alias("keys"))
