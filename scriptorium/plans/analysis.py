"""The whole analysis of a table of texts, and a command line for it."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import flow
from scriptorium.functions.dialect import Dialect
from scriptorium.operators import entities, indic, language, models, ngrams, phonetics, safety, scripts, text
from scriptorium.sources import readers


#: What an analysis gives, in its short and in its long form.
COMPACT = ("doc_id", "text", "language", "language_name", "confidence", "method", "is_code_mixed", "has_profanity", "severity_score", "max_severity", "is_financial", "is_temporal", "is_technical", "clean")
VERBOSE = (
    "indic_percentage", "latin_percentage", "numeric_percentage", "punctuation_percentage", "other_percentage", "dominant_script", "rom_lang", "rom_conf", "mix_method", "mix_conf", "mix_primary",
    "detected_words", "currencies", "amounts", "percentages", "tickers", "terms", "dates", "times", "relative_dates", "functions", "measures", "keywords", "domains",
)


def rules(d: Dialect) -> list[dict[str, str]]:
    """All that is said by rules; needs ``ng_lang, ng_conf`` beside the text."""
    return [
        *language.signals(d), *language.detect(d), *safety.profanity(d), *entities.financial(d), *entities.temporal(d), *entities.technical(d), *text.cleaned(d),
        *language.display_name(d, "split_part(language, '_', 1)"),
    ]


def analyze(docs: DataFrame, compact: bool = True, sentiment=None, toxicity=None) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with language, profanity, domains, cleaned text, sentiment and toxicity.

    All rules are projections; the one shuffle joins the n-gram result, which is a row for each document.
    """
    joined = docs.select("doc_id", "text").join(ngrams.predict(docs), "doc_id", "left")
    out = flow.apply(joined, rules, COMPACT if compact else COMPACT + VERBOSE)
    out = out.withColumn("sentiment", models.sentiment(F.col("clean"), sentiment)).withColumn("toxicity", models.toxicity(F.col("clean"), toxicity))
    return out.withColumn("max_toxicity", F.greatest(*(F.col(f"toxicity.{k}") for k in models.TOXICITY)))


def analyze_distinct(docs: DataFrame, **options) -> DataFrame:
    """The same for tables with many copies: each distinct text is analyzed once and its result joined back by hash."""
    hashed = docs.select("doc_id", "text", F.sha2("text", 256).alias("text_hash"))
    once = hashed.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.min("text").alias("text"))
    results = analyze(once.select(F.col("first_id").alias("doc_id"), "text"), **options).drop("text").withColumnRenamed("doc_id", "first_id")
    keyed = once.select("text_hash", "first_id").join(results, "first_id").drop("first_id")
    return hashed.join(keyed, "text_hash", "left").drop("text_hash")


TASKS = ("tokenize", "detokenize", "sentence_split", "normalize", "morph", "syllabify", "wc", "indic2roman", "roman2indic", "script_unify", "script_convert", "analyze")


def main(argv: list[str] | None = None) -> None:
    """``python -m scriptorium.plans.analysis TASK INPUT OUTPUT [--lang hi] [--to bn]`` over lines of text files."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("task", choices=TASKS)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--lang", default="hi")
    parser.add_argument("--to", default="bn")
    parser.add_argument("--mode", default="basic", choices=("naive", "basic", "aggressive"))
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    lines = readers.texts(spark, args.input)
    if args.task == "analyze":
        analyze(lines).write.mode("overwrite").json(args.output)
    elif args.task == "wc":
        flow.apply(lines, text.statistics).agg(F.count("*").alias("lines"), F.sum("word_count").alias("words"), F.sum("text_length").alias("chars")).write.mode("overwrite").json(args.output)
    else:
        lang, column = args.lang, F.col("text")
        native = {
            "tokenize": lambda d: [*indic.tokenized(d, lang=lang), {"out": d.join("tokens", " ")}],
            "detokenize": lambda d: [*indic.detokenized_rules(d), {"out": "detokenized"}],
            "normalize": lambda d: [{"out": scripts.normalized(d, lang)}],
            "script_unify": lambda d: [{"out": scripts.unified(d, lang, args.to, kind=args.mode)}],
            "script_convert": lambda d: [{"out": scripts.moved(d, lang, args.to)}],
        }
        turned = {
            "sentence_split": lambda: F.explode(indic.sentences(column, lang)),
            "morph": lambda: F.concat_ws(" ", phonetics.morphs(column)),
            "syllabify": lambda: F.concat_ws(" ", phonetics.syllables(column, lang)),
            "indic2roman": lambda: phonetics.itrans(column, lang, back=True),
            "roman2indic": lambda: phonetics.itrans(column, lang),
        }
        out = flow.apply(lines, native[args.task], ["out"]) if args.task in native else lines.select(turned[args.task]().alias("out"))
        readers.write_texts(out, args.output, "out")


if __name__ == "__main__":
    main()
