"""Models as pluggable pandas functions: a scorer is loaded once in a worker and gets batches of texts.

Without a model the results say so: label ``unknown`` with confidence 0, six zeros for toxicity, no translation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOXICITY = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
#: Languages that the first sentiment model is for; others go to the second.
FIRST_MODEL = ("hi", "bn", "ta", "te", "mr", "gu", "kn", "ml", "pa", "or", "as", "en", "hin", "ben", "tam", "tel", "mar", "guj", "kan", "mal", "pan", "ori", "asm", "eng")
Load = Callable[[], Callable[[Sequence[str]], Sequence[tuple]]]


def sentiment(column: Column, load: Load | None = None) -> Column:
    """``struct<label, confidence, model_used>``; ``load`` gives a function from texts to (label, confidence, name)."""
    if load is None:
        return F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("confidence"), F.lit("none").alias("model_used"))

    @F.pandas_udf("label string, confidence double, model_used string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            yield pd.DataFrame(list(model(texts.fillna("").tolist())), columns=["label", "confidence", "model_used"])

    return score(column)


def routed_sentiment(df: DataFrame, language: str, first: Load | None, second: Load | None, text: str = "text") -> DataFrame:
    """Each row by the model of its language: two filters and a union, as a CASE would run both models on all rows."""
    mine = F.coalesce(F.split(F.col(language), "_")[0].isin(*FIRST_MODEL), F.lit(False))
    return df.where(mine).withColumn("sentiment", sentiment(F.col(text), first)).unionByName(df.where(~mine).withColumn("sentiment", sentiment(F.col(text), second)))


def toxicity(column: Column, load: Load | None = None) -> Column:
    """Six scores."""
    if load is None:
        return F.struct(*(F.lit(0.0).alias(k) for k in TOXICITY))

    @F.pandas_udf(", ".join(f"{k} double" for k in TOXICITY))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            yield pd.DataFrame(list(model(texts.fillna("").tolist())), columns=list(TOXICITY))

    return score(column)


#: Words that the lexicon scorers below count. They are extras for trying the hooks out, no substitute for a model.
GOOD, BAD = ("good", "nice", "great", "awesome", "cool", "love", "happy", "best"), ("bad", "late", "tired", "hate", "worst", "sad", "poor", "wrong")


def lexicon_sentiment() -> Callable[[Sequence[str]], Sequence[tuple]]:
    """Counts words: the sign of good less bad ones is the label, their share of both the confidence."""
    good_words, bad_words = frozenset(GOOD), frozenset(BAD)

    def score(texts: Sequence[str]) -> list[tuple]:
        out = []
        for t in texts:
            words = t.lower().split()
            good, bad = sum(w in good_words for w in words), sum(w in bad_words for w in words)
            label = "positive" if good > bad else "negative" if bad > good else "neutral"
            out.append((label, max(good, bad) / (good + bad) if good + bad else 0.0, "lexicon"))
        return out

    return score


def lexicon_toxicity() -> Callable[[Sequence[str]], Sequence[tuple]]:
    """Shares of words that are profane, by severity, in the six scores."""
    from scriptorium.functions import lexicons

    levels = {k: frozenset(v) for k, v in lexicons.profane().items()}

    def score(texts: Sequence[str]) -> list[tuple]:
        out = []
        for t in texts:
            words = t.lower().split()
            n = max(1, len(words))
            extreme, moderate, mild = (sum(w in levels[k] for w in words) / n for k in ("extreme", "moderate", "mild"))
            out.append((extreme + moderate + mild, extreme, extreme, 0.0, moderate, 0.0))
        return out

    return score


def lid_summary(predictions: Column, names: dict[str, str]) -> Column:
    """The first three of a model's predictions, ``array<struct<lang, script, conf>>``, with their languages' names."""
    named = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.transform(F.slice(predictions, 1, 3), lambda p: F.struct(p["lang"].alias("language"), F.coalesce(F.element_at(named, p["lang"]), F.upper(p["lang"])).alias("language_name"), p["script"].alias("script"), p["conf"].alias("confidence")))


def top_languages(column: Column, k: int, load: Load) -> Column:
    """A model's ``k`` likeliest languages: ``load`` gives a function from texts to lists of (label like ``__label__hin_Deva``, probability)."""

    @F.pandas_udf("array<struct<lang: string, script: string, conf: double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = []
            for found in model([" ".join(t.split()) for t in texts.fillna("").tolist()]):
                parts = [(label.removeprefix("__label__").partition("_"), p) for label, p in found[:k]]
                rows.append([{"lang": lang, "script": script, "conf": float(p)} for (lang, _, script), p in parts])
            yield pd.Series(rows)

    return score(column)


def lid_result(predictions: Column, length: Column) -> Column:
    """``struct<lid_lang, lid_conf, is_mixed, threshold, passed>`` of a model's predictions; mixed if the second is over 0.2 or the first under 0.7."""
    first, second = F.get(predictions, F.lit(0)), F.get(predictions, F.lit(1))
    threshold = F.when(length <= 5, 0.28).when(length <= 10, 0.4).otherwise(0.5)
    mixed = F.coalesce(second["conf"] > 0.2, F.lit(False)) | F.coalesce(first["conf"] < 0.7, F.lit(False))
    return F.struct(first["lang"].alias("lid_lang"), F.coalesce(first["conf"], F.lit(0.0)).alias("lid_conf"), mixed.alias("is_mixed"), threshold.alias("threshold"), F.coalesce(first["conf"] >= threshold, F.lit(False)).alias("passed"))


class Loaded:
    """What a session knows of its models: which are set, and the share of them that is."""

    def __init__(self, **loads: Load | None) -> None:
        self.loads = loads

    def status(self) -> dict[str, object]:
        on = sum(v is not None for v in self.loads.values())
        return {"models": {k: v is not None for k, v in self.loads.items()}, "readiness": 100.0 * on / max(1, len(self.loads))}

    def without(self, *names: str) -> Loaded:
        return Loaded(**{k: None if k in names else v for k, v in self.loads.items()})


def language_id(column: Column, load: Load | None = None) -> Column:
    """``struct<lid_lang, lid_conf>`` for the ensemble; nulls without a model, so that the rules decide."""
    if load is None:
        return F.struct(F.lit(None).cast("string").alias("lid_lang"), F.lit(0.0).alias("lid_conf"))

    @F.pandas_udf("lid_lang string, lid_conf double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            yield pd.DataFrame(list(model(texts.fillna("").tolist())), columns=["lid_lang", "lid_conf"])

    return score(column)


def translation(column: Column, target: str, load: Load | None = None) -> Column:
    """``struct<success, translated_text, target_language, error>``."""
    if load is None:
        return F.struct(
            F.lit(False).alias("success"), column.alias("translated_text"), F.lit(target).alias("target_language"), F.lit("no translator").alias("error")
        )

    @F.pandas_udf("success boolean, translated_text string, target_language string, error string")
    def translate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            rows = [(True, t[0], target, None) for t in model(texts.fillna("").tolist())]
            yield pd.DataFrame(rows, columns=["success", "translated_text", "target_language", "error"])

    return translate(column)


# Two-letter codes that translators take, by the codes of detection.
TRANSLATOR_CODES = {"hin": "hi", "mar": "mr", "ben": "bn", "tam": "ta", "tel": "te", "kan": "kn", "mal": "ml", "guj": "gu", "pan": "pa", "ori": "or", "eng": "en", "spa": "es", "fra": "fr", "deu": "de"}


def supported_languages(spark) -> DataFrame:
    """``code, translator_code`` of the languages that can be translated."""
    return spark.createDataFrame(sorted(TRANSLATOR_CODES.items()), "code string, translator_code string")


def translations(df: DataFrame, targets: Sequence[str], load: Load | None = None, text: str = "text") -> DataFrame:
    """A row for each text and target; the targets are a short list, so rows are multiplied where they are, without a shuffle."""
    out = None
    for t in targets:
        one = df.withColumn("__t", translation(F.col(text), t, load)).withColumn("target_language", F.lit(t)).select(*df.columns, "target_language", "__t.success", "__t.translated_text", "__t.error")
        out = one if out is None else out.unionByName(one)
    return out


def to_english(df: DataFrame, load: Load | None = None, text: str = "text") -> DataFrame:
    return translations(df, ["en"], load, text)


def glossary_translator() -> Callable[[Sequence[str]], Sequence[tuple]]:
    """Words of a dozen that are known turned into others: an extra for trying the hook out."""
    glossary = {"the": "le", "river": "fleuve", "and": "et", "is": "est", "of": "de"}
    return lambda texts: [(" ".join(glossary.get(w, w) for w in t.split()),) for t in texts]
