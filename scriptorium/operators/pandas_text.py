"""The text steps that Spark has no built-in for: Unicode forms, repeats of any character, emoji names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import flow
from scriptorium.operators import text as rules
from scriptorium.operators.validation import validated


def unicode_form(column: Column, form: str = "NFKC") -> Column:
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return normal(column)


def fewer_repeats(column: Column, most: int = 2) -> Column:
    """Runs of three and more of a character are cut to ``most``. Native: Java has back-references."""
    return F.regexp_replace(column, r"(?d)(.)\1{2,}", "$1" * most)


def named_emoji(column: Column, keep: bool = True) -> Column:
    """Emoji as their Unicode names between blanks, or dropped."""

    @F.pandas_udf("string")
    def named(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            if text.isascii():
                return text
            return "".join(
                (f" {unicodedata.name(c, '').lower().replace(' ', '_')} " if keep else "") if 0x1F300 <= ord(c) <= 0x1FAFF or 0x2600 <= ord(c) <= 0x27BF else c for c in text
            )

        return texts.map(one, na_action="ignore")

    return named(column)


@validated(level=lambda x: isinstance(x, str))
def normalized(df: DataFrame, level: str = "moderate", out: str = "normalized", column: str = "text", **flags: bool) -> DataFrame:
    """``df`` with ``column`` normalized at a level (``light``, ``moderate``, ``aggressive``; any other leaves it as it is) or by six flags.

    Unicode forms need Python; only texts beyond ASCII go there (see ``unicode_form``), all else is native.
    """
    if not flags and level not in rules.LEVELS:
        return df.withColumn(out, F.col(column))
    on = rules.LEVELS.get(level, rules.LEVELS["aggressive"]) | flags
    held = df.select(F.struct("*").alias("row"), F.col(column).cast("string").alias("text"))
    if on["unicode"]:
        held = held.withColumn("text", unicode_form(F.col("text")))
    if on["repeats"]:
        held = held.withColumn("text", fewer_repeats(F.col("text")))
    steps = lambda d: rules.normalized(d, on["slang"], on["contract"], on["numbers"], on["blanks"])
    done = flow.apply(held, steps, ["row", "normalized"])
    return done.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != out), F.col("normalized").alias(out))


def preprocessed(df: DataFrame, level: str | None = None, keep_emoji: bool = True, punctuation: str = "preserve", out: str = "clean", column: str = "text") -> DataFrame:
    """``df`` with ``column`` preprocessed: normalized at a level if one is given, emoji named or dropped, then cleaned."""
    held = df.select(F.struct("*").alias("row"), F.col(column).cast("string").alias("text"))
    if level in rules.LEVELS:
        held = normalized(held, level, "text")
    held = held.withColumn("text", named_emoji(F.col("text"), keep_emoji))
    done = flow.apply(held, lambda d: rules.cleaned(d, punctuation), ["row", "clean"])
    return done.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != out), F.col("clean").alias(out))
