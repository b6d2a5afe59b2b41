"""Romanized words to native script, within the row: no shuffle, whatever the length of the text.

A dictionary is a fixed list (a parameter), so it goes into the plan as a literal. Words that it lacks are read as ITRANS for Hindi and
Marathi; that step is Python's, for which the distinct words of a batch are turned once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import flow
from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import Dialect
from scriptorium.operators import phonetics
from scriptorium.operators.text import Step
from scriptorium.operators.validation import validated

EDGES = ".,!?;:'\"()\\[\\]{}"
#: Languages whose words are read as ITRANS where the dictionary lacks them.
SPELT = {"hin": "hi", "hi": "hi", "mar": "mr", "mr": "mr"}
# English words that stay English whatever the dictionary says.
VERY_COMMON = (
    "the to of and a in is it you that he was for on are with as his they be at one have this from or had by not but what all were we when your can said if do will each about how up out "
    "them my so am going today tomorrow yesterday morning evening night time day week month year"
).split()
CONTRACTION = r"^[\p{L}\p{N}_]+'(t|re|ve|ll|d|m|s)$"
SUFFIX = r"^[\p{L}\p{N}_]+(ing|ed|ly|er|est|tion|sion|ness|ment|ful|less|able|ible|ous|ious|ive|al|ial)$"


def tokens(d: Dialect, dictionary: Mapping[str, str] = L.HINDI, keep_english: bool = True) -> Sequence[Step]:
    """``conv_tokens``: a struct for each white-space token with what it is (``state``) and what it becomes but for ITRANS (``made``)."""
    common = sorted({w for g in L.groups(L.ENGLISH_WORDS) for w in g})
    parts = {
        "t": "t_",
        "core": "lower(" + d.replace_all("t_", f"^[{EDGES}]+|[{EDGES}]+$", "") + ")",
        "lead": d.one("t_", r"^[^\p{L}\p{N}]*"),
        "tail": d.one("t_", r"[^\p{L}\p{N}]*$"),
        "shout": d.matches("t_", "^[A-Z]{2,}([^A-Za-z0-9_]|$)"),
        "capital": d.matches("t_", "^[A-Z]"),
    }
    known, very = d.among("x_.core", sorted(dictionary)), d.among("x_.core", VERY_COMMON)
    english = (
        f"{d.matches('x_.core', '[0-9]')} OR (x_.capital AND length(x_.t) = 1) OR ({d.among('x_.core', common)} AND ({very} OR NOT {known})) "
        f"OR {d.matches('x_.core', CONTRACTION)} OR x_.shout OR ({d.matches('x_.core', SUFFIX)} AND length(x_.core) > 5 AND NOT {known}) OR (x_.capital AND length(x_.t) > 2 AND NOT {known})"
    )
    english = english if keep_english else "false"
    state = f"CASE WHEN length(x_.core) = 0 THEN 'bare' WHEN {english} THEN 'preserved' WHEN {known} THEN 'converted' ELSE 'failed' END"
    struct = (lambda fields: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")") if d.name == "spark" else (lambda fields: "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}")
    made = f"CASE x_.state WHEN 'converted' THEN concat(x_.lead, {d.lookup('x_.core', dictionary)}, x_.tail) WHEN 'failed' THEN concat(x_.lead, x_.core, x_.tail) ELSE x_.t END"
    keep = {k: f"x_.{k}" for k in ("t", "core", "lead", "tail")}
    return [
        {"conv_0": d.map(d.words("text"), "t_", struct(parts))},
        {"conv_1": d.map("conv_0", "x_", struct({**keep, "state": state}))},
        {"conv_tokens": d.map("conv_1", "x_", struct({**keep, "state": "x_.state", "made": made}))},
    ]


def summary(d: Dialect) -> Sequence[Step]:
    """The text and its figures, from ``conv_tokens`` whose states may also be ``itrans``."""
    count = lambda s: d.long(d.size(d.filter("conv_tokens", "x_", f"x_.state IN ({s})")))
    return [
        {
            "converted_text": d.join(d.map("conv_tokens", "x_", "x_.made"), " "),
            "total_tokens": d.long(d.size("conv_tokens")),
            "converted_tokens": count("'converted', 'itrans'"),
            "by_dictionary": count("'converted'"),
            "preserved_tokens": count("'preserved'"),
            "failed_tokens": count("'failed'"),
        },
        {
            "conversion_rate": f"CASE WHEN total_tokens > 0 THEN {d.double('converted_tokens')} / total_tokens * 100e0 ELSE 0e0 END",
            "conversion_method": "CASE WHEN converted_tokens > 0 AND preserved_tokens > 0 THEN 'hybrid' WHEN by_dictionary > 0 THEN 'dictionary' WHEN converted_tokens > 0 THEN 'itrans' ELSE 'none' END",
        },
    ]


def converted(d: Dialect, dictionary: Mapping[str, str] = L.HINDI, keep_english: bool = True) -> Sequence[Step]:
    """``converted_text`` and counts by the dictionary alone. English words stay, dictionary words change script, others go to lower case."""
    return [*tokens(d, dictionary, keep_english), *summary(d)]


@validated(lang=lambda x: isinstance(x, str) and 2 <= len(x) <= 3)
def to_native(df: DataFrame, lang: str = "hin", keep_english: bool = True, dictionary: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with the conversion of ``text``: by the dictionary, else (Hindi, Marathi) as ITRANS if that gives native letters."""
    table = L.dictionary(lang) if dictionary is None else dictionary
    out = flow.apply(df, lambda d: tokens(d, table, keep_english))
    if lang in SPELT:
        # the words that are left go through Python in one array, and come back in the same order
        left = F.transform(F.filter("conv_tokens", lambda x: x["state"] == "failed"), lambda x: x["core"])
        out = out.withColumn("conv_spelt", phonetics.itrans_words(F.array_distinct(left), SPELT[lang]))
        spelt = lambda x: F.element_at(F.col("conv_spelt"), x["core"])

        def turned(x):
            native = (x["state"] == "failed") & F.coalesce(spelt(x).rlike("[\\x{0900}-\\x{097F}]"), F.lit(False))
            made = F.when(native, F.concat(x["lead"], spelt(x), x["tail"])).otherwise(x["made"])
            return F.struct(x["t"].alias("t"), x["core"].alias("core"), x["lead"].alias("lead"), x["tail"].alias("tail"), F.when(native, "itrans").otherwise(x["state"]).alias("state"), made.alias("made"))

        out = out.withColumn("conv_tokens", F.transform("conv_tokens", turned)).drop("conv_spelt")
    out = flow.apply(out.drop("conv_0", "conv_1"), summary)
    status = lambda x: F.when(x["state"] == "preserved", "preserved_english").when(x["state"] == "failed", "failed").otherwise("converted")
    method = lambda x: F.when(x["state"] == "converted", "dictionary").when(x["state"] == "itrans", "itrans").otherwise("none")
    detail = lambda x: F.struct(x["t"].alias("original"), F.when(x["state"] == "failed", x["t"]).otherwise(x["made"]).alias("converted"), status(x).alias("status"), method(x).alias("method"))
    details = F.transform(F.filter("conv_tokens", lambda x: x["state"] != "bare"), detail)
    return out.withColumn("token_details", details).drop("conv_tokens", "by_dictionary")
