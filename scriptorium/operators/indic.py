"""Scripts of India: tokenizing, normalizing and moving between scripts as native expressions; the rest by pandas UDFs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.dialect import Dialect
from scriptorium.operators.text import Step

# Where each script's block begins.
BLOCKS = {"hi": 0x0900, "mr": 0x0900, "bn": 0x0980, "as": 0x0980, "pa": 0x0A00, "gu": 0x0A80, "or": 0x0B00, "ta": 0x0B80, "te": 0x0C00, "kn": 0x0C80, "ml": 0x0D00}
# Punctuation that stands apart from words.
PUNCTUATION = "!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~\\x{0964}\\x{0965}\\x{AAF0}\\x{AAF1}\\x{ABEB}-\\x{ABEF}\\x{1C7E}\\x{1C7F}"
# Punctuation marks and what they become, in this order.
MARKS = (("﻿", ""), ("„", '"'), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), ("´", "'"), ("‘", "'"), ("‚", "'"), ("’", "'"), ("''", '"'), ("…", "..."))


# Punctuation of Urdu.
URDU_PUNCTUATION = PUNCTUATION.split("\\x{0964}")[0] + "\\x{0609}\\x{060A}\\x{060C}\\x{061E}\\x{066A}-\\x{066D}\\x{06D4}"


def tokenized(d: Dialect, column: str = "text", lang: str = "hi") -> Sequence[Step]:
    """Tokens, with punctuation apart; digits with separators between them stay together but for a text's very first."""
    spaced = d.replace_all(f"replace({column}, chr(9), ' ')", f"([{URDU_PUNCTUATION if lang == 'ur' else PUNCTUATION}])", " $1 ")
    steps = [{"tok_spaced": "trim(" + d.replace_all(spaced, " +", " ") + ")"}]
    steps += [{"tok_text": "tok_spaced"}] if lang == "ur" else whole_numbers(d, "tok_spaced", "tok_text")
    return [*steps, {"tokens": ("split(tok_text, ' ')" if d.name == "spark" else "string_split(tok_text, ' ')")}]


def whole_numbers(d: Dialect, column: str, out: str) -> Sequence[Step]:
    """Numbers and dates that were cut at their separators put together, but for one at the very beginning."""
    head = d.one(column, "^(?:[0-9]+ [,.:/] )+[0-9]+", 0)
    rest = f"substr({column}, length({out}_head) + 1)"
    if d.name == "spark":
        joined = d.replace_all(rest, "(?<=[0-9]) ([,.:/]) (?=[0-9])", "$1")
    else:  # no lookaround: a digit is taken on both sides, so that it takes two turns where one digit stands between two separators
        joined = d.replace_all(d.replace_all(rest, "([0-9]) ([,.:/]) ([0-9])", "$1$2$3"), "([0-9]) ([,.:/]) ([0-9])", "$1$2$3")
    return [{f"{out}_head": head}, {out: f"concat({out}_head, {joined})"}]


def detokenized_rules(d: Dialect, column: str = "text") -> Sequence[Step]:
    """Tokens joined again: numbers, marks that lean on both sides, closing and opening marks, and quotes that open and close in turn."""
    out = "det_numbers"
    for pattern, by in ((r" ([-/\\]) ", "$1"), (r" ([!%)\]},.:;>?\x{0964}\x{0965}])", "$1"), (r"([#$(\[{<@]) ", "$1")):
        out = d.replace_all(out, pattern, by)
    steps = [*whole_numbers(d, column, "det_numbers"), {"det_0": out}]
    for i, quote in enumerate(("'", '"', "`")):
        # between two quotes stands every second part: the first quote leans to the right, the second to the left
        parts = f"split(det_{i}, {d.text(quote)})" if d.name == "spark" else f"string_split(det_{i}, {d.text(quote)})"
        n = d.size(f"det_parts_{i}")
        bare = "regexp_replace(p_, '^ ', '')" if d.name == "spark" else "regexp_replace(p_, '^ ', '')"
        trimmed = f"CASE WHEN i_ % 2 = 1 THEN regexp_replace({bare}, ' $', '') ELSE p_ END"
        lone = f"CASE WHEN i_ % 2 = 1 THEN CASE WHEN i_ = {n} - 1 THEN {bare} ELSE {trimmed} END ELSE p_ END"
        if d.name == "spark":
            joined = f"array_join(transform(det_parts_{i}, (p_, i_) -> {lone}), {d.text(quote)})"
        else:
            joined = f"array_to_string(list_transform(det_parts_{i}, lambda p_, j_: {lone.replace('i_ ', '(j_ - 1) ')}), {d.text(quote)})"
        steps += [{f"det_parts_{i}": parts}, {f"det_{i + 1}": joined}]
    return [*steps, {"detokenized": "det_3"}]


def moved(d: Dialect, source: str, target: str, column: str = "text") -> str:
    """``column`` from one script to another: the blocks are laid out alike, so offsets carry over. Dandas stay."""
    a, b = BLOCKS[source], BLOCKS[target]
    offsets = [o for o in range(0x70) if o not in (0x64, 0x65)]
    to = [_tamil(o) if target == "ta" else o for o in offsets]
    return f"translate({column}, {d.text(''.join(chr(a + o) for o in offsets))}, {d.text(''.join(chr(b + o) for o in to))})"


def _tamil(offset: int) -> int:
    """Tamil writes one stop for each place of articulation, and one labial for the aspirated and voiced ones."""
    row, place = divmod(offset - 0x15, 5)
    if 0x15 <= offset <= 0x28 and offset != 0x1C and 0 < place < 4:
        return 0x15 + 5 * row
    return {0x2B: 0x2A, 0x2C: 0x2A, 0x2D: 0x2A, 0x36: 0x37}.get(offset, offset)


# ------------------------------------------------------------------------------------------------ pandas UDFs


def _sentences(text: str, danda: bool) -> list[str]:
    stops = "।॥?!" if danda and ("।" in text or "॥" in text) else "?!.।॥"
    text, out, begin = text.strip(), [], 0
    for i, c in enumerate(text):
        if c not in stops or (i and text[i - 1].isnumeric()):
            continue
        near = lambda x: x.isascii() and x.isalnum()
        if i and near(text[i - 1]) and i + 1 < len(text) and near(text[i + 1]):
            continue
        if text[begin : i + 1].strip():
            out.append(text[begin : i + 1].strip())
        begin = i + 1
    if text[begin:].strip():
        out.append(text[begin:].strip())
    if "." not in stops:
        return out
    # a lone word with a full stop is an abbreviation: it takes in the sentence before and the one after
    merged: list[str] = []
    open_ = False
    for s in out:
        short = s.endswith(".") and (" " not in s or len(s.split(" ")[-1]) == 2)
        if merged and (open_ or (short and " " not in s)):
            merged[-1] += " " + s
        else:
            merged.append(s)
        open_ = short
    return [" ".join(s.split(" ")) for s in merged]


def sentences(column: Column, lang: str = "hi") -> Column:
    """Sentences of each text, by dandas where the text has them, else by full stops."""
    danda = lang in ("hi", "mr", "bn", "as", "pa", "or", "ne", "sa")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else _sentences(t, danda))

    return split(column)
