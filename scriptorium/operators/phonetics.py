"""Sounds of the scripts of India: property vectors, similarity, syllables, subsequences and ITRANS spelling.

The published tables of the reference scheme aren't at hand, so the vectors follow from the layout of the code blocks, which
is that of the traditional order of sounds, and from phonology where the layout doesn't say: 38 bits in twelve properties.
Vectors and similarities are relations (a row for each offset or pair of offsets); text goes through pandas functions,
word by word, each distinct word once.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import scripts

OFFSETS = 0x70
#: Properties, their places in a vector, and their values in order.
PROPERTIES = {
    "basic_type": ("vowel", "consonant", "nukta", "halant", "anusvaar", "misc"), "vowel_length": ("short", "long"), "vowel_strength": ("weak", "medium", "strong"),
    "vowel_status": ("independent", "dependent"), "consonant_type": ("plosive", "fricative", "central approximant", "lateral approximant", "flap"),
    "articulation_place": ("velar", "palatal", "retroflex", "dental", "labial"), "aspiration": ("aspirated", "unaspirated"), "voicing": ("voiced", "unvoiced"),
    "nasalization": ("nasal", "not nasal"), "vowel_horizontal": ("front", "central", "back"), "vowel_vertical": ("close", "close-mid", "open-mid", "open"), "vowel_roundness": ("rounded", "unrounded"),
}
PLACES: dict[str, tuple[int, int]] = {}
for _name, _values in PROPERTIES.items():
    _at = max((b for _, b in PLACES.values()), default=0)
    PLACES[_name] = (_at, _at + len(_values))
LENGTH = 38

# offset of an independent vowel: length, strength, horizontal, vertical, roundness; a sign is 0x38 further
_VOWELS = {
    0x05: ("short", "weak", "central", "open-mid", "unrounded"), 0x06: ("long", "weak", "central", "open", "unrounded"), 0x07: ("short", "weak", "front", "close", "unrounded"),
    0x08: ("long", "weak", "front", "close", "unrounded"), 0x09: ("short", "weak", "back", "close", "rounded"), 0x0A: ("long", "weak", "back", "close", "rounded"),
    0x0B: ("short", "weak", "front", "close", "unrounded"), 0x0C: ("short", "weak", "front", "close", "unrounded"), 0x0D: ("short", "medium", "front", "open-mid", "unrounded"),
    0x0E: ("short", "medium", "front", "close-mid", "unrounded"), 0x0F: ("long", "medium", "front", "close-mid", "unrounded"), 0x10: ("long", "strong", "front", "open-mid", "unrounded"),
    0x11: ("short", "medium", "back", "open-mid", "rounded"), 0x12: ("short", "medium", "back", "close-mid", "rounded"), 0x13: ("long", "medium", "back", "close-mid", "rounded"),
    0x14: ("long", "strong", "back", "open-mid", "rounded"),
}
_STOPS = (("velar", 0x15, 0x19), ("palatal", 0x1A, 0x1E), ("retroflex", 0x1F, 0x23), ("dental", 0x24, 0x28), ("labial", 0x2A, 0x2E))
# the other consonants: type, place, voicing
_REST = {
    0x29: ("plosive", "dental", "voiced"), 0x2F: ("central approximant", "palatal", "voiced"), 0x30: ("flap", "dental", "voiced"), 0x31: ("flap", "retroflex", "voiced"),
    0x32: ("lateral approximant", "dental", "voiced"), 0x33: ("lateral approximant", "retroflex", "voiced"), 0x34: ("central approximant", "retroflex", "voiced"),
    0x35: ("central approximant", "labial", "voiced"), 0x36: ("fricative", "palatal", "unvoiced"), 0x37: ("fricative", "retroflex", "unvoiced"), 0x38: ("fricative", "dental", "unvoiced"),
    0x39: ("fricative", "velar", "voiced"),
}
#: Offsets that Tamil has no letter for, by the letter that stands for them.
_TAMIL_GAPS = {0x16, 0x17, 0x18, 0x1B, 0x1D, 0x20, 0x21, 0x22, 0x25, 0x26, 0x27, 0x2B, 0x2C, 0x2D, 0x36}


def properties(offset: int, lang: str = "hi") -> dict[str, str]:
    """The properties of the sound at an offset of a script's block; none for offsets without one."""
    if lang == "ta" and offset in _TAMIL_GAPS:
        return {}
    sign = {0x3E + k: v for k, v in enumerate((0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B, 0x0B, 0x0D, 0x0E, 0x0F, 0x10, 0x11, 0x12, 0x13, 0x14))}
    vowel = offset if offset in _VOWELS else sign.get(offset)
    if vowel is not None:
        length, strength, horizontal, vertical, roundness = _VOWELS[vowel]
        status = "independent" if offset in _VOWELS else "dependent"
        return {"basic_type": "vowel", "vowel_length": length, "vowel_strength": strength, "vowel_status": status, "nasalization": "not nasal", "vowel_horizontal": horizontal, "vowel_vertical": vertical, "vowel_roundness": roundness}
    for place, first, last in _STOPS:
        if first <= offset <= last:
            k = offset - first
            nasal = k == 4
            return {
                "basic_type": "consonant", "consonant_type": "plosive", "articulation_place": place, "aspiration": "aspirated" if k in (1, 3) else "unaspirated",
                "voicing": "voiced" if k >= 2 else "unvoiced", "nasalization": "nasal" if nasal else "not nasal",
            }
    if offset in _REST:
        kind, place, voicing = _REST[offset]
        return {"basic_type": "consonant", "consonant_type": kind, "articulation_place": place, "aspiration": "unaspirated", "voicing": voicing, "nasalization": "nasal" if offset == 0x29 else "not nasal"}
    other = {0x3C: "nukta", 0x4D: "halant", 0x01: "anusvaar", 0x02: "anusvaar", 0x03: "misc", 0x3D: "misc", 0x50: "misc", **{o: "misc" for o in range(0x66, 0x70)}}
    return {"basic_type": other[offset]} if offset in other else {}


def vector(offset: int, lang: str = "hi") -> list[int]:
    """The 38 bits of an offset; all zero where there is no sound."""
    have = properties(offset, lang) if 0 <= offset < OFFSETS else {}
    return [int(have.get(name) == value) for name, values in PROPERTIES.items() for value in values]


def vectors(spark: SparkSession, lang: str = "hi") -> DataFrame:
    """``o, bits`` of every offset."""
    return spark.createDataFrame([(o, vector(o, lang)) for o in range(OFFSETS)], "o int, bits array<int>")


def property_bits(bits: Column, name: str) -> Column:
    a, b = PLACES[name]
    return F.slice(bits, a + 1, b - a)


def property_value(bits: Column, name: str) -> Column:
    """The bits of a property read as a binary number."""
    return F.aggregate(property_bits(bits, name), F.lit(0), lambda total, bit: total * 2 + bit)


def either(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda a, b: F.greatest(a, b))


def differing(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda a, b: (a != b).cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def _dot(one: Column, two: Column) -> Column:
    return _sum(F.zip_with(one, two, lambda a, b: a * b)).cast("double")


#: Similarities of two vectors. Dice and Jaccard divide by the vectors' lengths, not by their ones.
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {
    "equal": lambda a, b: (_sum(differing(a, b)) == 0).cast("double"),
    "dice": lambda a, b: 2 * _dot(a, b) / (F.size(a) + F.size(b)),
    "jaccard": lambda a, b: _dot(a, b) / (F.size(a) + F.size(b) - _dot(a, b)),
    "cosine": lambda a, b: _dot(a, b) / (F.sqrt(_dot(a, a) * _dot(b, b)) + F.lit(0.00001)),
    "dotprod": _dot,
    "sim1": lambda a, b: F.pow(F.lit(5.0), _dot(a, b)),
    "softmax": lambda a, b: F.exp(_dot(a, b)),
}


def similarity_matrix(spark: SparkSession, measure: str = "cosine", source: str = "hi", target: str = "hi", normalize: bool = True) -> DataFrame:
    """``o, o2, similarity`` of every two offsets, and each row's ``share`` of it: 112 by 112, a fixed number."""
    one = vectors(spark, source)
    two = vectors(spark, target).select(F.col("o").alias("o2"), F.col("bits").alias("bits2"))
    both = one.crossJoin(F.broadcast(two)).select("o", "o2", SIMILARITIES[measure](F.col("bits"), F.col("bits2")).alias("similarity"))
    total = F.sum("similarity").over(Window.partitionBy("o"))
    return both.withColumn("share", F.when(total > 0, F.col("similarity") / total).otherwise(0.0)) if normalize else both


def matrix_sql(measure: str = "cosine") -> str:
    """The matrix as DuckDB SQL, from a table of set bits instead of arrays."""
    ones = ", ".join(f"({o}, {i})" for o in range(OFFSETS) for i, bit in enumerate(vector(o)) if bit)
    each = f"(SELECT a.o, b.o AS o2 FROM range({OFFSETS}) a(o), range({OFFSETS}) b(o))"
    dots = "(SELECT x.o, y.o AS o2, cast(count(*) AS double) AS dot FROM ones x JOIN ones y ON x.i = y.i GROUP BY 1, 2)"
    size = "(SELECT o, cast(count(*) AS double) AS n FROM ones GROUP BY 1)"
    if measure != "cosine":
        raise ValueError("only the cosine has SQL")
    similarity = f"SELECT e.o, e.o2, coalesce(d.dot, 0) / (sqrt(coalesce(p.n, 0) * coalesce(q.n, 0)) + 0.00001e0) AS similarity FROM {each} e LEFT JOIN {dots} d USING (o, o2) LEFT JOIN {size} p ON p.o = e.o LEFT JOIN {size} q ON q.o = e.o2"
    total = "sum(similarity) OVER (PARTITION BY o)"
    return f"WITH ones(o, i) AS (VALUES {ones}) SELECT cast(o AS integer) AS o, cast(o2 AS integer) AS o2, round(similarity, 9) AS similarity, round(CASE WHEN {total} > 0 THEN similarity / {total} ELSE 0 END, 9) AS share FROM ({similarity})"


# ------------------------------------------------------------------------------------------------ syllables


@lru_cache(maxsize=512)
def _kind(c: str, lang: str) -> str:
    """What syllables depend on: V a vowel, v a vowel sign, C a plosive, c another consonant, n a nukta, h a halant, m an anusvara, - anything else."""
    have = properties(ord(c) - scripts.block(lang), lang) if 0 <= ord(c) - scripts.block(lang) < OFFSETS else {}
    basic = have.get("basic_type")
    if basic == "vowel":
        return "v" if have["vowel_status"] == "dependent" else "V"
    if basic == "consonant":
        return "C" if have["consonant_type"] == "plosive" else "c"
    return {"nukta": "n", "halant": "h", "anusvaar": "m"}.get(basic or "", "-")


def syllables_of(word: str, lang: str = "hi", simple: bool = False, vocabulary: Collection[str] | None = None) -> list[str]:
    """Orthographic syllables of a word.

    A syllable ends before or after a character that is no letter or sign, after a vowel, and after a consonant that another
    consonant or an independent vowel follows. An anusvara closes the syllable before it, unless a plosive follows; with
    ``simple`` it always stands for itself. Syllables that ``vocabulary`` lacks fall apart into characters.
    """
    kinds = "".join(_kind(c, lang) for c in word) + "$"
    out = [""]
    for i, c in enumerate(word):
        out[-1] += c
        now, after, later = kinds[i], kinds[i + 1], kinds[i + 2 : i + 3]
        lone = after == "m" and later != "C"  # an anusvara that closes the syllable
        if now == "-" or after == "-":
            cut = True
        elif now in "Vv":
            cut = simple or not lone
        elif now in "Ccn":
            cut = after in "Cc" or (after == "V" and not simple) or (after == "m" and (simple or not lone))
        else:
            cut = False
        if cut:
            out.append("")
    found = [s for s in "\0".join(out).strip("\0 ").replace(" ", "\0").split("\0") if s]
    return found if vocabulary is None else [x for s in found for x in ([s] if s in vocabulary else list(s))]


_ADDAK, _TIPPI, _BINDI = "ੱ", "ੰ", "ਂ"


def improved_syllables_of(word: str, lang: str = "hi", vocabulary: Collection[str] | None = None) -> list[str]:
    """The same, but Malayalam's final consonants and Gurmukhi's addak and tippi are cut as what they stand for, and kept as they are."""
    stands = {chillu: letter + "്" for chillu, letter in scripts.CHILLUS} if lang == "ml" else {}
    plain, shown = [], []  # the word as it is cut, and what each of its characters is shown as
    i = 0
    while i < len(word):
        c = word[i]
        if c in stands:
            plain += stands[c]
            shown += [c, ""]
        elif lang == "pa" and c == _ADDAK and i + 1 < len(word) and word[i + 1] != "\n":
            plain += [word[i + 1], "੍", word[i + 1]]
            shown += [_ADDAK + word[i + 1], "", ""]
            i += 1
        elif lang == "pa" and c == _TIPPI:
            plain.append(_BINDI)
            shown.append(c)
        else:
            plain.append(c)
            shown.append(c)
        i += 1
    at, out = 0, []
    text = "".join(plain)
    for s in syllables_of(text, lang):
        while text[at : at + len(s)] != s:
            at += 1
        out.append("".join(shown[at : at + len(s)]))
        at += len(s)
    out = [s for s in out if s]
    return out if vocabulary is None else [x for s in out for x in ([s] if s in vocabulary else list(s))]


def syllables(column: Column, lang: str = "hi", kind: str = "plain", vocabulary: Collection[str] | None = None) -> Column:
    """Syllables of each text; each distinct word is cut once."""
    cut = {"plain": lambda w: syllables_of(w, lang, False, vocabulary), "simple": lambda w: syllables_of(w, lang, True, vocabulary), "improved": lambda w: improved_syllables_of(w, lang, vocabulary)}[kind]

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}

        def one(text: str | None) -> list[str]:
            out: list[str] = []
            for word in (text or "").split():
                if word not in known:
                    known[word] = cut(word)
                out += known[word]
            return out

        return texts.map(one)

    return split(column)


# ------------------------------------------------------------------------------------------------ subsequences


def common_ratio(one: str, two: str, source: str | None = None, target: str | None = None) -> float:
    """Length of the longest common subsequence over the longer length; across two scripts characters match by offset."""
    if source and target and source != target:
        one, two = ([_place(c, lang) for c in word] for word, lang in ((one, source), (two, target)))
    row = [0] * (len(two) + 1)
    for x in one:
        before = 0
        for j, y in enumerate(two, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / max(len(one), len(two), 1)


def _place(c: str, lang: str) -> int | str:
    offset = ord(c) - scripts.block(lang)
    return offset if 0 <= offset < OFFSETS else c


def lcs_ratio(one: Column, two: Column, source: str | None = None, target: str | None = None) -> Column:
    """``struct<ratio, length, length2>`` of each pair of words."""

    @F.pandas_udf("ratio double, length double, length2 double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(common_ratio(x or "", y or "", source, target), float(len(x or "")), float(len(y or ""))) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=["ratio", "length", "length2"])

    return ratio(one, two)


# ------------------------------------------------------------------------------------------------ ITRANS

# The published ITRANS spelling of offsets. A consonant's is that with its vowel a.
ITRANS = {
    0x01: ".N", 0x02: ".m", 0x03: "H", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "R^i", 0x0C: "L^i", 0x0D: "e.c", 0x0E: "E", 0x0F: "e", 0x10: "ai",
    0x11: "o.c", 0x12: "O", 0x13: "o", 0x14: "au", 0x15: "ka", 0x16: "kha", 0x17: "ga", 0x18: "gha", 0x19: "~Na", 0x1A: "cha", 0x1B: "Cha", 0x1C: "ja", 0x1D: "jha", 0x1E: "~na",
    0x1F: "Ta", 0x20: "Tha", 0x21: "Da", 0x22: "Dha", 0x23: "Na", 0x24: "ta", 0x25: "tha", 0x26: "da", 0x27: "dha", 0x28: "na", 0x29: "n2a", 0x2A: "pa", 0x2B: "pha", 0x2C: "ba",
    0x2D: "bha", 0x2E: "ma", 0x2F: "ya", 0x30: "ra", 0x31: "r2a", 0x32: "la", 0x33: "lda", 0x34: "zha", 0x35: "va", 0x36: "sha", 0x37: "Sha", 0x38: "sa", 0x39: "ha", 0x3C: ".x", 0x3D: ".a",
    0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "R^i", 0x44: "R^I", 0x45: "e.c", 0x46: "E", 0x47: "e", 0x48: "ai", 0x49: "o.c", 0x4A: "O", 0x4B: "o", 0x4C: "au",
    0x50: "AUM", 0x60: "R^I", 0x61: "L^I", 0x64: ".", 0x65: "..", **{0x66 + k: str(k) for k in range(10)},
}
# Other spellings and those that they stand for, in the order in which they are replaced.
ITRANS_ALIASES = (
    ("A", "aa"), ("I", "ii"), ("U", "uu"), ("RRi", "R^i"), ("RRI", "R^I"), ("LLi", "L^i"), ("LLI", "L^I"), ("L", "ld"), ("w", "v"), ("x", "kSh"), ("gj", "j~n"), ("dny", "j~n"),
    (".n", ".m"), ("M", ".m"), ("OM", "AUM"),
)
_CONSONANTS = {v[:-1]: k for k, v in ITRANS.items() if 0x15 <= k <= 0x39}
_SIGNS = {v: k for k, v in ITRANS.items() if 0x3E <= k <= 0x4C}
_OTHERS = {v: k for k, v in ITRANS.items() if not 0x15 <= k <= 0x4C or k in (0x3C, 0x3D)}
_LONGEST = max(map(len, ITRANS.values()))


@lru_cache(maxsize=100_000)
def from_itrans(word: str, lang: str = "hi") -> str:
    """An ITRANS spelling in the script of a language: the longest spelling first; a consonant without a vowel has a halant."""
    for one, other in ITRANS_ALIASES:
        word = word.replace(one, other)
    base = scripts.block(lang)
    out: list[str] = []
    bare = False  # whether the last consonant still waits for its vowel
    at = 0
    while at < len(word):
        for n in range(min(_LONGEST, len(word) - at), 0, -1):
            part = word[at : at + n]
            if part in _CONSONANTS or part in _SIGNS or part in _OTHERS:
                break
        if bare and part == "a":
            bare = False  # the vowel that a consonant has by itself
        elif bare and part in _SIGNS:
            out.append(chr(base + _SIGNS[part]))
            bare = False
        else:
            if bare and part != ".x":
                out.append(chr(base + 0x4D))
            if part in _CONSONANTS:
                out.append(chr(base + _CONSONANTS[part]))
                bare = True
            else:
                out.append(chr(base + _OTHERS[part]) if part in _OTHERS else part)
                bare = bare and part == ".x"
        at += len(part)
    return "".join(out) + (chr(base + 0x4D) if bare else "")


@lru_cache(maxsize=100_000)
def to_itrans(word: str, lang: str = "hi") -> str:
    """A word of a script of India in ITRANS; a vowel sign or a halant takes a consonant's vowel away."""
    if lang == "ml":
        for chillu, letter in scripts.CHILLUS:
            word = word.replace(chillu, letter + "്")
    base, out = scripts.block(lang), ""
    for c in word:
        o = ord(c) - base
        if o == 0x4D:
            out = out[:-1]
        elif o in ITRANS:
            out = (out[:-1] if 0x3E <= o <= 0x4C else out) + ITRANS[o]
        else:
            out += c
    return out


def itrans(column: Column, lang: str = "hi", back: bool = False) -> Column:
    """Text from ITRANS to the script of a language, or with ``back`` the other way, word by word."""
    turn = to_itrans if back else from_itrans

    @F.pandas_udf("string")
    def turned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(turn(w, lang) for w in t.split(" ")), na_action="ignore")

    return turned(column)


def itrans_words(column: Column, lang: str = "hi") -> Column:
    """A map from each word of an array to its spelling in the script of a language."""

    @F.pandas_udf("array<string>")
    def turned(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: None if ws is None else [from_itrans(w, lang) for w in ws])

    return F.map_from_arrays(column, turned(column))


def indic_share(column: Column, lang: str = "hi") -> Column:
    """How much of each text is Devanagari once it is read as ITRANS, as a share of its characters."""

    @F.pandas_udf("double")
    def share(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> float:
            turned = " ".join(from_itrans(w, lang) for w in (t or "").split(" "))
            return sum("ऀ" <= c <= "ॿ" for c in turned) / len(t) if t else 0.0

        return texts.map(one)

    return share(column)


# A shorter list than the English alphabet's ARPABET codes, by the kind of sound that each is.
ARPABET = {
    "vowel": "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW".split(), "stop": "B D G K P T".split(), "affricate": "CH JH".split(), "fricative": "DH F HH S SH TH V Z ZH".split(),
    "nasal": "M N NG".split(), "liquid": "L R".split(), "glide": "W Y".split(),
}


def english_sounds(spark: SparkSession) -> DataFrame:
    """``code, kind, position`` of the sounds of English."""
    codes = sorted((c, kind) for kind, members in ARPABET.items() for c in members)
    return spark.createDataFrame([(c, kind, i) for i, (c, kind) in enumerate(codes)], "code string, kind string, position int")


def morphs(column: Column, model: Callable[[], Callable[[str], Sequence[str]]] | None = None) -> Column:
    """Each text's words cut into morphs by a model that ``model`` loads, each distinct word once; as they are without one."""
    if model is None:
        return F.filter(F.split(column, " "), lambda w: w != "")

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyse = lru_cache(maxsize=16_384)(model())
        for texts in batches:
            yield texts.map(lambda t: [m for w in (t or "").split(" ") if w for m in analyse(w)])

    return cut(column)
