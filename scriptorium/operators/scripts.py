"""Scripts of India: normalizing each in its own way, bringing several to one script, names of letters. Native expressions.

A script's rules are steps on a column, in order; a step that an option asks for stands beside it. All of them are literal
replacements or a regular expression that Java and RE2 read alike, so that a row is never left for Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from scriptorium.functions.dialect import Dialect
from scriptorium.operators import indic

DEVANAGARI = ("hi", "mr", "sa", "kK", "ne", "sd")
#: Languages that have a normalizer.
SUPPORTED = (*DEVANAGARI, "ur", "pa", "gu", "bn", "as", "or", "ml", "kn", "ta", "te")
# Language families, by which final vowels are written out.
DRAVIDIAN = ("ta", "te", "kn", "ml")
INDO_ARYAN = ("hi", "mr", "kK", "sa", "ne", "sd", "bn", "as", "pa", "gu", "or", "si")
# Letters with a nukta by script, and the letters that they are made of, as offsets.
NUKTAS = {
    "hi": {0x29: 0x28, 0x31: 0x30, 0x34: 0x33, 0x58: 0x15, 0x59: 0x16, 0x5A: 0x17, 0x5B: 0x1C, 0x5C: 0x21, 0x5D: 0x22, 0x5E: 0x2B, 0x5F: 0x2F},
    "pa": {0x33: 0x32, 0x36: 0x38, 0x59: 0x16, 0x5A: 0x17, 0x5B: 0x1C, 0x5E: 0x2B},
    "or": {0x5C: 0x21, 0x5D: 0x22},
    "bn": {0x5C: 0x21, 0x5D: 0x22, 0x5F: 0x2F},
}
# Spellings in two parts by script and the one sign that stands for them, in the order in which they are replaced.
TWO_PARTS = {
    "pa": (("ਅਾ", "ਆ"), ("ੲਿ", "ਇ"), ("ੲੀ", "ਈ"), ("ੳੁ", "ਉ"), ("ੳੂ", "ਊ"), ("ੲੇ", "ਏ"), ("ਅੈ", "ਐ"), ("ੳੋ", "ਓ"), ("ਅੌ", "ਔ")),
    "or early": (("ଅା", "ଆ"), ("ଏୗ", "ଐ"), ("ଓୗ", "ଔ")),
    "or": (("ଵ", "ବ"), ("ୈ", "୘"), ("ୋ", "ୋ"), ("ୌ", "ୌ")),
    "bn": (("ো", "ো"), ("ৌ", "ৌ")),
    "ta": (("ஔ", "ஔ"), ("ொ", "ொ"), ("ோ", "ோ"), ("ௌ", "ௌ")),
    "te": (("ై", "ై"),),
    "kn": (("ೀ", "ೀ"), ("ೇ", "ೇ"), ("ೈ", "ೈ"), ("ೊ", "ೊ"), ("ೋ", "ೋ")),
    "ml": (("ൊ", "ൊ"), ("ോ", "ോ"), ("ൌ", "ൌ"), ("ൗ", "ൌ")),
}
# Malayalam's final consonants and the letters that they are.
CHILLUS = (("ൺ", "ണ"), ("ൻ", "ന"), ("ർ", "ര"), ("ൽ", "ല"), ("ൾ", "ള"), ("ൿ", "ക"))
# A nasal and the stops that it stands before, as offsets: nasal, first and last stop.
NASALS = ((0x19, 0x15, 0x18), (0x1E, 0x1A, 0x1D), (0x23, 0x1F, 0x22), (0x28, 0x24, 0x27), (0x29, 0x24, 0x27), (0x2E, 0x2A, 0x2D))
# Open vowels and signs, and the plain ones that they become, as offsets.
CHANDRAS = ((0x0D, 0x0F), (0x11, 0x13), (0x45, 0x47), (0x49, 0x4B), (0x00, 0x02), (0x01, 0x02))
# Signs of Sinhala and of Devanagari that stand for each other, in the order of their code points.
SINHALA = "ංඃ඄අආඇඈඉඊඋඌඍඏඑඒඓඔඕඖකඛගඝඞඟචඡජඣඤඥඦටඨඩඪණඬතථදධන඲ඳපඵබභමයරලවශෂසහළ්ාැෑිීුූෘෙේෛොෝෞ"
FROM_SINHALA = "ंःऄअआऍऍइईउऊऋऌऎएऐऒओऔकखगघङङचछजझञञञटठडढणणतथदधननऩपफबभमयरलवशषसहळ्ाॉॉिीुूृॆेैॊोौ".replace("ऩ", "न")
DEVANAGARI_LETTERS = "ऀँंःऄअआइईउऊऋऌऍऎएऐऒओऔकखगघङचछजझञटठडढणतथदधनऩपफबभमयरलळवशषसहाॉिीुूृॆेैॊोौ्"
TO_SINHALA = "ංංංඃ඄අආඉඊඋඌඍඏඈඑඒඓඔඕඖකඛගඝඞචඡජඣඤටඨඩඪණතථදධනනපඵබභමයරලළවශෂසහාෑිීුූෘෙේෛොෝෞ්"
# Names of Latin letters in Devanagari, from a to z.
LETTER_NAMES = "ए बी सी डी ई एफ जी एच आई जे के एल एम एन ओ पी क्यू आर एस टी यू वी डब्ल्यू एक्स वाय जेड".split()


def block(lang: str) -> int:
    """Where the script of a language begins."""
    if lang in DEVANAGARI:
        return 0x0900
    return 0x0D80 if lang == "si" else indic.BLOCKS[lang]


def char(offset: int, lang: str) -> str:
    return chr(block(lang) + offset)


def _each(d: Dialect, out: str, pairs: Sequence[tuple[str, str]]) -> str:
    for one, other in pairs:
        out = f"replace({out}, {d.text(one)}, {d.text(other)})"
    return out


def common(d: Dialect, out: str) -> str:
    """What is done in every script: marks that don't show dropped, blanks and quotes made plain."""
    out = d.replace_all(out, "[\\x{FEFF}\\x{FFFE}\\x{2060}\\x{00AD}\\x{200C}\\x{200D}]", "")
    out = d.replace_all(out, "[\\x{200B}\\x{00A0}]", " ")
    return _each(d, out, indic.MARKS)


def nasals(d: Dialect, out: str, lang: str, mode: str) -> str:
    """``strict``: a nasal before a stop of its place becomes an anusvara; ``relaxed``: any nasal with a halant; ``consonants``: the other way."""
    halant, anusvara = char(0x4D, lang), char(0x02, lang)
    if mode == "relaxed":
        return d.replace_all(out, f"[{','.join(dict.fromkeys(char(n, lang) for n, _, _ in NASALS))}]{halant}", anusvara)
    for nasal, first, last in NASALS:
        stops = f"([{char(first, lang)}-{char(last, lang)}])"
        if mode == "strict":
            out = d.replace_all(out, f"{char(nasal, lang)}{halant}{stops}", f"{anusvara}$1")
        elif mode == "consonants":
            out = d.replace_all(out, f"{anusvara}{stops}", f"{char(nasal, lang)}{halant}$1")
    return out


def vowel_endings(d: Dialect, out: str, lang: str) -> str:
    """A word that ends in a bare consonant gets a halant, in Dravidian languages an aa sign."""
    sign = 0x3E if lang in DRAVIDIAN else 0x4D if lang in INDO_ARYAN else None
    return out if sign is None else d.replace_all(out, f"([{char(0x15, lang)}-{char(0x39, lang)}])( |\\z)", f"$1{char(sign, lang)}$2")


def normalized(
    d: Dialect, lang: str, column: str = "text", drop_nuktas: bool = False, nasals_mode: str = "keep", chandras: bool = False, endings: bool = False, loose: bool = False
) -> str:
    """``column`` in one spelling of the script of ``lang``; ``loose`` folds what unifying scripts folds besides.

    The options of one script that ``loose`` turns on: Gurmukhi's addak written out, tippi as bindi and vowel bases as vowels;
    Oriya's wa as ba; Assamese ra and va as Bengali ones; Malayalam's final consonants written out and tta for rra.
    """
    out = column
    script = "hi" if lang in DEVANAGARI else "bn" if lang == "as" else lang
    if script == "ur":
        return urdu(d, out)
    if script == "pa":
        if loose:
            out = _each(d, d.replace_all(out, "ੱ([^\\n])", "$1੍$1"), (("ੰ", "ਂ"),))
        out = _each(d, out, TWO_PARTS["pa"])
        if loose:
            out = _each(d, out, (("ੲ", "ਇ"), ("ੳ", "ਉ")))
    if script == "ml":
        out = _each(d, out, [(f"{letter}്‍", chillu) for chillu, letter in CHILLUS])
        if loose:
            out = _each(d, out, [(chillu, f"{letter}്") for chillu, letter in CHILLUS])
    out = common(d, out)
    if lang in SUPPORTED or lang == "si":
        if chandras:
            out = _each(d, out, [(char(a, lang), char(b, lang)) for a, b in CHANDRAS])
        out = nasals(d, out, lang, nasals_mode)
        if endings:
            out = vowel_endings(d, out, lang)
    if lang not in SUPPORTED:
        return out
    if script == "hi":
        out = _each(d, out, ((char(0x72, lang), char(0x0F, lang)),))
    if script == "or":
        out = _each(d, out, TWO_PARTS["or early"])
    out = _each(d, out, [(char(a, lang), char(b, lang) + char(0x3C, lang)) for a, b in NUKTAS.get(script, {}).items()])
    if drop_nuktas and script not in ("ta", "te", "kn", "ml"):
        out = _each(d, out, ((char(0x3C, lang), ""),))
    if lang == "as" and loose:
        out = _each(d, out, (("ৰ", "র"), ("ৱ", "ব")))
    if script != "hi":
        out = _each(d, out, ((char(0x64, lang), "।"), (char(0x65, lang), "॥")))
    if script in ("hi", "pa", "bn"):
        out = _each(d, out, (("|", "।"),))
    if script == "bn":
        out = _each(d, out, (("৷", "।"),))
    if script == "or":
        out = _each(d, out, (("୼", "।"), *((("ୱ", "ବ"),) if loose else ())))
    if script != "pa":
        out = _each(d, out, TWO_PARTS.get(script, ()))
    if script == "ml" and loose:
        out = _each(d, out, (("റ്റ", "ട്ട"),))
    return d.replace_all(out, f"([{char(0, lang)}-{char(0x7F, lang)}]):", f"$1{char(0x03, lang)}")


# Arabic letters that Urdu writes otherwise.
URDU_LETTERS = (("ي", "ی"), ("ى", "ی"), ("ك", "ک"), ("ه", "ہ"), ("ة", "ۃ"), ("ۀ", "ۂ"), ("٤", "۴"), ("٥", "۵"), ("٦", "۶"))


def urdu(d: Dialect, out: str) -> str:
    """Urdu by rule, as the library for it isn't at hand: plain marks, no vowel points, Urdu letters, blanks squeezed."""
    out = d.replace_all(_each(d, out, indic.MARKS), "[\\x{064B}-\\x{0652}\\x{0670}]", "")
    out = d.replace_all(_each(d, out, URDU_LETTERS), "([0-9۰-۹]+)", " $1 ")
    out = d.replace_all(out, "([،؛؟۔!?.,;:()])", " $1 ")
    return f"trim({d.replace_all(out, ' +', ' ')})"


def counts(d: Dialect, lang: str, column: str = "text") -> dict[str, str]:
    """How often a text has the marks that normalizing drops, and the letters with a nukta."""
    marks = {"byte_order": "FEFF", "byte_order_2": "FFFE", "word_joiner": "2060", "soft_hyphen": "00AD", "zero_width_space": "200B", "no_break_space": "00A0", "non_joiner": "200C", "joiner": "200D"}
    out = {f"n_{k}": d.long(d.count_in(column, f"\\x{{{v}}}")) for k, v in marks.items()}
    script = "hi" if lang in DEVANAGARI else "bn" if lang == "as" else lang
    return out | {f"n_nukta_{o:02x}": d.long(d.count_in(column, char(o, lang))) for o in NUKTAS.get(script, {})}


def moved(d: Dialect, source: str, target: str, column: str = "text") -> str:
    """``column`` from one script to another, Sinhala by way of Devanagari; as it is if there is no script for a language."""
    if any(x not in indic.BLOCKS and x not in DEVANAGARI and x != "si" for x in (source, target)):
        return column
    if source == "si":
        column, source = f"translate({column}, {d.text(SINHALA)}, {d.text(FROM_SINHALA)})", "hi"
    end = "hi" if target == "si" else target
    plain = lambda x: "hi" if x in DEVANAGARI else x
    out = indic.moved(d, plain(source), plain(end), column)
    return f"translate({out}, {d.text(DEVANAGARI_LETTERS)}, {d.text(TO_SINHALA)})" if target == "si" else out


def unified(d: Dialect, lang: str, common_lang: str = "hi", column: str = "text", kind: str = "basic") -> str:
    """Text in one common script: ``naive`` moves it, ``basic`` normalizes it first, ``aggressive`` folds all that can be folded."""
    if kind == "basic":
        column = normalized(d, lang, column)
    elif kind == "aggressive":
        column = normalized(d, lang, column, drop_nuktas=True, nasals_mode="consonants", chandras=True, endings=True, loose=True)
    return moved(d, lang, common_lang, column)


def acronym(d: Dialect, lang: str, column: str = "text") -> str:
    """Latin letters by their names in the script of ``lang``."""
    names = [(chr(ord("a") + i), name) for i, name in enumerate(LETTER_NAMES)]
    return moved(d, "hi", lang, _each(d, f"lower({column})", names))


def rejoined(d: Dialect, lang: str = "hi", column: str = "text") -> str:
    """Halants and nuktas that another tokenizer set apart, joined again."""
    halant, nukta = char(0x4D, lang), char(0x3C, lang)
    return _each(d, column, ((f" {halant} ", halant), (f" {nukta} ", nukta), (f" {nukta}{halant}", nukta + halant)))


# ------------------------------------------------------------------------------------------------ classes of characters

#: Classes of characters as ranges of offsets.
CLASSES: dict[str, tuple[tuple[int, int], ...]] = {
    "vowel": ((0x04, 0x14),), "vowel_sign": ((0x3E, 0x4C),), "halant": ((0x4D, 0x4D),), "nukta": ((0x3C, 0x3C),), "aum": ((0x50, 0x50),), "consonant": ((0x15, 0x39),),
    "velar": ((0x15, 0x19),), "palatal": ((0x1A, 0x1E),), "retroflex": ((0x1F, 0x23),), "dental": ((0x24, 0x29),), "labial": ((0x2A, 0x2E),),
    "voiced": ((0x17, 0x18), (0x1C, 0x1D), (0x21, 0x22), (0x26, 0x27), (0x2C, 0x2D)), "unvoiced": ((0x15, 0x16), (0x1A, 0x1B), (0x1F, 0x20), (0x24, 0x25), (0x2A, 0x2B)),
    "aspirated": tuple((o, o) for o in (0x16, 0x18, 0x1B, 0x1D, 0x20, 0x22, 0x25, 0x27, 0x2B, 0x2D)), "unaspirated": tuple((o, o) for o in (0x15, 0x17, 0x1A, 0x1C, 0x1F, 0x21, 0x24, 0x26, 0x2A, 0x2C)),
    "nasal": tuple((o, o) for o in (0x19, 0x1E, 0x23, 0x28, 0x29, 0x2D)), "fricative": ((0x36, 0x38),), "approximant": ((0x2F, 0x35),), "number": ((0x66, 0x6F),), "coordinated": ((0x00, 0x6F),),
}


def is_class(d: Dialect, name: str, lang: str, column: str = "c") -> str:
    """Whether the character in ``column`` is of a class; also for its offset, see ``is_class_offset``."""
    code = f"ascii({column})" if d.name == "spark" else f"unicode({column})"
    return is_class_offset(d, name, f"({code} - {block(lang)})")


def is_class_offset(d: Dialect, name: str, column: str = "o") -> str:
    return "(" + " OR ".join(f"{column} BETWEEN {a} AND {b}" for a, b in CLASSES[name]) + ")"
