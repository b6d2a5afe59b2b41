"""The rules once more in plain Python, from their description and with nothing of the operators but the fixed word lists."""

import hashlib
import math
import re
import string

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import flow
from scriptorium.functions import lexicons as L
from scriptorium.operators import convert, entities, indic, language, text
from scriptorium.plans import catalog

SMALL = "/root/testdata/sf0.001"
LINES = (
    "aaj mala late hoeil thik ahe", "tu kashala jatos mi yenar", "main bahut achha hoon yaar", "naan ippo varen pathukaren", "aaj traffic bahut hai", "The quick brown fox", "Good morning everyone", "",
    "   ", "Hi", "ok!", "hello yo", "नमस्ते", "मेरा नाम राम है और यह लंबा है", "आज traffic बहुत है, let us go now!", "Yaar ye movie bahut mast hai! Must watch bro, ekdum zabardast!", "तु kal office madhye ahe का?",
    "(Kya) XYZ can't 5pm Running THE nation's movie.", "kal kal kal yaar the is of", "তুমি কেমন আছো বন্ধু", "abc १२३ தமிழ் def ghi jkl mno", "x" * 12, "1234567890 12", "nahi nahin ka ki se par movie", "ye hai hai hai good bad movie watch",
    "$50 today, ₹1,250 crore AAPL IBM. Rs.20 5 % 3.5% roi", "10,000 on 3.14 and 12/05/2020", "पैसा 10,000 का 3.14",
)


def words_of(s):
    return s.split()


def runs_of(s):
    return re.findall(r"\w+", "".join(c if c.isalpha() or c.isnumeric() or c == "_" else " " for c in s))


def hits(lang, low):
    """A word counts once for every group that has it."""
    lines = [line.split() for line in L.MARKERS[lang].strip().splitlines()]
    return sum(run in line for line in lines for run in runs_of(low))


def share(s, lo, hi):
    return sum(lo <= ord(c) <= hi for c in s)


def latin(s):
    return sum(c in string.ascii_letters for c in s)


def romanized(s):
    low = s.lower()
    n = len(words_of(low))
    if len(s.strip()) < 3 or not n:
        return None, 0.0
    m, h, t, g = (hits(k, low) for k in ("mar", "hin", "tam", "generic"))
    mar, hin, tam = (m + 0.5 * g) / n, (h + 0.5 * g) / n, t / n
    strong = {k: any(x in low for x in v) for k, v in L.STRONG.items()}
    if t >= 1:
        if strong["tam"] or t >= 2:
            return "tam", min(0.95, tam + 0.4)
        if tam >= 0.15:
            return "tam", min(1, tam + 0.3)
    if m >= 1:
        if strong["mar"] or m >= 2:
            return "mar", min(0.9, mar + 0.3)
        if mar > hin and mar >= 0.2:
            return "mar", min(1, mar + 0.2)
    if h >= 1:
        if strong["hin"] or h >= 2:
            return "hin", min(0.9, hin + 0.3)
        if hin > mar and hin >= 0.2:
            return "hin", min(1, hin + 0.2)
    if g >= 2 and g / n >= 0.25:
        return "hin", min(1, g / n + 0.1)
    return None, 0.0


def script_lang(s):
    blocks = [("pa", 0xA00), ("gu", 0xA80), ("or", 0xB00), ("ta", 0xB80), ("te", 0xC00), ("kn", 0xC80), ("ml", 0xD00), ("si", 0xD80), ("hi", 0x900), ("bn", 0x980)]
    best = max(((share(s, b, b + 0x7F), -i, k) for i, (k, b) in enumerate(blocks)))
    return best[2] if best[0] else None


def code_mixed(s):
    """(is mixed, method, first language, confidence)."""
    low, strip = s.lower(), len(s.strip())
    words = words_of(low)
    if not words:
        return False, "none", None, 0.0
    marks = {k: hits(k, low) for k in L.MARKERS}
    lang = "tam" if marks["tam"] else "hin" if marks["hin"] else "mar" if marks["mar"] else "hin"
    english_lines = [line.split() for line in L.ENGLISH_MARKERS.strip().splitlines()]
    english = sum(run in line for line in english_lines for run in runs_of(low))
    indic_words = {w for v in L.MARKERS.values() for w in v.split()}
    english_words = set(L.ENGLISH_MARKERS.split())
    ti = te = 0
    for w in words:
        if len(w) < 2:
            continue
        head = re.match(r"[^\W]*", "".join(c if c.isalpha() or c.isnumeric() or c == "_" else " " for c in w))[0]
        if share(w, 0x900, 0x97F) or head in indic_words:
            ti += 1
        elif head in english_words:
            te += 1
    n = len(words)
    d, l = share(s, 0x900, 0x97F), latin(s)  # noqa: E741
    dp, lp = 100 * d / len(s), 100 * l / len(s)
    threshold = 0.12 if strip <= 15 else 0.10 if strip <= 30 else 0.08
    ri, re_ = ti / n, te / n
    total = sum(marks.values())
    if d >= max(2, int(strip * 0.05)) and l >= max(3, int(strip * 0.10)) and dp >= 10 and lp >= 20:
        return True, "script_diversity", (script_lang(s) or "hin") if dp > lp else lang if ti > te else "eng", min(0.92, (dp + lp) / 100)
    if ti >= 2 and te >= 2:
        if ri < threshold or re_ < threshold:
            return False, "none", None, 0.0
        first = lang if ri > re_ else "eng" if re_ > ri else lang if total >= english else "eng"
        return True, "token_analysis_adaptive", first, min(0.90, (ri + re_) * 1.5) if min(ri, re_) >= 0.15 else min(0.85, (ri + re_) * 1.3)
    if total >= 2 and english >= 2:
        return True, "pattern_based", lang if total > english else "eng", min(0.80, 2 * (total + english) / n)
    return False, "none", None, 0.0


def detected(s):
    """(language, method, confidence) without a model and without n-grams."""
    strip = len(s.strip())
    if not strip:
        return "unknown", "empty_text", 0.0
    ip, lp = 100 * share(s, 0x900, 0xDFF) / len(s), 100 * latin(s) / len(s)
    rom, rc = romanized(s)
    early, ec = (rom, rc) if lp > 60 and ip < 10 else (None, 0.0)
    mixed, _, first, _ = code_mixed(s)
    script = script_lang(s)
    if early and ec > 0.75 and strip > 8 and (strip > 10 or ec >= 0.85):
        return early, "romanized_indic_early_detection", ec
    if strip <= 5:
        return (script, "script_very_short_text", min(0.75, ip / 100 + 0.1)) if script and ip > 50 else ("unknown", "very_short_text_insufficient_data", 0.3)
    if strip <= 10:
        if script and ip > 25:
            return script, "script_analysis_short_text", min(0.85, ip / 100 + 0.1)
        if early and ec > 0.85:
            return early, "romanized_short_text", ec * 0.9
        if ip > 0:
            return script or "unknown", "script_fallback_short_text", 0.4
        return ("eng", "latin_fallback_short_text", 0.4) if lp > 50 else ("unknown", "short_text_ambiguous", 0.3)
    if script and ip > 50:
        return script, "script_analysis", min(0.95, ip / 100 + 0.1)
    if script and 20 <= ip <= 50 and latin(s):
        return f"{script}_mixed", "code_mixed_analysis", min(0.85, ip / 100 + 0.2)
    if lp > 70:
        if rom and rc >= 0.5:
            return rom, "romanized_indic_latin", rc
        if mixed:
            return "eng_indic_mixed" if first == "eng" else f"{first}_eng_mixed", "code_mixed_latin_dominant", 0.75
        return (rom, "romanized_indic_latin_low_conf", rc) if rom else ("eng", "latin_fallback", 0.5)
    if script and 5 <= ip < 20:
        return f"{script}_transliterated", "transliterated", 0.5
    return "unknown", "no_detection", 0.3


def code_of(lang):
    base, _, rest = lang.partition("_")
    return L.CODES.get(base, base) + ("_" + rest if rest else "")


def signature(s):
    low = s.lower().strip()
    length = "short" if len(low) < 20 else "medium" if len(low) < 100 else "long"
    lat, dev = bool(re.search("[a-z]", low)), bool(share(low, 0x900, 0x97F))
    kind = "mixed" if lat and dev else "latin" if lat else "indic" if dev else "other"
    return f"{length}_{len(words_of(low))}_{kind}_{hashlib.md5(' '.join(words_of(low)[:3]).encode()).hexdigest()[:8]}"


def tokens(s):
    marks = string.punctuation + "।॥\uaaf0\uaaf1\uabeb\uabec\uabed\uabee\uabef\u1c7e\u1c7f"
    spaced = re.sub(" +", " ", "".join(f" {c} " if c in marks else c for c in s.replace("\t", " "))).strip(" ")
    joined = re.sub(r"([0-9]+ [,.:/] )+[0-9]+", lambda m: m[0].replace(" ", "") if m.start() else m[0], spaced)
    return joined.split(" ")


def converted(s):
    common = set(L.ENGLISH_WORDS.split())
    suffixes = ("ing", "ed", "ly", "er", "est", "tion", "sion", "ness", "ment", "ful", "less", "able", "ible", "ous", "ious", "ive", "al", "ial")
    out = []
    for t in words_of(s):
        core = t.strip(".,!?;:'\"()[]{}").lower()
        if not core:
            out.append(t)
            continue
        known = core in L.HINDI
        wordy = all(c.isalpha() or c.isnumeric() or c == "_" for c in core)
        english = (
            any(c in "0123456789" for c in core) or (len(t) == 1 and t in string.ascii_uppercase) or (core in common and (core in convert.VERY_COMMON or not known))
            or bool(re.fullmatch(r"[^\W]+'(t|re|ve|ll|d|m|s)", core)) or bool(re.match(r"[A-Z]{2,}([^A-Za-z0-9_]|$)", t))
            or (wordy and len(core) > 5 and not known and any(core.endswith(x) and len(core) > len(x) for x in suffixes)) or (t[0] in string.ascii_uppercase and len(t) > 2 and not known)
        )
        if english:
            out.append(t)
            continue
        solid = [i for i, c in enumerate(t) if c.isalpha() or c.isnumeric()]
        lead, tail = (t[: solid[0]], t[solid[-1] + 1 :]) if solid else (t, t)
        out.append(lead + (L.HINDI[core] if known else core) + tail)
    return " ".join(out)


def fused(lid, conf, s):
    words = words_of(s.lower())
    ratio = sum(w in set(L.ENGLISH_WORDS.split()) for w in words) / len(words) if words else 0.0
    sure, ec = ratio > 0.5, min(ratio * 1.2, 0.95)
    if sure and ec > 0.7 and lid != "eng":
        lid, conf = "eng", ec
    rom, rc = romanized(s)
    if conf > 0.90:
        return lid, conf, "glotlid_preferred_high_confidence"
    if not rom or rc <= 0:
        return lid, conf, "glotlid_only"
    if sure and ec > 0.7:
        return "eng", ec, "english_validated_override_romanized"
    letters = sum(c.isalpha() for c in s)
    lp = 100 * latin(s) / letters if letters else 0
    if lp <= 60:
        return lid, conf, "glotlid_preferred_low_latin"
    w = 0.5 if lp > 80 else 0.55 if lp > 70 else 0.6
    both = conf * w + rc * (1 - w)
    if abs(conf - rc) > 0.30:
        return (lid, conf, "glotlid_preferred_conf_gap") if conf > rc else (rom, rc, "romanized_preferred_conf_gap")
    if rc > conf and rom in L.ENSEMBLE_INDIAN:
        return rom, both, "ensemble_weighted_romanized"
    if (lid in L.ENSEMBLE_INDIAN and rom not in L.ENSEMBLE_INDIAN) or conf >= rc:
        return lid, both, "ensemble_weighted_glotlid"
    return rom, both, "ensemble_weighted_romanized"


def financial(s):
    signs = dict(L.CURRENCIES)
    found = re.findall(r"(?i)([₹$€£¥₽₩₪₦₨]|Rs\.?|INR|USD|EUR|GBP)\s*([\d,]+\.?\d*)(?:\s*(thousand|million|billion|trillion|lakh|crore|K|M|B|T)\b)?", s)
    named = {k.lower(): v for k, v in signs.items()}
    percent = [p + "%" for p in re.findall(r"(\d+\.?\d*)\s*%", s)]
    terms = [t for t in L.FINANCIAL_TERMS if t in s.lower()]
    tickers = re.findall(r"\b[A-Z]{2,5}\b(?=\s|$|[,.])", s)
    n = len(words_of(s))
    counted = 2 * len(found) + len(percent) + len(terms)
    return sorted(named.get(a.lower(), a.upper()) for a, _, _ in found), sorted(b for _, b, _ in found), sorted(percent), sorted(terms), sorted(tickers), bool(n) and counted / n >= 0.15


@pytest.fixture(scope="module")
def texts(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    indian = [r["text"] for r in catalog.indic_documents(spark, SMALL).collect()]
    mixed = [f"{a[:60]} {line} {b[:40]}" for a, b, line in zip(docs, indian, LINES * 20)]
    return [*LINES, *docs, *indian, *mixed]


def got(spark, texts, steps, keep):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: tuple(r)[1:] for r in flow.apply(df, steps, ["doc_id", *keep]).collect()}


def close(a, b):
    return len(a) == len(b) and all(math.isclose(x, y, abs_tol=1e-9) if isinstance(y, float) else x == y for x, y in zip(a, b))


CASES = {
    "romanized": (language.romanized, ["rom_lang", "rom_conf"], lambda s: (romanized(s)[0], float(romanized(s)[1]))),
    "code_mixed": (language.signals, ["is_code_mixed", "mix_method", "mix_primary", "mix_conf"], lambda s: (*code_mixed(s)[:3], float(code_mixed(s)[3]))),
    "detected": (lambda d: [*language.signals(d), *language.detect(d, ngram=False)], ["language", "method", "confidence"], lambda s: (code_of(detected(s)[0]), detected(s)[1], float(detected(s)[2]))),
    "signature": (text.signature, ["signature"], lambda s: (signature(s),)),
    "tokens": (indic.tokenized, ["tokens"], lambda s: (tokens(s),)),
    "converted": (convert.converted, ["converted_text"], lambda s: (converted(s),)),
    "financial": (entities.financial, ["currencies", "amounts", "percentages", "terms", "tickers", "is_financial"], financial),
    "ensemble": (
        lambda d: [{"lid_lang": "CASE length(text) % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'hin' ELSE 'fra' END", "lid_conf": "(length(text) % 100) / 100e0"}, *language.romanized(d), *language.english_ratio(d), *language.ensemble(d)],
        ["final_language", "final_confidence", "ensemble_method"],
        lambda s: (lambda r: (r[0], float(r[1]), r[2]))(fused(("eng", "hin", "fra")[len(s) % 3], (len(s) % 100) / 100, s)),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_operators_equal_the_rules_in_plain_python(spark, texts, name):
    steps, keep, plain = CASES[name]
    for i, row in got(spark, texts, steps, keep).items():
        assert close(row, plain(texts[i])), (texts[i][:200], row, plain(texts[i]))


def test_a_model_that_knows_nothing_leaves_the_rules(spark, texts):
    none = lambda d: [*language.signals(d), {"lid_lang": "cast(null AS string)", "lid_conf": "0e0", "lid_mixed": "false"}, *language.english_ratio(d), *language.ensemble(d), *language.detect_with_model(d)]
    rules = lambda d: [*language.signals(d), *language.detect(d, ngram=False)]
    one, two = got(spark, texts, none, ["method", "confidence"]), got(spark, texts, rules, ["method", "confidence"])
    assert one == two


def test_a_model_decides_in_the_stated_order(spark):
    rows = [
        ("a long English sentence about rivers and hills", "eng", 0.97, False, "ensemble_glotlid_preferred_high_confidence"), ("Hi", "eng", 0.9, False, "glotlid_very_short_text"), ("hello yo", "eng", 0.5, False, "glotlid_short_text"),
        ("यह एक लंबा वाक्य है और कुछ नहीं", "hin", 0.55, False, "script_analysis"), ("१२३४ ५६७८ 1234 5678 9", "xxx", 0.55, True, "glotlid_code_mixed"), ("zzz qqq www rrr ppp sss ddd", "ido", 0.5, False, "latin_fallback"),
        ("zzz qqq www rrr ppp sss ddd", "fra", 0.5, False, "glotlid_latin"), ("zzz qqq www rrr ppp sss ddd", "fra", 0.62, False, "glotlid_medium"),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "doc_id long, text string, lid_lang string, lid_conf double, lid_mixed boolean")
    out = flow.apply(df, lambda d: [*language.signals(d), *language.english_ratio(d), *language.ensemble(d), *language.detect_with_model(d)], ["doc_id", "method"])
    assert [r["method"] for r in out.orderBy(F.col("doc_id")).collect()] == [r[4] for r in rows]
