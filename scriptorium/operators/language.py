"""Language codes, romanized markers, code mixing, the rule ladder and the ensemble, over a column ``text``.

Markers are whole words, so a text's runs of word characters are found once and looked up in sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import Dialect
from scriptorium.operators.settings import Detection
from scriptorium.operators.text import Step, composition, script


def code(d: Dialect, column: str = "lang", out: str = "code", suffixes: bool = True) -> Sequence[Step]:
    """Canonical code of the part before the first ``_``; the rest stays if ``suffixes``."""
    base = f"lower({d.one(column, '^([^_]*)', 1)})"
    rest = d.one(column, "^[^_]*(_.*)$", 1) if suffixes else "''"
    known = d.lookup("code_base", L.CODES, "code_base")
    return [{"code_base": base, "code_rest": f"coalesce({rest}, '')"}, {out: f"CASE WHEN coalesce({column}, '') = '' THEN 'unknown' ELSE concat({known}, code_rest) END"}]


def display_name(d: Dialect, column: str = "code", out: str = "language_name") -> Sequence[Step]:
    names = L.INDIAN_NAMES | L.OTHER_NAMES | {"unknown": "Unknown"}
    return [{out: d.lookup(column, names, f"upper({column})")}]


def _count(d: Dialect, runs: str, markers: str) -> str:
    parts = [f"{n} * {d.size(d.filter(runs, 'w_', d.among('w_', words)))}" for n, words in L.by_weight(markers).items()]
    return "(" + " + ".join(parts) + ")"


def romanized_scores(d: Dialect) -> Sequence[Step]:
    """Marker counts by language and shares of words."""
    return [
        {"low": "lower(text)"},
        {"runs": d.word_runs("low"), "n_words": d.n_words("low")},
        {f"m_{k}": _count(d, "runs", v) for k, v in L.MARKERS.items()},
        {f"s_{k}": f"CASE WHEN n_words > 0 THEN ({d.double(f'm_{k}')}{' + m_generic * 0.5e0' if k != 'tam' else ''}) / n_words ELSE 0e0 END" for k in ("mar", "hin", "tam")},
    ]


def romanized(d: Dialect) -> Sequence[Step]:
    """The romanized language by its markers, and a confidence. Tamil is tried first, then Marathi, Hindi, generic words."""

    def tried(lang: str, top: str, strong: str, weak: str, clear: str) -> list[tuple[str, str, str]]:
        has = d.has_any("low", L.STRONG[lang])
        return [
            (f"m_{lang} >= 1 AND ({has} OR m_{lang} >= 2)", lang, f"least({top}, s_{lang} + {strong})"),
            (f"m_{lang} >= 1 AND {clear}", lang, f"s_{lang} + {weak}"),
        ]

    cases = [
        *tried("tam", "0.95e0", "0.4e0", "0.3e0", "s_tam >= 0.15e0"),
        *tried("mar", "0.90e0", "0.3e0", "0.2e0", "s_mar > s_hin AND s_mar >= 0.2e0"),
        *tried("hin", "0.90e0", "0.3e0", "0.2e0", "s_hin > s_mar AND s_hin >= 0.2e0"),
        ("m_generic >= 2 AND m_generic >= 0.25e0 * n_words", "hin", f"{d.double('m_generic')} / n_words + 0.1e0"),
    ]
    numbered = " ".join(f"WHEN {c} THEN {i}" for i, (c, _, _) in enumerate(cases))
    return [
        *romanized_scores(d),
        {"rom_case": f"CASE WHEN text IS NULL OR length({d.trim('text')}) < 3 OR n_words = 0 THEN -1 {numbered} ELSE -1 END"},
        {
            "rom_lang": "CASE rom_case " + " ".join(f"WHEN {i} THEN '{lang}'" for i, (_, lang, _) in enumerate(cases)) + " END",
            "rom_conf": "CASE rom_case " + " ".join(f"WHEN {i} THEN least(1e0, greatest(0e0, {e}))" for i, (_, _, e) in enumerate(cases)) + " ELSE 0e0 END",
        },
    ]


# Words that hint at a language, in the order in which languages are tried.
HINTS = {
    "hin": "hai hain hoon bahut kya main mein yaar bhai".split(), "mar": "aahe ahe khup mi tu kay kashala la var".split(), "ben": "ache ami tumi khub bhalo keno kothay".split(),
    "tam": "irukku naan nee romba enna epdi inniki".split(), "tel": "undi nenu nuvvu chala enti ela indu".split(), "pan": "hai main tu bahut ki kive hun".split(),
}


def boosted(d: Dialect) -> Sequence[Step]:
    """A model's ``lid_lang, lid_conf`` against hints of romanized languages in texts that are mostly Latin. Hints count anywhere in the text."""
    share = {k: "(" + " + ".join(f"cast(contains(hint_low, {d.text(w)}) AS int)" for w in words) + f") / {len(words)}e0 * 0.85e0" for k, words in HINTS.items()}
    first = " ".join(f"WHEN h_{k} = hint_conf THEN '{k}'" for k in HINTS)
    strong = "latin_letters > 70 AND hint_conf > 0.30e0 AND lid_conf < 0.60e0"
    return [
        {"hint_low": "lower(text)", "hint_letters": d.count_in("text", "\\p{L}"), "hint_latin": d.count_in("text", L.LATIN)},
        {"latin_letters": f"CASE WHEN hint_letters > 0 THEN {d.double('hint_latin')} / hint_letters * 100e0 ELSE 0e0 END"},
        {f"h_{k}": f"CASE WHEN latin_letters > 70 THEN {v} ELSE 0e0 END" for k, v in share.items()},
        {"hint_conf": f"greatest({', '.join(f'h_{k}' for k in HINTS)})"},
        {"hint_lang": f"CASE WHEN hint_conf > 0 THEN CASE {first} END END"},
        {
            "boosted_language": f"CASE WHEN {strong} THEN hint_lang ELSE lid_lang END",
            "boosted_confidence": f"CASE WHEN {strong} THEN hint_conf ELSE lid_conf END",
            "boosted_method": f"CASE WHEN {strong} THEN 'romanized_ensemble' ELSE 'glotlid' END",
        },
    ]


def enhanced(d: Dialect) -> Sequence[Step]:
    """The romanized language with the share of a text that reads as ITRANS, ``itrans_share``; needs ``romanized``."""
    fused = "least(0.95e0, itrans_share * 0.6e0 + rom_conf * 0.4e0)"
    return [
        {
            "enh_lang": "CASE WHEN itrans_share >= 0.30e0 THEN coalesce(rom_lang, 'hin') ELSE rom_lang END",
            "enh_conf": f"CASE WHEN itrans_share >= 0.30e0 THEN CASE WHEN rom_lang IS NOT NULL THEN {fused} ELSE least(0.85e0, itrans_share + 0.2e0) END ELSE rom_conf END",
        }
    ]


def shown_name(d: Dialect, column: str = "language", out: str = "shown_name") -> Sequence[Step]:
    """Display names with what a suffix says: two languages of a mix, or a romanized form."""
    names = L.INDIAN_NAMES | L.OTHER_NAMES | {"unknown": "Unknown"}
    base, second = d.one(column, "^([^_]*)", 1), d.one(column, "^[^_]*_([^_]*)_mixed$", 1)
    name = lambda c: d.lookup(c, names, f"upper({c})")
    return [
        {"name_base": base, "name_second": second},
        {
            out: f"CASE WHEN name_second <> '' THEN concat({name('name_base')}, '-', {name('name_second')}, ' (Code-mixed)') WHEN {d.matches(column, '_mixed$')} THEN concat({name('name_base')}, ' (Code-mixed)') "
            f"WHEN {d.matches(column, '_(romanized|transliterated)$')} THEN concat({name('name_base')}, ' (Romanized)') ELSE {name('name_base')} END"
        },
    ]


def english_ratio(d: Dialect) -> Sequence[Step]:
    words = sorted({w for g in L.groups(L.ENGLISH_WORDS) for w in g})
    return [
        {"eng_words": d.words("lower(text)")},
        {"eng_hits": d.size(d.filter("eng_words", "w_", d.among("w_", words))), "eng_total": d.size("eng_words")},
        {"english_ratio": f"CASE WHEN eng_total > 0 THEN {d.double('eng_hits')} / eng_total ELSE 0e0 END"},
        {"is_english": "english_ratio > 0.5e0", "english_conf": "least(english_ratio * 1.2e0, 0.95e0)"},
    ]


def code_mixing(d: Dialect) -> Sequence[Step]:
    """Whether Indic and English are mixed, by scripts, by words or by markers. Needs ``romanized`` and ``composition``."""
    indic = sorted({w for v in L.MARKERS.values() for g in L.groups(v) for w in g})
    english = sorted({w for g in L.groups(L.ENGLISH_MARKERS) for w in g})
    n = f"length({d.trim('text')})"
    # a word is judged by the run of word characters that it begins with
    head = d.one("w_", r"^[\p{L}\p{N}_]+")
    native = f"deva > 0 AND {d.matches('w_', f'[{L.DEVANAGARI}]')}"
    kind = lambda k: d.size(d.filter("token_kinds", "k_", f"k_ = {k}"))
    return [
        {"eng_markers": _count(d, "runs", L.ENGLISH_MARKERS), "all_markers": "m_mar + m_hin + m_tam + m_generic", "tokens": d.words("low"), "deva": d.count_in("indic_only", L.DEVANAGARI), "strip_n": n},
        # what a token is judged by, then its class: 1 Indic, 2 English; each token is looked at once
        {"token_heads": d.map("tokens", "w_", f"CASE WHEN length(w_) < 2 THEN '' WHEN {native} THEN 'अ' ELSE {head} END")},
        {"token_kinds": d.map("token_heads", "h_", f"CASE WHEN h_ = 'अ' OR {d.among('h_', indic)} THEN 1 WHEN {d.among('h_', english)} THEN 2 ELSE 0 END")},
        {
            "t_indic": kind(1),
            "t_english": kind(2),
            "mix_threshold": "CASE WHEN strip_n <= 15 THEN 0.12e0 WHEN strip_n <= 30 THEN 0.10e0 ELSE 0.08e0 END",
            "mix_lang": "CASE WHEN m_tam > 0 THEN 'tam' WHEN m_hin > 0 THEN 'hin' WHEN m_mar > 0 THEN 'mar' ELSE 'hin' END",
            "deva_percentage": f"CASE WHEN n_all > 0 THEN {d.double('deva')} / n_all * 100e0 ELSE 0e0 END",
        },
        {"r_indic": f"CASE WHEN n_words > 0 THEN {d.double('t_indic')} / n_words ELSE 0e0 END", "r_english": f"CASE WHEN n_words > 0 THEN {d.double('t_english')} / n_words ELSE 0e0 END"},
        {
            "mix_case": "CASE WHEN coalesce(n_words, 0) = 0 THEN 0 "
            "WHEN deva >= greatest(2, floor(strip_n * 0.05e0)) AND n_latin >= greatest(3, floor(strip_n * 0.10e0)) AND deva_percentage >= 10 AND latin_percentage >= 20 THEN 1 "
            "WHEN t_indic >= 2 AND t_english >= 2 THEN CASE WHEN r_indic >= mix_threshold AND r_english >= mix_threshold THEN 2 ELSE 0 END "
            "WHEN all_markers >= 2 AND eng_markers >= 2 THEN 3 ELSE 0 END"
        },
        {
            "is_code_mixed": "mix_case > 0",
            "mix_method": "CASE mix_case WHEN 1 THEN 'script_diversity' WHEN 2 THEN 'token_analysis_adaptive' WHEN 3 THEN 'pattern_based' ELSE 'none' END",
            "mix_primary": "CASE mix_case WHEN 1 THEN CASE WHEN deva_percentage > latin_percentage THEN coalesce(script_lang, 'hin') WHEN t_indic > t_english THEN mix_lang ELSE 'eng' END "
            "WHEN 2 THEN CASE WHEN r_indic > r_english THEN mix_lang WHEN r_english > r_indic THEN 'eng' WHEN all_markers >= eng_markers THEN mix_lang ELSE 'eng' END "
            "WHEN 3 THEN CASE WHEN all_markers > eng_markers THEN mix_lang ELSE 'eng' END END",
            "mix_conf": "CASE mix_case WHEN 1 THEN least(0.92e0, (deva_percentage + latin_percentage) / 100e0) "
            "WHEN 2 THEN CASE WHEN least(r_indic, r_english) >= 0.15e0 THEN least(0.90e0, (r_indic + r_english) * 1.5e0) ELSE least(0.85e0, (r_indic + r_english) * 1.3e0) END "
            f"WHEN 3 THEN least(0.80e0, ({d.double('all_markers + eng_markers')} / n_words) * 2e0) ELSE 0e0 END",
        },
    ]


def signals(d: Dialect) -> Sequence[Step]:
    """All that the ladder looks at."""
    return [*composition(d), *script(d), *romanized(d), *code_mixing(d)]


def detect(d: Dialect, ngram: bool = True) -> Sequence[Step]:
    """Language, method and confidence by rules alone. Needs ``ng_lang`` and ``ng_conf`` columns if ``ngram``."""
    better = "ng_lang IS NOT NULL AND ng_conf > 0.4e0 AND ng_conf > rom_conf AND (rom_lang IS NULL OR rom_conf < 0.6e0) AND length(text) >= 10" if ngram else "FALSE"
    roman = "latin_percentage > 60 AND indic_percentage < 10"
    strong = "least(0.95e0, indic_percentage / 100e0 + 0.1e0)"
    ladder = [
        ("strip_n = 0", "'unknown'", "empty_text", "0e0"),
        ("early_lang IS NOT NULL AND early_conf > 0.75e0 AND strip_n > 8 AND (strip_n > 10 OR early_conf >= 0.85e0)", "early_lang", "romanized_indic_early_detection", "early_conf"),
        ("strip_n <= 5 AND script_lang IS NOT NULL AND indic_percentage > 50", "script_lang", "script_very_short_text", "least(0.75e0, indic_percentage / 100e0 + 0.1e0)"),
        ("strip_n <= 5", "'unknown'", "very_short_text_insufficient_data", "0.3e0"),
        ("strip_n <= 10 AND script_lang IS NOT NULL AND indic_percentage > 25", "script_lang", "script_analysis_short_text", "least(0.85e0, indic_percentage / 100e0 + 0.1e0)"),
        ("strip_n <= 10 AND early_lang IS NOT NULL AND early_conf > 0.85e0", "early_lang", "romanized_short_text", "early_conf * 0.9e0"),
        ("strip_n <= 10 AND indic_percentage > 0", "coalesce(script_lang, 'unknown')", "script_fallback_short_text", "0.4e0"),
        ("strip_n <= 10 AND latin_percentage > 50", "'eng'", "latin_fallback_short_text", "0.4e0"),
        ("strip_n <= 10", "'unknown'", "short_text_ambiguous", "0.3e0"),
        ("script_lang IS NOT NULL AND indic_percentage > 50", "script_lang", "script_analysis", strong),
        ("script_lang IS NOT NULL AND indic_percentage BETWEEN 20 AND 50 AND has_both_scripts", "concat(script_lang, '_mixed')", "code_mixed_analysis", "least(0.85e0, indic_percentage / 100e0 + 0.2e0)"),
        ("latin_percentage > 70 AND rom_lang IS NOT NULL AND rom_conf >= 0.5e0", "rom_lang", "romanized_indic_latin", "rom_conf"),
        ("latin_percentage > 70 AND is_code_mixed", "CASE WHEN mix_primary = 'eng' THEN 'eng_indic_mixed' ELSE concat(mix_primary, '_eng_mixed') END", "code_mixed_latin_dominant", "0.75e0"),
        ("latin_percentage > 70 AND rom_lang IS NOT NULL", "rom_lang", "romanized_indic_latin_low_conf", "rom_conf"),
        ("latin_percentage > 70", "'eng'", "latin_fallback", "0.5e0"),
        ("script_lang IS NOT NULL AND indic_percentage >= 5 AND indic_percentage < 20", "concat(script_lang, '_transliterated')", "transliterated", "0.5e0"),
    ]
    pick = lambda of, rest: "CASE det_case " + " ".join(f"WHEN {i} THEN {of(r)}" for i, r in enumerate(ladder)) + f" ELSE {rest} END"
    return [
        {"early_lang": f"CASE WHEN {roman} THEN CASE WHEN {better} THEN {'ng_lang' if ngram else 'rom_lang'} ELSE rom_lang END END", "early_conf": f"CASE WHEN {roman} THEN CASE WHEN {better} THEN {'ng_conf' if ngram else 'rom_conf'} ELSE rom_conf END ELSE 0e0 END"},
        {"det_case": "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, (c, _, _, _) in enumerate(ladder)) + " ELSE -1 END"},
        {"detected": pick(lambda r: r[1], "'unknown'"), "method": pick(lambda r: f"'{r[2]}'", "'no_detection'"), "confidence": pick(lambda r: r[3], "0.3e0")},
        *code(d, "detected", "language"),
    ]


def detect_with_model(d: Dialect, settings: Detection = Detection()) -> Sequence[Step]:
    """The whole ladder with a model's ``lid_lang, lid_conf, lid_mixed``. Needs ``signals``, ``english_ratio`` and ``ensemble`` on the romanized result ``rom_lang, rom_conf``.

    Without a model (``lid_lang`` null) it is the ladder of rules. ``seen_lang`` is what the early steps know of romanized languages.
    """
    s = settings
    latin, indic = "latin_percentage", "indic_percentage"
    fused = "lid_lang IS NOT NULL"
    early = "seen_conf > {} AND strip_n > {}".format(s.romanized_early, s.early_length)
    mix = lambda same: f"CASE WHEN mix_primary = 'eng' THEN {same} ELSE concat(mix_primary, '_eng_mixed') END"
    known = "use_lang IS NOT NULL"
    real = "use_lang IS NOT NULL AND use_lang <> 'unknown'"
    script_conf = lambda top, more: f"least({top}, {indic} / 100e0 + {more})"
    ladder = [
        ("strip_n = 0", "'unknown'", "'empty_text'", "0e0"),
        (f"{fused} AND final_confidence > {s.ensemble_early} AND NOT is_code_mixed AND strip_n > {s.early_length}", "final_language", "concat('ensemble_', ensemble_method)", "final_confidence"),
        (f"lid_lang IS NULL AND seen_lang IS NOT NULL AND {early} AND (strip_n > 10 OR seen_conf >= {s.romanized_early_short})", "seen_lang", "'romanized_indic_early_detection'", "seen_conf"),
        (f"is_obscure AND {latin} > 50 AND rom_lang IS NOT NULL", "rom_lang", "'obscure_filtered_romanized_detected'", "rom_conf"),
        (f"strip_n <= 5 AND {known} AND use_conf > 0.3", "use_lang", "'glotlid_very_short_text'", "least(0.70e0, use_conf)"),
        (f"strip_n <= 5 AND script_lang IS NOT NULL AND {indic} > 50", "script_lang", "'script_very_short_text'", script_conf("0.75e0", "0.1e0")),
        ("strip_n <= 5", "'unknown'", "'very_short_text_insufficient_data'", "0.3e0"),
        (f"strip_n <= 10 AND {known} AND use_conf > 0.4", "use_lang", "'glotlid_short_text'", "least(0.80e0, use_conf)"),
        (f"strip_n <= 10 AND script_lang IS NOT NULL AND {indic} > 25", "script_lang", "'script_analysis_short_text'", script_conf("0.85e0", "0.1e0")),
        (f"strip_n <= 10 AND seen_lang IS NOT NULL AND seen_conf > {s.romanized_early_short}", "seen_lang", "'romanized_short_text'", "seen_conf * 0.9e0"),
        (f"strip_n <= 10 AND {indic} > 0", "coalesce(script_lang, 'unknown')", "'script_fallback_short_text'", "0.4e0"),
        (f"strip_n <= 10 AND {latin} > 50", "'eng'", "'latin_fallback_short_text'", "0.4e0"),
        ("strip_n <= 10", "'unknown'", "'short_text_ambiguous'", "0.3e0"),
        (f"{fused} AND final_confidence >= {s.ensemble_least}", "final_language", "concat('ensemble_', ensemble_method)", "final_confidence"),
        (f"{known} AND use_conf > {s.model_sure}", "use_lang", "'glotlid_high_confidence'", "use_conf"),
        (f"lid_mixed AND {known} AND use_conf > {s.model_mixed}", "concat(use_lang, '_mixed')", "'glotlid_code_mixed'", "use_conf"),
        (f"script_lang IS NOT NULL AND {indic} > {s.strong_script}", "script_lang", "'script_analysis'", script_conf("0.95e0", "0.1e0")),
        (f"{known} AND use_conf > {s.model_high} AND {latin} > 70 AND is_code_mixed", mix("concat(use_lang, '_indic_mixed')"), "'code_mixed_high_confidence'", "0.82e0"),
        (f"{known} AND use_conf > {s.model_high}", "use_lang", "'glotlid'", "use_conf"),
        (f"script_lang IS NOT NULL AND {indic} BETWEEN {s.mixed_least} AND {s.mixed_most} AND has_both_scripts", "concat(script_lang, '_mixed')", "'code_mixed_analysis'", script_conf("0.85e0", "0.2e0")),
        (f"{known} AND use_conf > {s.model_medium} AND is_code_mixed AND {latin} > 70", mix("concat(use_lang, '_mixed')"), "'code_mixed_romanized'", "0.80e0"),
        (f"{known} AND use_conf > {s.model_medium} AND rom_lang IS NOT NULL AND {latin} > 70 AND rom_conf > use_conf", "rom_lang", "'romanized_indic'", "rom_conf"),
        (f"{known} AND use_conf > {s.model_medium} AND rom_lang IS NOT NULL AND {latin} > 70", "use_lang", "'glotlid_medium_override_romanized'", "use_conf"),
        (f"{known} AND use_conf > {s.model_medium}", "use_lang", "'glotlid_medium'", "use_conf"),
        (f"{latin} > {s.latin_dominance} AND rom_lang IS NOT NULL AND rom_conf >= 0.5 AND {real} AND use_conf > rom_conf", "use_lang", "'glotlid_latin_override_romanized'", "use_conf"),
        (f"{latin} > {s.latin_dominance} AND rom_lang IS NOT NULL AND rom_conf >= 0.5", "rom_lang", "'romanized_indic_latin'", "rom_conf"),
        (f"{latin} > {s.latin_dominance} AND is_code_mixed", mix("'eng_indic_mixed'"), "'code_mixed_latin_dominant'", "0.75e0"),
        (f"{latin} > {s.latin_dominance} AND rom_lang IS NOT NULL", "rom_lang", "'romanized_indic_latin_low_conf'", "rom_conf"),
        (f"{latin} > {s.latin_dominance} AND {real}", "use_lang", "'glotlid_latin'", "use_conf"),
        (f"{latin} > {s.latin_dominance}", "'eng'", "'latin_fallback'", "0.5e0"),
        (real, "use_lang", "'glotlid_low'", "use_conf"),
        (f"script_lang IS NOT NULL AND {indic} >= {s.minor_least} AND {indic} < {s.minor_most}", "concat(script_lang, '_transliterated')", "'transliterated'", "0.5e0"),
    ]
    early_cases = 4  # of these, all but the first leave the code as it is
    pick = lambda k, rest: "CASE det_case " + " ".join(f"WHEN {i} THEN {r[k]}" for i, r in enumerate(ladder)) + f" ELSE {rest} END"
    roman = f"{latin} > 60 AND {indic} < 10"
    obscure = f"coalesce({d.among('lid_lang', L.OBSCURE)} AND lid_conf < 0.8, false)"
    return [
        {"seen_lang": f"CASE WHEN {roman} THEN rom_lang END", "seen_conf": f"CASE WHEN {roman} THEN rom_conf ELSE 0e0 END", "is_obscure": obscure},
        {"use_lang": "CASE WHEN is_obscure THEN 'unknown' ELSE lid_lang END", "use_conf": "CASE WHEN is_obscure THEN 0.3e0 ELSE lid_conf END"},
        {"det_case": "CASE " + " ".join(f"WHEN {r[0]} THEN {i}" for i, r in enumerate(ladder)) + " ELSE -1 END"},
        {"detected": pick(1, "'unknown'"), "method": pick(2, "'no_detection'"), "confidence": pick(3, "0.3e0")},
        *code(d, "detected", "language_code"),
        {"language": f"CASE WHEN det_case BETWEEN 1 AND {early_cases - 1} THEN detected ELSE language_code END"},
    ]


def ensemble(d: Dialect) -> Sequence[Step]:
    """Fuse a model's ``lid_lang``, ``lid_conf`` with the romanized result. Needs ``romanized`` and ``english_ratio``."""
    indian = lambda c: d.among(c, L.ENSEMBLE_INDIAN)
    cases = [
        ("model_conf > 0.90e0", "model_lang", "model_conf", "glotlid_preferred_high_confidence"),
        ("rom_lang IS NULL OR rom_conf <= 0", "model_lang", "model_conf", "glotlid_only"),
        ("is_english AND english_conf > 0.7e0", "'eng'", "english_conf", "english_validated_override_romanized"),
        ("letters_latin <= 60", "model_lang", "model_conf", "glotlid_preferred_low_latin"),
        ("abs(model_conf - rom_conf) > 0.30e0 AND model_conf > rom_conf", "model_lang", "model_conf", "glotlid_preferred_conf_gap"),
        ("abs(model_conf - rom_conf) > 0.30e0", "rom_lang", "rom_conf", "romanized_preferred_conf_gap"),
        (f"rom_conf > model_conf AND {indian('rom_lang')}", "rom_lang", "fused", "ensemble_weighted_romanized"),
        (f"{indian('model_lang')} AND NOT {indian('rom_lang')}", "model_lang", "fused", "ensemble_weighted_glotlid"),
        ("model_conf >= rom_conf", "model_lang", "fused", "ensemble_weighted_glotlid"),
    ]
    pick = lambda i, rest: "CASE ens_case " + " ".join(f"WHEN {k} THEN {c[i]}" for k, c in enumerate(cases)) + f" ELSE {rest} END"
    override = "is_english AND english_conf > 0.7e0 AND lid_lang <> 'eng'"
    weight = "CASE WHEN letters_latin > 80 THEN 0.5e0 WHEN letters_latin > 70 THEN 0.55e0 ELSE 0.6e0 END"
    return [
        {"model_lang": f"CASE WHEN {override} THEN 'eng' ELSE lid_lang END", "model_conf": f"CASE WHEN {override} THEN english_conf ELSE lid_conf END", "n_letters": d.count_in("text", "\\p{L}")},
        {"letters_latin": f"CASE WHEN n_letters > 0 THEN {d.double(d.count_in('text', L.LATIN))} / n_letters * 100e0 ELSE 0e0 END"},
        {"fused": f"model_conf * ({weight}) + rom_conf * (1e0 - {weight})"},
        {"ens_case": "CASE " + " ".join(f"WHEN {c[0]} THEN {i}" for i, c in enumerate(cases)) + " ELSE -1 END"},
        {"final_language": pick(1, "rom_lang"), "final_confidence": pick(2, "fused"), "ensemble_method": "CASE ens_case " + " ".join(f"WHEN {k} THEN '{c[3]}'" for k, c in enumerate(cases)) + " ELSE 'ensemble_weighted_romanized' END"},
    ]
