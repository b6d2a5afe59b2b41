"""All queries over the driver's tables by name, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import flow
from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import SPARK, Dialect
from scriptorium.operators import convert, entities, indic, language, models, ngrams, pandas_text, phonetics, safety, scripts, text, validation
from scriptorium.plans import analysis, learning

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The driver's tables have no text in scripts of India, so the documents stand in, all of them and whole: their Latin letters are turned
#: into Devanagari ones (with signs, halants and letters with a nukta among them) and moved to the script of a language that follows from the id.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ाबचदेफ़गहिजकलमनोपक़रसतुवं्यज़".replace("फ़", "\u095e").replace("क़", "\u0958").replace("ज़", "\u095b"))
INDIC_LANGS = ("hi", "mr", "bn", "as", "pa", "gu", "or", "ta", "te", "kn", "ml")


def _by_lang(d: Dialect, of: Callable[[str], str], langs: Sequence[str] = INDIC_LANGS) -> str:
    return "CASE lang " + " ".join(f"WHEN '{x}' THEN {of(x)}" for x in langs) + " END"


def _as_indic(d: Dialect) -> list[dict[str, str]]:
    return [
        {"deva": f"translate(lower(latin), {d.text(LETTERS[0])}, {d.text(LETTERS[1])})", "lang": "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(INDIC_LANGS)) + " END"},
        {"text": _by_lang(d, lambda x: scripts.moved(d, "hi", x, "deva"))},
    ]


_INDIC_SQL = f"({flow.sql('(SELECT doc_id, text AS latin FROM documents)', _as_indic, ['doc_id', 'text', 'lang'])})"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def indic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.apply(_read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("latin")), _as_indic, ["doc_id", "text", "lang"])


def _row_query(name: str, steps: flow.Steps, keep: Sequence[str], table: str = "documents", columns: Sequence[str] = ("doc_id", "text")) -> None:
    """A query whose rows are a table's rows."""
    QUERIES[name] = lambda spark, sf_dir: flow.apply(_read(spark, sf_dir, table).select(*columns), steps, keep)
    ORACLES[name] = flow.sql(table, steps, keep)


def _sum_query(name: str, steps: flow.Steps, table: str, columns: Sequence[str], query: str) -> None:
    """A query that runs SQL, spelt alike in both dialects, over the rows that ``steps`` give; ``{src}`` names them."""
    QUERIES[name] = lambda spark, sf_dir: spark.sql(query, src=flow.apply(_read(spark, sf_dir, table).select(*columns), steps))
    ORACLES[name] = query.replace("{src}", f"({flow.sql(table, steps, ['*'])})")


def _chain(*parts: flow.Steps) -> flow.Steps:
    return lambda d: [s for p in parts for s in p(d)]


def _one(**columns: Callable[[Dialect], str]) -> flow.Steps:
    return lambda d: [{n: f(d) for n, f in columns.items()}]


# ---- script, cleaning, hashes

_sum_query(
    "text_composition", text.composition, "documents", ["doc_id", "text", "lang"],
    "SELECT lang, dominant_script, count(*) AS docs, round(avg(indic_percentage), 6) AS indic, round(avg(latin_percentage), 6) AS latin, "
    "round(avg(numeric_percentage), 6) AS digits, round(avg(punctuation_percentage), 6) AS punctuation, round(avg(other_percentage), 6) AS other "
    "FROM {src} GROUP BY lang, dominant_script",
)
_row_query("script_detect", _chain(text.composition, text.script), ["doc_id", "script_lang", "dominant_script", "has_both_scripts", "indic_percentage", "latin_percentage"])
_row_query("text_stats", text.statistics, ["doc_id", "text_length", "word_count"])
_row_query("text_validation", text.validity, ["doc_id", "is_valid", "problem"])
_row_query(
    "validate_rows",
    lambda d: [validation.checked([*validation.request(d), *validation.language_code(d, "lang"), *validation.choice(d, "lang", ("en", "de", "fr")), *validation.number("n_chars", 1, 4000)])],
    ["doc_id", "problem"], columns=("doc_id", "text", "lang", "n_chars"),
)
_row_query("validate_props", lambda d: [validation.checked(validation.keys(d, "props", ["page", "ref"]))], ["event_id", "problem"], "events", ["event_id", "props"])


def validation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of at most 5,000 characters in a supported language are good; the others go to a table of their own."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rules = [*validation.request(SPARK), *validation.choice(SPARK, "lang", ("en", "de"))]
    good, bad = validation.split_rejects(docs, rules)
    return good.select("doc_id", F.lit(None).cast("string").alias("problem")).union(bad.select("doc_id", "problem"))


QUERIES["validation_rejects"] = validation_rejects
ORACLES["validation_rejects"] = "SELECT doc_id, CASE WHEN text IS NULL THEN 'text_missing' WHEN length(text) = 0 THEN 'text_short' WHEN length(text) > 5000 THEN 'text_long' WHEN lang IS NULL OR lang NOT IN ('en', 'de') THEN 'lang_choice' END AS problem FROM documents"
_row_query("clean_text", text.cleaned, ["doc_id", "clean"])
_row_query("clean_text_aggressive", lambda d: text.cleaned(d, "aggressive"), ["doc_id", "clean"])
_row_query("clean_text_minimal", lambda d: text.cleaned(d, "minimal"), ["doc_id", "clean"])
_row_query("contractions", _one(expanded=text.contractions), ["doc_id", "expanded"])
_row_query("ordinals", _one(expanded=text.ordinals), ["doc_id", "expanded"])
_row_query("normalize_slang", text.normalized, ["doc_id", "normalized"])
_row_query("normalize_slang_case", lambda d: text.normalized(d, keep_case=True), ["doc_id", "normalized"])
_row_query("model_text", _one(line=text.one_line), ["doc_id", "line"])
_row_query("json_key", _one(analysis_key=lambda d: text.key(d, "analysis:", "lang", "source", "text")), ["doc_id", "analysis_key"], columns=("doc_id", "text", "lang", "source"))
for _level in text.LEVELS:
    # the documents are in one Unicode form already; runs of any character have no pattern in RE2, so those of each Latin one are replaced one by one
    QUERIES[f"normalize_{_level}"] = (lambda level: lambda spark, sf_dir: pandas_text.normalized(_read(spark, sf_dir, "documents").select("doc_id", "text"), level).drop("text"))(_level)


def _less_repeats(column: str) -> str:
    for c in map(chr, (*range(32, 127), *range(0xA1, 0x180))):
        column = f"regexp_replace({column}, '\\x{{{ord(c):x}}}{{3,}}', '{c * 2 if c not in (chr(92), chr(39)) else c * 4}', 'g')"
    return column


for _level, _on in text.LEVELS.items():
    _source = f"(SELECT doc_id, {_less_repeats('text') if _on['repeats'] else 'text'} AS text FROM documents)"
    ORACLES[f"normalize_{_level}"] = flow.sql(_source, (lambda on: lambda d: text.normalized(d, on["slang"], on["contract"], on["numbers"], on["blanks"]))(_on), ["doc_id", "normalized"])
QUERIES["preprocess_levels"] = lambda spark, sf_dir: pandas_text.preprocessed(_read(spark, sf_dir, "documents").select("doc_id", "text"), "light").drop("text")
ORACLES["preprocess_levels"] = flow.sql(
    flow.sql("documents", lambda d: text.normalized(d, False, False, False, True), ["doc_id", "normalized AS text"]).join("()"), text.cleaned, ["doc_id", "clean"]
)
_row_query("text_hash", text.hashes, ["doc_id", "text_hash", "analysis_key"])
_row_query("text_signature", text.signature, ["doc_id", "signature"])
_row_query("length_bucket", text.length_bucket, ["doc_id", "threshold"])

# ---- language

_row_query("lang_code_normalize", lambda d: language.code(d), ["doc_id", "code"], columns=("doc_id", "text", "lang"))
_row_query("lang_display_name", lambda d: [*language.code(d, suffixes=False), *language.display_name(d)], ["doc_id", "code", "language_name"], columns=("doc_id", "text", "lang"))


def _scores(d: Dialect) -> list[dict[str, str]]:
    return [*language.romanized_scores(d), {f"n_{k}": d.long(f"m_{k}") for k in ("mar", "hin", "tam", "generic")}]


_row_query("romanized_scores", _scores, ["doc_id", "n_mar", "n_hin", "n_tam", "n_generic", "s_mar", "s_hin", "s_tam"])
_row_query("romanized_detect", language.romanized, ["doc_id", "rom_lang", "rom_conf"])
_row_query("codemix_detect", language.signals, ["doc_id", "is_code_mixed", "mix_method", "mix_primary", "mix_conf", "r_indic", "r_english"])
_row_query("english_ratio", language.english_ratio, ["doc_id", "english_ratio", "is_english", "english_conf"])
_row_query("detect_language_rules", lambda d: [*language.signals(d), *language.detect(d, ngram=False)], ["doc_id", "language", "method", "confidence"])


_row_query("lang_shown_name", lambda d: [{"mixed": "concat(lang, CASE doc_id % 4 WHEN 0 THEN '_mixed' WHEN 1 THEN '_eng_mixed' WHEN 2 THEN '_romanized' ELSE '' END)"}, *language.shown_name(d, "mixed")], ["doc_id", "shown_name"], columns=("doc_id", "text", "lang"))


def _lid(d: Dialect) -> list[dict[str, str]]:
    """A model's results, as the ensemble takes them: here the table's own language with a made-up confidence."""
    names = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa"}
    steps = [{"lid_lang": d.lookup("lang", names, "'hin'"), "lid_conf": f"{d.double('doc_id % 100')} / 100e0"}]
    return [*steps, *language.romanized(d), *language.english_ratio(d), *language.ensemble(d)]


_row_query("ensemble_ladder", _lid, ["doc_id", "final_language", "final_confidence", "ensemble_method"], columns=("doc_id", "text", "lang"))

_row_query("romanized_boost", lambda d: [*_lid(d), *language.boosted(d)], ["doc_id", "boosted_language", "boosted_confidence", "boosted_method", "hint_lang", "hint_conf"], columns=("doc_id", "text", "lang"))
_row_query(
    "detect_language_model",
    lambda d: [*language.signals(d), *_lid(d)[:1], *language.english_ratio(d), *language.ensemble(d), {"lid_mixed": "lid_conf < 0.7e0"}, *language.detect_with_model(d)],
    ["doc_id", "language", "method", "confidence"], columns=("doc_id", "text", "lang"),
)


def romanized_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("itrans_share", phonetics.indic_share(F.col("text")))
    return flow.apply(docs, lambda d: [*language.romanized(d), *language.enhanced(d)], ["doc_id", "enh_lang", "enh_conf"])


QUERIES["romanized_enhanced"] = romanized_enhanced
QUERIES["ngram_profile"] = lambda spark, sf_dir: ngrams.profile_table(spark).select("lang", "ngram", F.round("freq", 12).alias("freq"))
ORACLES["ngram_profile"] = f"SELECT lang, ngram, round(freq, 12) AS freq FROM {ngrams.profile_sql()}"


def ngram_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.extract(_read(spark, sf_dir, "documents")).groupBy("ngram").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


QUERIES["ngram_extract"] = ngram_extract
ORACLES["ngram_extract"] = f"SELECT ngram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {ngrams.extract_sql()} GROUP BY ngram"
QUERIES["ngram_train"] = lambda spark, sf_dir: ngrams.trained(_read(spark, sf_dir, "documents").where("lang IS NOT NULL"), "lang").withColumn("freq", F.round("freq", 12))
ORACLES["ngram_train"] = (
    f"SELECT lang, ngram, round(cast(count(*) AS double) / sum(count(*)) OVER (PARTITION BY lang), 12) AS freq FROM {ngrams.extract_sql()} JOIN (SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL) USING (doc_id) GROUP BY lang, ngram"
)
QUERIES["ngram_top3"] = lambda spark, sf_dir: ngrams.predict_top(_read(spark, sf_dir, "documents"), 3)
ORACLES["ngram_top3"] = ngrams.predict_top_sql(3)
QUERIES["ngram_predict"] = lambda spark, sf_dir: ngrams.predict(_read(spark, sf_dir, "documents"))
ORACLES["ngram_predict"] = ngrams.predict_sql()


def detect_language_nomodel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    joined = docs.join(ngrams.predict(docs), "doc_id", "left")
    return flow.apply(joined, lambda d: [*language.signals(d), *language.detect(d)], ["doc_id", "language", "method", "confidence"])


QUERIES["detect_language_nomodel"] = detect_language_nomodel
ORACLES["detect_language_nomodel"] = flow.sql(
    f"(SELECT d.doc_id, d.text, g.ng_lang, g.ng_conf FROM documents d LEFT JOIN ({ngrams.predict_sql()}) g ON g.doc_id = d.doc_id)",
    lambda d: [*language.signals(d), *language.detect(d)], ["doc_id", "language", "method", "confidence"],
)

# ---- profanity, entities

_row_query("profanity_detect", safety.profanity, ["doc_id", "has_profanity", "severity_score", "max_severity", "detected_words", "profane_words"])
_row_query("profanity_stats", safety.profanity_statistics, ["doc_id", "total_words", "profane_words", "profanity_percentage", "is_safe"])
_row_query("profanity_mask", safety.masked, ["doc_id", "masked"])
_row_query("profanity_remove", lambda d: safety.removed(d, by="[x]"), ["doc_id", "removed"])
_row_query("profanity_safe", lambda d: [*safety.profanity(d), {f"safe_{k}": safety.is_safe(k) for k in safety.LEVELS}], ["doc_id", *(f"safe_{k}" for k in safety.LEVELS)])
_row_query("financial_entities", entities.financial, ["doc_id", "currencies", "amounts", "units_of_amounts", "percentages", "tickers", "terms", "is_financial"])
_row_query("temporal_entities", entities.temporal, ["doc_id", "dates", "times", "relative_dates", "months", "days", "is_temporal"])
_row_query("technical_entities", entities.technical, ["doc_id", "functions", "scientific_numbers", "measures", "keywords", "domains", "is_technical"])
_sum_query(
    "domain_flags", _chain(entities.financial, entities.temporal, entities.technical), "documents", ["doc_id", "text", "lang"],
    "SELECT lang, is_financial, is_temporal, is_technical, count(*) AS docs FROM {src} GROUP BY lang, is_financial, is_temporal, is_technical",
)
_row_query("date_mark", _one(marked=entities.marked_dates), ["doc_id", "marked"])
_row_query("code_mark", _one(marked=entities.marked_code), ["doc_id", "marked"])
_row_query("currency_remove", _one(removed=entities.without_amounts), ["doc_id", "removed"])

_row_query("currency_expand", entities.expanded_amounts, ["doc_id", "expanded"])
_row_query("domain_text_marked", lambda d: entities.processed(d, "expand", "normalize", "placeholder"), ["doc_id", "processed"])
_row_query("domain_text_removed", lambda d: entities.processed(d, "remove", "remove", "remove"), ["doc_id", "processed"])

# ---- conversion, translation

_row_query("token_convert", convert.converted, ["doc_id", "converted_text"])
_row_query("conversion_stats", convert.converted, ["doc_id", "total_tokens", "converted_tokens", "preserved_tokens", "failed_tokens", "conversion_rate", "conversion_method"])
QUERIES["convert_marathi"] = lambda spark, sf_dir: convert.to_native(_read(spark, sf_dir, "documents").select("doc_id", "text"), "mar").select("doc_id", "converted_text", "conversion_method", "converted_tokens")
_TARGETS = ("en", "hi", "fr")


def translate_targets_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text for each of a list of targets, by a glossary of a few words in place of a translator."""
    out = models.translations(_read(spark, sf_dir, "documents").select("doc_id", "text"), _TARGETS, models.glossary_translator)
    return out.select("doc_id", "target_language", "success", F.md5("translated_text").alias("translated_md5"))


def _translated_sql() -> str:
    words = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
    known = "CASE w WHEN 'the' THEN 'le' WHEN 'river' THEN 'fleuve' WHEN 'and' THEN 'et' WHEN 'is' THEN 'est' WHEN 'of' THEN 'de' ELSE w END"
    targets = ", ".join(f"('{t}')" for t in _TARGETS)
    return f"SELECT doc_id, t AS target_language, true AS success, md5(array_to_string(list_transform({words}, lambda w: {known}), ' ')) AS translated_md5 FROM documents CROSS JOIN (VALUES {targets}) v(t)"


QUERIES["translate_targets_cross"] = translate_targets_cross
ORACLES["translate_targets_cross"] = _translated_sql()
QUERIES["translatable_languages"] = lambda spark, sf_dir: models.supported_languages(spark)
ORACLES["translatable_languages"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in models.TRANSLATOR_CODES.items()) + ") v(code, translator_code)"

# ---- scripts of India


def _indic_query(name: str, steps: flow.Steps, keep: Sequence[str]) -> None:
    QUERIES[name] = lambda spark, sf_dir: flow.apply(indic_documents(spark, sf_dir), steps, keep)
    ORACLES[name] = flow.sql(_INDIC_SQL, steps, keep)


_indic_query("indic_tokenize", indic.tokenized, ["doc_id", "tokens"])
_indic_query("indic_normalize", lambda d: [{"normalized": _by_lang(d, lambda x: scripts.normalized(d, x))}], ["doc_id", "normalized"])
_indic_query("indic_normalize_nasals", lambda d: [{f"nasals_{m}": scripts.normalized(d, "hi", nasals_mode=m, drop_nuktas=True) for m in ("strict", "relaxed", "consonants")}], ["doc_id", "nasals_strict", "nasals_relaxed", "nasals_consonants"])
_indic_query("indic_vowel_endings", lambda d: [{"ended": _by_lang(d, lambda x: scripts.normalized(d, x, chandras=True, endings=True))}], ["doc_id", "ended"])
for _kind in ("naive", "basic", "aggressive"):
    _indic_query(f"indic_unify_{_kind}", (lambda kind: lambda d: [{"unified": _by_lang(d, lambda x: scripts.unified(d, x, "kn", kind=kind))}])(_kind), ["doc_id", "unified"])
_indic_query("indic_char_stats", lambda d: [scripts.counts(d, "hi")], ["doc_id", *scripts.counts(SPARK, "hi")])
_indic_query("indic_composition", _chain(text.composition, text.script), ["doc_id", "script_lang", "dominant_script", "indic_percentage", "latin_percentage"])
_indic_query("indic_detect", lambda d: [*language.signals(d), *language.detect(d, ngram=False)], ["doc_id", "language", "method", "confidence"])
_indic_query("indic_codemix", language.signals, ["doc_id", "is_code_mixed", "mix_method", "mix_primary", "mix_conf"])
_TO = ("bn", "kn", "ta", "te", "gu", "ml", "or", "pa", "si")
_indic_query("script_transliterate", lambda d: [{f"to_{t}": _by_lang(d, lambda x: scripts.moved(d, x, t)) for t in _TO}], ["doc_id", *(f"to_{t}" for t in _TO)])
_indic_query("sinhala_round_trip", lambda d: [{"there": scripts.moved(d, "hi", "si")}, {"back": scripts.moved(d, "si", "hi", "there")}], ["doc_id", "there", "back"])
_indic_query("moses_repair", lambda d: [{"spaced": f"replace(text, {d.text(chr(0x94D))}, {d.text(' ' + chr(0x94D) + ' ')})"}, {"repaired": scripts.rejoined(d, "hi", "spaced")}], ["doc_id", "repaired"])
_indic_query("char_classes", lambda d: [{"c": "substr(text, 1, 1)"}, {f"is_{k}": scripts.is_class(d, k, "hi") for k in scripts.CLASSES}], ["doc_id", *(f"is_{k}" for k in scripts.CLASSES)])
_row_query("acronym_transliterate", lambda d: [{"short": "substr(text, 1, 12)"}, {f"in_{x}": scripts.acronym(d, x, "short") for x in ("hi", "ta", "kn")}], ["doc_id", "in_hi", "in_ta", "in_kn"])
_row_query("urdu_tokenize", lambda d: indic.tokenized(d, lang="ur"), ["doc_id", "tokens"])
_row_query("document_detokenize", lambda d: [*indic.tokenized(d), {"joined_tokens": d.join("tokens", " ")}, *indic.detokenized_rules(d, "joined_tokens")], ["doc_id", "detokenized"])
_row_query("document_tokenize", indic.tokenized, ["doc_id", "tokens"])
QUERIES["sentence_split"] = lambda spark, sf_dir: _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(indic.sentences(F.col("text"), "en")).alias("pos", "sentence"))
for _kind in ("plain", "simple", "improved"):
    QUERIES["syllabify" + ("" if _kind == "plain" else f"_{_kind}")] = (lambda kind: lambda spark, sf_dir: indic_documents(spark, sf_dir).where("lang IN ('hi', 'mr')").select("doc_id", phonetics.syllables(F.col("text"), "hi", kind).alias("syllables")))(_kind)
QUERIES["itrans_round_trip"] = lambda spark, sf_dir: indic_documents(spark, sf_dir).where("lang = 'hi'").select("doc_id", phonetics.itrans(F.col("text"), "hi", back=True).alias("itrans")).withColumn("native", phonetics.itrans(F.col("itrans"), "hi"))
QUERIES["morphs"] = lambda spark, sf_dir: _read(spark, sf_dir, "documents").select("doc_id", phonetics.morphs(F.col("text")).alias("morphs"))
ORACLES["morphs"] = "SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS morphs FROM documents"
QUERIES["phonetic_sim_matrix"] = lambda spark, sf_dir: phonetics.similarity_matrix(spark).select("o", "o2", F.round("similarity", 9).alias("similarity"), F.round("share", 9).alias("share"))
ORACLES["phonetic_sim_matrix"] = phonetics.matrix_sql()
QUERIES["phonetic_similarities"] = lambda spark, sf_dir: _similarities(spark)


def _similarities(spark: SparkSession) -> DataFrame:
    out = None
    for name in phonetics.SIMILARITIES:
        one = phonetics.similarity_matrix(spark, name, "hi", "ta").withColumn("measure", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_sum_query(
    "wc", lambda d: [{"lines_": d.size(d.find_all("text", "\n")), "words_": d.size(d.words("text"))}], "documents", ["doc_id", "text"],
    "SELECT cast(sum(lines_) AS bigint) AS lines, cast(sum(words_) AS bigint) AS words, cast(sum(length(text)) AS bigint) AS chars FROM {src}",
)

# ---- learning: logs, caches, limits

for _name, (_table, _columns, _steps, _query) in learning.LOG_QUERIES.items():
    _sum_query(_name, _steps, _table, _columns, _query)


def pattern_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.cache_replay(flow.apply(_read(spark, sf_dir, "documents").select("doc_id", "text"), learning.observed))


QUERIES["cache_hits_simulated"] = pattern_cache_replay
ORACLES["cache_hits_simulated"] = learning.cache_replay_sql()


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.apply(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), learning.observed)


QUERIES["failure_patterns"] = lambda spark, sf_dir: learning.failure_patterns(_observed(spark, sf_dir))
ORACLES["failure_patterns"] = learning.failure_patterns_sql()
QUERIES["failure_recommendations"] = lambda spark, sf_dir: learning.recommendations(_observed(spark, sf_dir))
ORACLES["failure_recommendations"] = learning.recommendations_sql()


def request_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = flow.apply(_read(spark, sf_dir, "documents").select("doc_id", "text"), text.hashes, ["doc_id", "text_hash"])
    return learning.occurrences(hashed)


QUERIES["request_occurrences"] = request_occurrences
ORACLES["request_occurrences"] = (
    "SELECT doc_id, text_hash, cast(row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) AS integer) AS occurrence, doc_id = max(doc_id) OVER (PARTITION BY text_hash) AS is_latest "
    f"FROM ({flow.sql('documents', text.hashes, ['doc_id', 'text_hash'])})"
)

# ---- the whole analysis


def _analysis(d: Dialect) -> list[dict[str, str]]:
    return [
        *language.signals(d), *language.detect(d, ngram=False), *safety.profanity(d), *entities.financial(d), *entities.temporal(d), *entities.technical(d), *text.cleaned(d),
        *language.display_name(d, "split_part(language, '_', 1)"),
        {"sentiment_label": "'unknown'", "sentiment_confidence": "0e0", "max_toxicity": "0e0"},
    ]


_COMPACT = ["doc_id", "language", "language_name", "confidence", "method", "is_code_mixed", "has_profanity", "max_severity", "is_financial", "is_temporal", "is_technical", "clean", "sentiment_label", "sentiment_confidence", "max_toxicity"]
_row_query("analyze_compact", _analysis, _COMPACT)
_row_query("analyze_conversations", _analysis, ["conv_id", "turn", "language", "method", "has_profanity", "max_severity"], "conversations", ["conv_id", "turn", "text"])
_sum_query(
    "batch_summary", _analysis, "documents", ["doc_id", "text"],
    "SELECT language, method, count(*) AS docs, cast(count_if(has_profanity) AS bigint) AS profane, cast(count_if(is_code_mixed) AS bigint) AS mixed FROM {src} GROUP BY language, method",
)
_GOOD, _BAD = (", ".join(f"'{w}'" for w in words) for words in (models.GOOD, models.BAD))
_SCORED = f"SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM documents"


def sentiment_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentiment hook with a scorer that counts words."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", models.sentiment(F.col("text"), models.lexicon_sentiment).alias("s"))
    return docs.select("doc_id", "s.label", F.round("s.confidence", 9).alias("confidence"))


def toxicity_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity hook with a scorer that counts words."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", models.toxicity(F.col("text"), models.lexicon_toxicity).alias("t"))
    return docs.select("doc_id", F.round("t.toxic", 9).alias("toxic"), F.round("t.obscene", 9).alias("obscene"), F.round("t.insult", 9).alias("insult"))


def _level_sql(level: str) -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in L.profane()[level])
    return f"cast(len(list_filter(ws, lambda w: w IN ({words}))) AS double) / greatest(1, len(ws))"


QUERIES["sentiment_scored"], QUERIES["toxicity_scored"] = sentiment_scored, toxicity_scored
ORACLES["sentiment_scored"] = (
    "SELECT doc_id, CASE WHEN g > b THEN 'positive' WHEN b > g THEN 'negative' ELSE 'neutral' END AS label, round(CASE WHEN g + b > 0 THEN cast(greatest(g, b) AS double) / (g + b) ELSE 0e0 END, 9) AS confidence "
    f"FROM (SELECT doc_id, len(list_filter(ws, lambda w: w IN ({_GOOD}))) AS g, len(list_filter(ws, lambda w: w IN ({_BAD}))) AS b FROM ({_SCORED}))"
)
ORACLES["toxicity_scored"] = f"SELECT doc_id, round({_level_sql('extreme')} + {_level_sql('moderate')} + {_level_sql('mild')}, 9) AS toxic, round({_level_sql('extreme')}, 9) AS obscene, round({_level_sql('moderate')}, 9) AS insult FROM ({_SCORED})"


def analyze_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis: n-grams, all rules, and both model hooks with their counting scorers."""
    out = analysis.analyze(_read(spark, sf_dir, "documents"), sentiment=models.lexicon_sentiment, toxicity=models.lexicon_toxicity)
    return out.select(*(c for c in out.columns if c not in ("sentiment", "toxicity", "max_toxicity", "text")), F.col("sentiment.label").alias("label"), F.round(F.when(F.col("clean").isNotNull(), F.col("max_toxicity")), 9).alias("max_toxicity"))


QUERIES["analyze_whole"] = analyze_whole
_ANALYZED = flow.sql(
    f"(SELECT d.doc_id, d.text, g.ng_lang, g.ng_conf FROM documents d LEFT JOIN ({ngrams.predict_sql()}) g ON g.doc_id = d.doc_id)", analysis.rules, [*analysis.COMPACT]
)
_WORDS = "list_filter(string_split_regex(lower(clean), '\\s+'), lambda w: w <> '')"
ORACLES["analyze_whole"] = (
    f"SELECT * EXCLUDE (text, ws), CASE WHEN len(list_filter(ws, lambda w: w IN ({_GOOD}))) > len(list_filter(ws, lambda w: w IN ({_BAD}))) THEN 'positive' "
    f"WHEN len(list_filter(ws, lambda w: w IN ({_GOOD}))) < len(list_filter(ws, lambda w: w IN ({_BAD}))) THEN 'negative' ELSE 'neutral' END AS label, "
    f"round({_level_sql('extreme')} + {_level_sql('moderate')} + {_level_sql('mild')}, 9) AS max_toxicity FROM (SELECT *, {_WORDS} AS ws FROM ({_ANALYZED}))"
)
