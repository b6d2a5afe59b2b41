"""Rules against stated goldens, and against Python restatements of documented behaviour."""

import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import flow
from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import SPARK
from scriptorium.operators import convert, entities, indic, language, models, ngrams, pandas_text, phonetics, safety, scripts, text, validation
from scriptorium.operators.settings import Detection
from scriptorium.plans import analysis, learning, monitor
from scriptorium.sources import readers
from scriptorium.streaming import state


def rows_of(spark, texts, steps, keep):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return flow.apply(df, steps, ["doc_id", *keep]).orderBy("doc_id").collect()


def test_romanized_goldens(spark):
    cases = {
        "aaj mala late hoeil thik ahe": ("mar", 0.9), "tu kashala jatos mi yenar": ("mar", 0.9), "main bahut achha hoon yaar": ("tam", 0.5), "naan ippo varen pathukaren": ("tam", 0.95),
        "mi ghari hotay zala hota": ("mar", 0.9), "mi khup khush ahe": ("mar", 0.9), "aaj traffic bahut hai": ("hin", 0.8), "The quick brown fox": None, "Good morning everyone": None,
        "Yaar ye movie bahut mast hai! Must watch bro, ekdum zabardast!": ("hin", 0.8454545),
    }
    got = rows_of(spark, list(cases), language.romanized, ["rom_lang", "rom_conf"])
    for (name, expected), r in zip(cases.items(), got):
        if expected is None:
            assert r["rom_lang"] is None or r["rom_conf"] < 0.5
        else:
            assert (r["rom_lang"], round(r["rom_conf"], 7)) == expected, name


def test_short_and_indic_texts(spark):
    texts = ["", "   ", None, "Hi", "नमस्ते", "hello yo", "मेरा नाम राम है और यह लंबा है", "x" * 4 + "।"]
    got = rows_of(spark, texts, lambda d: [*language.signals(d), *language.detect(d, ngram=False)], ["language", "method", "confidence"])
    assert [r["method"] for r in got[:2]] == ["empty_text"] * 2
    assert got[3]["method"] == "very_short_text_insufficient_data"
    assert (got[4]["language"], got[4]["method"]) == ("hi", "script_analysis_short_text")
    assert got[5]["method"] == "latin_fallback_short_text" and got[6]["method"] == "script_analysis" and got[6]["language"] == "hi"


def test_text_goldens(spark):
    steps = lambda d: [{"c": text.contractions(d), "o": text.ordinals(d)}]
    got = rows_of(spark, ["can't won't it's", "1st 2nd 11th"], steps, ["c", "o"])
    assert got[0]["c"] == "ca not wo not it is" and got[1]["o"] == "first second 11th"
    df = spark.createDataFrame([("hellooooo worlddddd!!!",), ("ﬁne ①",), ("a\n\n\nb",)], "t string")
    out = df.select(pandas_text.fewer_repeats(F.col("t")).alias("r"), pandas_text.unicode_form(F.col("t")).alias("u")).collect()
    assert out[0]["r"] == "helloo worldd!!" and out[1]["u"] == "fine 1" and out[2]["r"] == "a\n\n\nb"
    slang = rows_of(spark, ["tbh idk what's happening rn smh"], text.normalized, ["normalized"])
    assert slang[0]["normalized"] == "to be honest i dont know what is happening right now shaking my head"
    clean = rows_of(spark, ["Hey @you see #Spark at https://x.org/a &amp; a@b.com  now"], text.cleaned, ["clean"])
    assert clean[0]["clean"] == "hey see spark at a.com now"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=20, max_size=60))
def test_percentages_sum_to_100_and_masks_keep_length(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    keep = ["n_all", "indic_percentage", "latin_percentage", "numeric_percentage", "punctuation_percentage", "other_percentage", "masked"]
    for t, r in zip(texts, rows_of(spark, texts, lambda d: [*text.composition(d), *safety.masked(d)], keep)):
        total = sum(r[k] for k in keep[1:6])
        assert r["n_all"] == len(t) and abs(total - (100 if t else 0)) < 1e-6
        assert len(r["masked"]) == len(t)


def test_signature_is_the_documented_one(spark):
    import hashlib

    for t, r in zip(["Hello there big World", "नमस्ते दुनिया", "hi नम"], rows_of(spark, ["Hello there big World", "नमस्ते दुनिया", "hi नम"], text.signature, ["signature"])):
        low = t.lower().strip()
        kind = "mixed" if any("a" <= c <= "z" for c in low) and "ा" <= max(low) else "latin" if low.isascii() else "indic"
        kind = "mixed" if t.startswith("hi ") else kind
        assert r["signature"] == f"{'short' if len(low) < 20 else 'medium'}_{len(low.split())}_{kind}_{hashlib.md5(' '.join(low.split()[:3]).encode()).hexdigest()[:8]}"


def test_entities(spark):
    texts = [
        "Apple stock rose 5% to $150.25, with market cap reaching $2.5T. The company reported Q3 earnings of ₹1,250 crore.",
        "Meeting scheduled for 2024-11-15 at 14:30. The project deadline is next Friday.",
        "The algorithm processes data at 1.5e6 ops/sec. Use function calculate_mean() with array of 1000 values.",
        "$50 today", "at 2:30 PM and 14:30:00",
    ]
    steps = lambda d: [*entities.financial(d), *entities.temporal(d), *entities.technical(d)]
    got = rows_of(spark, texts, steps, ["currencies", "amounts", "units_of_amounts", "percentages", "dates", "times", "relative_dates", "functions", "scientific_numbers", "is_financial", "is_technical"])
    assert got[0]["currencies"] == ["INR", "USD", "USD"] and got[0]["units_of_amounts"] == ["T", "crore"] and got[0]["percentages"] == ["5%"] and got[0]["is_financial"]
    assert got[1]["dates"] == ["iso:2024-11-15"] and got[1]["times"] == ["24h:14:30"] and got[1]["relative_dates"] == ["next friday"]
    assert "calculate_mean()" in got[2]["functions"] and got[2]["scientific_numbers"] == ["1.5e6"] and got[2]["is_technical"]
    assert got[3]["amounts"] == ["50"] and got[3]["units_of_amounts"] == []
    assert got[4]["times"] == ["12h:2:30 PM", "24h:14:30:00", "24h:2:30"]


def test_profanity_with_a_neutral_lexicon(spark):
    lexicon = {"extreme": ["badwordx", "two worded", "m$ney", "x**y"], "moderate": ["roughy"], "mild": ["mildwordy"]}
    texts = ["a BadWordX and badwordx, mildwordy", "mildwordy only", "badwordxy", "", "so Two  worded, mSney and x**y xaay"]
    got = rows_of(spark, texts, lambda d: safety.profanity(d, lexicon), ["severity_score", "max_severity", "detected_words", "profane_words"])
    assert [(r["severity_score"], r["profane_words"]) for r in got] == [(3, 3), (1, 1), (0, 0), (0, 0), (3, 3)]
    assert got[0]["detected_words"] == ["BadWordX", "badwordx", "mildwordy"]
    gone = rows_of(spark, texts, lambda d: [*safety.removed(d, lexicon, "_"), *safety.masked(d, lexicon)], ["removed", "masked"])
    assert [r["removed"] for r in gone] == ["a _ and _, _", "_ only", "badwordxy", "", "so _, _ and _ xaay"]
    assert gone[0]["masked"] == "a B******X and b******x, m*******y"


def test_conversion(spark):
    got = rows_of(spark, ["aaj traffic bahut hai!", "", "(Kya) XYZ"], convert.converted, ["converted_text", "converted_tokens", "preserved_tokens", "conversion_method"])
    assert got[0]["converted_text"] == f"{L.HINDI['aaj']} {L.HINDI['traffic']} {L.HINDI['bahut']} {L.HINDI['hai']}!"
    assert got[1]["conversion_method"] == "none" and got[2]["converted_text"] == f"({L.HINDI['kya']}) XYZ"


def test_scripts_round_trip(spark):
    there = lambda d: [{"kn": indic.moved(d, "hi", "kn")}, {"back": indic.moved(d, "kn", "hi", "kn")}]
    texts = ["कंप्यूटर और संस्कृत।", "abc", ""]
    for t, r in zip(texts, rows_of(spark, texts, there, ["kn", "back"])):
        assert r["back"] == t
    ta = rows_of(spark, ["गज"], lambda d: [{"ta": indic.moved(d, "hi", "ta")}], ["ta"])
    assert ta[0]["ta"] == "கஜ"


def indic_rows(spark, texts, of):
    return [r["x"] for r in rows_of(spark, texts, lambda d: [{"x": of(d)}], ["x"])]


def test_normalizing_by_script(spark):
    norm = lambda lang, texts, **options: indic_rows(spark, texts, lambda d: scripts.normalized(d, lang, **options))
    assert norm("hi", ["क़लम|", "राम:", "a—b", "x\u200b\u200cy", "\u0972"]) == ["क\u093cलम।", "रामः", "a - b", "x y", "\u090f"]
    assert norm("hi", ["\u0958\u095e"], drop_nuktas=True) == ["कफ"]
    assert norm("pa", ["\u0a05\u0a3e|", "\u0a71\u0a15", "\u0a72 \u0a36:"]) == ["\u0a06।", "\u0a71\u0a15", "\u0a72 \u0a38\u0a3c:"[:-1] + "\u0a03"]
    assert norm("pa", ["\u0a71\u0a15 \u0a70 \u0a72"], loose=True) == ["\u0a15\u0a4d\u0a15 \u0a02 \u0a07"]
    assert norm("bn", ["\u09c7\u09be\u09f7", "\u09f0|"]) == ["\u09cb।", "\u09f0।"] and norm("as", ["\u09f0"], loose=True) == ["\u09b0"]
    assert norm("or", ["\u0b35\u0b47\u0b3e|", "\u0b7c\u0b71"], loose=True) == ["\u0b2c\u0b4b|", "।\u0b2c"]
    assert norm("ta", ["\u0bc6\u0bbe\u0be4"]) == ["\u0bca।"] and norm("te", ["\u0c46\u0c56"]) == ["\u0c48"] and norm("kn", ["\u0cc6\u0cc2\u0cd5"]) == ["\u0ccb"]
    assert norm("ml", ["\u0d28\u0d4d\u200d\u0d46\u0d57", "\u0d57"]) == ["\u0d7b\u0d4c", "\u0d4c"] and norm("ml", ["\u0d7b \u0d31\u0d4d\u0d31"], loose=True) == ["\u0d28\u0d4d \u0d1f\u0d4d\u0d1f"]
    assert norm("gu", ["\u0ae4 \u0a95:"]) == ["। \u0a95\u0a83"] and norm("xx", ["“a”"]) == ['"a"']
    assert norm("ur", ["كي،٤"]) == ["کی ، ۴"]


def test_nasals_endings_and_other_folds(spark):
    norm = lambda texts, lang="hi", **options: indic_rows(spark, texts, lambda d: scripts.normalized(d, lang, **options))
    assert norm(["गङ्गा", "सम्मान", "हिन्दी"], nasals_mode="strict") == ["गंगा", "सम्मान", "हिंदी"]
    assert norm(["सम्मान", "अन्य"], nasals_mode="relaxed") == ["संमान", "अंय"]
    assert norm(["गंगा", "हिंदी", "अंय"], nasals_mode="consonants") == ["गङ्गा", "हिन्दी", "अंय"]
    assert norm(["राम घर जा", "क क\n"], endings=True) == ["राम् घर् जा", "क् क\n"] and norm(["ರಾಮ"], "kn", endings=True) == ["ರಾಮಾ"]
    assert norm(["\u0901\u0945\u0911"], chandras=True) == ["\u0902\u0947\u0913"]


def test_scripts_to_one_and_names_of_letters(spark):
    unify = lambda lang, kind, texts: indic_rows(spark, texts, lambda d: scripts.unified(d, lang, "hi", kind=kind))
    assert unify("bn", "naive", ["\u0995\u09dc"]) == ["क\u095c"] and unify("bn", "basic", ["\u0995\u09dc"]) == ["क\u0921\u093c"] and unify("bn", "aggressive", ["\u0995\u09dc", "\u0995\u09ac"]) == ["क\u0921", "क\u092c\u094d"]
    assert indic_rows(spark, ["क ा", "කා"], lambda d: scripts.moved(d, "si", "hi")) == ["क ा", "का"]
    assert indic_rows(spark, ["का।"], lambda d: scripts.moved(d, "hi", "si")) == ["කා।"] and indic_rows(spark, ["का"], lambda d: scripts.moved(d, "hi", "zz")) == ["का"]
    assert indic_rows(spark, ["BBC"], lambda d: scripts.acronym(d, "hi")) == ["बीबीसी"]
    assert indic_rows(spark, ["क ् ष ़ x"], lambda d: scripts.rejoined(d, "hi")) == ["क्ष़x"]


def test_tokens_and_back(spark):
    texts = ["यह 10,000 रुपये 12/05/2020 को।", "10,000 on 3.14", "a  b\t\"c d\" it's 'x'", "5 , 6 x 7 : 8 : 9"]
    got = rows_of(spark, texts, indic.tokenized, ["tokens"])
    assert got[0]["tokens"] == ["यह", "10,000", "रुपये", "12/05/2020", "को", "।"]
    assert got[1]["tokens"] == ["10", ",", "000", "on", "3.14"]  # a number at the very beginning stays cut
    assert got[3]["tokens"] == ["5", ",", "6", "x", "7:8:9"]
    back = rows_of(spark, ['" a b " , ( c ) 5 . 5', "x 1 , 2 ' y '"], lambda d: indic.detokenized_rules(d), ["detokenized"])
    assert [r["detokenized"] for r in back] == ['"a b", (c) 5.5', "x 1,2 'y'"]
    assert rows_of(spark, ["a۔b"], lambda d: indic.tokenized(d, lang="ur"), ["tokens"])[0]["tokens"] == ["a", "۔", "b"]


def test_syllables():
    cut = phonetics.syllables_of
    assert cut("कमल") == ["क", "म", "ल"] and cut("भारत") == ["भा", "र", "त"] and cut("आई") == ["आ", "ई"] and cut("क-ख") == ["क", "-", "ख"]
    # an anusvara stays with the syllable before it unless a plosive follows, and no syllable ends behind it
    assert cut("संसार") == ["संसा", "र"] and cut("हिंदी") == ["हि", "ंदी"] and cut("संसार", simple=True) == ["स", "ंसा", "र"]
    assert cut("कमल", vocabulary={"क"}) == ["क", "म", "ल"] and cut("भारत", vocabulary={"र"}) == ["भ", "ा", "र", "त"]
    assert phonetics.improved_syllables_of("\u0d05\u0d35\u0d7b", "ml") == ["\u0d05", "\u0d35", "\u0d7b"] and phonetics.improved_syllables_of("ਪੱਕਾ", "pa") == ["ਪ", "ੱਕਾ"]
    assert phonetics.improved_syllables_of("कमल") == cut("कमल")


def test_sounds(spark):
    assert all(len(phonetics.vector(o)) == phonetics.LENGTH for o in range(0x70)) and sum(phonetics.vector(0x64)) == 0
    assert phonetics.properties(0x18)["voicing"] == "voiced" and phonetics.properties(0x18)["aspiration"] == "aspirated" and phonetics.properties(0x3F)["vowel_status"] == "dependent"
    assert phonetics.properties(0x17, "ta") == {} and phonetics.properties(0x15, "ta")
    rows = {r["o"]: r for r in phonetics.vectors(spark).select("o", "bits", phonetics.property_value(F.col("bits"), "articulation_place").alias("place")).collect()}
    assert rows[0x15]["place"] == 16 and rows[0x2A]["place"] == 1 and rows[0x05]["place"] == 0
    pair = spark.createDataFrame([([1, 1, 0], [1, 0, 1])], "a array<int>, b array<int>")
    got = pair.select(*(f(F.col("a"), F.col("b")).alias(n) for n, f in phonetics.SIMILARITIES.items()), phonetics.either(F.col("a"), F.col("b")).alias("or"), phonetics.differing(F.col("a"), F.col("b")).alias("xor")).first()
    assert (got["equal"], got["dotprod"], got["sim1"]) == (0, 1, 5) and got["dice"] == pytest.approx(2 / 6) and got["jaccard"] == pytest.approx(1 / 5) and got["cosine"] == pytest.approx(1 / 2.00001)
    assert got["softmax"] == pytest.approx(2.718281828) and (got["or"], got["xor"]) == ([1, 1, 1], [0, 1, 1])
    assert phonetics.similarity_matrix(spark).count() == 112 * 112
    assert phonetics.common_ratio("abcde", "ace") == 0.6 and phonetics.common_ratio("कमल", "ಕಮಲ", "hi", "kn") == 1 and phonetics.common_ratio("", "") == 0
    words = spark.createDataFrame([("कमल", "कल")], "a string, b string")
    assert tuple(words.select(phonetics.lcs_ratio(F.col("a"), F.col("b")).alias("r")).first()["r"]) == (pytest.approx(2 / 3), 3.0, 2.0)


def test_itrans_and_back(spark):
    there = {"namaste": "नमस्ते", "raama": "राम", "ki": "कि", "shrii": "श्री", "kShamaa": "क्षमा", "aaj": "आज्", "gaM": "गं", "12": "१२"}
    for word, native in there.items():
        assert phonetics.from_itrans(word) == native, word
    for word in ("raama", "namaste", "kShamaa", "bhaarata", "hai"):
        assert phonetics.to_itrans(phonetics.from_itrans(word)) == word
    assert phonetics.from_itrans("raama", "bn") == "রাম" and phonetics.to_itrans("\u0d28\u0d7b", "ml") == "nan"
    df = spark.createDataFrame([("raama ki",), (None,)], "t string")
    assert [r["x"] for r in df.select(phonetics.itrans(F.col("t")).alias("x")).collect()] == ["राम कि", None]


def test_conversion_to_native(spark):
    df = spark.createDataFrame([(1, "(Aaj) zindagii bahut 5 the traffic!"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in convert.to_native(df, "hin").collect()}
    assert got[1]["converted_text"].split() == ["(आज)", phonetics.from_itrans("zindagii"), "बहुत", "5", "the", "ट्रैफिक!"]
    assert (got[1]["conversion_method"], got[1]["converted_tokens"], got[1]["preserved_tokens"], got[1]["total_tokens"]) == ("hybrid", 4, 2, 6)
    assert [d["method"] for d in got[1]["token_details"]] == ["dictionary", "itrans", "dictionary", "none", "none", "dictionary"] and got[2]["total_tokens"] == 0
    assert convert.to_native(df, "tel").where("doc_id = 1").first()["failed_tokens"] >= 1 and len(L.dictionary("mar")) == 137 and L.dictionary("tam") == {}
    with pytest.raises(ValueError):
        convert.to_native(df, "hindi")


def test_currency_dates_and_code(spark):
    texts = ["paid $1,250.5K and ₹3 crore, Rs 20", "no money", "on 2024-11-15 f(x) 1e5"]
    steps = lambda d: [*entities.expanded_amounts(d), *entities.processed(d, "expand", "normalize", "remove"), {"code": entities.without_code(d), "dates": entities.without_dates(d)}]
    got = rows_of(spark, texts, steps, ["expanded", "processed", "code", "dates"])
    assert got[0]["expanded"] == "paid 1250.5 thousand USD and 3 crore INR, 20 INR" and got[1]["expanded"] == "no money"
    assert got[2]["processed"] == "on [DATE:ISO]  1e5" and got[2]["code"] == "on 2024-11-15  1e5" and got[2]["dates"] == "on  f(x) 1e5"


def test_validation(spark):
    df = spark.createDataFrame([("ok", "en", 0.5), ("", "eng", 0.5), ("x", "english", 0.5), ("x", "e1", 0.5), ("x", "en", 1.5), (None, "en", 0.5)], "text string, language string, confidence double")
    rules = [*validation.text_input(SPARK), *validation.language_result(SPARK)]
    good, bad = validation.split_rejects(df, rules)
    assert good.columns == df.columns and good.count() == 1
    assert sorted(r["problem"] for r in bad.collect()) == ["confidence_large", "language_letters", "language_long", "text_blank", "text_missing"]
    assert validation.strict(good, rules).count() == 1
    with pytest.raises(Exception, match="breaks the rule"):
        validation.strict(df, rules).collect()
    types = spark.createDataFrame([("1",), ("x",)], "n string")
    assert validation.split_rejects(types, [validation.of_type("n", "int")])[1].count() == 1
    assert validation.split_rejects(df, validation.sentiment_result(SPARK, "language"))[0].count() == 0
    assert validation.split_rejects(df, validation.toxicity_result(["confidence"]))[1].count() == 1


def test_levels_and_emoji(spark):
    df = spark.createDataFrame([(1, "Tbh  ﬁne sooooo it's 1st 🙂", "k")], "doc_id long, text string, normalized string")
    text_at = lambda level: pandas_text.normalized(df, level).first()["normalized"]
    assert text_at("light") == "Tbh fine sooooo it's 1st 🙂" and text_at("moderate") == "Tbh fine soo it is first 🙂"
    assert text_at("aggressive") == "to be honest fine soo it is first 🙂" and text_at("other") == df.first()["text"]
    assert pandas_text.normalized(df, unicode=False, repeats=False, contract=False, slang=True, numbers=False, blanks=False).first()["normalized"] == "to be honest  ﬁne sooooo it's 1st 🙂"
    assert rows_of(spark, ["Brb brb"], lambda d: text.normalized(d, keep_case=True), ["normalized"])[0]["normalized"] == "Be right back be right back"
    assert pandas_text.preprocessed(df, "moderate").first()["clean"] == "tbh fine soo it is first slightly_smiling_face" and "🙂" not in pandas_text.preprocessed(df, keep_emoji=False).first()["clean"]


def test_model_hooks(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")

    def load():
        return lambda texts: [[("__label__hin_Deva", 0.6), ("__label__mar_Deva", 0.3), ("__label__nep_Deva", 0.1)] for _ in texts]

    p = df.select("doc_id", models.top_languages(F.col("text"), 2, load).alias("p"))
    r = p.select(models.lid_result(F.col("p"), F.lit(11)).alias("r"), models.lid_summary(F.col("p"), L.INDIAN_NAMES).alias("s")).first()
    assert (r["r"]["lid_lang"], r["r"]["is_mixed"], r["r"]["threshold"], r["r"]["passed"]) == ("hin", True, 0.5, True) and [x["language_name"] for x in r["s"]] == ["Hindi", "Marathi"]
    assert models.Loaded(a=load, b=None).status()["readiness"] == 50 and models.Loaded(a=load).without("a").status()["models"] == {"a": False}
    assert models.to_english(df, models.glossary_translator).where("doc_id = 1").first()["translated_text"] == "a b c d e f"
    with pytest.warns(UserWarning):
        assert Detection().updated(latin_dominance=60, nothing=1).shown()["latin_dominance"] == 60


def test_ngram_profiles_and_prediction(spark):
    sums = {}
    for lang, _, _, freq in ngrams.profiles():
        sums[lang] = sums.get(lang, 0) + freq
    assert all(abs(s - 1) < 1e-9 for s in sums.values()) and list(sums) == list(L.PROFILE_TEXTS)
    docs = spark.createDataFrame([(1, "aaj mala late hoeil thik ahe"), (2, "ami bhalo achi"), (3, "…"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ng_lang"] for r in ngrams.predict(docs).collect()}
    assert got == {1: "mar", 2: "ben"}


def test_models_without_and_with_a_scorer(spark):
    df = spark.createDataFrame([(1, "good", "hi"), (2, None, "fr")], "doc_id long, text string, language string")
    none = df.select(models.sentiment(F.col("text")).alias("s"), models.toxicity(F.col("text")).alias("t"), models.translation(F.col("text"), "en").alias("x")).first()
    assert none["s"]["label"] == "unknown" and sum(none["t"]) == 0 and not none["x"]["success"]

    def load():
        return lambda texts: [("positive" if "good" in t else "neutral", 0.9, "toy") for t in texts]

    got = models.routed_sentiment(df, "language", load, None).collect()
    assert {r["doc_id"]: r["sentiment"]["label"] for r in got} == {1: "positive", 2: "unknown"}


def test_sources(spark, tmp_path):
    (tmp_path / "hi.json").write_text(json.dumps({"iso_code": "hin", "categories": {"a": {"kal": "1", "aaj": "2"}, "b": {"kal": "3"}}}))
    got = {r["roman"]: r["native"] for r in readers.dictionaries(spark, str(tmp_path)).collect()}
    assert got == {"kal": "3", "aaj": "2"}
    fresh = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "key string, ts int, value string")
    table = readers.upsert(None, fresh, "key", "ts")
    again = readers.upsert(table, fresh.where("key = 'k'"), "key", "ts")
    assert {r["key"]: (r["value"], r["request_count"]) for r in again.collect()} == {"k": ("b", 4), "m": ("c", 1)}
    (tmp_path / "lines.txt").write_text("one\ntwo three\n")
    analysis.main(["wc", str(tmp_path / "lines.txt"), str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out")).first().asDict() == {"chars": 12, "lines": 2, "words": 3}


def test_analysis_of_distinct_texts_is_the_same(spark):
    docs = spark.createDataFrame([(1, "aaj mala late hoeil thik ahe"), (2, "This is a good day"), (3, "This is a good day"), (4, None)], "doc_id long, text string")
    one = {r["doc_id"]: (r["language"], r["method"]) for r in analysis.analyze(docs, compact=False).collect()}
    two = {r["doc_id"]: (r["language"], r["method"]) for r in analysis.analyze_distinct(docs).collect()}
    assert {k: v for k, v in one.items() if k != 4} == {k: v for k, v in two.items() if k != 4}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "eng", 0.9 if i % 3 else 0.4) for i in range(30)]
    schema = "doc_id long, signature string, detected string, confidence double"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = state.pattern_cache(stream).writeStream.format("memory").queryName("cache_out").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = {r["doc_id"]: r["cache_hit"] for r in spark.table("cache_out").collect()}
    from scriptorium.plans.learning import cache_replay

    expected = {r["doc_id"]: r["cache_hit"] for r in cache_replay(spark.createDataFrame(rows, schema)).collect()}
    assert got == expected and any(got.values()) and not all(got.values())


def test_rate_limit_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, 10), 1)] * 31 + [(datetime(2024, 1, 1, 0, 0, 20), 2), (datetime(2024, 1, 1, 1), 3)]
    schema = "ts timestamp, user_id long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    query = state.rate_limits(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("limits").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert {(r["user_id"], r["requests"], r["over_limit"]) for r in spark.table("limits").collect()} == {(1, 31, True), (2, 1, False), (3, 1, False)}


def test_late_requests_are_dropped(spark, tmp_path):
    schema = "ts timestamp, user_id long"
    parts = [[(datetime(2024, 1, 1, 2), 1)], [(datetime(2024, 1, 1, 2, 0, 30), 5)], [(datetime(2024, 1, 1, 0), 2), (datetime(2024, 1, 1, 1, 59), 3)], [(datetime(2024, 1, 1, 4), 4)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = state.rate_limits(stream).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    users = {r["user_id"] for r in spark.table("late").collect()}
    assert 1 in users and 2 not in users  # two hours late, with a watermark of ten minutes


def test_corrections_make_the_cache_forget(spark, tmp_path):
    rows = [(i, "s", "eng", 0.9, i == 4) for i in range(9)]
    schema = "doc_id long, signature string, detected string, confidence double, corrected boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = state.pattern_cache(stream).writeStream.format("memory").queryName("forgotten").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r["doc_id"] for r in spark.table("forgotten").where("cache_hit").collect()} == {3, 8}


def test_logs_of_streams(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 0, 0, i), lang, conf, "latin_fallback", f"hash{i}", rep, "hin") for i, (lang, conf, rep) in enumerate([("eng", 0.7, False), ("ido", 0.9, False), ("eng", 0.55, True), ("eng", 0.55, False), ("unknown", 0.3, False)])]
    schema = "doc_id long, ts timestamp, detected string, confidence double, method string, text_hash string, reported boolean, expected string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert state.failure_log(stream, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination(120)
    got = {r["doc_id"]: r for r in state.newest_failures(spark, str(tmp_path / "log"), 500).collect()}
    assert {k: sorted(r["reasons"]) for k, r in got.items()} == {0: ["suspicious_confidence"], 1: ["obscure_language", "suspicious_confidence"], 2: ["user_reported"], 4: ["low_confidence", "unknown_language"]}
    assert got[0]["failure_id"] == "fail_20240101_000000_hash0_0" and [r["doc_id"] for r in state.newest_failures(spark, str(tmp_path / "log"), 1).collect()] == [4]
    kept = []
    query = state.upserted(stream, "detected", "doc_id", lambda df: kept.append({r["detected"]: (r["doc_id"], r["request_count"]) for r in df.collect()}), lambda: None, str(tmp_path / "c2"))
    assert query.awaitTermination(120) and kept[-1]["eng"] == (3, 3)


def test_caches_and_counts(spark):
    cache = spark.createDataFrame([(f"lang:{i}", i % 3, i / 10) for i in range(9)] + [("sentiment:1", 9, 0.5)], "signature string, use_count int, avg_confidence double")
    assert learning.evicted(cache, trigger=20).count() == 10 and [r["signature"] for r in learning.evicted(cache, trigger=5, keep=2).collect()] == ["sentiment:1", "lang:8"]
    assert learning.invalidated(cache, cache.where("use_count = 9")).count() == 9 and readers.without(cache, "signature", "lang:").count() == 1 and readers.without(cache, "signature").count() == 0
    assert {r["prefix"]: r["keys"] for r in readers.keys_by_prefix(cache, "signature").collect()} == {"lang": 9, "sentiment": 1}
    fixes = spark.createDataFrame([("lang:1", "mar"), ("lang:1", "hin")], "signature string, correct_language string")
    assert learning.suggestions(cache, fixes).where("suggestions IS NOT NULL").first()["suggestions"] == ["hin", "mar"]
    asked = spark.createDataFrame([("a",), ("b",)], "text_hash string")
    hit, missed = learning.with_cache(asked, spark.createDataFrame([("a", 1)], "text_hash string, response int"))
    assert hit.count() == 1 and missed.first()["text_hash"] == "b"
    df, seen = monitor.measured(spark.createDataFrame([("ab",), ("",), (None,)], "text string"), "texts")
    df.collect()
    assert seen.get == {"rows": 3, "missing": 1, "blank": 1, "characters": 2, "longest": 2} and monitor.timed(lambda: asked, "asked")["rows"] == 2


@pytest.mark.parametrize("code,expected", [("hi", "hi"), ("HIF", "hin"), ("mr_mixed", "mar_mixed"), ("", "unknown"), (None, "unknown"), ("ido", "unknown"), ("en-US", "eng")])
def test_language_codes(spark, code, expected):
    df = spark.createDataFrame([(code,)], "lang string")
    assert flow.apply(df, lambda d: language.code(d), ["code"]).first()["code"] == expected
