"""The parts that the whole analysis spends its time in, against plain forms of the same."""

from collections import Counter

import duckdb

from scriptorium.functions import flow
from scriptorium.functions import lexicons as L
from scriptorium.functions.dialect import BLANK, SPARK, WORD
from scriptorium.operators import ngrams
from scriptorium.plans import catalog

TEXTS = ["aaj mala late hoeil thik ahe", "a", "", "  \t", "yeh kya hai bhai", "नमस्ते दुनिया कैसे हो", "x" * 70, "\U0001f600 main ghar ja raha hoon \U0001f600", "kya baat hai " * 90, "日本語の文"]


def test_runs_and_trimming_equal_plain_classes(spark):
    points = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x30000, 1))]
    texts = ["".join(f"{x}{c}b{c}{c} " for c in points[i : i + 500]) for i in range(0, len(points), 500) for x in ("a", "")]
    texts += [f"{a}x{c} y{b}" for c in (" ", "\n") for a in ("", " ", " \t", "\x85") for b in ("", "\n", " \r\n", " ", "\xa0 ")] + ["", " ", "\n", "　 \n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text")
    plain = [f"regexp_extract_all(text, r'[^{BLANK}]+', 0)", f"regexp_extract_all(text, r'[{WORD}]+', 0)", f"regexp_replace(text, r'^[{BLANK}]+|[{BLANK}]+$', '')", f"size(regexp_extract_all(text, r'[^{BLANK}]+', 0))", "length(text) - length(regexp_replace(text, '[A-Za-z]', ''))"]
    mine = [SPARK.words("text"), SPARK.word_runs("text"), SPARK.trim("text"), SPARK.n_words("text"), SPARK.count_in("text", L.LATIN)]
    out = df.selectExpr(*(f"({a}) <=> ({b}) AS e{i}" for i, (a, b) in enumerate(zip(plain, mine)))).collect()
    assert len(out) == len(texts) and all(all(r) for r in out)


def test_scores_equal_counting():
    freq = {(place, g): f for _, place, g, f in ngrams.profiles()}
    whole, pieces = ngrams.scorer(), ngrams.scorer(step=5)
    for text in TEXTS:
        count = Counter(text[i : i + n] for n in ngrams.SIZES for i in range(len(text) - n + 1))
        for place in range(len(L.PROFILE_TEXTS)):
            expected = sum(k * freq.get((place, g), 0.0) for g, k in count.items())
            assert abs(whole(text)[place] - expected) < 1e-9 and abs(pieces(text)[place] - expected) < 1e-9


def _rows(tmp_path, spark):
    # an id with two texts, and rows without an id or a text
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "irukku naan romba nee"), (0, "kya hai"), (None, "kya baat hai"), (90, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return con


def test_texts_of_one_id_are_scored_together(spark, tmp_path):
    con = _rows(tmp_path, spark)
    got = {tuple(r) for r in catalog.QUERIES["ngram_predict"](spark, str(tmp_path)).collect()}
    assert {r for r in got if r[0] is not None} == {r for r in con.sql(catalog.ORACLES["ngram_predict"]).fetchall() if r[0] is not None} and 0 in {r[0] for r in got}


def test_whole_analysis_makes_no_row_of_an_ngram(spark):
    plan = catalog.QUERIES["analyze_whole"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_whole_analysis_of_odd_rows_equals_its_sql(spark, tmp_path):
    con = _rows(tmp_path, spark)
    df, relation = catalog.QUERIES["analyze_whole"](spark, str(tmp_path)), con.sql(catalog.ORACLES["analyze_whole"])
    at = [relation.columns.index(n) for n in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall())


def test_quick_tests_lose_no_entity(spark):
    texts = [
        "Rs. 5 USD  7 eur\t9,5 GBP3 inr 1 ₹2 $ 3k €,4 cars 7 EURO 5 Rs5M", "f(x) foo bar (y) é(z) aé (1) a.b(c)(d) été_1\n(e) 中文(f) x1é2(g)", "AB CDE, FGHIJK. éAB ABé AB", "5 % 7.5% 10km 3.5 MB 1e5 2.5E-3",
        "1/2/2020 on 2020-01-05, 3 Jan 2020 jan 3 2020 Mayhem 3, 2021 at 5:30 pm 17:45:01", "Today IN 3 days, 2 weeks ago this  monday Last year yesterday", "visit http://a.b/c or www.x.y &amp; #tag @me\x1c\x85 end httpx www.",
    ]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts * 2)))
    from scriptorium.operators import entities, text

    for steps, keep in ((entities.financial, ["currencies", "amounts", "units_of_amounts", "percentages", "tickers"]), (entities.temporal, ["dates", "times", "relative_dates"]), (entities.technical, ["functions", "scientific_numbers", "measures"]), (text.cleaned, ["clean"])):
        got = sorted(tuple(r) for r in flow.apply(df, steps, ["doc_id", *keep]).collect())
        assert got == sorted(con.sql(flow.sql("documents", steps, ["doc_id", *keep])).fetchall())
