"""Language, quality, personal data and licences."""

import itertools
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import crf_langid, license_scan, pii, quality_gam, queries

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


# ---- language


def test_marginals_are_exact():
    r = np.random.default_rng(1)
    move = r.random((3, 3)) + 0.1
    lengths = np.array([1, 3, 6, 5])
    e = r.random((15, 3)) + 0.05
    got = crf_langid.marginals(e, lengths, move)[0]
    at = 0
    for n in lengths:
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.prod([e[at + i, k] for i, k in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            for i, k in enumerate(path):
                total[i, k] += p
        assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True))
        at += n


def test_long_chains_equal_sequential_ones(monkeypatch):
    r = np.random.default_rng(2)
    move, e = r.random((2, 2)) + 0.1, r.random((900, 2)) + 0.01
    lengths = np.array([500, 130, 64, 65, 141])
    many = crf_langid.marginals(e, lengths, move)[0]
    monkeypatch.setattr(crf_langid, "CHUNK", 600)
    assert np.allclose(many, crf_langid.marginals(e, lengths, move)[0])


def small_model():
    words = {"aa": "der die und nicht schule wasser".split(), "bb": "the and of water school never".split()}
    r = np.random.default_rng(0)
    return crf_langid.fit([(k, [str(w) for w in r.choice(v, 60)]) for k, v in words.items() for _ in range(20)], crf_langid.CrfParams(max_docs=40, steps=30))


def test_labels_words_of_switched_text_and_odd_texts():
    scorer = crf_langid.WordScorer(small_model())
    german, english = "und nicht die schule der", "the water and never of school"
    out = crf_langid.label([f"{german} {english}", "", "  ", "12 ###", "und " * 3000], scorer, segments=True)
    assert out[0][2] == [(0, 5, "aa"), (5, 11, "bb")]
    assert [o[:2] for o in out[1:4]] == [("und", 0.0)] * 3
    assert out[4][0] == "aa" and 0 <= out[4][1] <= 1
    assert crf_langid.label(["x"], crf_langid.WordScorer(crf_langid.fit([])))[0][:2] == ("und", 0.0)


def test_stretches_of_long_texts_are_one_chain(monkeypatch):
    scorer = crf_langid.WordScorer(small_model())
    r = np.random.default_rng(5)
    vocabulary = "der die und nicht schule wasser the and of water school never 12 x ##".split()
    texts = [" ".join(str(w) for w in r.choice(vocabulary, n)) for n in (3, 700, 5000)] + ["\u2003".join(["und", "the"] * 300), "a" * 3000 + " the water", "\n \t" * 900]
    whole = crf_langid.label(texts, scorer, segments=True)
    monkeypatch.setattr(crf_langid, "STRETCH", 500)
    for one, other in zip(whole, crf_langid.label(texts, scorer, segments=True)):
        assert one[0] == other[0] and one[1] == pytest.approx(other[1], abs=1e-9) and one[2] == other[2]


def test_language_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score string, segments int"
    rows = [(i, "der die und nicht schule" if i % 2 else "the and of water school", "de" if i % 2 else "en", "c", "c", 1) for i in range(40)]
    odd = [(None, "the water", "en", "c", "c", 1), (100, None, "de", "c", "c", 1), (101, "", None, "c", "c", 1), (102, "1 2 ...", "en", "c", "c", 1), (103, "the " * 200_000, None, "c", "c", 1), (3, "der die", "de", "c", "c", 1)]
    docs = spark.createDataFrame(rows + odd, schema)
    model = crf_langid.learn(docs)
    out = crf_langid.identify(docs, model).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert (got[None], got[100], got[101], got[102], got[103]) == ("en", "und", "und", "und", "en")
    assert crf_langid.identify(docs.where("false"), model).collect() == []
    assert crf_langid.learn(docs.where("false")).langs == [] and crf_langid.learn(docs.where("doc_id IS NULL")).langs == []
    assert {r["lang_pred"] for r in crf_langid.identify(docs, crf_langid.learn(docs.where("false"))).collect()} == {"und"}


def test_language_query_on_held_out_rows(spark):
    rows = queries.op2_language_id(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98


# ---- quality


def test_quality_query_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = queries.op3_quality_classifier(spark, MIDDLE).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and len(held) > 80
    assert np.mean([labels[r["doc_id"]] == r["predicted"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_quality_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 2), (3, "", 3), (4, "w " * 50_000, 4)], "doc_id long, text string, score long")
    none = quality_gam.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["quality_score"] for r in quality_gam.score(docs, none).collect()] == [0.5] * 5
    one = quality_gam.learn(docs, spark.createDataFrame([(1, 1), (3, 1), (4, None)], "doc_id long, quality int"))
    assert all(r["quality_score"] > 0.9 for r in quality_gam.score(docs, one).collect())
    assert quality_gam.score(docs.where("false"), none).collect() == []


def test_scores_of_any_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 0.2, 3), (None, None, 0.3, 4)], "doc_id long, text string, Quality_Score double, score int")
    model = quality_gam.Gam(base=1.0)
    out = quality_gam.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "quality_score"] and all(r["quality_score"] == pytest.approx(1 / (1 + np.exp(-1))) for r in out.collect())
    assert quality_gam.accepted(docs, model).columns == docs.columns and quality_gam.accepted(docs, model).count() == 2
    assert quality_gam.accepted(docs, model, 0.9).count() == 0 and quality_gam.accepted(docs.where("false"), model).collect() == []


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(3)
    x = r.random((400, 4))
    model = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.7).astype(float), quality_gam.GamParams(rounds=10, pair_rounds=5))
    for row, got in zip(x, model.score(x)):
        place = lambda edges, v: sum(1 for e in edges if e <= v)
        total = model.base + sum(model.tables[i][place(model.edges[i], row[i])] for i in range(4))
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[place(model.pair_edges[i], row[i]), place(model.pair_edges[j], row[j])]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_shallow_trees_make_the_best_cut():
    r = np.random.default_rng(4)
    for _ in range(50):
        g, h, n = r.standard_normal(9), r.random(9) + 0.1, r.integers(0, 9, 9)
        tree = quality_gam._shallow_tree(g, h, 2, n, 8)
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        cuts = [(gain(0, c) + gain(c, 9) - gain(0, 9), c) for c in range(1, 9) if n[:c].sum() >= 8 and n[c:].sum() >= 8]
        if not cuts or max(cuts)[0] <= 1e-9:
            assert not tree.any()
            continue
        c = max(cuts)[1]
        assert np.allclose(tree[:c], g[:c].sum() / (h[:c].sum() + 1)) and np.allclose(tree[c:], g[c:].sum() / (h[c:].sum() + 1))


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (1, 0) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


ODD = [
    "", None, "a@b", "a@b.c", "x a@b.com_x@c.d y", "@a@b.c.d..e", "é1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1 000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "+1 (301) 555-0345 4111111111111111", "+49 30 123456", "+1234567890123456", "😀 me@x.org 😀 4111111111111111", "1" * 30_000, "a" * 30_000 + "@x.y", "7 " * 9000, "a.b@" * 2000,
    "12345678901234567890", "+1..............2", "call (301) 555-0345 now", "jo [at] mail [dot] com", "4111111111111111" * 2,
]


def test_base_spans_equal_plain_patterns(spark):
    texts = [*ODD, *(r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect())]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    found = pii.find(docs).select("doc_id", pii.joined("base").alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in found} == {i: plain_spans(t or "") for i, t in enumerate(texts)}


def test_added_spans_and_redaction(spark):
    rows = [
        (1, "+1 (301) 555-0345 4111111111111111 x"), (2, "ring (301) 555-0345 now"), (3, "jo [at] mail [dot] com"), (4, "number 4111111111111112 and 1234567890123"),
        (5, None), (6, "plain words only"), (7, "me@x.org, 10.0.0.1"), (7, "me@x.org, 10.0.0.1"),
    ]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, spans int, added string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert got[0] == "[PHONE] [CARD] x" and got[2] == "[EMAIL]"
    assert got[3] == rows[3][1] and got[4] is None and got[5] == "plain words only"
    assert got[6] == got[7] == "[EMAIL], [IP]"
    assert pii.find(docs.where("false")).collect() == []


def test_redaction_equals_a_plain_one(spark):
    texts = [t for t in ODD if t] + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: sorted([*r["base"], *r["added"]]) for r in pii.find(docs).collect()}
    for r in pii.redact(docs).collect():
        out, at, text = "", 0, texts[r["doc_id"]]
        for start, kind, end in spans[r["doc_id"]]:
            if start >= at:
                out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        assert r["text"] == out + text[at:]


def test_proposals_leave_base_spans_alone(spark):
    rows = [r for r in pii.find(spark.createDataFrame(list(enumerate(t for t, _, _ in pii.other_examples(400, 9))), "doc_id long, text string")).collect()]
    assert sum(len(r["added"]) for r in rows) > 50
    for r in rows:
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in r["added"] for b in r["base"])
        assert all(a == b or a[1] != b[1] or a[2] <= b[0] or b[2] <= a[0] for a in r["added"] for b in r["added"])


def test_many_matches_take_linear_time(spark):
    import time

    def seconds(n):
        text = "v 12345; mail bob@x.org or 4111111111111111 call 555-867-5309; " * n
        began = time.time()
        (row,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert (len(row["base"]), len(row["added"])) == (2 * n, n)
        return time.time() - began

    seconds(10)
    few, many = seconds(2000), seconds(16_000)
    assert many < 8 * few + 8


def test_base_spans_stay_in_all_spans(spark):
    for r in queries.op6_pii(spark, SMALL).collect():
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert len(kinds) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]


# ---- licences


def test_licences_equal_sql(spark):
    rows = [
        (1, "Released under the MIT Licence"), (2, "text\n# (c) 2020 Somebody\nreleased under the mit license!\nmore"), (3, None), (4, ""), (5, "Copyright 2020 X\n\n" + license_scan.KNOWN["ISC"][0].upper()),
        (6, "nothing"), (6, "nothing"), (None, "Licensed under CC BY-NC 4.0."), (8, "x\n" * 20_000 + "Licensed under the Apache Licence, Version 2.0"),
    ]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string")
    got = license_scan.scan(docs).collect()
    by = {r["doc_id"]: (r["license"], r["notices"]) for r in got}
    assert by[1] == ("MIT", "MIT") and by[2] == (None, "MIT") and by[3] == (None, None) and by[5][0] == "ISC" and by[None] == ("CC-BY-NC-4.0",) * 2 and by[8] == (None, "Apache-2.0")
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    expected = con.sql(license_scan.scan_sql()).fetchall()
    order = lambda xs: sorted([tuple(x) for x in xs], key=str)
    assert order(got) == order(expected)
    assert license_scan.scan(docs.where("false")).collect() == []


def test_whole_licence_files_and_copyright_lines(spark):
    import textwrap

    whole = {**{n: (t[0],) for n, t in license_scan.WHOLE.items()}, **{n: t[:1] for n, t in license_scan._files().items()}}
    assert {"BSD-3-Clause", "Unlicense", "0BSD", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0"} <= set(whole)
    rows, expected = [], {}
    for name, (text,) in whole.items():
        forms = [text]
        if name in license_scan.TITLES:
            head = f"{license_scan.TITLES[name][0]}\n\nCopyright (c) 2020 Some Body\n\n"
            forms = [h + "\n".join(textwrap.wrap(text, width, break_on_hyphens=False)) for h in ("", head) for width in range(30, 90, 5)]
        for form in forms:
            expected[len(rows)] = name
            rows.append((len(rows), form))
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected
    dropped = ["copyright 2020 x", "# (c) 2020 x", "copyright (c) x", "copyright: x", "copyright nora", "copyright the authors", "copyright o", "© x", "(c) copyright x", "copyright [yyyy] [name]", "all rights reserved."]
    kept = ["copyright notice and this", "copyright holders or", "copyright owner", "copyright, patent", "copyrighted work", "(c) you must retain", "copyright", "copyright law."]
    for line in dropped + kept:
        assert bool(re.match(license_scan.COPYRIGHT.replace(r"\z", r"\Z"), line)) == (line in dropped), line
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [*rows, *((1000 + i, x) for i, x in enumerate(dropped + kept))])
    docs = spark.createDataFrame([*rows, *((1000 + i, x) for i, x in enumerate(dropped + kept))], "doc_id long, text string")
    assert sorted(map(str, map(tuple, license_scan.scan(docs).collect()))) == sorted(map(str, con.sql(license_scan.scan_sql()).fetchall()))


def test_licences_on_one_line_and_in_other_scripts(spark):
    mit = license_scan.KNOWN["MIT"][0]
    texts = [f"Copyright (c) 2020 X. {mit}", f"Copyright 2020 Foo, Inc. All rights reserved. {mit}", f"MIT License\n\nCopyright (c) 2020 John A. Smith\n\n{mit}", "हिन्दी पाठ", "हन्द पठ", "русский текст", "中文", ""]
    got = [r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r["license"] for r in got] == ["MIT"] * 3 + [None] * 5
    assert len({r["digest"] for r in got[3:]}) == 5


def plain_lines(text):
    """The canonical lines of a text by the stated rules, in plain Python."""
    holder = lambda rest: (w := re.match("[a-z]+", rest)) is not None and w[0] not in license_scan.BODY_WORDS

    def clause(line):
        body = line.lstrip(" \t*#/;-")
        if body.startswith("copyright"):
            rest = body[9:].lstrip(" \t:")
            spaced = body[9:10] in (" ", "\t", ":") and body[9:].lstrip(" \t:") == rest
            found = bool(rest) and (rest[0] not in 'abcdefghijklmnopqrstuvwxyz \t:,.;)"\n-' or (spaced and holder(rest)))
        elif body.startswith("(c)"):
            rest = body[3:].lstrip(" \t")
            found = bool(rest) and (not "a" <= rest[0] <= "z" or rest.startswith("copyright") or holder(rest))
        else:
            found = body.startswith(("©", "all rights reserved"))
        if not found:
            return line
        m = re.search(r"\.[ \t]+((?:%s)[ \t].*)" % "|".join(license_scan.STARTS), body)
        return m[1] if m else ""

    out = []
    for line in text.lower().split("\n"):
        line = clause(clause(line))
        for one, other in license_scan.SPELLINGS:
            line = line.replace(one, other)
        line = " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in line).split())
        for filler in license_scan.FILLERS:
            line = line.replace(filler, " ")
        if line.strip():
            out.append(line.strip())
    return out


def test_canonical_lines_equal_the_stated_rules(spark):
    r = random.Random(4)
    parts = ["Copyright (c) 2020 X.", "copyright holders", "(c) 2001 Foo", "All rights reserved.", "Permission is hereby granted.", "MIT Licence, Version 2.0", "© Bar", "This v 2", "— «слово» १२", "# * ", "\n", "\n\n", "Copyright: nora", "non-commercial", "(C) you must"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", license_scan.canonical_lines(F.col("text")).alias("lines")).collect()
    for row in rows:
        assert row["lines"] == plain_lines(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_a_registry_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_REGISTRY", 3)
    with pytest.raises(ValueError):
        license_scan.registry(spark)
