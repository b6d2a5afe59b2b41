"""URLs, media, mixing, packing and the pipeline."""

import io
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import media, mixing, packing, queries, url_filter

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# ---- URLs


def test_rules_and_aliases(spark):
    link = '<head><LINK href="{}" rel=canonical></head>'
    rows = [
        (1, "https://Example.COM/en/x", None), (2, "http://www.example.com/en/x", ""), (3, "https://a.net/es/1", None), (4, "http://other.org/p", link.format("https://a.net/es/1")),
        (5, "http://third.org/q?utm_source=x#top", '<meta http-equiv="refresh" content="0; url=http://other.org/p">'), (6, "http://third.org/q", None), (7, None, None), (8, "no scheme", None),
        (9, "http://fourth.org/r", link.format("http://good.com/")), (10, "http://fourth.org/r/", link.format("http://b.net/fr/2")), (11, "http://alone.org/", None), (11, "http://alone.org/", None),
        (12, "x://NET?q", None), (13, "https://evilnet/es/", None),
    ]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, verdict string")
    folded = url_filter.Folding(tracking=True, index=True)
    got = {r["page_id"]: r for r in url_filter.judge(pages, queries.URL_RULES, folding=folded).collect()}
    plain = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert (plain[4], plain[5], plain[6]) == ("block", "block", "allow")
    verdict = {k: (r["rule"], r["verdict"], r["decided_by"]) for k, r in got.items()}
    assert verdict[1] == ("example.com/en/", "block", "rule") and verdict[2] == ("www.example.com/en/", "allow", "rule")
    assert verdict[3] == ("net/es/", "block", "rule") and verdict[4] == verdict[5] == verdict[6] == (None, "block", "alias")
    assert verdict[9] == verdict[10] == (None, "allow", "alias") and verdict[11] == verdict[13] == (None, "allow", "default")
    assert (got[7]["host"], got[7]["path"]) == (got[8]["host"], got[8]["path"]) == ("", "") and (got[12]["host"], got[12]["path"]) == ("net", "")
    assert (got[1]["host"], got[1]["path"]) == ("example.com", "/en/x")
    assert url_filter.judge(pages.where("false"), queries.URL_RULES).collect() == []


def brute_verdicts(rows, rules, redirects=()):
    """Verdicts by a parser of HTML, the standard library's URL joining, and union-find."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin, urlsplit

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def form(url):
        if url is None or "://" not in url:
            return None
        u = urlsplit(urljoin(url, url))
        path = urljoin(url, u.path or "/").split("://", 1)[1]
        path = path[path.index("/") :]
        return u.netloc.lower().removesuffix(":80").removesuffix(":443") + path + ("?" + u.query if u.query else "")

    def rule_of(url):
        if url is None or "://" not in url:
            return None
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fits)[1:] if fits else None

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in attrs}
            if tag == "link" and "canonical" in a.get("rel", "").lower().split() and "href" in a:
                self.found.append(a["href"].strip())
            if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
                m = re.match(r"(?i)[\s\d.]*[;,]?\s*url\s*=\s*['\"]?\s*([^'\"]*)", a.get("content", ""))
                if m:
                    self.found.append(m[1].strip())

    opinions = defaultdict(set)
    edges = [(u, t) for u, t in redirects]
    for _, url, html in rows:
        if url is not None and "://" in url:
            parser = Links()
            parser.found = []
            parser.feed(html or "")
            edges += [(url, urljoin(url, t)) for t in parser.found if not re.match(r"[a-z]+:(?!//)", t)]
    for u, t in edges:
        parent[find(form(u))] = find(form(t))
    for url in [r[1] for r in rows] + [x for e in edges for x in e]:
        if rule_of(url):
            opinions[find(form(url))].add(rule_of(url)[1])
    out = {}
    for page, url, _ in rows:
        own = rule_of(url)
        taken = opinions[find(form(url))] if form(url) else set()
        out[page] = own[1] if own else "allow" if "allow" in taken or not taken else "block"
    return out


def test_aliases_equal_brute_force(spark):
    r = random.Random(8)
    hosts = ["a.org", "B.org:443", "c.org", "x.net", "www.y.com", "d.org"]
    url = lambda: f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['', '/', '/es/', '/fr/p', '/q', '/en/../es/', '/q/./z'])}{r.choice(['', '?a=1', '#f'])}"
    target = lambda: r.choice([url(), "//c.org/q", "/q", "z", "../q", "?a=1", "#top", "mailto:x@y.z", "", "/es/1"])
    tags = [
        lambda: f'<link href="{target()}" rel="alternate canonical">', lambda: f"<LINK rel=canonical href='{target()}'/>", lambda: f'<link rel="stylesheet" href="{target()}">',
        lambda: f'<meta http-equiv="Refresh" content="5; URL={target()}">', lambda: f'<meta name="x" content="0;url={target()}">', lambda: "<p>canonical refresh</p>",
    ]
    for seed in range(3):
        r.seed(seed)
        rows = [(i, url() if r.random() < 0.95 else r.choice([None, "no scheme"]), "".join(t() for t in r.sample(tags, r.randint(0, 3))) if r.random() < 0.6 else None) for i in range(60)]
        redirects = [(url(), url()) for _ in range(4)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        moved = spark.createDataFrame(redirects, "url string, target string")
        got = url_filter.judge(pages, queries.URL_RULES, moved).collect()
        assert {x["page_id"]: x["verdict"] for x in got} == brute_verdicts(rows, queries.URL_RULES, redirects)
        assert {x["decided_by"] for x in got} == {"rule", "alias", "default"}


def test_every_page_has_one_verdict(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert Counter(r["page_id"] for r in queries.op5_url_filters(spark, SMALL).collect()) == Counter(r["page_id"] for r in pages.collect())


# ---- media


def test_sounds_hold_their_texts(spark):
    texts = ["", None, "short", "é" * 63, "x" * 64, "y" * 65, "hello world " * 40_000, "short"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        with wave.open(io.BytesIO(got[i]["media"])) as w:
            back = w.readframes(w.getnframes())
        assert back == media.padded(raw) and len(back) % 64 == 0 and len(back) >= 64
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["tail_crc32"], got[i]["media_bytes"]) == (len(raw), len(back), zlib.crc32(back[-64:]), len(got[i]["media"]))
    assert got[2]["fingerprint"] == got[7]["fingerprint"] and len(got[6]["fingerprint"]) > 1000
    assert media.media_columns(docs.where("false")).collect() == []


def test_blocks_of_frames_do_not_matter(monkeypatch):
    sound = bytes(random.Random(1).randrange(256) for _ in range(20_000))
    time, code = media.peak_pairs(sound)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 7)
    again = media.peak_pairs(sound)
    assert len(time) and (time == again[0]).all() and (code == again[1]).all()
    assert len(media.peak_pairs(bytes([128]) * 5000)[0]) == 0


def plain_pairs(sound):
    """Peak pairs by plain loops and a plain Fourier sum."""
    x = np.frombuffer(sound, np.uint8).astype(float) - 128
    n = max(1, -(-max(0, len(x) - media.FRAME) // media.HOP) + 1)
    x = np.append(x, np.zeros((n - 1) * media.HOP + media.FRAME - len(x)))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    peaks = []
    for f in range(n):
        power = np.abs(turn @ (x[f * media.HOP : f * media.HOP + media.FRAME] * np.hanning(media.FRAME)))
        mine = []
        for lo, hi in zip(media.BANDS, media.BANDS[1:]):
            top = lo + int(np.argmax(power[lo:hi]))
            if power[top] >= media.STANDS_OUT * power[1:].mean() and power[top] > 1e-3:
                mine.append(top)
        peaks.append(mine)
    return [(f, one << 20 | two << 8 | gap) for f in range(n) for one in peaks[f] for gap in range(1, media.FAN + 1) if f + gap < n for two in peaks[f + gap]]


def test_peak_pairs_equal_plain_loops():
    r = random.Random(7)
    text = " ".join(r.choice("peak pair sound time code wave".split()) for _ in range(700)).encode()
    for sound in (text, media.padded(b""), bytes(r.randrange(256) for _ in range(3000)), media.padded(b"short")):
        time, code = media.peak_pairs(sound)
        got, expected = list(zip(time.tolist(), code.tolist())), plain_pairs(sound)
        assert got == expected


def test_sounds_of_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "a b c " * 50, "x"), (1, "a b c " * 50, "x"), (1, "a b c " * 50, "x")], "doc_id long, text string, fingerprint string")
    got = media.media_columns(docs).collect()
    assert len(got) == 3 and len({(r["media_sha256"], str(r["fingerprint"])) for r in got}) == 1 and [r["doc_id"] for r in got].count(None) == 1


# ---- mixing


def test_raking_meets_margins_and_budget(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 80), r.choice(["a", "a", "a", "b", None]), r.choice(["x", "y"]), "c") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight string")
    params = mixing.MixParams(targets={"lang": {"x": 0.3, "y": 0.7}}, budget=0.3)
    out = mixing.mix(mixing.described(docs), params).collect()
    assert len(out) == 3000
    share = defaultdict(float)
    for row in out:
        share[row["lang"]] += row["weight"] * row["n_tokens"]
    assert abs(share["y"] / sum(share.values()) - 0.7) < 1e-6
    total = sum(row["n_tokens"] for row in out)
    assert abs(sum(row["probability"] * row["n_tokens"] for row in out) / total - 0.3) < 1e-9
    assert abs(sum(row["n_tokens"] for row in out if row["selected"]) / total - 0.3) < 0.05
    assert {row["doc_id"] for row in out if row["selected"]} == {row["doc_id"] for row in mixing.sample(docs, params).collect()}
    assert mixing.sample(docs, params).columns == docs.columns


def test_raking_equals_plain_proportional_fitting():
    r = np.random.default_rng(4)
    tokens = r.integers(1, 50, (3, 4, 2)).astype(float)
    goals = [r.dirichlet(np.ones(n)) for n in tokens.shape]
    plain = tokens.copy()
    for _ in range(400):
        for axis, goal in enumerate(goals):
            now = plain.sum(axis=tuple(a for a in range(3) if a != axis))
            plain *= (goal * plain.sum() / now).reshape([-1 if a == axis else 1 for a in range(3)])
    codes = [c.ravel() for c in np.indices(tokens.shape)]
    weight = mixing.rake(tokens.ravel(), codes, goals, 500, 1e-12)
    assert np.allclose((weight * tokens.ravel()).reshape(tokens.shape) / plain, (weight * tokens.ravel()).sum() / plain.sum(), rtol=1e-6)
    with pytest.warns(UserWarning, match="raking"):
        mixing.rake(np.array([1.0, 1.0]), [np.array([0, 1]), np.array([0, 1])], [np.array([0.9, 0.1]), np.array([0.1, 0.9])], 50, 1e-9)


def test_mixing_odd_tables(spark):
    schema = "doc_id long, text string, source string, lang string"
    assert mixing.mix(mixing.described(spark.createDataFrame([], schema))).collect() == []
    rows = [(1, None, None, None), (None, "", "s", None), (3, "a b", None, "x"), (3, "a b", None, "x"), (4, "t " * 100_000, "s", "x")]
    out = mixing.mix(mixing.described(spark.createDataFrame(rows, schema))).collect()
    assert len(out) == 5 and all(0 <= r["probability"] <= 1 for r in out)
    with pytest.raises(ValueError):
        mixing.mix(mixing.described(spark.createDataFrame(rows, schema)), mixing.MixParams(max_cells=1))


def test_calibration_caps_at_one():
    tokens, weight = np.array([10, 10, 80]), np.array([9.0, 1.0, 0.1])
    p = mixing.calibrated(tokens, weight, 50)
    assert p.max() == 1 and abs((p * tokens).sum() - 50) < 1e-9
    assert p[0] == p[1] == 1 and p[2] == pytest.approx(30 / 80)


# ---- packing


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    r = random.Random(1)
    texts = [x["text"] for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["", " ", "  a  b\n\n c \t", "I'll don't '!'s ''s 's'song", "日本 é <|endoftext|>", "x" * 3000, "\x85\x1c\xa0 a"]
    texts += ["".join(r.choice(" '\n\tsltrevmdab1²½.!é\x1c\x85\xa0") for _ in range(r.randint(0, 25))) for _ in range(1500)]
    for text, ids in zip(texts, packing.WordEncoder(VOCABULARY).encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    encoder = packing.WordEncoder(VOCABULARY, keep=10)
    encoder.AT_ONCE = 40
    assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_beyond_latin_scripts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    r = random.Random(3)
    known = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    texts = ["Don’t — “stop” 10 € now…", "हिन्दी का पाठ। १२३", "漢字" * 900, "🙂🙂 ok\u3000\u2003x", "\ufeff\x00a\x00"]
    texts += ["".join(r.choice(known if r.random() < 0.4 else " \n'sa1.é—’") for _ in range(40)) for _ in range(3000)]
    texts += [f"a{c}1{c} {c}" for c in r.sample(known, 3000)]
    encoder = packing.WordEncoder(VOCABULARY)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_ids_of_long_texts_with_blank_lines():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    r = random.Random(2)
    texts = ["a b.\n\nNext line\nmore\n \n\nwords 1\r\n2\n\x1c\n3 " * 30, "日本\n\nNext\nline " * 40]
    texts += ["".join(r.choice(["\n", "\n", " ", "a", "Bc", "1", ".", "\r", "\t", "\xa0", "\x85", "'s"]) for _ in range(400)) for _ in range(200)]
    encoder = packing.WordEncoder(VOCABULARY)
    encoder.AT_ONCE = 20
    assert all(len(list(encoder._parts(t))) > 1 for t in texts[:2])
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_bins_are_few_and_whole():
    r = random.Random(4)
    for n, top in ((12, 100), (60, 70), (400, 100), (30, 40)):
        sizes = [r.randint(1, top) for _ in range(n)]
        bins = packing.pack_histogram(dict(Counter(sizes)), 100)
        held = Counter()
        for times, bin_ in bins:
            assert sum(bin_) <= 100
            for x in bin_:
                held[x] += times
        assert held == Counter(sizes)
        report = {}
        packing.pack_histogram(dict(Counter(sizes)), 100, report=report)
        assert report["bins"] == sum(t for t, _ in bins) <= report["least"] + 1
    assert sum(t for t, _ in packing.pack_histogram({60: 2, 40: 2, 50: 2}, 100)) == 3
    assert packing.pack_histogram({}, 100) == []


def fewest(sizes, size):
    """The least number of bins, by trying everything."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, size - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_small_packings_are_the_best():
    r = random.Random(6)
    for _ in range(150):
        sizes = [r.randint(1, r.choice([20, 12, 9])) for _ in range(r.randint(1, 9))]
        best = fewest(sizes, 20)
        assert sum(t for t, _ in packing.pack_histogram(dict(Counter(sizes)), 20)) == best >= packing.fewest_bins(dict(Counter(sizes)), 20), sizes


def check_pieces(rows, lengths, size):
    """Each document's pieces follow one another, and each sequence is filled without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, n in lengths.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(by_doc[doc])):
            assert (piece, start) == (k, at) and (length == size or k == 0)
            at += length
        assert at == n
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_documents_are_packed_tight(spark):
    texts = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{SMALL}/documents.parquet").collect())] + [(900, None), (901, ""), (902, "a " * 9000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, length string")
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    encoder = packing.WordEncoder(VOCABULARY)
    lengths = {i: len(x) + 1 for (i, _), x in zip(texts, encoder.encode([t or "" for _, t in texts]))}
    assert check_pieces(rows, lengths, 2048) <= -(-sum(lengths.values()) // 2048) + 1
    first = next(r for r in rows if r["doc_id"] == 901)
    assert first["ids_crc32"] == zlib.crc32(bytes(4))
    assert packing.pack_documents(docs.where("false"), VOCABULARY).collect() == []


def test_repeated_rows_are_packed_each(spark):
    rows = packing.pack_documents(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string"), VOCABULARY).collect()
    assert sorted(r["offset"] for r in rows) == [0, 2, 4]


# ---- the pipeline


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "pii", "mix", "pack"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SMALL)
        after = after.cache()
        if name != "pack":
            assert after.columns == docs.columns and {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        if name == "quality":
            kept = {r["doc_id"] for r in after.collect()}
            good = [d for d, q in labels.items() if q == 1]
            assert np.mean([d in kept for d in good]) > 0.95 and np.mean([d not in kept for d, q in labels.items() if q == 0]) > 0.8
        if name == "near_dedup":
            texts = [r["text"] for r in after.collect()]
            assert len(set(texts)) == len(texts)
            assert {r["text"] for r in before.collect()} and len(texts) >= 0.5 * before.count()
        if name == "pii":
            assert after.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        before = after
    check_pieces(before.collect(), {}, 2048)


def test_stages_of_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality_score double, row string, n_tokens int, weight string, base int, added int"
    rest = (1.0, "r", 1, "w", 1, 1)
    good = "The river ran past the old mill and the children walked to the school in the morning light, as they did every day of the week. " * 4
    rows = [(None, good, None, None, None, *rest), (1, None, "en", "s", 0, *rest), (2, "", "en", "s", 0, *rest), (3, good, "en", "s", 5, *rest), (3, good, "en", "s", 5, *rest), (4, good * 3000, "en", "s", 5, *rest)]
    for table in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SMALL)
            assert out.columns == table.columns and out.schema["text"].dataType == table.schema["text"].dataType, name
            out.collect()
        assert corpus_pipeline.pack(spark, table, SMALL).count() >= table.count()


def test_run_leaves_its_result_alone(spark):
    import glob

    from scriptorium.llm import storage

    folder = storage.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/scriptorium-*"))
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() and len(set(glob.glob(f"{folder}/scriptorium-*")) - before) == 1


def test_dedup_stage_keeps_rows_without_an_id(spark):
    rows = [(1, "one two three four five six", "en", "s", 1), (1, "one two three four five six", "en", "s", 1), (2, "one two three four five six", "en", "s", 1), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or -1) for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()) == [-1, 1]
