"""SimHash, vectors and components against brute force, with the cases that need a defined result."""

import random

import numpy as np
import pytest
import xxhash

from scriptorium.llm import buckets, simhash, similar
from scriptorium.llm.components import connected_components
from scriptorium.llm.embedding_dedup import near_duplicate_vectors

DOCS = "doc_id long, text string"


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    pieces = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in pieces) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(pieces))


def some_texts(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 3):
        part = out[i].split()
        part[r.randrange(len(part))] = "changed"
        out.append(" ".join(part))
    return [*out, out[0], out[0].upper(), "", None, "   ", "one", "one two", "ÀÉ straße\x0bÜber\u00a0x", "long " * 5000]


def test_fingerprint_is_the_plain_one():
    for text in some_texts():
        assert simhash.fingerprint((text or "").encode()) == [plain_fingerprint(text)]


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_near_duplicates_against_all_pairs(spark, block_rows):
    rows = list(enumerate(some_texts()))
    params = simhash.SimHashParams(block_rows=block_rows)
    prints = {i: plain_fingerprint(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    expected = components_of(prints, links)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, f0 string, rep long")
    got = simhash.near_duplicates(docs, params).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert {r["doc_id"]: r["f0"] % (1 << 64) for r in got} == prints


def test_near_duplicates_of_odd_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "zz"), (7, None)], DOCS)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 1), (1, 1), (1, 1), (7, 7)]
    # without an id, but as a bridge between those that have one
    near = simhash.SimHashParams(distance=64, segments=((1, 1),) * 64)
    assert {r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame([(None, "p q"), (5, "a b c"), (4, "x y z")], DOCS), near).collect()} == {4}


def test_segments_must_cover_and_find_all():
    with pytest.raises(ValueError):
        simhash.SimHashParams(segments=((32, 1),))
    with pytest.raises(ValueError):
        simhash.SimHashParams(segments=((32, 0), (32, 1)))


def test_wide_fingerprints_find_near_copies(spark):
    r = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"t{r.randrange(400)}" for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        words[50] = "other"
        rows.append((2 * i + 1, " ".join(words)))  # a similarity of 0.95 in five-word shingles
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), simhash.planned(len(rows))).collect()
    assert all(row["component_id"] == row["doc_id"] // 2 * 2 for row in got)


def shingles_of(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def by_similarity(rows, least=0.8):
    """Components of rows (id, text) by shingle similarity, over all pairs that share a shingle."""
    sets = {i: shingles_of(t) for i, t in rows}
    holders, links = {}, set()
    for i, s in sets.items():
        for p in s:
            holders.setdefault(p, []).append(i)
    for held in holders.values():
        links |= {(a, b) for x, a in enumerate(held) for b in held[x + 1 :]}
    blank = [i for i, s in sets.items() if not s]
    near = [(a, b) for a, b in links if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]
    return components_of(sets, near + list(zip(blank, blank[1:])))


def edited_texts(seed=7, n=150):
    """Texts of 3 to 300 words, and for each one copy with some words changed: similarities of all sizes."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"t{r.randrange(5000)}" for _ in range(r.choice([3, 6, 9, 20, 60, 300]))]
        out.append((2 * i, " ".join(words)))
        for _ in range(r.randint(0, max(1, len(words) // 15))):
            words[r.randrange(len(words))] = f"c{r.randrange(5000)}"
        out.append((2 * i + 1, " ".join(words)))
    line = " ".join(f"l{j}" for j in range(40))
    return [*out, (1000, line), (1001, f"{line} " * 6 + line), (1002, ""), (1003, None), (1004, line.upper())]


@pytest.mark.parametrize("block_rows", [256, 4])
def test_links_are_verified_against_all_pairs(spark, block_rows):
    rows = [*edited_texts(), *((2000 + i, f"{' '.join(f'h{j}' for j in range(100))} x{i} y{i % 7}") for i in range(40))]
    docs = spark.createDataFrame(rows, DOCS)
    found = docs.selectExpr("0L AS key", "doc_id AS node", "text")  # all are candidates of each other
    got = similar.verified(found, similar.SimilarParams(block_rows=block_rows)).collect()
    expected = by_similarity(rows)
    assert {r["node"]: r["component"] for r in got} == {i: c for i, c in expected.items() if i != c or list(expected.values()).count(c) > 1}


def test_dedup_stage_against_all_pairs(spark):
    import corpus_pipeline

    rows = edited_texts()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    expected = by_similarity(rows)
    ours, theirs = {r["doc_id"] for r in kept}, {i for i, c in expected.items() if i == c}
    assert theirs <= ours  # nothing is dropped without a link of 0.8
    assert len(ours - theirs) <= 1  # candidates of 0.8 are found with probability 0.994, nearer ones more surely


def test_plans_keep_their_recall_at_any_size():
    small, large = simhash.planned(1000), simhash.planned(10**10)
    assert small.segments == ((16, 1),) * 16 and small.words == 4
    assert large.segments[0][0] >= 27 and sum(w for w, _ in large.segments) <= 64 * large.words
    # by drawing: pairs that differ in the share of bits that a similarity of 0.8 leaves meet in some segment
    r = np.random.default_rng(3)
    for plan in (small, simhash.planned(10**8)):
        apart = r.random((4000, 64 * plan.words)) < simhash.APART
        bit, met = 0, np.zeros(len(apart), bool)
        for width, radius in plan.segments:
            bit += 64 - bit % 64 if bit % 64 + width > 64 else 0
            met |= apart[:, bit : bit + width].sum(axis=1) <= radius
            bit += width
        assert (met & (apart.sum(axis=1) <= plan.distance)).mean() > 0.985


def test_wide_plans_find_what_narrow_ones_find(spark):
    rows = edited_texts(9, 60)
    expected = {i for i, c in by_similarity(rows).items() if i == c}
    kept = similar.distinct_documents(spark.createDataFrame(rows, DOCS), near=simhash.planned(10**8)).collect()
    assert expected <= {r["doc_id"] for r in kept} and len(kept) <= len(expected) + 1


def test_dedup_of_odd_rows(spark):
    import corpus_pipeline

    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [
        (1, a, "z"), (1, a, "y"), (2, a, "y"), (3, b, "y"), (3, "another text of its own", "y"), (3, "a third text under this id", "y"), (None, a, "y"), (None, "words without an id here", "y"),
        (None, "words without an id here", "x"), (None, None, "y"), (None, "", "x"), (9, " ", "x"),
    ]
    schema = "doc_id long, text string, digest string, n long, node string, row string, key string"
    docs = spark.createDataFrame([(*r, 5, "c", "c", "c") for r in rows], schema)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or -1, r["text"] or "", r["digest"]) for r in out.collect())
    assert got == sorted([(1, a, "y"), (3, b, "y"), (3, "another text of its own", "y"), (3, "a third text under this id", "y"), (-1, "words without an id here", "x"), (9, " ", "x")])
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").collect() == []


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(300, 300), (400, 401), (401, 400), (None, 5)]
    edges += [(r.randrange(500, 900), r.randrange(500, 900)) for _ in range(150)]
    real = [(a, b) for a, b in edges if a is not None and a != b]
    expected = components_of({n for e in real for n in e}, real)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in got} == expected and len(got) == len(expected)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_labels_and_chains():
    labels = buckets.join_labels(np.arange(6), np.array([5, 4, 1]), np.array([4, 3, 0]))
    assert labels.tolist() == [0, 0, 2, 3, 3, 3]
    a, b = buckets.chained(np.arange(6) * 10, labels)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 10), (30, 40), (40, 50)]


@pytest.mark.parametrize("block_rows", [2048, 8])
def test_vectors_against_all_pairs(spark, block_rows):
    r = np.random.default_rng(0)
    base = r.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.1 * r.standard_normal((20, 16)), base[:5], np.repeat(base[:1], 30, 0) + 0.05 * r.standard_normal((30, 16)), base[3:4] * 7])
    x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    expected = components_of(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    rows = [(i, [float(v) for v in row], "c") for i, row in enumerate(x)]
    rows += [(900, None, "c"), (901, [0.0] * 16, "c"), (902, [float("nan")] * 16, "c"), (903, [], "c"), (904, [1.0, None], "c"), (905, [1.0, 1.0], "c"), (906, [float("inf")] * 16, "c")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, copies string")
    got = {row["vec_id"]: row for row in near_duplicate_vectors(docs, block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (int(near[i].sum()) - 1, expected[i], expected[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(900, 907))


def test_no_vectors(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
