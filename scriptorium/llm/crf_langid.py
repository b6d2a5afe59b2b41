"""Language identification of words in code-switched text by a linear-chain conditional random field.

Each word has affix, character n-gram and lexicon (whole word) features, hashed into one table of weights for each
language. Transitions between the languages of neighbouring words are learned with them, from streams of words that
switch between documents of different languages. Forward-backward gives every word's probability for each
language; a document's language is the one with the largest sum over its words that have letters.

Fitting takes at most ``max_docs`` rows, in the order of a hash of their id, of those with at most ``max_chars``
characters (documented bounds on the sample of rows; the texts of its rows are whole). Prediction covers every row and
whole texts. A text of over ``STRETCH`` characters goes through in stretches, twice: once from left to right for the
forward vectors at their bounds, and once from right to left with the backward vectors, so that the result is that of
one chain over the whole text while memory is bounded by a stretch.

Forward-backward runs over chunks of words in lockstep: products of transition matrices for each chunk, a scan over the
chunks of a document, then the words within the chunks. Feature sums are kept for each distinct word in a bounded cache.

Defined results: the language of a text that is null or has no letter is ``und`` with score 0. Documents without a
language or id aren't learned from; with nothing to learn from, every result is ``und`` with score 0. Ties go to the first
language by name. Repeated rows get equal results. A null ``doc_id`` keeps its row. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import bounded_batches

STRETCH = 4 << 20
CHUNK = 64
EDGE = np.uint64(0x110000)
_BLANK = re.compile(r"\s")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class CrfParams:
    max_docs: int = 1500
    max_chars: int = 20_000
    table_bits: int = 17
    steps: int = 60
    rate: float = 0.12
    decay: float = 2e-5
    sequence: int = 128
    seed: int = 3
    max_langs: int = 64


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray
    change: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(self.weights.tobytes() + self.change.tobytes()).hexdigest()


# ------------------------------------------------------------------------------------------------ features


def core(word: str) -> str:
    """A word in lower case without what is no letter at its ends."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def word_features(cores: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, row of the table) for each feature of each word."""
    shift = np.uint64(64 - bits)
    sizes = np.fromiter(map(len, cores), np.int64, len(cores)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    point = np.full(int(sizes.sum()), EDGE)
    inner = np.ones(len(point), bool)
    inner[starts] = inner[ends - 1] = False
    point[inner] = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(cores)), sizes)
    who, rows = [], []

    def add(words: np.ndarray, values: np.ndarray, salt: int) -> None:
        who.append(words)
        rows.append((((values ^ np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))) * _MIX) >> shift).astype(np.int64))

    gram = point * _MIX
    for n in (2, 3, 4):
        gram = (gram[:-1] ^ (gram[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + point[n - 1 :]
        inside = owner[: len(gram)] == owner[n - 1 :]
        add(owner[: len(gram)][inside], gram[inside], n)
        long = np.flatnonzero(sizes > n)
        add(long, gram[starts[long]], 10 + n)  # prefix
        add(long, gram[ends[long] - n], 20 + n)  # suffix
    with np.errstate(over="ignore"):
        at = np.arange(len(point), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64) + np.uint64(1)
        whole = np.add.reduceat(point * at * (at * _MIX | np.uint64(1)), starts) if len(cores) else np.empty(0, np.uint64)
    add(np.arange(len(cores)), whole, 30)  # the lexicon: a row that training did not touch weighs nothing
    return np.concatenate(who), np.concatenate(rows)


def _sums(who: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(who, weights[rows, k], n) for k in range(weights.shape[1])], axis=1)


# ------------------------------------------------------------------------------------------------ training


def fit(samples: list[tuple[str, list[str]]], params: CrfParams = CrfParams()) -> Crf:
    """Fit to (language, words) samples by full-batch Adam on the likelihood of streams that switch language."""
    langs = sorted({lang for lang, _ in samples})
    if len(langs) > params.max_langs:
        raise ValueError(f"more than {params.max_langs} languages")
    k = len(langs)
    weights, change = np.zeros((1 << params.table_bits, k)), np.zeros((k, k))
    random = np.random.default_rng(params.seed)
    parts = []
    for lang, words in samples:
        at = 0
        while at < len(words):
            size = int(random.integers(8, 81))
            parts.append((langs.index(lang), words[at : at + size]))
            at += size
    if k < 2 or not parts:
        return Crf(langs, weights.astype(np.float32), change)
    order = random.permutation(len(parts))
    index: dict[str, int] = {}
    stream = np.array([index.setdefault(w, len(index)) for i in order for w in parts[i][1]], np.int64)
    truth = np.array([parts[i][0] for i in order for _ in parts[i][1]], np.int64)
    size = min(params.sequence, len(stream))
    n = len(stream) // size * size
    stream, truth = stream[:n].reshape(-1, size), truth[:n].reshape(-1, size)
    who, rows = word_features([core(w) for w in index], params.table_bits)
    seen_change = np.zeros((k, k))
    np.add.at(seen_change, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    seen_word = np.stack([np.bincount(stream[truth == j], minlength=len(index)) for j in range(k)], axis=1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, change)]
    for step in range(1, params.steps + 1):
        scores = _sums(who, rows, weights, len(index))
        chance, moved = _marginals(scores[stream], change)
        expected = np.stack([np.bincount(stream.ravel(), chance[:, :, j].ravel(), len(index)) for j in range(k)], axis=1)
        slope = (seen_word - expected) / n
        per_row = np.stack([np.bincount(rows, slope[who, j], len(weights)) for j in range(k)], axis=1)
        for value, grad, m in ((weights, per_row - params.decay * weights / len(index), moments[0]), (change, (seen_change - moved) / n, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.98 * m[1] + 0.02 * grad**2
            value += params.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.98**step)) + 1e-9)
    return Crf(langs, weights.astype(np.float32), change)


def _marginals(scores: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals, and expected numbers of transitions, of sequences of equal length."""
    b, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(change - change.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ move) * e[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    moved = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        right = e[:, i + 1] * beta[:, i + 1]
        both = alpha[:, i, :, None] * move * right[:, None, :]
        moved += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        x = right @ move.T
        beta[:, i] = x / x.sum(axis=1, keepdims=True)
    chance = alpha * beta
    return chance / chance.sum(axis=2, keepdims=True), moved


# ------------------------------------------------------------------------------------------------ prediction


def marginals(
    e: np.ndarray, lengths: np.ndarray, move: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals of sequences that stand one after another in ``e`` (positive scores), exact for any length.

    A single sequence may be a stretch of a longer one: ``before`` is the forward vector of the word before it and
    ``after`` the backward vector of its last word. Also gives the backward vector of the word before the first one.
    """
    k = e.shape[1]
    chunks = -(-lengths // CHUNK)
    doc = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    size = np.minimum(CHUNK, lengths[doc] - nth * CHUNK)
    at = np.repeat(np.cumsum(lengths) - lengths, chunks) + nth * CHUNK
    order = np.argsort(-size, kind="stable")  # the longer chunks first: those still open are a prefix
    doc_o, nth_o, size_o, at_o = doc[order], nth[order], size[order], at[order]
    open_ = [int(np.searchsorted(-size_o, -t, "left")) for t in range(CHUNK)]  # chunks with more than t words
    first = nth_o == 0
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))

    def norm(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)

    if before is not None:
        first = np.zeros(len(order), bool)
    whole = np.tile(np.eye(k), (len(order), 1, 1))
    for t in range(CHUNK):
        n = open_[t]
        if not n:
            break
        now = whole[:n] @ move
        if t == 0:
            now[first[:n]] = whole[:n][first[:n]]
        now *= e[at_o[:n] + t][:, None, :]
        whole[:n] = now / now.sum(axis=(1, 2), keepdims=True)
    start, stop = np.ones((len(order), k)) / k, np.ones((len(order), k)) / k
    base = np.cumsum(chunks) - chunks
    if before is not None:
        start[place[0]] = before
    if after is not None:
        stop[place[len(order) - 1]] = after
    many = np.argsort(-chunks, kind="stable")
    for j in range(1, int(chunks.max(initial=0))):
        docs = many[: int(np.searchsorted(-chunks[many], -j, "left"))]
        here, before = place[base[docs] + j], place[base[docs] + j - 1]
        start[here] = norm(np.einsum("nk,nkl->nl", start[before], whole[before]))
    for j in range(int(chunks.max(initial=0)) - 2, -1, -1):
        docs = many[: int(np.searchsorted(-chunks[many], -(j + 1), "left"))]
        here, after = place[base[docs] + j], place[base[docs] + j + 1]
        stop[here] = norm(np.einsum("nkl,nl->nk", whole[after], stop[after]))
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = start
    for t in range(CHUNK):
        n = open_[t]
        if not n:
            break
        now = a[:n] @ move
        if t == 0:
            now[first[:n]] = a[:n][first[:n]]
        a = norm(now * e[at_o[:n] + t])
        alpha[at_o[:n] + t] = a
    last = at_o + size_o - 1
    beta[last] = stop
    for t in range(CHUNK - 2, -1, -1):
        n = open_[t + 1]
        if n:
            where = at_o[:n] + t
            beta[where] = norm((e[where + 1] * beta[where + 1]) @ move.T)
    return norm(alpha * beta), norm((e[:1] * beta[:1]) @ move.T).sum(axis=0)


def carried(e: np.ndarray, move: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """The forward vector of the last word of one sequence, of which ``before`` is that of the word before it."""
    k = e.shape[1]
    n = len(e) // CHUNK * CHUNK
    a = before
    if n:
        whole = np.tile(np.eye(k), (n // CHUNK, 1, 1))
        parts = e[:n].reshape(-1, CHUNK, k)
        for t in range(CHUNK):
            now = whole @ move
            if t == 0 and before is None:
                now[0] = whole[0]
            now = now * parts[:, t][:, None, :]
            whole = now / now.sum(axis=(1, 2), keepdims=True)
        a = np.ones(k) / k if a is None else a
        for w in whole:
            a = a @ w
            a = a / max(a.sum(), 1e-300)
    for row in e[n:]:
        a = row if a is None else (a @ move) * row
        a = a / max(a.sum(), 1e-300)
    return a


class WordScorer:
    """Scores of distinct words, remembered up to ``keep`` and then forgotten."""

    def __init__(self, model: Crf, keep: int = 300_000) -> None:
        self.model, self.keep = model, keep
        self.bits = int(len(model.weights)).bit_length() - 1
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.empty((0, len(self.model.langs)))
        self.letters = np.empty(0, bool)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positive scores by language and whether there are letters, for each word."""
        if len(self.index) > self.keep:
            self._forget()
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new))))
            cores = [core(w) for w in new]
            who, rows = word_features(cores, self.bits)
            sums = _sums(who, rows, self.model.weights, len(new))
            letters = np.fromiter(map(bool, cores), bool, len(cores))
            sums[~letters] = 0
            self.scores = np.concatenate([self.scores, np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -60, 0))])
            self.letters = np.concatenate([self.letters, letters])
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        return self.scores[at], self.letters[at]


_SCORERS: dict[str, WordScorer] = {}


def _scorer(model: Crf, name: str) -> WordScorer:
    """A worker process keeps one model's scorer from task to task."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = WordScorer(model)
    return _SCORERS[name]


def _stretches(text: str) -> Iterator[str]:
    """A text in parts of about ``STRETCH`` characters that end before white space."""
    at = 0
    while len(text) - at > STRETCH:
        m = _BLANK.search(text, at + STRETCH)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def label(texts: list[str], scorer: WordScorer, segments: bool = False) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, segments of words by language) of each text."""
    model = scorer.model
    k = len(model.langs)
    if not k:
        return [("und", 0.0, []) for _ in texts]
    move = np.exp(model.change - model.change.max())
    out: list[tuple[str, float, list[tuple[int, int, str]]]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= STRETCH // 4):
            size += len(texts[end])
            end += 1
        if size > STRETCH:
            out.append(_label_long(texts[at], scorer, move, segments))
        else:
            words = [t.split() for t in texts[at:end]]
            lengths = np.array([len(w) for w in words])
            e, letters = scorer([w for ws in words for w in ws])
            chance = marginals(e, lengths, move)[0] if len(e) else e
            owner = np.repeat(np.arange(len(words)), lengths)
            votes = np.stack([np.bincount(owner, chance[:, j] * letters, len(words)) for j in range(k)], axis=1)
            bounds = np.append(0, np.cumsum(lengths))
            for i, v in enumerate(votes):
                runs = _runs(chance[bounds[i] : bounds[i + 1]], 0, model.langs) if segments else []
                out.append((*_verdict(v, model.langs), runs))
        at = end
    return out


def _verdict(votes: np.ndarray, langs: list[str]) -> tuple[str, float]:
    total = float(votes.sum())
    return (langs[int(votes.argmax())], float(votes.max() / total)) if total > 0 else ("und", 0.0)


def _runs(chance: np.ndarray, offset: int, langs: list[str]) -> list[tuple[int, int, str]]:
    """(first word, word after the last, language) of each run of words with one likeliest language."""
    if not len(chance):
        return []
    best = chance.argmax(axis=1)
    cut = np.flatnonzero(np.r_[True, best[1:] != best[:-1]]).tolist()
    return [(a + offset, b + offset, langs[best[a]]) for a, b in zip(cut, [*cut[1:], len(best)])]


def _label_long(text: str, scorer: WordScorer, move: np.ndarray, segments: bool) -> tuple[str, float, list[tuple[int, int, str]]]:
    """One very long text, as one chain: stretch by stretch, forwards for the vectors at the bounds and then backwards."""
    parts = [p for p in _stretches(text) if p.split(None, 1)]
    before, counts, a = [], [], None
    for part in parts:
        words = part.split()
        before.append(a)
        counts.append(len(words))
        a = carried(scorer(words)[0], move, a)
    votes, runs, after = np.zeros(len(scorer.model.langs)), [], None
    for i in range(len(parts) - 1, -1, -1):
        e, letters = scorer(parts[i].split())
        chance, after = marginals(e, np.array([len(e)]), move, before[i], after)
        votes += (chance * letters[:, None]).sum(axis=0)
        if segments:
            mine = _runs(chance, sum(counts[:i]), scorer.model.langs)
            if runs and mine and mine[-1][2] == runs[0][2]:
                mine[-1] = (mine[-1][0], runs[0][1], runs[0][2])
                runs = runs[1:]
            runs = mine + runs
    return (*_verdict(votes, scorer.model.langs), runs)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, params: CrfParams = CrfParams()) -> Crf:
    """Fit on rows with a language whose crc32 of the id as text is no multiple of 5."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    some = some.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).where(F.length("text") <= params.max_chars)
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = F.broadcast(some.select("doc_id").orderBy(*order).limit(params.max_docs).distinct())  # at most max_docs ids
    rows = some.join(ids, "doc_id").orderBy(*order, "lang", "text").limit(params.max_docs).collect()
    return fit([(r["lang"], [w for w in r["text"].split() if core(w)]) for r in rows], params)


def identify(docs: DataFrame, model: Crf, segments: bool = True) -> DataFrame:
    """``doc_id, lang_pred, score, segments`` of each row's whole text; segments are ranges of white-space words."""
    bounded_batches(docs.sparkSession)
    name = model.digest()
    part = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model, name)
        for batch in batches:
            rows = label([t or "" for t in batch.column(1).to_pylist()], scorer, segments)
            found = [[{"first": a, "last": b - 1, "lang": lang} for a, b, lang in r[2]] for r in rows]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array(found, pa.list_(part))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "segments"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return some.mapInArrow(run, "doc_id long, lang_pred string, score double, segments array<struct<first:int,last:int,lang:string>>")
