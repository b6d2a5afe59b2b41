"""Best-fit packing of token sequences by bin completion.

Texts become token ids; longer ones than a sequence are cut. Only the lengths of the pieces matter for the packing,
and there are fewer lengths than tokens in a sequence, so the driver solves the problem on the histogram of lengths,
which is bounded whatever the corpus: it enumerates fillings around the largest length left, skips dominated ones,
takes each filling as often as the counts allow, prunes by the waste that the incumbent still permits, and starts
from the best-fit-decreasing solution as incumbent. The answer is a list of runs (a length's pieces from rank r0 to r1
go to such sequences), and each piece finds its run by its rank among the pieces of its length. Ranks come from
windows over (bucket of ids, length) and prefix sums of their counts, so no task holds all pieces of a hot length.

The search is bounded by ``nodes``, by the fillings tried for a bin, and by three branches for a bin, so the answer may hold
more bins than needed where the bound of ``fewest_bins`` isn't met; the log says both numbers.

Defined results: a null text is taken as empty (one piece: the end token). Repeated rows are packed each. A null
``doc_id`` is packed as any other. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import logging
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.storage import bounded_batches, materialise, scratch

_LOG = logging.getLogger(__name__)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ------------------------------------------------------------------------------------------------ token ids


class WordEncoder:
    """Ids by a byte-level BPE tokenizer, which never joins characters of two pre-tokens, so each pre-token is encoded once.

    Pre-tokens are found by vectorised comparisons of character classes. Only texts with characters that this Python's
    Unicode tables don't know go through the tokenizer as they are, as it may know them. Distinct pre-tokens
    are kept up to ``keep``, then forgotten.
    """

    LETTER, NUMBER, SPACE, OTHER, END, UNKNOWN = range(6)
    STOP = 0x110000
    AT_ONCE = 1 << 20
    #: Longer pre-tokens (in bytes) are merged by the tokenizer, whose merging doesn't take quadratic time.
    LONG = 400

    def __init__(self, path: str, keep: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = _merger(path)
        self.keep = keep
        self.classes = _character_classes()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.offsets, self.lengths, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= self.AT_ONCE):
                size += len(texts[end])
                end += 1
            if size > 4 * self.AT_ONCE:
                yield np.concatenate([x for part in self._parts(texts[at]) for x in self._encode([part])])
            else:
                yield from self._encode(texts[at:end])
            at = end

    def _parts(self, text: str) -> Iterator[str]:
        """Cuts a very long text where a pre-token must begin: at a letter or digit after a line end that follows no other white space."""
        at = 0
        while len(text) - at > self.AT_ONCE:
            m = re.compile(r"(?<=\S)\n(?=[A-Za-z0-9])").search(text, at + self.AT_ONCE)
            if not m:
                break
            yield text[at : m.end()]
            at = m.end()
        yield text[at:]

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        plain = [len(c) == 0 or int(c.max()) < 0x250 or not (self.classes[c] == self.UNKNOWN).any() for c in codes]
        fast = iter(self._fast([t for t, p in zip(texts, plain) if p], [c for c, p in zip(codes, plain) if p]))
        for text, p in zip(texts, plain):
            yield next(fast) if p else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _fast(self, texts: list[str], codes: list[np.ndarray]) -> list[np.ndarray]:
        if not texts:
            return []
        big = "\0".join(texts) + "\0"  # what stands between texts is no token
        stop = np.array([self.STOP], np.uint32)
        point = np.concatenate([x for c in codes for x in (c, stop)])
        starts = self._starts(point)
        kind = self.classes[point[starts]]
        is_end = kind == self.END
        bounds = np.append(starts, len(point))
        tokens = [big[a:b] for a, b in zip(bounds[:-1][~is_end].tolist(), bounds[1:][~is_end].tolist())]
        index = self._index(tokens)
        owner = np.cumsum(is_end)[~is_end]
        count = self.lengths[index]
        per_text = np.bincount(owner, count, len(texts)).astype(np.int64)
        total = np.cumsum(count)
        flat = np.repeat(self.offsets[index] - (total - count), count) + np.arange(total[-1] if len(total) else 0)
        ids = self.pool[flat]
        return np.split(ids, np.cumsum(per_text)[:-1])

    def _starts(self, point: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, by the tokenizer's own rule.

        A run of letters, numbers or other characters takes one blank before it; the rest of a run of white space is
        on its own, all in one at the end of a text; an apostrophe that begins a pre-token takes a contraction.
        """
        kind = self.classes[point]
        start = np.ones(len(point), bool)
        start[1:] = kind[1:] != kind[:-1]
        start[kind == self.END] = True
        after = np.flatnonzero((kind[1:] < self.END) & (kind[1:] != self.SPACE) & (kind[:-1] == self.SPACE)) + 1
        start[after - 1] = True
        start[after] = point[after - 1] != 32
        quote = np.flatnonzero((point == 39) & start)
        if len(quote):
            padded = np.append(point, [0, 0])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for q, size in [*zip(quote[short].tolist(), [2] * int(short.sum())), *zip(quote[long & ~short].tolist(), [3] * int((long & ~short).sum()))]:
                start[q + 1 : q + size] = False
                if kind[q + size] == self.LETTER:
                    start[q + size] = True
        return np.flatnonzero(start)

    def _index(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > self.keep or len(self.pool) > 8 * self.keep:
            self._forget()
        known = self.known
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if new:
            if self.merge:
                raw = [t.encode() for t in new]
                ids = [self.merge(b) if len(b) <= self.LONG else self.tokenizer.encode(t, add_special_tokens=False).ids for t, b in zip(new, raw)]
            else:
                ids = [e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            at = len(self.pool)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.offsets = np.append(self.offsets, at + np.cumsum(sizes) - sizes)
            self.lengths = np.append(self.lengths, sizes)
            self.pool = np.append(self.pool, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


def _character_classes() -> np.ndarray:
    """The class of every code point, and of ``WordEncoder.STOP``, by which the tokenizer's rule tells characters apart."""
    import unicodedata

    w = WordEncoder
    of = {"L": w.LETTER, "N": w.NUMBER}
    out = np.full(w.STOP + 1, w.OTHER, np.uint8)
    for i in range(w.STOP):
        kind = unicodedata.category(chr(i))
        out[i] = w.UNKNOWN if kind == "Cn" else of.get(kind[0], w.OTHER)
    for i in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[i] = w.SPACE
    out[w.STOP] = w.END
    return out


def _merger(path: str) -> Callable[[bytes], list[int]] | None:
    """The vocabulary's merges for a single pre-token, without the tokenizer's bookkeeping of offsets.

    Only for a byte-level vocabulary whose ids follow the order of its merges: there an id is a merge's rank, and
    tiktoken's merging of ranks gives the tokenizer's own ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], model["merges"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or any(vocab.get(c, 256) >= 256 for c in byte):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """A worker process keeps its encoder from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces_of(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of each row's whole text: cut from the end, so that only a first piece can be shorter than ``size``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            if not batch.num_rows:
                continue
            who, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    who.append(doc), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            long = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(piece, pa.int32()), *long], ["doc_id", "piece", "start", "length", "ids_crc32"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return some.mapInArrow(run, PIECES)


# ------------------------------------------------------------------------------------------------ bin completion


def pack_histogram(counts: dict[int, int], size: int, nodes: int = 20_000, report: dict | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Pack ``counts[length]`` pieces of each length into few bins of ``size``: a list of (times, lengths of a bin).

    ``nodes`` bounds the fillings looked at in the whole search; when they are spent, the incumbent is the answer.
    ``report`` gets the number of ``bins``, a bound on the ``least`` possible, and the ``nodes`` that were used.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    incumbent = _best_fit(counts, size)
    least = fewest_bins(counts, size)
    best = sum(t for t, _ in incumbent)
    budget = [nodes]
    found = _greedy_completion(dict(counts), size)
    if sum(t for t, _ in found) < best:
        incumbent, best = found, sum(t for t, _ in found)
    if best > least:
        found = _search(dict(counts), size, best, least, budget)
        if found is not None:
            incumbent = found
    if report is not None:
        report |= {"bins": sum(t for t, _ in incumbent), "least": least, "nodes": nodes - budget[0]}
    return incumbent


def fewest_bins(counts: dict[int, int], size: int) -> int:
    """A bound on how few bins can do (Martello and Toth's L2): their sum, once pieces that can't share a bin have theirs."""
    number, total = np.zeros(size + 2, np.int64), np.zeros(size + 2, np.int64)
    for length, n in counts.items():
        number[length] += n
        total[length] += n * length
    number, total = np.cumsum(number), np.cumsum(total)  # of pieces up to a length
    half = size // 2
    best = -(-int(total[size]) // size)
    for k in range(1, half + 1):
        alone = int(number[size] - number[half])  # each needs a bin of its own
        shared = int(number[size - k] - number[half]), int(total[size - k] - total[half])  # those with room for pieces of k and more
        rest = int(total[half] - total[k - 1]) - (shared[0] * size - shared[1])
        best = max(best, alone + max(0, -(-rest // size)))
    return best


def _greedy_completion(left: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Bin completion without branching: the first undominated filling with the least waste around the largest length."""
    out = []
    lengths = sorted(left, reverse=True)
    while lengths:
        top = lengths[0]
        left[top] -= 1
        fill = next(iter(_fillings(left, lengths, size - top, limit=1)), ())
        left[top] += 1
        out.append(_take(left, (top, *fill)))
        lengths = [x for x in lengths if left[x]]
    return out


def _take(left: dict[int, int], bin_: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Use a filling as often as the counts allow."""
    need: dict[int, int] = {}
    for x in bin_:
        need[x] = need.get(x, 0) + 1
    times = min(left[x] // n for x, n in need.items())
    for x, n in need.items():
        left[x] -= n * times
    return times, bin_


def _fillings(left: dict[int, int], lengths: list[int], gap: int, limit: int, looks: int = 4000) -> list[tuple[int, ...]]:
    """Fillings of ``gap`` by at most five pieces and then as many of one length as fit, least waste first, undominated.

    A filling to which another piece could be added is dominated, and so is one that has several pieces where one
    piece of their sum would do. Of fillings of one sum up to ``limit`` are kept, those with the largest pieces first.
    """
    usable = [x for x in lengths if x <= gap and left[x] > 0]
    if not usable:
        return [()]
    found: dict[int, list[tuple[int, ...]]] = {}
    seen = [0]
    have = set(usable)

    def keep(total: int, filling: tuple[int, ...]) -> None:
        mine = found.setdefault(total, [])
        if len(mine) < limit and filling not in mine:
            mine.append(filling)

    def go(at: int, room: int, held: tuple[int, ...]) -> bool:
        seen[0] += 1
        if room in have and left[room] > held.count(room):
            keep(gap, (*held, room))
            return True
        fits = [i for i in range(at, len(usable)) if usable[i] <= room and left[usable[i]] > held.count(usable[i])]
        if not fits or len(held) == 4:
            full, rest = held, room
            for i in fits:
                n = min(rest // usable[i], left[usable[i]] - full.count(usable[i]))
                full, rest = full + (usable[i],) * n, rest - usable[i] * n
            keep(gap - rest, full)
            return rest == 0
        for i in fits:
            go(i, room - usable[i], (*held, usable[i]))
            if seen[0] > looks or len(found.get(gap, ())) >= limit:
                break
        return gap in found

    go(0, gap, ())
    return [f for s in sorted(found, reverse=True) for f in found[s]][:limit]


def _search(left: dict[int, int], size: int, best: int, least: int, budget: list[int], width: int = 3) -> list[tuple[int, tuple[int, ...]]] | None:
    """Branch and bound over fillings; a branch ends when its waste leaves no room to beat the incumbent."""
    answer = None
    free = size * (best - 1) - sum(k * v for k, v in left.items())
    stack: list[tuple[dict[int, int], list, int]] = [(left, [], 0)]
    while stack and budget[0] > 0:
        now, done, waste = stack.pop()
        budget[0] -= 1
        lengths = sorted((x for x in now if now[x]), reverse=True)
        used = sum(t for t, _ in done)
        if not lengths:
            if used < best:
                answer, best = done, used
                free = size * (best - 1) - sum(k * v for k, v in left.items())
                if best <= least:
                    break
            continue
        top = lengths[0]
        now[top] -= 1
        options = _fillings(now, lengths, size - top, limit=width)
        now[top] += 1
        for fill in reversed(options):
            branch = dict(now)
            times, bin_ = _take(branch, (top, *fill))
            lost = waste + times * (size - sum(bin_))
            if lost <= free:
                stack.append((branch, [*done, (times, bin_)], lost))
    return answer


def _best_fit(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on the histogram: equal bins are filled alike as long as there are enough pieces."""
    import bisect

    open_: dict[int, list[list]] = {}
    rooms: list[int] = []
    closed: list[list] = []

    def put(times: int, bin_: tuple[int, ...]) -> None:
        room = size - sum(bin_)
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append([times, bin_])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                if n >= each:
                    put(n // each, (length,) * each)
                    n %= each
                else:
                    put(1, (length,) * n)
                    n = 0
                continue
            room = rooms[at]
            times, bin_ = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // length
            whole = min(times, n // each)
            if whole:
                put(whole, bin_ + (length,) * each)
                n -= whole * each
                if times > whole:
                    put(times - whole, bin_)
            else:
                put(1, bin_ + (length,) * n)
                n = 0
                if times > 1:
                    put(times - 1, bin_)
    closed = [x for xs in open_.values() for x in xs]
    return [(t, b) for t, b in closed]


# ------------------------------------------------------------------------------------------------ assignment


def runs_of(bins: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset, pieces per sequence) for each length of each filling."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for times, bin_ in bins:
        offset = 0
        for length in sorted(set(bin_), reverse=True):
            each = bin_.count(length)
            first = rank.get(length, 0)
            rank[length] = first + times * each
            out.append((length, first, rank[length], sequence, offset, each))
            offset += each * length
        sequence += times
    return out


def pack(pieces: DataFrame, size: int = 2048, nodes: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to token pieces: bins of at most ``size`` tokens, filled without gaps."""
    spark = pieces.sparkSession
    with scratch() as tables:
        table = materialise(pieces)
        histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
        if histogram and not 0 < min(histogram) <= max(histogram) <= size:
            raise ValueError("a piece is empty or longer than a sequence")
        report: dict = {}
        runs = runs_of(pack_histogram(histogram, size, nodes, report))
        _LOG.info("packed %d pieces into %d sequences, at least %d; %d nodes of %d", sum(histogram.values()), report["bins"], report["least"], report["nodes"], nodes)
        # a window's partition is a bucket of bounded size of the pieces of one length
        buckets = max(8, sum(histogram.values()) // 50_000)
        dealt = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
        counts = materialise(dealt.groupBy("bucket", "length").count())
        before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
        within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
        ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(base, ["bucket", "length"])
        ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")
        # a row for each of at most ``size`` lengths, with its runs, which the search's nodes bound: a proven bound
        by_length: dict[int, list] = {}
        for length, *run in sorted(runs):
            by_length.setdefault(length, []).append(tuple(run))
        schema = "length long, runs array<struct<r0: long, r1: long, seq: long, off: long, each: long>>"
        placed = ranked.join(F.broadcast(spark.createDataFrame(list(by_length.items()), schema)), "length")
        run = F.element_at("runs", F.size(F.filter("runs", lambda r: r["r0"] <= F.col("rank"))))
        placed = placed.withColumn("run", run)
        step = F.col("rank") - F.col("run.r0")
        return tables.result(placed.select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("run.seq") + F.floor(step / F.col("run.each"))).cast("long").alias("sequence_id"),
            (F.col("run.off") + step % F.col("run.each") * F.col("length")).cast("long").alias("offset"),
        ))


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, nodes: int = 20_000) -> DataFrame:
    """Tokenize, cut and pack the whole texts of ``docs``: one row for each piece."""
    return pack(pieces_of(docs, vocabulary, size, end_id), size, nodes)
