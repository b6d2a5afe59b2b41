"""Media columns: payloads as WAV sound, read by the ``wave`` module, with spectral-peak pair fingerprints.

A sound is cut into frames, each frame goes through a short-time Fourier transform, the strongest bin of each band
that stands out of its frame is a peak, and each peak is paired with the peaks of the next few frames. A pair
``(bin, later bin, frames between)`` is one integer; the pairs of a sound are a time-coded array of
``(frame, code)``. Long sounds go through in blocks of frames, so that beside a block only one row's sound and pairs are in
memory (8 bytes a pair, up to 0.6 pairs a sample), and rows leave in batches of bounded size.

Defined results: a null text is taken as empty, and an empty payload is 64 zero bytes. Silence has no peaks and
an empty array. Equal payloads have equal results, so do repeated rows. A null ``doc_id`` keeps its row. An empty table
gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import BATCH_BYTES, bounded_batches

RATE, FRAME, HOP, FAN, BLOCK_FRAMES = 8000, 256, 128, 3, 4096
#: Bounds of the bands of bins in which a frame's peaks are sought; bin 0, the mean, is in none.
BANDS = (1, 8, 20, 45, 80, 129)
#: A peak's magnitude is at least so many times the mean of its frame.
STANDS_OUT = 1.5


def padded(payload: bytes, multiple: int = 64) -> bytes:
    """The payload with zero bytes up to a positive multiple of ``multiple`` bytes."""
    return payload + bytes(max(multiple, -(-len(payload) // multiple) * multiple) - len(payload))


def to_wav(payload: bytes) -> bytes:
    """A mono WAV file with one 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples(stored: bytes) -> bytes:
    """The samples of a mono 8-bit WAV file."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit sound")
        return w.readframes(w.getnframes())


def peak_pairs(sound: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and codes of a sound's peak pairs, in order of frame, band, gap and later band."""
    parts = list(_pairs_by_block(sound))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _pairs_by_block(sound: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one block of frames after another. The peaks of the last ``FAN`` frames are carried to the next block."""
    data = np.frombuffer(sound, np.uint8)
    n = max(1, -(-max(0, len(data) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME).astype(np.float32)
    k = len(BANDS) - 1
    peak, clear, base = np.empty((0, k), np.int64), np.empty((0, k), bool), 0
    for at in range(0, n, BLOCK_FRAMES):
        count = min(BLOCK_FRAMES, n - at)
        part = data[at * HOP : (at + count - 1) * HOP + FRAME].astype(np.float32)
        part = np.pad(part, (0, (count - 1) * HOP + FRAME - len(part)), constant_values=128) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * window, axis=1))
        mean = power[:, 1:].mean(axis=1)
        best = np.stack([power[:, lo:hi].argmax(axis=1) + lo for lo, hi in zip(BANDS, BANDS[1:])], axis=1)
        height = np.take_along_axis(power, best, axis=1)
        peak = np.concatenate([peak, best])
        clear = np.concatenate([clear, (height >= STANDS_OUT * mean[:, None]) & (height > 1e-3)])
        due = len(peak) if at + count == n else max(0, len(peak) - FAN)  # frames whose partners are all known
        time, code, rank = [], [], []
        for gap in range(1, FAN + 1):
            last = min(due, len(peak) - gap)
            if last <= 0:
                break
            frame, one, two = np.nonzero(clear[:last, :, None] & clear[gap : gap + last, None, :])
            time.append(frame)
            code.append((peak[frame, one] << 20) | (peak[frame + gap, two] << 8) | gap)
            rank.append(((frame * k + one) * (FAN + 1) + gap) * k + two)
        if time:
            order = np.argsort(np.concatenate(rank), kind="stable")
            yield (np.concatenate(time)[order] + base).astype(np.int32), np.concatenate(code)[order].astype(np.int32)
        peak, clear, base = peak[due:], clear[due:], base + due


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, fingerprint array<struct<frame:int,code:int>>, media binary"
)


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Store each row's text as a sound, read it back, and describe it. ``media`` is null unless it is kept."""
    bounded_batches(docs.sparkSession)
    pair = pa.struct([("frame", pa.int32()), ("code", pa.int32())])

    def made(ids: list, rows: list[tuple], times: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        frame, code = (pa.array(np.concatenate(x)) for x in (times, codes))
        offsets = np.append(0, np.cumsum([len(t) for t in times]))
        prints = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([frame, code], fields=list(pair)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        *plain, media = zip(*rows)
        columns = [pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(plain, kinds)), prints, pa.array(media, pa.binary())]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint", "media"]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, times, codes, held = [], [], [], [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = value.as_py() or b""
                stored = to_wav(padded(raw))
                back = samples(stored)
                time, code = peak_pairs(back)
                ids.append(doc), times.append(time), codes.append(code)
                rows.append((len(raw), len(back), _hex(back), zlib.crc32(back[-64:]), len(stored), _hex(stored), stored if keep_media else None))
                held += 8 * len(time) + (len(stored) if keep_media else 0)
                if held > BATCH_BYTES:
                    yield made(ids, rows, times, codes)
                    ids, rows, times, codes, held = [], [], [], [], 0
            if ids:
                yield made(ids, rows, times, codes)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return some.mapInArrow(run, SCHEMA)


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
