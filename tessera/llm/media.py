"""Media columns: texts as 8-bit WAV samples, short-time Fourier transforms and spectral-peak pair fingerprints.

The payload is the text's UTF-8 bytes, padded with zero bytes to a positive multiple of UNIT. It is written as one
channel of 8-bit samples by the wave module and read back from the stored bytes. Peaks are the PEAKS strongest local
maxima of each frame's spectrum; each is paired with the peaks of the next SPAN frames. A fingerprint is an array of
(time, hash) with hash = (first bin, second bin, frames between).

Defined cases: null counts as the empty text, whose payload is UNIT zero bytes and which has no peaks; equal texts give
equal values, repeated rows too. Magnitudes are rounded before peaks are compared, ties go to the lower bin. Texts of
any length are read whole, in blocks of BLOCK frames; an empty table gives an empty result; no column but the text is
read, whatever its name.
"""
from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .common import utf8

UNIT, RATE, FRAME, HOP, PEAKS, SPAN = 64, 8000, 256, 128, 3, 3
#: Frames transformed at once; bounds memory for very long texts.
BLOCK = 4096
RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MARKS = "array<struct<time: int, hash: int>>"
_WINDOW = np.hanning(FRAME)


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of spectral peaks, by frame, then strength, then bin."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    frames, bins = [], []
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        part = x[first * HOP : (last - 1) * HOP + FRAME].astype(np.float64)
        part = np.pad(part, (0, (last - 1 - first) * HOP + FRAME - len(part)))
        stacked = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        m = np.round(np.abs(np.fft.rfft((stacked - stacked.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)), 3)
        top = np.zeros(m.shape, bool)
        top[:, 1:-1] = (m[:, 1:-1] > m[:, :-2]) & (m[:, 1:-1] >= m[:, 2:]) & (m[:, 1:-1] > 1)
        strength = np.where(top, m, 0)
        order = np.argsort(-strength, axis=1, kind="stable")[:, :PEAKS]
        has = np.take_along_axis(strength, order, axis=1) > 0
        f, k = np.nonzero(has)
        frames.append(f + first)
        bins.append(order[f, k])
    return np.concatenate(frames), np.concatenate(bins)


def fingerprint(samples: bytes) -> np.ndarray:
    """An array of (time, hash) pairs, by time and then hash."""
    f, b = peaks(samples)
    found = []
    for ahead in range(1, PEAKS * (SPAN + 1)):
        if ahead >= len(f):
            break
        apart = f[ahead:] - f[:-ahead]
        keep = (apart >= 1) & (apart <= SPAN)
        found.append(np.stack([f[:-ahead][keep], (b[:-ahead][keep] << 16) | (b[ahead:][keep] << 4) | apart[keep]], axis=1))
    out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return out[np.lexsort((out[:, 1], out[:, 0]))].astype("<i4")


def describe(text: bytes | None) -> tuple:
    text = text or b""
    media = to_wav(payload(text))
    back = from_wav(media)
    marks = fingerprint(back)
    return (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(),
            f"{len(marks)}:{hashlib.sha256(marks.tobytes()).hexdigest()}", marks)


def media_features(text: Column) -> Column:
    """A struct of RESULT for each text, and its fingerprint as a time-coded array; feature is that array's length and digest."""

    @F.arrow_udf(f"{RESULT}, fingerprint {MARKS}")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"long": pa.int64(), "string": pa.string()}
        names = [c.split() for c in RESULT.split(", ")]
        for batch in batches:
            rows = [describe(t) for t in batch.to_pylist()]
            columns = [pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(names)]
            yield pa.StructArray.from_arrays([*columns, _marks([r[-1] for r in rows])], [*(n for n, _ in names), "fingerprint"])

    return features(utf8(text))


def _marks(found: list[np.ndarray | None]) -> pa.Array:
    """Arrays of (time, hash) rows as a column of MARKS; None is null."""
    ends = np.cumsum([0] + [0 if m is None else len(m) for m in found]).astype(np.int32)
    flat = np.concatenate([m for m in found if m is not None] or [np.zeros((0, 2), "<i4")])
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1], pa.int32())], ["time", "hash"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs, mask=pa.array([m is None for m in found]))


def media_column(text: Column) -> Column:
    """The stored WAV bytes."""

    @F.arrow_udf("binary")
    def store(texts: pa.Array) -> pa.Array:
        return pa.array([to_wav(payload(t or b"")) for t in texts.to_pylist()], pa.binary())

    return store(utf8(text))


def fingerprint_column(media: Column) -> Column:
    """The time-coded array of stored WAV bytes."""

    @F.arrow_udf(MARKS)
    def marks(batch: pa.Array) -> pa.Array:
        return _marks([None if m is None else fingerprint(from_wav(m)) for m in batch.to_pylist()])

    return marks(media)
