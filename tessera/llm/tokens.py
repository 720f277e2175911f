"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Texts up to CHUNK_BYTES are encoded whole. A longer one is cut into overlapping chunks, each encoded with byte offsets.
Two neighbours are spliced where both put a token boundary at the same proven stable place in their overlap. If the
overlap holds none, it is widened (doubled) until it does; if the whole chunk holds none, the chunk itself is doubled, so
a text is encoded about three times at most.

Why a place is stable: merges join neighbouring pieces into pieces of the vocabulary. If no piece holds the two
characters around a place next to each other, none spans it, so what stands left and right of it cannot influence each
other. These pairs of characters are read from the vocabulary once. A space and the space mark are one character here.
If the model's normaliser changes characters (its specification is read from the model), texts are encoded whole.

Defined cases: null counts as the empty text, which has no tokens; texts of any length are counted whole, with spaces or
without; bytes that are no UTF-8 count as replacement characters; repeated rows are counted each; an empty table gives
an empty result; no column but the text is read, whatever its name.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .common import utf8

MODEL = "piece_bpe_32k.model"
CHUNK_BYTES = 64 << 10
OVERLAP_BYTES = 1 << 10
LIMIT = 4096
_MARK = "▁"
_BITS = np.int64(21)  # a code point has 21 bits


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def keeps_characters(model: bytes) -> bool:
    """Whether a model's normaliser (field 3) has no character map (2), keeps spaces (4) and writes them as marks (5)."""
    own = dict(_fields(dict(_fields(model)).get(3, b"")))
    return not own.get(2, b"") and not own.get(4, 1) and bool(own.get(5, 1))


class PieceCounter:
    def __init__(self, path: str, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk_bytes, overlap_bytes
        self.stable = keeps_characters(m.serialized_model_proto())
        named = {i: m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        pieces = list(named.values())
        #: UTF-8 bytes of each token; 0 where that is unknown.
        self.bytes = np.array([len(named[i].replace(_MARK, " ").encode()) if i in named else int(m.is_byte(i)) for i in range(m.get_piece_size())], np.int64)
        self.pairs = np.unique(np.concatenate([self._pairs(self._points(p)) for p in pieces] or [np.zeros(0, np.int64)]))

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.replace(" ", _MARK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)

    @staticmethod
    def _pairs(points: np.ndarray) -> np.ndarray:
        return (points[:-1] << _BITS) | points[1:]

    def count(self, text: bytes) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[bytes]) -> list[int]:
        texts = [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in texts]
        short = [k for k, t in enumerate(texts) if len(t) <= self.chunk or not self.stable]
        out = [0] * len(texts)
        for k, ids in zip(short, self.model.encode([texts[k].decode() for k in short], num_threads=1) if short else []):
            out[k] = len(ids)
        for k in set(range(len(texts))) - set(short):
            out[k] = self._spliced(texts[k])
        return out

    def _starts(self, text: bytes, at: int, end: int) -> np.ndarray:
        """Where the tokens of text[at:end] begin, as offsets into text, in order."""
        part = text[at:end].decode()
        if _MARK not in part:
            sizes = self.bytes[np.array(self.model.encode(part), np.int64)]
            extra = int(sizes.sum()) - (end - at)  # 1: the mark that the library puts in front
            if len(sizes) and sizes.all() and extra in (0, 1):
                return at + np.maximum(np.cumsum(sizes) - sizes - extra, 0)
        found = self.model.encode(part, return_type="proto").pieces
        return at + np.fromiter((p.begin for p in found), np.int64, len(found))

    @staticmethod
    def _whole(text: bytes, at: int) -> int:
        """The next start of a character."""
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(text))

    def _places(self, text: bytes, at: int, end: int) -> np.ndarray:
        """Stable places after at and before end, both starts of characters."""
        points = self._points(text[at:end].decode())
        pairs = self._pairs(points)
        near = np.searchsorted(self.pairs, pairs)
        apart = np.ones(len(pairs), bool) if not len(self.pairs) else self.pairs[np.minimum(near, len(self.pairs) - 1)] != pairs
        raw = np.frombuffer(text[at:end], np.uint8)
        return (at + np.flatnonzero((raw & 0xC0) != 0x80)[1:])[apart]

    def _spliced(self, text: bytes) -> int:
        total, done, begin, end = 0, 0, 0, self._whole(text, self.chunk)
        left = self._starts(text, begin, end)
        while end < len(text):
            overlap, joint = self.overlap, None
            while joint is None:
                at = self._whole(text, max(begin, end - overlap))
                places = self._places(text, at, end)
                places = places[places > done]
                if len(places):
                    to = self._whole(text, min(len(text), end + self.chunk))
                    right = self._starts(text, at, to)
                    agreed = places[np.isin(places, left) & np.isin(places, right)]
                    joint = int(agreed[0]) if len(agreed) else None
                if joint is None and at <= begin:
                    break
                overlap *= 2
            if joint is None:  # no joint in the whole chunk: twice the chunk
                end = self._whole(text, min(len(text), begin + 2 * (end - begin)))
                left = self._starts(text, begin, end)
                continue
            total += int(np.searchsorted(left, joint) - np.searchsorted(left, done))
            done, begin, end, left = joint, at, to, right
        return total + int(len(left) - np.searchsorted(left, done))


_counters: dict[tuple, PieceCounter] = {}


def counter(path: str, chunk_bytes: int, overlap_bytes: int) -> PieceCounter:
    """One counter for each worker process."""
    key = path, chunk_bytes, overlap_bytes
    if key not in _counters:
        _counters[key] = PieceCounter(*key)
    return _counters[key]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_count(text: Column, path: str | None = None, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> Column:
    """Tokens of the text. path: a sentencepiece model that executors can read; by default the installed one's own place there."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path or model_path(), chunk_bytes, overlap_bytes)
        for batch in batches:
            yield pa.array(own.count_all([t or b"" for t in batch.to_pylist()]), pa.int64())

    return count(utf8(text))
