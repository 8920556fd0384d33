"""Vectorised text primitives over Arrow string buffers: words, hashes, gathers. No per-row Python strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: Random byte values and odd multipliers of the polynomial hashes (fixed: both sides of an exchange must agree).
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_WINDOW_BASE = U64(0xD1342543DE82EF95)
#: Those of a second word hash that shares nothing with the first.
_BYTE_2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE_2 = U64(0xA0761D6478BD642F)
#: Text handled at a time; blocks end between documents, so a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A column as one contiguous array."""
    x = batch.column(name)
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
        if isinstance(x, pa.ChunkedArray):
            x = pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)
    return x


def small(batches, rows: int = 2000):
    """Slices of Arrow batches, so that what is made of one stays small whatever the session's batch size; Spark bounds a batch's bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(off: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges [i, j) of documents of about `most` bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """Words (maximal runs of bytes other than space and tab to CR) of a block of documents."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        ns = ~_WS[buf]
        self.ns = ns
        n = len(buf)
        begins, ends = np.ones(n, bool), np.ones(n, bool)
        if n:
            begins[1:] = ~ns[:-1]
            begins[off[:-1][off[:-1] < n]] = True
            ends[:-1] = ~ns[1:]
            last = off[1:] - 1
            ends[last[last >= 0]] = True
        self.start = np.flatnonzero(ns & begins)
        self.end = np.flatnonzero(ns & ends) + 1
        #: Index of each document's first word, and the count of all at the end.
        self.first = np.searchsorted(self.start, off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return segment_hash(self.buf, self.start, self.end)

    def two_hashes(self) -> list[np.ndarray]:
        """Two independent hashes of each word."""
        return segment_hashes(self.buf, self.start, self.end, ((_BYTE, _BASE), (_BYTE_2, _BASE_2)))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of bytes of a kind, none across documents."""
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = off[:-1][off[:-1] < len(inside)]  # a document's first byte begins a run, its last ends one
    begins[at] |= inside[at]
    last = off[1:] - 1
    last = last[last >= 0]
    ends[last] |= inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, 1024), base, U64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= 1 << 21:
            _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def segment_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte segment: a polynomial over random byte values, mixed with the length."""
    return segment_hashes(buf, start, end, ((_BYTE, _BASE),))[0]


def segment_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, kinds) -> list[np.ndarray]:
    """segment_hash for each (byte values, base) of kinds."""
    if not len(start):
        return [np.zeros(0, U64) for _ in kinds]
    lens = end - start
    pos = ragged(lens)
    data = buf[np.repeat(start, lens) + pos]
    at = np.cumsum(lens) - lens
    full = lens > 0
    out = []
    for value, base in kinds:
        h = np.zeros(len(start), U64)
        h[full] = np.add.reduceat(value[data] * powers(base, int(lens.max()))[pos], at[full])
        out.append(mix(h + lens.astype(U64) * U64(0x2545F4914F6CDD1D)))
    return out


def ragged(lens: np.ndarray) -> np.ndarray:
    """0 ... lens[0] - 1, 0 ... lens[1] - 1, ..."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lens, lens)


def window_hash(h: np.ndarray, size: int, base: np.uint64 = _WINDOW_BASE) -> np.ndarray:
    """Rabin-Karp hash of every `size` consecutive values: differences of one prefix sum, scaled back to position 0."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    s = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(base, len(h)), out=s[1:])
    return mix((s[size:] - s[:-size]) * powers(U64(pow(int(base), -1, 2**64)), n))


def take_segments(buf: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, n: int, sep: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of n texts: the segments of each group (ascending group numbers) joined by the byte sep."""
    off = np.zeros(n + 1, np.int64)
    if not len(start):
        return np.zeros(0, np.uint8), off
    lens = end - start
    joined = np.ones(len(lens), bool)
    joined[-1] = False
    joined[:-1] = group[1:] == group[:-1]
    wide = lens + joined
    off[1:] = np.cumsum(np.bincount(group, wide, n)).astype(np.int64)
    src = np.repeat(start, wide) + ragged(wide)
    out = buf[np.minimum(src, len(buf) - 1)]
    out[(np.cumsum(wide) - 1)[joined]] = sep
    return out, off


def strings(data: np.ndarray, off: np.ndarray, kind=None) -> pa.Array:
    """An Arrow string (or binary) array over such bytes."""
    kind = kind or pa.string()
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
