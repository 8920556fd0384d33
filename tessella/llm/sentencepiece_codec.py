"""SentencePiece models on the tokenizers library: the model's protobuf is read field by field, and normaliser, white-space
marker, scores (unigram) or merges (BPE) and byte fallback are rebuilt.

Texts are cut where no piece of the vocabulary spans two neighbouring characters; no segmentation crosses such a place, so
distinct parts are encoded once, in batches over several threads. This holds for models with byte fallback and without a
normaliser of their own; others are encoded text by text. `parity` compares with the sentencepiece library.

Nulls and edges: null text counts as empty (no ids, decodes to an empty text); a null id is passed on; rows are encoded one by
one, so repeated rows get equal results; very long texts are encoded whole, in blocks of parts; an empty table gives an empty result; other columns are ignored. Invalid UTF-8 among decoded bytes becomes U+FFFD.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, column, ragged, small, strings, text_buffer
from .tokens import vocabulary

MARK = "▁"
_MARK = MARK.encode()
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # piece types of the format
THREADS = 2
#: Distinct parts that a codec remembers; beyond that it starts anew.
REMEMBERED = 300_000


def _fields(data: bytes):
    """(number, value) of a protobuf message: integers, or the bytes of what is fixed in width or has a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = data[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
        if size is None:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    suffix: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                m.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                if f.get(3, 1) not in (1, 2):
                    raise ValueError("only unigram and BPE models")
                m.unigram, m.suffix, m.byte_fallback, m.unk_id = f.get(3, 1) == 1, bool(f.get(24, 0)), bool(f.get(35, 0)), f.get(40, 0)
            elif number == 3:
                f = dict(_fields(value))
                m.charsmap, m.dummy_prefix, m.remove_spaces = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        if m.suffix:
            raise ValueError("white space as suffix is not supported")
        return m

    def tokenizer(self, normalise: bool = True):
        """The tokenizers-library form; without normaliser for parts that are normalised already."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        names = [p for p, _, _ in self.pieces]
        vocab = {p: i for i, p in enumerate(names)}
        if self.unigram:
            least = min(s for _, s, _ in self.pieces) - 1e6  # control pieces never win over characters
            tok = Tokenizer(models.Unigram([(p, s if t in (NORMAL, USER) else least) for p, s, t in self.pieces], self.unk_id, self.byte_fallback))
        else:
            merges = []
            for p, s, t in self.pieces:
                if t in (NORMAL, USER):
                    merges += [(-s, vocab[p], i, (p[:i], p[i:])) for i in range(1, len(p)) if p[:i] in vocab and p[i:] in vocab]
            merges.sort()
            tok = Tokenizer(models.BPE(vocab, [m for *_, m in merges], unk_token=names[self.unk_id], fuse_unk=True, byte_fallback=self.byte_fallback))
        if normalise:
            steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            if self.remove_spaces:
                steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
            steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
            tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        own = [AddedToken(p, normalized=True, special=False) for p, _, t in self.pieces if t == USER]
        if own:
            tok.add_tokens(own)
        tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return tok


class Codec:
    """Encodes and decodes Arrow arrays with one model."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        pieces = self.model.pieces
        self.whole, self.parts = self.model.tokenizer(), self.model.tokenizer(False)
        inner = {p[i : i + 2] for p, _, t in pieces if t in (NORMAL, USER) for i in range(len(p) - 1)}
        self.inner = inner
        self.cuts = self.model.byte_fallback and not self.model.charsmap and not self.model.remove_spaces and self.model.dummy_prefix
        self.cuts &= not any(t == USER for *_, t in pieces) and not any(b == MARK != a or "\n" in (a, b) or " " in (a, b) for a, b in inner)
        self.space = re.compile(rb" *[^ \n]+|\n| +")
        # what each id decodes to, and the byte pieces
        blobs = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_end = np.cumsum([len(b) for b in blobs])
        self.blob_len = np.array([len(b) for b in blobs], np.int64)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.cores: dict[str, np.ndarray] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _split(self, part: str) -> tuple[str, str]:
        """A part without its last punctuation, if a cut there is safe."""
        n = len(part)
        while n > 1 and not part[n - 1].isalnum() and part[n - 1] != MARK:
            n -= 1
        return (part[:n], part[n:]) if n < len(part) and part[n - 1 : n + 1] not in self.inner else (part, "")

    def _learn(self, fresh: list[bytes]) -> None:
        split = [self._split(w.decode().replace(" ", MARK)) for w in fresh]
        new = list(dict.fromkeys(x for pair in split for x in pair if x and x not in self.cores))
        for a in range(0, len(new), 8192):
            for x, e in zip(new[a : a + 8192], self.parts.encode_batch_fast(new[a : a + 8192], add_special_tokens=False), strict=True):
                self.cores[x] = np.array(e.ids, np.int32)
        got = [self.cores[a] if not b else np.concatenate([self.cores[a], self.cores[b]]) for a, b in split]
        flat = np.concatenate(got)
        n0 = len(self.place)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n0 + len(fresh) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[n0 + 1 : n0 + 1 + len(got)] = self.used + np.cumsum([len(x) for x in got])
        self.used += len(flat)
        self.place.update(zip(fresh, range(n0, n0 + len(fresh)), strict=True))

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 bounds of each text's."""
        data, bounds = buf.tobytes(), off.tolist()
        if not self.cuts:
            texts = [data[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)]
            got = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        if len(self.place) > REMEMBERED:
            self.clear()
        words: list[bytes] = []
        counts = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            # the marker itself in a text is no different from a space
            ws = self.space.findall(b" " + data[a:b].replace(_MARK, b" ")) if b > a else []
            counts.append(len(ws))
            words += ws
        get = self.place.get
        place = np.array([get(w, -1) for w in words], np.int64)
        miss = np.flatnonzero(place < 0).tolist()
        if miss:
            self._learn(list(dict.fromkeys(words[i] for i in miss)))
            place[miss] = [self.place[words[i]] for i in miss]
        lens = self.first[place + 1] - self.first[place]
        ids = self.ids[np.repeat(self.first[place], lens) + ragged(lens)]
        return ids, np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def encode(self, texts: pa.Array):
        """Yields (first text, ids, bounds) of each block of texts."""
        buf, off = text_buffer(texts)
        for i, j in blocks(off):
            yield i, *self.block(buf[off[i] : off[j]], off[i : j + 1] - off[i])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts; the space that the model put before each is taken off."""
        lens = self.blob_len[ids]
        src = np.repeat(self.blob_end[ids] - lens, lens) + ragged(lens)
        data = self.blob[src]
        off = np.concatenate([[0], np.cumsum(lens)])[at]
        if self.model.dummy_prefix and len(data):
            has = np.flatnonzero(off[1:] > off[:-1])
            lead = off[:-1][has]
            gone = lead[data[lead] == 32]
            keep = np.ones(len(data), bool)
            keep[gone] = False
            off = off - np.searchsorted(gone, off)
            data = data[keep]
        return data, off

    def text(self, data: np.ndarray, off: np.ndarray) -> pa.Array:
        try:
            x = strings(data, off)
            x.validate(full=True)
            return x
        except pa.ArrowInvalid:
            raw, b = data.tobytes(), off.tolist()
            return pa.array([raw[i:j].decode(errors="replace") for i, j in zip(b, b[1:], strict=False)], pa.string())

    def parity(self, path: str, texts: list[str]) -> list[int]:
        """Indexes of the texts that the sentencepiece library encodes or decodes otherwise."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        out = []
        for i, t in enumerate(texts):
            ((_, ids, at),) = self.encode(pa.array([t], pa.string()))
            if ids.tolist() != sp.encode(t) or self.text(*self.decode(ids, at))[0].as_py() != sp.decode(ids.tolist()):
                out.append(i)
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model, kept over tasks."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian, 4 bytes each), round_trip (do the ids decode to the text?)."""
    path = model or vocabulary("piece_bpe_32k.model")

    def run(batches):
        c = codec(path)
        for batch in small(batches):
            texts = column(batch, "text")
            buf, off = text_buffer(texts)
            for i, ids, at in c.encode(texts):
                n = len(at) - 1
                data, to = c.decode(ids, at)
                lens, want = np.diff(to), np.diff(off[i : i + n + 1])
                same = lens == want
                if same.all() and np.array_equal(data, buf[off[i] : off[i + n]]):
                    pass
                else:
                    raw, mine = buf.tobytes(), data.tobytes()
                    same = np.array([raw[off[i + k] : off[i + k + 1]] == mine[to[k] : to[k + 1]] for k in range(n)], bool)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": column(batch, "doc_id").slice(i, n),
                        "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]),
                        "round_trip": pa.array(same),
                    }
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id, text of ids (binary as `encode` gives; null counts as empty)."""
    path = model or vocabulary("piece_bpe_32k.model")

    def run(batches):
        c = codec(path)
        for batch in small(batches):
            lists = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in column(batch, "ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "text": c.text(*c.decode(np.concatenate([np.zeros(0, np.int64), *lists]), at))})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
