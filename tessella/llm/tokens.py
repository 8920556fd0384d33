"""Token ids of whole texts, by the tokenizers library, with each distinct word encoded once.

A word is a maximal run of bytes other than space and tab to CR. The tokenizer's normaliser, pre-tokenizer and model never
join across such white space, so the ids of a text are those of its words in order; `WordEncoder.verify` holds this
against encoding whole texts.
"""

from __future__ import annotations

import os
import string
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .arrays import blocks, ragged, text_buffer

#: Distinct words that an encoder remembers; beyond that it starts anew.
REMEMBERED = 600_000
_TAIL = string.punctuation.encode()
#: A byte-level vocabulary writes the bytes that are not printable in Latin-1 as the letters from U+0100 on.
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ragged(NamedTuple):
    flat: np.ndarray
    ends: np.ndarray


class WordEncoder:
    """Encodes Arrow string arrays to ragged id arrays."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The library's model without normaliser and pre-tokenizer, if it takes runs of letters in byte-level form: their ids end where a word-end id stands.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        probe = ["the", "ntblere", "zqxjkv", "\u00e9l\u00e8ve", "\u00fcber\u00e4\u00df\u00f1"]
        self.clear()
        if not suffix or self._runs(probe).flat.tolist() != [i for x in probe for i in self.tokenizer.encode(x.capitalize() + ".", add_special_tokens=False).ids[:-1]]:
            self.letters = None

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)  # first id of each word; n + 1 used
        self.used = 0
        self.piece: dict[str | bytes, int] = {b"": 0}  # letter runs as str, punctuation and other words as bytes
        self.piece_ids: list[np.ndarray] = []
        self.piece_len: list[np.ndarray] = [np.zeros(1, np.int64)]

    def _runs(self, runs: list[str]) -> _Ragged:
        """Ids of runs of lower-case letters."""
        byte_form = [r if r.isascii() else r.encode().decode("latin-1").translate(_BYTE_LETTERS) for r in runs]
        got = self.letters.encode_batch_fast([" ".join(byte_form[a : a + 512]) for a in range(0, len(byte_form), 512)], add_special_tokens=False)
        flat = np.array([i for e in got for i in e.ids], np.uint32)
        cut = np.flatnonzero(self.ends[flat]) + 1
        if len(cut) != len(runs):
            raise ValueError("a run of letters is not one pre-token")
        return _Ragged(flat, cut)

    def _whole(self, words: list[bytes]) -> _Ragged:
        """Ids of each, by the whole tokenizer."""
        got = [e.ids for a in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[a : a + 4096]], add_special_tokens=False)]
        return _Ragged(np.array([i for x in got for i in x], np.uint32), np.cumsum([len(x) for x in got]).astype(np.int64))

    def _learn(self, fresh: list[bytes]) -> _Ragged:
        """Ids of new words. A run of letters with a tail of punctuation is two pieces: the pre-tokenizer splits it so in any case."""
        piece = self.piece
        runs: list[str] = []
        rest: list[bytes] = []
        n = len(piece)
        pairs = np.zeros((len(fresh), 2), np.int64)
        later: list[tuple[int, int, bytes]] = []
        for i, w in enumerate(fresh):
            core = w.rstrip(_TAIL)
            text = core.decode()
            if self.letters and text.isalpha() and (text.isascii() or max(text) < "\u0130"):  # letters of Latin-1: normalised by lower-casing, one pre-token
                key = text.lower()
                at = piece.get(key)
                if at is None:
                    at = piece[key] = n + len(runs)
                    runs.append(key)
                pairs[i, 0] = at
                if len(core) < len(w):
                    later.append((i, 1, w[len(core) :]))
            else:
                later.append((i, 0, w))
        n += len(runs)
        for i, k, w in later:
            at = piece.get(w)
            if at is None:
                at = piece[w] = n + len(rest)
                rest.append(w)
            pairs[i, k] = at
        for new, how in ((runs, self._runs), (rest, self._whole)):
            if new:
                got = how(new)
                self.piece_ids.append(got.flat)
                self.piece_len.append(np.diff(got.ends, prepend=0))
        self.piece_ids, self.piece_len = [np.concatenate([np.zeros(0, np.uint32), *self.piece_ids])], [np.concatenate(self.piece_len)]
        seg = pairs.ravel()
        size = self.piece_len[0]
        first = np.cumsum(size) - size
        lens = size[seg]
        flat = self.piece_ids[0][np.repeat(first[seg], lens) + ragged(lens)]
        return _Ragged(flat, np.cumsum(lens.reshape(-1, 2).sum(1)))

    def _add(self, fresh: list[bytes]) -> None:
        n0 = len(self.place)
        got = self._learn(fresh)
        self.place.update(zip(fresh, range(n0, n0 + len(fresh)), strict=True))
        while self.used + len(got.flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n0 + len(fresh) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.used : self.used + len(got.flat)] = got.flat
        self.first[n0 + 1 : n0 + 1 + len(fresh)] = self.used + got.ends
        self.used += len(got.flat)

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 bounds of each text's."""
        if len(self.place) > REMEMBERED:
            self.clear()
        data = buf.tobytes()
        bounds = off.tolist()
        words: list[bytes] = []
        counts = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            ws = data[a:b].split()
            counts.append(len(ws))
            words += ws
        get = self.place.get
        at = [get(w, -1) for w in words]
        place = np.array(at, np.int64)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            new = list(dict.fromkeys(words[i] for i in miss.tolist()))
            self._add(new)
            get = self.place.__getitem__
            place[miss] = [get(words[i]) for i in miss.tolist()]
        lens = self.first[place + 1] - self.first[place]
        ids = self.ids[np.repeat(self.first[place], lens) + ragged(lens)]
        upto = np.concatenate([[0], np.cumsum(lens)])
        return ids, upto[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def encode(self, texts: pa.Array):
        """Yields (first text, ids, bounds) of each block of texts."""
        buf, off = text_buffer(texts)
        for i, j in blocks(off):
            yield i, *self.block(buf[off[i] : off[j]], off[i : j + 1] - off[i])

    def verify(self, texts: list[str]) -> bool:
        whole = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        mine = [ids[a:b].tolist() for _, ids, at in self.encode(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:], strict=True)]
        return whole == mine


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary, kept over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Frees the worker's encoders and the words they remember; for work of another kind that needs the memory."""
    _ENCODERS.clear()


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    bounds = at + np.arange(len(at))
    out = np.empty(len(ids) + len(at) - 1, np.uint32)
    last = bounds[1:] - 1
    body = np.ones(len(out), bool)
    body[last] = False
    out[body] = ids
    out[last] = end
    return out, bounds


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


