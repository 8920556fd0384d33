"""Personal data: exact base patterns, and spans that a linear-chain conditional random field over word shapes adds.

The field has a state per kind and one for ordinary words. A word's features are its shape, a few cue words, and those of its
neighbours. It is trained on a small labelled table (`labelled_lines` unless another is given) and decoded by Viterbi in numpy
batches. Ordinary words far from any word with a digit, an @ or a cue all have the same few feature sets; training proves that
no path leaves the ordinary state there (`Field.settled`), so only the words around the others are decoded, with the same result
as decoding every line whole.

Nulls and edges: null text counts as empty and has no spans (`mask_pii` leaves it null); a null id is passed on; rows are read one by one, so
repeated rows get equal results; an empty table gives an empty result; other columns are ignored, whatever they are called. Very long texts are
read whole: patterns, field and the merging of spans take time linear in the text.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, blocks, column, small, text_buffer
from .spans import SPANS, Points, outside

KINDS = ("email", "ip", "card", "phone")
STATES = ("O", *KINDS)
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match of four digit runs starts at the start of a run and ends at the end of one
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[^0-9]+")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: bytes):
    """A match starts where the run of local characters before an @ starts, but not inside the match before."""
    done, at = 0, text.find(b"@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield a, m.end()
            done = m.end()
            at = text.find(b"@", done)
        else:
            done = at + 1  # no match can hold this @, and none after it starts before it
            at = text.find(b"@", done)


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (x.lstrip(b"0") for x in m[0].split(b"."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _DIGITS.sub(b"", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if b"+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub(b"", m[0])) <= 15]
    return out


# ---- the field ----

BUCKETS = 1 << 12
CUES = ("at", "(at)", "[at]", "{at}", "dot", "(dot)", "[dot]", "{dot}", "tel", "tel:", "phone", "phone:", "call", "mobile:", "fax:", "card", "card:", "visa", "e-mail:", "email:", "mail:", "ip", "ip:", "com", "org", "net", "edu", "io", "de", "fr", "uk")
#: An "at" in brackets within a word.
_GLUED = (b"(at)", b"[at]", b"{at}")
REACH = 2
#: The weights of a plain word among plain ones are learned last, with a softmax margin: where such a word is ordinary, every kind's score is
#: raised by so much, so that they keep the ordinary state ahead by it. What labels say of such words decides whether `Field.settled` holds.
MARGIN, MARGIN_EPOCHS = 12.0, 4
_TRIM = b".,;:!?\"')]}>"
_OPEN = b"\"'([{<"


def features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word's own features: shape with run lengths, coarse shape, cue. Only short words are remembered, by the same rule."""
    return _remembered(word) if len(word) <= 64 else _features(word)


def _features(word: bytes) -> tuple[int, ...]:
    low = word.lower()
    core = low.strip(_TRIM + _OPEN)
    has_digit = any(48 <= c < 58 for c in core)
    if low.decode(errors="replace") in CUES or core.decode(errors="replace") in CUES:
        names = ["cue=" + core.decode(errors="replace")]
    elif any(g in core for g in _GLUED):
        names = ["glued", "glued-dot" if b"." in core or b"dot" in core else "glued-open"]
    elif not has_digit and b"@" not in core:
        names = ["plain"]
    else:
        shape = re.sub(rb"[0-9]+", lambda m: b"d%d" % min(len(m[0]), 20), re.sub(rb"[a-z\x80-\xff]+", b"x", core))
        n = sum(48 <= c < 58 for c in core)
        names = ["shape=" + shape.decode(errors="replace"), f"digits={min(n, 20)}", "coarse=" + re.sub(rb"[0-9]+", b"d", shape).decode(errors="replace")]
    return tuple(_bucket(x) for x in names)


def _bucket(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


_remembered = lru_cache(100_000)(_features)


def interesting(word: bytes) -> bool:
    return features(word) != _PLAIN


_PLAIN = (_bucket("plain"),)
#: Digits that a span found by the field alone must hold; a card's must pass Luhn as well.
PLAUSIBLE = {"email": (0, 64), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}


def labelled_lines(n: int = 2000, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: lines of ordinary words and numbers with personal data in plain and in disguised forms."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    end = lambda: rng.choice(["com", "org", "net", "edu", "io", "de", "fr", "uk"])
    forms = {
        "email": [
            lambda: [f"{name()}{d(rng.randrange(3))}@{name()}.{end()}"],
            lambda: [name(), rng.choice(["(at)", "[at]", "{at}"]), name(), rng.choice(["dot", "(dot)", "[dot]", "{dot}"]), end()],
            lambda: [name(), "at", name(), "dot", end()],
            lambda: [name(), rng.choice(["(at)", "[at]", "{at}"]), f"{name()}{rng.choice(['', '-' + name()])}.{end()}"],
            lambda: [f"{name()}.{name()}{rng.choice(['(at)', '[at]', '{at}'])}{name()}.{end()}"],
            lambda: [f"{name()}{rng.choice(['(at)', '[at]', '{at}'])}{name()}{rng.choice(['(dot)', '[dot]', '{dot}'])}{end()}"],
            lambda: [name(), "dot", name(), "at", name(), "dot", end()],
            lambda: [name(), "dot", name(), "at", name(), "dot", end()],
        ],
        "ip": [lambda: [".".join(str(rng.randrange(256)) for _ in range(4))]],
        "card": [lambda: [d(4) for _ in range(4)], lambda: ["-".join(d(4) for _ in range(4))], lambda: [".".join(d(4) for _ in range(4))]],
        "phone": [
            lambda: ["+" + d(2), d(3), d(7)],
            lambda: [f"+{d(2)}-{d(3)}-{d(4)}"],
            lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"],
            lambda: [f"{d(3)}-{d(3)}-{d(4)}"],
            lambda: [f"{d(1)}-{d(3)}-{d(3)}-{d(4)}"],
            lambda: [f"{d(3)}.{d(3)}.{d(4)}"],
            lambda: ["0" + d(3), d(3), d(4)],
            lambda: ["0" + d(2), d(4), d(4)],
            lambda: [f"0{d(3)}/{d(rng.randrange(6, 9))}"],
            lambda: [f"(0{d(rng.randrange(2, 4))})", d(rng.randrange(6, 8))],
        ],
    }
    cue = {"email": ["mail:", "e-mail:", "email:"], "ip": ["ip", "ip:"], "card": ["card", "visa", "card:"], "phone": ["tel:", "tel", "phone", "phone:", "call", "fax:", "mobile:"]}
    plain = [
        lambda: [d(rng.randrange(1, 7))], lambda: [f"{d(2)}.{d(2)}.{d(4)}"], lambda: [f"{d(4)}-{d(2)}-{d(2)}"], lambda: [f"{d(1)}.{d(2)}"], lambda: [f"{name()}{d(2)}"], lambda: [d(rng.randrange(8, 20))],
        lambda: [f"v{d(1)}.{d(1)}.{d(1)}"], lambda: [f"{d(2)}:{d(2)}"], lambda: ["@" + name()], lambda: ["at"], lambda: ["at", name(), "at"], lambda: [name(), "at", name()], lambda: ["dot"], lambda: ["call"], lambda: ["card"], lambda: [d(2) + "%"], lambda: [d(1) + "," + d(3)],
        lambda: [d(20) + name()], lambda: [d(rng.randrange(20, 120))], lambda: [name() * 20 + d(3)], lambda: [rng.choice(["ip", "phone", "mail:"]), name()], lambda: [d(3), d(3)], lambda: [d(4), d(4)],
        lambda: [f"{d(3)}-{d(2)}-{d(4)}"], lambda: [f"{d(2)}.{d(1)}.{d(5)}.{d(rng.randrange(1, 4))}"], lambda: ["dot", "dot"], lambda: ["at", name(), "dot", "dot"], lambda: [f"{name()[:2].upper()}{d(2)}", *[d(4) for _ in range(4)], d(2)],
        lambda: [f"{d(4)}-{d(4)}"], lambda: [f"{d(2)}/{d(2)}/{d(4)}"], lambda: ["at", name(), "dot", name()], lambda: [name(), "at", name(), name(), "dot", name()], lambda: [name(), "dot", name(), "at", name()], lambda: [end()], lambda: [name() + "(" + name() + ")"], lambda: [f"{d(3)}.{d(3)}.{d(3)}"], lambda: [f"{d(4)}/{d(4)}"],
        lambda: ["-".join(d(4) for _ in range(3))], lambda: ["at", f"{d(2)}.{d(2)}", "dot", end()], lambda: [".".join(d(4) for _ in range(3))],
    ]
    out = []
    for _ in range(n):
        words: list[str] = []
        tags: list[str] = []
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(0, 7)
            words += [name().capitalize() if rng.random() < 0.2 else name() for _ in range(k)]
            tags += ["O"] * k
            x = rng.random()
            if x < 0.35:
                kind = rng.choice(KINDS)
                if rng.random() < 0.3:
                    words.append(rng.choice(cue[kind]))
                    tags.append("O")
                new = rng.choice(forms[kind])()
                if rng.random() < 0.3:
                    new[-1] += rng.choice(".,;")
                words += new
                tags += [kind] * len(new)
            elif x < 0.8:
                new = rng.choice(plain)()
                words += new
                tags += ["O"] * len(new)
        k = rng.randrange(0, 4)
        words += [name() for _ in range(k)]
        tags += ["O"] * k
        out.append((words, tags))
    return out


class Field:
    """Weights of a linear-chain conditional random field, in log space."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move  # (3 * BUCKETS + 1, states): of the word before, the word, the word after, a plain word among plain ones; (states, states)

    @staticmethod
    def rows(words: list[bytes]) -> list[list[int]]:
        f = [features(w) for w in words]
        out = []
        for i in range(len(f)):
            x = [BUCKETS + b for b in f[i]]
            if i:
                x += f[i - 1]
            if i + 1 < len(f):
                x += [2 * BUCKETS + b for b in f[i + 1]]
            if all(y == _PLAIN for y in f[max(0, i - 1) : i + 2]):
                x.append(3 * BUCKETS)
            out.append(x)
        return out

    def scores(self, words: list[bytes]) -> np.ndarray:
        rows = self.rows(words)
        at = np.cumsum([0, *map(len, rows)])
        return np.add.reduceat(self.emit[[b for x in rows for b in x]], at[:-1])

    @classmethod
    def train(cls, lines: list[tuple[list[str], list[str]]], epochs: int = 16, rate: float = 0.4, decay: float = 1e-4, seed: int = 3) -> Field:
        """Stochastic gradient (AdaGrad) on the conditional log-likelihood, by forward-backward over batches of padded lines;
        then the weights of plain words among plain ones alone, with the margin."""
        k = len(STATES)
        code = {s: i for i, s in enumerate(STATES)}
        data = []
        for ws, ts in lines:
            if ws:
                x = cls.rows([w.encode() for w in ws])
                data.append((np.array([b for r in x for b in r]), np.array([len(r) for r in x]), np.array([code[t] for t in ts])))
        emit, move = np.zeros((3 * BUCKETS + 1, k)), np.zeros((k, k))
        g_emit, g_move = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
        rng = np.random.default_rng(seed)
        for epoch in range(epochs + MARGIN_EPOCHS):
            late = epoch >= epochs
            if epoch == epochs:
                g_emit[-1] = 1e-6
            for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // 64)):
                batch = [data[i] for i in part]
                lens = np.array([len(y) for _, _, y in batch])
                b, longest = len(batch), int(lens.max())
                feats, per, gold = (np.concatenate([x[j] for x in batch]) for j in range(3))
                real = np.arange(longest) < lens[:, None]
                e = np.zeros((b, longest, k))
                first = np.cumsum(per) - per
                e[real] = np.add.reduceat(emit[feats], first)
                if late:
                    among = np.logical_or.reduceat(feats == 3 * BUCKETS, first) & (gold == 0)
                    e[real] += MARGIN * among[:, None] * (np.arange(k) > 0)
                fwd = np.empty_like(e)
                fwd[:, 0] = e[:, 0]
                for t in range(1, longest):
                    fwd[:, t] = np.where(real[:, t, None], _lse(fwd[:, t - 1, :, None] + move, 1) + e[:, t], fwd[:, t - 1])
                z = _lse(fwd[:, -1], 1)
                bwd = np.zeros_like(e)
                g = np.zeros_like(move)
                for t in range(longest - 2, -1, -1):
                    step = move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :]
                    on = real[:, t + 1]
                    bwd[:, t] = np.where(on[:, None], _lse(step, 2), bwd[:, t + 1])
                    g -= np.exp(fwd[:, t, :, None] + step - z[:, None, None])[on].sum(0)
                p = -np.exp(fwd + bwd - z[:, None, None])[real]
                p[np.arange(len(gold)), gold] += 1
                inner = np.ones(len(gold), bool)
                inner[np.cumsum(lens) - 1] = False
                at = np.flatnonzero(inner)
                g += np.bincount(gold[at] * k + gold[at + 1], minlength=k * k).reshape(k, k)
                rows = np.repeat(p, per, axis=0)
                ge = np.stack([np.bincount(feats, rows[:, j], len(emit)) for j in range(k)], 1)
                ge, g = ge / b - decay * emit, g / b - decay * move
                if late:
                    ge[:-1], g = 0, np.zeros_like(g)
                g_emit += ge**2
                g_move += g**2
                emit += rate * ge / np.sqrt(g_emit)
                move += rate * g / np.sqrt(g_move)
        return cls(emit, move)

    def settled(self) -> bool:
        """Does every path gain by giving a plain word among plain words the ordinary state, whatever stands around it?"""
        p = _PLAIN[0]
        gain = max((e[1:] - e[0]).max() for rows in ([p, 2 * BUCKETS + p], [p], [2 * BUCKETS + p], []) for e in [self.emit[[*rows, BUCKETS + p, 3 * BUCKETS]].sum(0)])
        into, out = self.move[:, 1:] - self.move[:, :1], self.move[1:] - self.move[:1]  # by the state before; by the state after
        return gain + max(into.max(), 0) + max(out.max(), 0) < 0

    def decode(self, lines: list[list[bytes]]) -> list[np.ndarray]:
        """Best states of each line, lines of like length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lines)
        order = sorted((i for i in range(len(lines)) if lines[i]), key=lambda i: len(lines[i]))
        a = 0
        while a < len(order):
            part = order[a : a + max(1, min(512, (1 << 16) // len(lines[order[a]])))]
            a += len(part)
            lens = np.array([len(lines[i]) for i in part])
            longest = int(lens.max())
            e = np.zeros((len(part), longest, len(STATES)))
            for r, i in enumerate(part):
                e[r, : lens[r]] = self.scores(lines[i])
            best = e[:, 0]
            back = np.zeros((len(part), longest, len(STATES)), np.int64)
            for t in range(1, longest):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(1)
                on = (t < lens)[:, None]
                back[:, t] = np.where(on, back[:, t], np.arange(len(STATES)))
                best = np.where(on, step.max(1) + e[:, t], best)
            state = best.argmax(1)
            path = np.empty((len(part), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                path[:, t] = state
                state = back[np.arange(len(part)), t, state]
            for r, i in enumerate(part):
                out[i] = path[r, : lens[r]]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


@lru_cache(1)
def default_field() -> Field:
    return Field.train(labelled_lines())


_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789@")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[list(_TRIM + _OPEN)] = True


def _packed(words: list[bytes]) -> np.ndarray:
    return np.array(sorted(int.from_bytes(w, "little") for w in words), np.uint64)


_CUE_WORDS = _packed(sorted({c.encode().strip(_TRIM + _OPEN) for c in CUES}))


def _marked(w: Words) -> np.ndarray:
    """Words that are not plain to `features`: a digit, an @, or a cue within their edges."""
    upto = np.concatenate([[0], np.cumsum(_MARK[w.buf])])
    hit = upto[w.end] > upto[w.start]
    a, b = w.start.copy(), w.end.copy()
    for _ in range(2):  # cheap trim; longer edges are looked at by `features`
        a += (a < b) & _EDGE[w.buf[np.minimum(a, len(w.buf) - 1)]]
        b -= (a < b) & _EDGE[w.buf[np.maximum(b - 1, 0)]]
    odd = (a < b) & (_EDGE[w.buf[np.minimum(a, len(w.buf) - 1)]] | _EDGE[w.buf[np.maximum(b - 1, 0)]])
    low = _LOWER[w.buf].tobytes()
    for g in _GLUED:
        p = low.find(g)
        while p >= 0:
            k = int(np.searchsorted(w.start, p, "right")) - 1
            hit[k] |= k >= 0 and p + len(g) <= w.end[k]
            p = low.find(g, p + 1)
    n = b - a
    key = np.zeros(len(a), np.uint64)
    for k in range(8):
        on = k < n
        key[on] |= _LOWER[w.buf[a[on] + k]].astype(np.uint64) << np.uint64(8 * k)
    at = np.minimum(np.searchsorted(_CUE_WORDS, key), len(_CUE_WORDS) - 1)
    return hit | ((n <= 8) & (n > 0) & (_CUE_WORDS[at] == key)) | odd


def _line_starts(w: Words) -> np.ndarray:
    """Is each word the first of its line (or document)?"""
    upto = np.concatenate([[0], np.cumsum(w.buf == 10)])
    first = np.zeros(len(w.start), bool)
    if len(first):
        first[w.first[:-1][w.counts > 0]] = True
        first[1:] |= upto[w.start[1:]] > upto[w.end[:-1]]
    return first


_DISGUISED = re.compile(rb"(?i:[(\[{]at[)\]}]|\sat\s|@).*(?i:[(\[{\s]dot[)\]}\s]|[a-z0-9-]\.[a-z0-9-])", re.S)


def _plausible(kind: str, span: bytes) -> bool:
    """A span of the field alone must hold as many digits as its kind has, a card's by Luhn; an address an at and a dot in some form."""
    low, high = PLAUSIBLE[kind]
    digits = _DIGITS.sub(b"", span)
    return low <= len(digits) <= high and (kind != "card" or luhn(digits)) and (kind != "email" or bool(_DISGUISED.search(span)))


def field_spans(w: Words, field: Field, everything: bool = False) -> list[tuple[int, str, int, int]]:
    """(document, kind, start, end) in bytes of the block, over runs of words in one state."""
    n = len(w.start)
    if not n:
        return []
    line = np.cumsum(_line_starts(w))
    if everything:
        take = np.ones(n, bool)
    else:
        hit = np.flatnonzero(_marked(w))
        take = np.zeros(n + 1, np.int64)
        np.add.at(take, np.maximum(hit - REACH, 0), 1)
        np.add.at(take, np.minimum(hit + REACH + 1, n), -1)
        take = np.cumsum(take)[:n] > 0
    at = np.flatnonzero(take)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(line[at], prepend=-1) != 0))
    ends = [*cut[1:].tolist(), len(at)]
    raw = w.buf
    runs = [at[i:j] for i, j in zip(cut.tolist(), ends, strict=True)]
    # the neighbours' features count although their states are not asked for: one more word on each side of the same line
    wider = [(max(r[0] - 1, 0) if r[0] and line[r[0] - 1] == line[r[0]] else r[0], r[-1] + 1 if r[-1] + 1 < n and line[r[-1] + 1] == line[r[-1]] else r[-1]) for r in runs]
    words = [[raw[w.start[k] : w.end[k]].tobytes() for k in range(a, b + 1)] for a, b in wider]
    out = []
    for (a, b), ws, path in zip(wider, words, field.decode(words), strict=True):
        if not path.any():
            continue
        i = 0
        while i < len(path):
            j = i
            while j + 1 < len(path) and path[j + 1] == path[i]:
                j += 1
            if path[i] and any(interesting(x) for x in ws[i : j + 1]):
                x, y = int(w.start[a + i]), int(w.end[a + j])
                while x < y and raw[y - 1] in _TRIM and not (raw[y - 1] == 41 and 40 in raw[x:y]):
                    y -= 1
                while x < y and raw[x] in b"\"'[{<":
                    x += 1
                doc = int(np.searchsorted(w.first, a + i, "right")) - 1
                if x < y and _plausible(STATES[path[i]], raw[x:y].tobytes()):
                    out.append((doc, STATES[path[i]], x, y))
            i = j + 1
    return out


def find(texts: pa.Array, field: Field) -> list[list[dict]]:
    """All spans of each text: base ones, then those that the field adds outside of them."""
    rank = {k: i for i, k in enumerate(KINDS)}
    everything = not field.settled()
    out: list[list[dict]] = []
    whole, offs = text_buffer(texts)
    for i, j in blocks(offs):
        buf, off = whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        data = buf.tobytes()
        mark = np.concatenate([[0], np.cumsum(_MARK[buf])])
        has = np.diff(mark[off]) > 0
        found: list[list[tuple[str, int, int, bool]]] = [[] for _ in range(j - i)]
        for d in np.flatnonzero(has).tolist():
            at = int(off[d])
            found[d] = [(k, at + a, at + b, True) for k, a, b in base_spans(data[at : int(off[d + 1])])]
        added: dict[int, list[tuple[str, int, int]]] = {}
        for d, kind, a, b in field_spans(Words(buf, off), field, everything):
            added.setdefault(d, []).append((kind, a, b))
        for d, more in added.items():
            found[d] += [(*more[k], False) for k in outside([(x, y) for _, x, y, _ in found[d]], [(a, b) for _, a, b in more])]
        points = Points(buf)
        for d, spans in enumerate(found):
            at = int(off[d])
            spans.sort(key=lambda s: (rank[s[0]], s[1]))
            out.append([{"kind": k, "start": points.of(at, a), "end": points.of(at, b), "base": base} for k, a, b, base in spans])
    return out


def _masked(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans are replaced together, by the first one's kind."""
    if not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most_lines: int = 20_000) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end in code points, base). labelled: words array<string>, tags array<string>; the most_lines rows of it with the least hashes train the field."""
    field = default_field() if labelled is None else Field.train([(r["words"], r["tags"]) for r in labelled.orderBy(F.xxhash64("words", "tags"), "words", "tags").limit(most_lines).collect()])

    def run(batches):
        for batch in small(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "spans": pa.array(find(column(batch, "text"), field), _ARROW)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its text replaced by <kind>; all columns stay, null text stays null."""
    field = default_field()
    names = docs.columns
    t = names.index(text_col)

    def run(batches):
        for batch in small(batches):
            texts = batch.column(t)
            new = pa.array([_masked(x, s) if s else x for x, s in zip(texts.to_pylist(), find(texts, field), strict=True)], texts.type)
            yield pa.RecordBatch.from_arrays([new if k == t else batch.column(k) for k in range(len(names))], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
