"""Secret scan: exact base patterns, and spans that two character Markov models add.

One model is of random strings, the other of ordinary identifiers, both trained from labelled samples (`labelled_samples` unless
others are given). A run of at least SHORTEST token characters is added if its log-likelihood ratio exceeds both THRESHOLD and
PER_CHAR times its length.

Nulls and edges: null text counts as empty and has no spans; a null id is passed on; rows are read one by one, so repeated rows get equal
results; an empty table gives an empty result; other columns are ignored. Very long texts are read whole: patterns, models and the merging of
spans take time linear in the text.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, column, small, text_buffer
from .spans import SPANS, Points, outside

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_CUES = (b"passw", b"secret", b"token", b"api")
SHORTEST, THRESHOLD, PER_CHAR = 20, 18.0, 0.9
#: Characters of a run that the models read; a longer run is judged by all its pieces of this length.
PIECE = 64

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-")] = True
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs within a document that are at least so long."""
    m = np.concatenate([[False], mask, [False]])
    change = np.flatnonzero(m[1:] != m[:-1])
    start, end = change[::2], change[1::2]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    inner = inner[mask[inner] & mask[inner - 1]] if len(inner) else inner  # a document ends within a run
    if len(inner):
        inner = np.unique(inner)
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    long = end - start >= least
    return start[long], end[long]


def base_spans(text: bytes, cued: bool) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start, then kind as listed."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6] if cued else []
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


def labelled_samples(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """Random strings (1) in the alphabets that keys use, and ordinary identifiers, paths, numbers and long words (0)."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789"]
    onset = ["b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "tr", "pr", "ch", "th", "sh", "qu", "bl", "gr", "", ""]
    nucleus = ["a", "e", "i", "o", "u", "ea", "ou", "ai", "io", "ee"]
    coda = ["", "", "", "n", "r", "s", "t", "l", "nt", "nd", "st", "ng", "rs", "ck", "ss", "m"]
    # fixed values: frequent German stems and word endings, as compounds join them
    roots = ["donau", "dampf", "schiff", "fahrt", "gesell", "haupt", "stadt", "kraft", "werk", "licht", "recht", "schutz", "ver", "ge", "be", "ein", "aus", "auf", "leb", "arbeit", "wirt", "land", "zeit", "gleich", "wissen", "eigen", "bund", "sicher", "unter", "nehm"]
    endings = ["", "s", "en", "ung", "ungs", "schaft", "schafts", "heit", "keit", "keits", "lich", "isch", "tum", "nis", "er", "ern", "chen", "bar", "sam", "los"]
    word = lambda: "".join(rng.choice(onset) + rng.choice(nucleus) + rng.choice(coda) for _ in range(rng.randrange(1, 4)))
    joins = [
        lambda ws: "_".join(ws), lambda ws: "-".join(ws), lambda ws: "/".join(ws), lambda ws: ws[0] + "".join(w.capitalize() for w in ws[1:]), lambda ws: "".join(w.capitalize() for w in ws), lambda ws: "".join(ws),
        lambda ws: "_".join(ws).upper(), lambda ws: "/".join(ws) + str(rng.randrange(100)), lambda ws: "-".join([*ws, str(rng.randrange(2030))]), lambda ws: "".join(ws).upper(),
    ]
    rules = "-=_/+0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out = [(c * 40, 0) for c in rules]  # a line of one character is ordinary
    for _ in range(n):
        out.append(("".join(rng.choices(rng.choice(alphabets), k=rng.randrange(20, 48))), 1))
        x = rng.random()
        if x < 0.7:
            out.append((rng.choice(joins)([word() for _ in range(rng.randrange(3, 8))]), 0))
        elif x < 0.8:  # long agglutinated words: stems and endings run together
            stems = [rng.choice(roots) + rng.choice(endings) for _ in range(rng.randrange(2, 6))]
            out.append((("".join(stems) + rng.choice(endings)).capitalize() if rng.random() < 0.5 else "".join(stems), 0))
        elif x < 0.88:
            out.append(("".join(rng.choices("0123456789", k=rng.randrange(8, 40))), 0))
        else:
            out.append((rng.choice(rules) * rng.randrange(16, 50), 0))
    return out


def train(samples: list[tuple[str, int]], smooth: float = 0.3) -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of each byte after each byte; row 0 is a string's start."""
    counts = np.full((2, 256, 256), smooth)
    for text, label in samples:
        x = np.frombuffer(text.encode(), np.uint8)
        np.add.at(counts[label], (np.concatenate([[0], x[:-1]]), x), 1)
    p = np.log(counts / counts.sum(2, keepdims=True))
    return p[1] - p[0]


@lru_cache(1)
def default_model() -> np.ndarray:
    return train(labelled_samples())


def ratio(model: np.ndarray, run: np.ndarray) -> tuple[float, float]:
    """The ratio of the likeliest piece, and per character of it."""
    step = model[np.concatenate([[0], run[:-1]]), run]
    upto = np.concatenate([[0.0], np.cumsum(step)])
    size = min(PIECE, len(run))
    best = float((upto[size:] - upto[:-size]).max())
    return best, best / size


def find(texts: pa.Array, model: np.ndarray) -> list[list[dict]]:
    rank = {k: i for i, k in enumerate(KINDS)}
    out: list[list[dict]] = []
    whole, offs = text_buffer(texts)
    for i, j in blocks(offs):
        buf, off = whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        data, low = buf.tobytes(), _LOWER[buf].tobytes()
        n = j - i
        cued, other = np.zeros(n, bool), np.zeros(n, bool)
        for cue in _CUES:
            p = low.find(cue)
            while p >= 0:
                d = int(np.searchsorted(off, p, "right")) - 1
                cued[d] = True
                p = low.find(cue, max(p + 1, int(off[d + 1]) - len(cue) + 1))
        p = data.find(b"AKIA")
        while p >= 0:
            other[int(np.searchsorted(off, p, "right")) - 1] = True
            p = data.find(b"AKIA", p + 1)
        a, b = runs(_IS_HEX[buf], off, 24)
        other[np.searchsorted(off, a, "right") - 1] = True
        found: list[list[tuple[str, int, int, bool]]] = [[] for _ in range(n)]
        for d in np.flatnonzero(cued | other).tolist():
            at = int(off[d])
            found[d] = [(k, at + x, at + y, True) for k, x, y in base_spans(data[at : int(off[d + 1])], bool(cued[d]))]
        a, b = runs(_TOKEN[buf], off, SHORTEST)
        likely: dict[int, list[tuple[int, int]]] = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            total, each = ratio(model, buf[x:y])
            if total > THRESHOLD and each > PER_CHAR:
                likely.setdefault(int(np.searchsorted(off, x, "right")) - 1, []).append((x, y))
        for d, more in likely.items():
            found[d] += [("random", *more[k], False) for k in outside([(u, v) for _, u, v, _ in found[d]], more)]
        points = Points(buf)
        for d, spans in enumerate(found):
            at = int(off[d])
            spans.sort(key=lambda s: (s[1], rank[s[0]]))
            out.append([{"kind": k, "start": points.of(at, x), "end": points.of(at, y), "base": base} for k, x, y, base in spans])
    return out


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most_samples: int = 50_000) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end in code points, base). samples: text, label (1 random); the most_samples rows of it with the least hashes train the models."""
    model = default_model() if samples is None else train([(r["text"], r["label"]) for r in samples.orderBy(F.xxhash64("text", "label"), "text", "label").limit(most_samples).collect()])

    def run(batches):
        for batch in small(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "spans": pa.array(find(column(batch, "text"), model), _ARROW)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")
