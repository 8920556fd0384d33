"""SimHash near-dedup by anchor-point covering.

Anchors are the codewords of the binary Golay code [23, 12], a perfect covering code of radius 3, on the first 23 bits of
a fingerprint. Every fingerprint has one home, its nearest codeword, at a distance of 3 at most. Of two fingerprints that differ in t
bits, the one lies within 3 + t of the other's home; so each fingerprint is replicated to all anchors within that reach, and homes are
compared with visitors anchor by anchor. An anchor that is home to more than CROWDED fingerprints is refined by the codewords on the
next 23 bits: what one block exceeds radius 3 by is taken from the other's reach, so no linked pair is missed. Where a pair of codewords is
still crowded (fingerprints around one centre), its members are dealt into parts, and every two parts are a block of their own.

Equal fingerprints are one before they are replicated. An anchor grows trees: a tree's members are compared with what is in no tree
yet, never with each other, and only the trees' links are handed on.

Nulls and edges: a null text counts as empty; a text without words has fingerprint zero, linked like any other; very long texts are
summed in slices; a row with a null id takes part but never names a component (a component of such rows alone has a null id);
repeated rows and ids are rows of their own, of which `keep_first` keeps one a component; an empty table gives an empty result; other
columns are passed on by `keep_first` whatever they are called, and ignored by `simhash_dedup`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster
from .arrays import Words, blocks, column, mix, ragged, small, take_segments, text_buffer
from .components import components, first_of, named

N = 23
RADIUS = 3
#: Homes from which an anchor is refined; homes of a part of one that is crowded still.
CROWDED, PART = 16_384, 131_072
#: Replicas per task's group of anchors, on average.
CELL = 1_000_000
#: Fingerprints whose replicas are in memory together.
CHUNK = 20_000
#: Homes that are looked at together for having any link.
WAVE = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(texts: pa.Array, words: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: bit b is 1 if it is set in over half the XXH64 of the word shingles, repeats included."""
    buf, off = text_buffer(texts)
    out = []
    for i, j in blocks(off):
        w = Words(_LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i])
        n_docs, counts = j - i, w.counts
        data, at = take_segments(w.buf, w.start, w.end, w.docs(), n_docs)
        lens = w.end - w.start
        begin = np.cumsum(lens + 1) - (lens + 1)  # in data, were every word followed by a byte
        done = np.cumsum(counts > 0) - (counts > 0)  # documents before whose last word has none
        begin = begin - np.repeat(done, counts)
        end = begin + lens
        per = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
        first = np.repeat(w.first[:-1], per) + ragged(per)
        last = np.minimum(first + words, np.repeat(w.first[1:], per)) - 1
        raw, digest = data.tobytes(), xxhash.xxh64_intdigest
        h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
        # sums of bits, a slice of shingles at a time; a document may go over several slices
        sums = np.zeros((n_docs, 64), np.int64)
        doc = np.repeat(np.arange(n_docs), per)
        for a in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            d = doc[a : a + (1 << 16)]
            cut = np.flatnonzero(np.diff(d, prepend=-1))
            sums[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        fp = ((2 * sums > per[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
        out.append(fp)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Golay:
    """Errors by syndrome: a codeword within distance d of x is x ^ e for an error e of x's syndrome with weight d at most."""

    def __init__(self, most: int):
        poly = 0b110001110101
        bit = []
        for i in range(N):
            x = 1 << i
            for k in range(N - 1, 10, -1):
                if x >> k & 1:
                    x ^= poly << (k - 11)
            bit.append(x)
        self.table = np.zeros(1 << N, np.uint16)  # syndrome of each word
        for i in range(N):
            self.table[1 << i : 2 << i] = self.table[: 1 << i] ^ np.uint16(bit[i])
        errors = np.concatenate([np.array([0], np.int64)] + [np.array([sum(1 << i for i in c) for c in combinations(range(N), k)], np.int64) for k in range(1, most + 1)])
        weight = np.bitwise_count(errors).astype(np.int64)
        order = np.lexsort((weight, self.table[errors]))
        self.errors, self.weight = errors[order], weight[order]
        self.first = np.searchsorted(self.table[self.errors], np.arange(2049))

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each x: index, codeword and distance of the codewords in reach."""
        s = self.table[x].astype(np.int64)
        lens = self.first[s + 1] - self.first[s]
        who = np.repeat(np.arange(len(x)), lens)
        at = np.repeat(self.first[s], lens) + ragged(lens)
        return who, x[who] ^ self.errors[at], self.weight[at]


_GOLAY: dict[int, Golay] = {}


def anchors(fp: np.ndarray, distance: int, refined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, is the index's home) of each fingerprint's anchors; refined: those of the first block that the second divides."""
    code = _GOLAY.get(distance) or _GOLAY.setdefault(distance, Golay(RADIUS + distance))
    block = lambda x, k: (x >> np.uint64(N * k) & np.uint64((1 << N) - 1)).astype(np.int64)
    who, anchor, d = code.near(block(fp, 0))
    home = d <= RADIUS
    if refined is None or not len(refined):
        return who, anchor, home
    fine = np.isin(anchor, refined)
    some, at = np.unique(who[fine], return_inverse=True)
    who2, a2, d2 = code.near(block(fp[some], 1))
    lens = np.bincount(who2, minlength=len(some))
    left = np.repeat(np.flatnonzero(fine), lens[at])
    right = np.repeat((np.cumsum(lens) - lens)[at], lens[at]) + ragged(lens[at])
    ok = np.maximum(d[left] - RADIUS, 0) + np.maximum(d2[right] - RADIUS, 0) <= distance
    left, right = left[ok], right[ok]
    return (
        np.concatenate([who[~fine], who[left]]),
        np.concatenate([anchor[~fine], anchor[left] | a2[right] + 1 << N]),
        np.concatenate([home[~fine], home[left] & (d2[right] <= RADIUS)]),
    )


def _forest(fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, parent) of a spanning forest over the pairs within the distance that have a home on one side at least."""
    taken = np.zeros(len(fp), bool)
    homes, visitors = np.flatnonzero(home), np.flatnonzero(~home)  # in no tree yet
    child, parent = [], []
    near = lambda at, of: np.flatnonzero(np.bitwise_count(fp[at] ^ fp[of]) <= distance)
    while len(homes := homes[~taken[homes]]):
        visitors = visitors[~taken[visitors]]
        some = homes[:WAVE]
        met = sum((np.bitwise_count(fp[some][:, None] ^ fp[x][None]) <= distance).sum(1) for x in (homes, visitors))
        taken[some[met == 1]] = True  # alone: a tree before would have taken what is near to it
        for seed in some[met > 1].tolist():
            if taken[seed]:
                continue
            taken[seed] = True
            homes, visitors = homes[~taken[homes]], visitors[~taken[visitors]]
            pivots, guests = [seed], [np.zeros(0, np.int64)]
            while pivots or (guests and len(homes)):
                if pivots:  # a home meets all
                    pivot = pivots.pop()
                    a, b = near(homes, pivot), near(visitors, pivot)
                    found, seen = homes[a], visitors[b]
                    child += [found, seen]
                    parent.append(np.full(len(found) + len(seen), pivot))
                    visitors = np.delete(visitors, b) if len(b) else visitors
                    taken[seen] = True
                    guests += [seen] if len(seen) else []
                else:  # visitors meet homes
                    mine, rest = guests[0][: (1 << 20) // len(homes) + 1], guests[0][(1 << 20) // len(homes) + 1 :]
                    guests = [rest, *guests[1:]] if len(rest) else guests[1:]
                    hit = np.bitwise_count(fp[mine][:, None] ^ fp[homes][None]) <= distance
                    a = np.flatnonzero(hit.any(0)) if len(mine) else np.zeros(0, np.int64)
                    found = homes[a]
                    child.append(found)
                    parent.append(mine[hit[:, a].argmax(0)] if len(a) else mine[:0])
                homes = np.delete(homes, a) if len(a) else homes
                taken[found] = True
                pivots += found.tolist()
    return (fp[np.concatenate(child)], fp[np.concatenate(parent)]) if child else (fp[:0], fp[:0])


def _crowded(prints: DataFrame, most: int, refined: np.ndarray | None = None) -> dict[int, int]:
    """Anchors with over `most` homes and how many they have: fewer than fingerprints / most."""

    def homes(batches):
        for batch in batches:
            fp = column(batch, "fp").to_numpy().view(np.uint64)
            for a in range(0, len(fp), CHUNK):
                _, anchor, home = anchors(fp[a : a + CHUNK], 0, refined)
                anchor = anchor[home]
                v, c = np.unique(anchor if refined is None else anchor[anchor >> N > 0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(v, pa.int64()), "n": pa.array(c, pa.int64())})

    counted = prints.mapInArrow(homes, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    return {r["anchor"]: r["n"] for r in counted.collect()}


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Spanning links a, b among distinct fingerprints (column fp, long) within the Hamming distance."""
    spark = prints.sparkSession
    refined = np.array(sorted(_crowded(prints, CROWDED)), np.int64)  # of 4096 anchors
    parts = {a: -(-n // PART) for a, n in _crowded(prints, PART, refined).items()} if len(refined) else {}
    hot = np.array(sorted(parts), np.int64)
    hot_parts = np.array([parts[a] for a in hot.tolist()], np.int64)

    def spread(batches):
        for batch in batches:
            every = column(batch, "fp").to_numpy().view(np.uint64)
            for a in range(0, len(every), CHUNK):
                fp = every[a : a + CHUNK]
                who, anchor, home = anchors(fp, distance, refined)
                part = np.zeros(len(who), np.int64)
                if len(hot):  # part p of an anchor meets each part q in the block of the two
                    at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                    n_parts = np.where(hot[at] == anchor, hot_parts[at], 1)
                    own = np.repeat((mix(fp)[who] % n_parts.astype(np.uint64)).astype(np.int64), n_parts)
                    other = ragged(n_parts)
                    part = np.minimum(own, other) * np.repeat(n_parts, n_parts) + np.maximum(own, other)
                    who, anchor, home = np.repeat(who, n_parts), np.repeat(anchor, n_parts), np.repeat(home, n_parts)
                order = np.lexsort((~home, part, anchor))
                who, anchor, part, home = who[order], anchor[order], part[order], home[order]
                cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
                data = fp[who].astype("<u8").tobytes()
                n_home = np.add.reduceat(home.astype(np.int64), cut)
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array(anchor[cut], pa.int64()),
                        "part": pa.array(part[cut], pa.int64()),
                        "homes": pa.array(n_home, pa.int32()),
                        "prints": pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.append(cut * 8, len(data)).astype(np.int32).tobytes()), pa.py_buffer(data)]),
                    }
                )

    def compare(table: pa.Table) -> pa.Table:
        key = np.stack([column(table, c).to_numpy() for c in ("anchor", "part")])
        order = np.lexsort(key[::-1])
        key, homes, data = key[:, order], column(table, "homes").to_numpy()[order], column(table, "prints")
        cells = [np.frombuffer(data[int(x)].as_buffer(), "<u8") for x in order]
        cut = np.flatnonzero((np.diff(key, axis=1, prepend=-1) != 0).any(0))
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for i, j in zip(cut, [*cut[1:], len(order)], strict=True):
            if homes[i:j].any():  # without a home there is nothing to compare
                x, y = _forest(np.concatenate(cells[i:j]), np.concatenate([np.arange(len(c)) < m for c, m in zip(cells[i:j], homes[i:j], strict=True)]), distance)
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(np.concatenate(a).astype(np.uint64).view(np.int64)), "b": pa.array(np.concatenate(b).astype(np.uint64).view(np.int64))})

    replicas = prints.mapInArrow(spread, "anchor long, part long, homes int, prints binary")
    n_cells = cluster.units(spark, prints.count() * (301 if len(refined) else 71), CELL)
    dealt = replicas.withColumn("cell", F.pmod(F.xxhash64("anchor", "part"), F.lit(n_cells))).repartition(cluster.tasks(spark, n_cells), "cell")
    return dealt.groupBy("cell").applyInArrow(compare, "a long, b long")


def _labelled(rows: DataFrame, words: int, distance: int) -> DataFrame:
    """rows: row, doc_id, text. Returns row, doc_id, fp, best (the first row of its component)."""

    def prints(batches):
        for batch in small(batches):
            yield pa.RecordBatch.from_pydict({c: column(batch, c) for c in ("row", "doc_id")} | {"fp": pa.array(fingerprints(column(batch, "text"), words).view(np.int64))})

    with cluster.Scratch(rows.sparkSession) as scratch:
        each = scratch.table(rows.mapInArrow(prints, "row long, doc_id long, fp long"))
        distinct = scratch.table(each.groupBy("fp").agg(F.min(F.struct(*first_of())).alias("best")))
        return named(each, distinct, components(links(distinct.select("fp").repartition("fp"), distance), scratch), "fp")


def _rows(docs: DataFrame, row, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def simhash_dedup(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least id reachable over links)."""
    out = _labelled(_rows(docs, F.monotonically_increasing_id(), id_col, text_col), words, distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that with the least id (of equal ids, and of rows without one, the first); all columns stay."""
    table, row = cluster.numbered(docs)  # read by what is returned; see cluster.release
    return cluster.without(table, row, _labelled(_rows(table, F.col(row), id_col, text_col), words, distance).filter("row <> best.row"))
