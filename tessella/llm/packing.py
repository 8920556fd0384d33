"""Packing along a space-filling curve: hashed document vectors are projected to three dimensions, range-sorted by their
Hilbert key, and neighbours on the curve are laid end to end into sequences.

Ranges of the curve are packed independently. A range's last tokens are cut at powers of two, lengths that need no padding;
so no sequence has any.

Nulls and edges: null text counts as empty (its end id alone is packed); a null id is kept as null; repeated rows are packed each;
very long texts are cut into as many pieces as they need; an empty table gives an empty result; other columns are ignored. Equal keys
are spread by a hash of the row's number, so a group of copies, even of fully equal rows, may be cut into several ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster
from .arrays import column, small
from .tokens import encoder, vocabulary, with_end

DIMS, BITS, BUCKETS = 3, 10, 4096
#: Bytes of text per range. Beyond cluster.MOST_TASKS ranges they get longer instead; a task streams through its range, whatever its length.
PART_BYTES = 4 << 20
#: Documents whose keys set the ranges' bounds, per range; so no more than SAMPLE * cluster.MOST_TASKS keys reach the driver. Only the ranges' evenness depends on it; the grid is of all documents.
SAMPLE = 64
_GAUSS = np.random.Generator(np.random.PCG64(7)).normal(size=(BUCKETS, DIMS))


def project(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashed token counts of each document, scaled to unit length in expectation, under a fixed Gaussian projection."""
    rows = _GAUSS[(ids.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(BUCKETS)]
    lens = np.diff(at)
    out = np.zeros((len(lens), DIMS))
    full = lens > 0
    if full.any():
        out[full] = np.add.reduceat(rows, at[:-1][full], axis=0) / lens[full, None]
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims), by exchanging and inverting bits from the top down."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(up, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def keys(points: np.ndarray, mean: np.ndarray, sd: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Hilbert key of each point on a grid of mean +- 3 sd, then 32 bits of the tie."""
    grid = np.clip((points - mean) / (6 * sd) + 0.5, 0, 1 - 1e-9) * (1 << BITS)
    return hilbert(grid.astype(np.int64)) << 32 | (tie & 0xFFFFFFFF)


def moments(points: DataFrame, axes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of all points; sums of integers, so the same in any order of the rows."""
    whole = [F.round(F.col(a) * (1 << 20)).cast("decimal(18,0)") for a in axes]
    r = points.agg(F.count(F.lit(1)), *[F.sum(v) for v in whole], *[F.sum((v * v).cast("decimal(28,0)")) for v in whole]).first()
    if not r[0]:
        return np.zeros(len(axes)), np.ones(len(axes))
    one, two = ([int(v) for v in r[1 + k * len(axes) : 1 + (k + 1) * len(axes)]] for k in (0, 1))
    sd = [max(0, r[0] * q - v * v) ** 0.5 / r[0] / (1 << 20) for v, q in zip(one, two, strict=True)]
    return np.array([v / r[0] / (1 << 20) for v in one]), np.maximum(sd, 1e-9)


def _cells(total: int, most: int) -> np.ndarray:
    """Bounds of sequences over the last tokens: full ones, then powers of two."""
    sizes = [most] * (total // most) + [1 << b for b in range(most.bit_length(), -1, -1) if (total % most) >> b & 1]
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


class _Packer:
    """Lays a range's documents end to end; hands out what fills sequences, holds the rest."""

    def __init__(self, part: int, length: int):
        self.part, self.length, self.done = part, length, 0
        self.rest: list[tuple] = []  # (doc_ids, starts, totals, lens, ids)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lens: np.ndarray):
        self.rest.append((doc_ids, np.zeros(len(lens), np.int64), lens, lens, ids))

    def cut(self, last: bool) -> pa.RecordBatch | None:
        if not self.rest:
            return None
        doc_ids = pa.concat_arrays([x[0] for x in self.rest])
        start, total, lens, ids = (np.concatenate([x[k] for x in self.rest]) for k in (1, 2, 3, 4))
        size = int(lens.sum())
        cells = _cells(size if last else size // self.length * self.length, self.length)
        upto = int(cells[-1])
        ends = np.cumsum(lens)
        begins = ends - lens
        point = np.unique(np.concatenate([cells, begins[begins < upto], ends[ends <= upto]]))
        a, b = point[:-1], point[1:]
        doc = np.searchsorted(ends, a, "right")
        cell = np.searchsorted(cells, a, "right") - 1
        out = pa.RecordBatch.from_pydict(
            {
                "doc_id": doc_ids.take(pa.array(doc)),
                "start": pa.array(start[doc] + a - begins[doc], pa.int64()),
                "length": pa.array(b - a, pa.int64()),
                "doc_tokens": pa.array(total[doc], pa.int64()),
                "sequence_id": pa.array(np.int64(self.part) << 40 | (self.done + cell), pa.int64()),
                "offset": pa.array(a - cells[cell], pa.int64()),
                "ids": pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((point * 4).astype(np.int32).tobytes()), pa.py_buffer(ids[:upto].astype("<u4").tobytes())]),
            }
        )
        self.done += len(cells) - 1
        i = int(np.searchsorted(ends, upto, "right"))
        left = np.minimum(lens[i:], ends[i:] - upto)
        self.rest = [] if i == len(ends) else [(doc_ids.slice(i), start[i:] + lens[i:] - left, total[i:], left, ids[upto:])]
        return out


def pack(docs: DataFrame, length: int = 2048, vocab: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", scratch: cluster.Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 4 bytes each). scratch: where the encoded documents are kept; write the result before it ends."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    vocab = vocab or vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    sizes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n_parts = cluster.tasks(spark, cluster.units(spark, sizes["b"], PART_BYTES))

    axes = [f"x{k}" for k in range(DIMS)]

    def encoded(batches):
        enc = encoder(vocab)
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        item = int(kind[-1])
        for batch in small(batches):
            for i, ids, at in enc.encode(column(batch, "text")):
                x = project(ids, at)
                ids, at = with_end(ids, at, end_id)
                yield pa.RecordBatch.from_pydict(
                    {
                        "tie": column(batch, "tie").slice(i, len(at) - 1),
                        "doc_id": column(batch, "doc_id").slice(i, len(at) - 1),
                        "ids": pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * item).astype(np.int32).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())]),
                    }
                    | {a: pa.array(v) for a, v in zip(axes, x.T, strict=True)}
                )

    known = (scratch.table if scratch else cluster.materialize)(rows.mapInArrow(encoded, "tie long, doc_id long, ids binary, " + ", ".join(f"{a} double" for a in axes)))
    mean, sd = moments(known, axes)
    share = min(1.0, SAMPLE * n_parts / max(1, sizes["n"]))
    seen = known.filter(F.pmod(F.xxhash64("tie", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("tie", *axes).toPandas()
    some = np.sort(keys(seen[axes].to_numpy().reshape(-1, DIMS), mean, sd, seen["tie"].to_numpy().astype(np.int64)))
    bounds = some[np.arange(1, n_parts) * len(some) // n_parts] if len(some) else some

    def place(batches):
        for batch in batches:
            x = np.stack([column(batch, a).to_numpy() for a in axes], 1)
            key = keys(x, mean, sd, column(batch, "tie").to_numpy())
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.searchsorted(bounds, key, "right"), pa.int32()), "key": pa.array(key)} | {c: column(batch, c) for c in ("tie", "doc_id", "ids")})

    def fill(batches):
        now: _Packer | None = None
        kind = None
        for batch in batches:
            kind = kind or ("<u2" if encoder(vocab).tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
            part = column(batch, "part").to_numpy()
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            for i, j in zip(cut, [*cut[1:], len(part)], strict=True):
                if now is None or now.part != part[i]:
                    if now and (out := now.cut(True)):
                        yield out
                    now = _Packer(int(part[i]), length)
                blob = column(batch, "ids").slice(i, j - i)
                off = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + j - i + 1].astype(np.int64)
                item = int(kind[-1])
                ids = np.frombuffer(blob.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).astype(np.uint32)
                now.add(column(batch, "doc_id").slice(i, j - i), ids, np.diff(off) // item)
                if out := now.cut(False):
                    if out.num_rows:
                        yield out
        if now and (out := now.cut(True)):
            yield out

    placed = known.mapInArrow(place, "part int, key long, tie long, doc_id long, ids binary")
    ordered = placed.repartition(n_parts, "part").sortWithinPartitions("part", "key", "tie", "doc_id")
    return ordered.mapInArrow(fill, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def packed_digest(docs: DataFrame) -> DataFrame:
    """`digest` of all pieces as a table; the encoded documents are deleted."""
    with cluster.Scratch(docs.sparkSession) as scratch:
        return cluster.materialize(digest(pack(docs, scratch=scratch)))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
