"""Exact dedup by a Golomb-coded fingerprint exchange.

Rows get numbers and are dealt into units by them, so that no group of copies, not even of fully equal rows, gathers anywhere.
Each unit sends every owner (a range of the fingerprint space) its sorted distinct fingerprints, Golomb-Rice coded, with a bit for
those it holds twice; owners answer with a bitmap of those that are anywhere twice. Only the texts of such suspects are shuffled,
grouped by their bytes after an aggregation on the map side, so a clash of fingerprints is never taken for a copy. Texts never
leave the JVM; what travels for every row is its number, id and SHA-256.

Nulls and edges: null text counts as empty (and so equals other empty texts); of equal texts the row with the largest id stays, of
equal ids the first row, so exactly one row of each text stays, repeated rows included; a row with a null id takes part and loses to
any row with an id; very long texts are hashed and compared whole; an empty table gives an empty result; other columns are passed
on by `drop_copies` whatever they are called, and ignored by `exact_dedup`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster
from .arrays import column

#: Rows per unit: about 50 bytes of each are in memory together.
UNIT_ROWS = 500_000
#: Fingerprints per owner.
OWNER_ROWS = 1_000_000
#: Bits of a fingerprint, a multiple of 4. With 48, a table of 2 ** 40 texts gets a false suspect among 256 texts; a false one costs only traffic.
BITS = 48


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct integers in [0, span): count (4 bytes), Rice parameter (1 byte), then unary quotients and remainders of the gaps."""
    n = len(values)
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    k = max(0, int(np.log2(max(1.0, span / max(1, n) * 0.69))))
    q, r = gaps >> k, gaps & ((1 << k) - 1)
    unary = np.zeros(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1  # q zeros, then a one
    rest = ((r[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
    return n.to_bytes(4, "little") + bytes([k]) + np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    n, k = int.from_bytes(blob[:4], "little"), blob[4]
    if n == 0:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=5))
    ones = np.flatnonzero(bits)[:n]  # the first n ones end the quotients
    q = np.diff(ones, prepend=-1) - 1
    rest = bits[ones[-1] + 1 : ones[-1] + 1 + n * k].reshape(n, k) if k else np.zeros((n, 0), np.uint8)
    r = rest.astype(np.int64) @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else np.zeros(n, np.int64)
    return np.cumsum(((q.astype(np.int64) << k) | r) + 1) - 1


def _prints(table: pa.Table) -> np.ndarray:
    """The leading BITS of each row's SHA-256."""
    sha = column(table, "sha")
    if not len(sha):
        return np.zeros(0, np.int64)
    raw = np.frombuffer(sha.buffers()[2], np.uint8, 32 * len(sha), 32 * sha.offset).reshape(-1, 32)
    return (np.ascontiguousarray(raw[:, :8]).view(">u8").ravel() >> np.uint64(64 - BITS)).astype(np.int64)


def _cells(fp: np.ndarray, owners: int) -> list[tuple[int, int, np.ndarray]]:
    """(owner, lowest fingerprint, distinct sorted fingerprints) of those owners that get any."""
    u = np.unique(fp)
    own = (u * owners) >> BITS if owners < 1 << (62 - BITS) else np.array([(int(x) * owners) >> BITS for x in u], np.int64)
    cut = np.flatnonzero(np.diff(own, prepend=-1))
    return [(int(own[i]), -((-int(own[i]) << BITS) // owners), u[i:j]) for i, j in zip(cut, [*cut[1:], len(u)], strict=True)]


def _groups(rows: DataFrame) -> DataFrame:
    """rows: row (its number), doc_id, text. Returns row, doc_id, keep_id, keep_row, group_size, sha (binary)."""
    spark = rows.sparkSession
    n = rows.count()
    n_units = cluster.units(spark, n, UNIT_ROWS)
    owners = cluster.units(spark, n, OWNER_ROWS)
    deal = lambda df, key, many: df.repartition(cluster.tasks(spark, many), key).groupBy(key)
    hashed = rows.select("row", "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.pmod(F.xxhash64("row"), F.lit(n_units)).cast("int").alias("unit"))
    dealt = deal(hashed, "unit", n_units)

    def send(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        fp = _prints(table)
        values, counts = np.unique(fp, return_counts=True)
        out = []
        for own, low, u in _cells(fp, owners):
            i = int(np.searchsorted(values, u[0]))
            twice = counts[i : i + len(u)] > 1
            out.append((own, golomb_encode(u - low, (1 << BITS) // owners + 1), np.packbits(twice).tobytes() if twice.any() else None))
        return pa.table({"owner": pa.array([x[0] for x in out], pa.int32()), "unit": pa.array([unit] * len(out), pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary()), "twice": pa.array([x[2] for x in out], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        owner, sender, here = table.column("owner")[0].as_py(), column(table, "unit"), column(table, "twice").to_pylist()
        lists = [golomb_decode(b.as_py()) for b in column(table, "blob")]
        _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        bits = np.split((counts > 1)[inverse], np.cumsum([len(x) for x in lists])[:-1])
        maps = [b if t is None else b | np.unpackbits(np.frombuffer(t, np.uint8))[: len(b)].astype(bool) for b, t in zip(bits, here, strict=True)]
        keep = [i for i, m in enumerate(maps) if m.any()]
        return pa.table({"unit": sender.take(pa.array(keep, pa.int64())), "owner": pa.array([owner] * len(keep), pa.int32()), "bitmap": pa.array([np.packbits(maps[i]).tobytes() for i in keep], pa.binary())})

    def mark(table: pa.Table, replies: pa.Table) -> pa.Table:
        fp = _prints(table)
        maps = dict(zip(replies.column("owner").to_pylist(), replies.column("bitmap").to_pylist(), strict=True))
        hit = [u[np.unpackbits(np.frombuffer(maps[own], np.uint8))[: len(u)].astype(bool)] for own, _, u in _cells(fp, owners) if own in maps]
        suspect = np.isin(fp, np.concatenate(hit)) if hit else np.zeros(len(fp), bool)
        return pa.table({c: table.column(c) for c in ("row", "doc_id", "sha")} | {"suspect": pa.array(suspect)})

    blobs = dealt.applyInArrow(send, "owner int, unit int, blob binary, twice binary")
    replies = deal(blobs, "owner", owners).applyInArrow(answer, "unit int, owner int, bitmap binary")
    with cluster.Scratch(spark) as scratch:
        marked = scratch.table(dealt.cogroup(deal(replies, "unit", n_units)).applyInArrow(mark, "row long, doc_id long, sha binary, suspect boolean"))
        # byte verification: the text is the grouping key, aggregated before the shuffle; row numbers are unique, so the join has no hot key
        best = F.max(F.struct("doc_id", (-F.col("row")).alias("last")))
        same = rows.join(marked.filter("suspect").select("row").hint("merge"), "row", "left_semi").groupBy("text").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        same = scratch.table(same.select(F.unhex(F.sha2("text", 256)).alias("sha"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.last")).alias("keep_row"), "group_size"))
        far = marked.filter("suspect").drop("suspect").join(same, "sha").select("row", "doc_id", "sha", "keep_id", "keep_row", "group_size")  # a hot text is split by adaptive execution
        near = marked.filter("not suspect").select("row", "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
        return cluster.materialize(near.unionByName(far))


def _rows(table: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    return table.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id (largest id among equal texts), group_size, kept (true for one row of each text), text_sha256."""
    with cluster.Scratch(docs.sparkSession) as scratch:
        table, row = cluster.numbered(docs.select(id_col, text_col), scratch)
        out = _groups(_rows(table, row, id_col, text_col))
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that with the largest id (of equal ids, and of rows without one, the first); all columns stay."""
    table, row = cluster.numbered(docs)
    return cluster.without(table, row, _groups(_rows(table, row, id_col, text_col)).filter("row <> keep_row"))


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
