"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted across the corpus.

Documents are dealt into units by a hash of id and text; rows equal in both travel as one with their number, from each batch. A unit hashes all its windows and sends each owner (a range of the
hash space) its distinct hashes, sorted, with the smallest id that holds each; an owner answers with one bit per hash: does
a smaller id hold it elsewhere? With that bit a unit decides all its windows, merges the repeated ones into maximal removal
intervals and cuts the texts. What travels is about 9 bytes a distinct window, and the hash of a passage that a third of
all documents share is sent once a unit. Units and owners grow with the square root of the corpus, so what one unit sends one
owner stays a few hundred windows and the number of such messages grows with the corpus, not with its square.

A window's hash has 80 bits: 64 of a polynomial over one hash of its words and 16 of another polynomial over a second, independent
hash of them. Among 10 ** 13 windows about 40 are expected to meet a different window of equal hash.

Nulls and edges: null or empty text has no words; a text under the window's length loses nothing; a very long text is one block of
its own; a row with a null id keeps its whole text and lends nothing (so it takes no part in the exchange); rows with equal ids never
remove from each other; repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster
from .arrays import U64, Words, blocks, column, small, strings, take_segments, text_buffer, window_hash

#: Bytes of text per unit, and of all units' text per owner, at least: both sides of the exchange hold that much at a time.
UNIT_BYTES = 8 << 20
#: Bytes of text whose windows one unit sends one owner on average, in a corpus of over UNIT_BYTES ** 2 / MESSAGE_BYTES (50 GB); at 100 TB units have 374 MB.
MESSAGE_BYTES = 1400
_SECOND = U64(0xBF58476D1CE4E5B9)


class _Block(NamedTuple):
    first: int  # document
    words: Words
    at: np.ndarray  # first word of each window
    doc: np.ndarray  # document of each window, within the block
    hash: np.ndarray
    more: np.ndarray  # 16 further bits of the hash


def _windows(table: pa.Table, size: int):
    """Words and windows of each block of documents."""
    buf, off = text_buffer(column(table, "text"))
    for i, j in blocks(off):
        w = Words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        one, two = w.two_hashes()
        h, more = window_hash(one, size), window_hash(two, size, _SECOND) >> U64(48)
        left = w.first[1:] - size  # the last window of a document starts here
        doc = w.docs()[: len(h)]
        at = np.flatnonzero(np.arange(len(h)) <= left[doc])
        yield _Block(i, w, at, doc[at], h[at], more[at].astype(np.uint16))


def _distinct(h: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes in two parts, the smallest id of each, and each window's place among them."""
    order = np.argsort(h, kind="stable")
    s, m = h[order], more[order]
    same, new = s[1:] == s[:-1], np.ones(len(s), bool)
    if (same & (m[1:] != m[:-1])).any():  # once in a long while
        order = np.lexsort((more, h))
        s, m = h[order], more[order]
        same = s[1:] == s[:-1]
    new[1:] = ~same | (m[1:] != m[:-1])
    at = np.flatnonzero(new)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[at], m[at], np.minimum.reduceat(ids[order], at) if len(at) else ids[:0], place


def _owners(h: np.ndarray, owners: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(owners) >> U64(32)).astype(np.int64)


def _planes(values: np.ndarray, raw: int, wide: int) -> list[bytes]:
    """The low bytes of integers as they are, the higher ones (whose values crowd) entropy-coded."""
    b = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T)
    c = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    high = c.compress(b[raw:].tobytes()) + c.flush()
    return [len(high).to_bytes(8, "little"), b[:raw].tobytes(), high]


def pack(h: np.ndarray, more: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted hashes as gaps of 6 bytes (8 where one is larger) and 2 bytes more, ids as indexes into a table of the distinct ones."""
    gaps = np.diff(h)
    wide = 6 if not len(gaps) or int(gaps.max()) < 1 << 48 else 8
    names, at = np.unique(ids, return_inverse=True)
    head = np.array([len(h), wide, len(names), h[0]], "<u8").tobytes()
    return b"".join([head, names.astype("<i8").tobytes(), more.astype("<u2").tobytes(), *_planes(gaps, 5, wide), *_planes(at, 1, 4)])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, wide, m, low = (int(x) for x in np.frombuffer(blob, "<u8", 4))
    at = 32 + 8 * m
    names = np.frombuffer(blob, "<i8", m, 32)
    more = np.frombuffer(blob, "<u2", n, at)
    at += 2 * n

    def planes(count: int, raw: int, width: int) -> np.ndarray:
        nonlocal at
        size = int.from_bytes(blob[at : at + 8], "little")
        at += 8
        out = np.zeros((count, 8), np.uint8)
        out[:, :raw] = np.frombuffer(blob, np.uint8, count * raw, at).reshape(raw, count).T
        at += count * raw
        out[:, raw:width] = np.frombuffer(zlib.decompress(blob[at : at + size], -15), np.uint8).reshape(width - raw, count).T
        at += size
        return out.view("<u8").ravel()

    h = np.empty(n, U64)
    h[0] = low
    h[1:] = planes(n - 1, 5, wide)
    return np.cumsum(h, dtype=U64), more, names[planes(n, 1, 4)]


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (words joined by one space), removed (word intervals [from, to])."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = cluster.text_bytes(rows)
    n_units = owners = cluster.units(spark, total, max(UNIT_BYTES, int((total * MESSAGE_BYTES) ** 0.5)))
    deal = lambda df, key: df.repartition(cluster.tasks(spark, n_units), key).groupBy(key)
    unknown = rows.filter("doc_id is null")
    one = rows.filter("doc_id is not null").mapInArrow(_once, "doc_id long, text string, times long")
    dealt = deal(one.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_units)).cast("int")), "unit")

    def distinct(table: pa.Table, made: list[_Block]):
        ids = column(table, "doc_id").to_numpy()
        h = np.concatenate([np.zeros(0, U64), *[b.hash for b in made]])
        more = np.concatenate([np.zeros(0, np.uint16), *[b.more for b in made]])
        own = np.concatenate([np.zeros(0, np.int64), *[ids[b.first + b.doc] for b in made]])
        return _distinct(h, more, own)

    def send(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        h, more, d, _ = distinct(table, [b._replace(words=None) for b in _windows(table, window)])
        own = _owners(h, owners)
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        blobs = [pack(h[i:j], more[i:j], d[i:j]) for i, j in zip(cut, [*cut[1:], len(h)], strict=True)]
        return pa.table({"owner": pa.array(own[cut], pa.int32()), "unit": pa.array([unit] * len(cut), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        lists = [unpack(b.as_py()) for b in column(table, "blob")]
        h, more, d = (np.concatenate([x[k] for x in lists]) for k in (0, 1, 2))
        ends = np.cumsum([len(x[0]) for x in lists])
        del lists
        _, _, least, place = _distinct(h, more, d)
        earlier = least[place] < d
        maps = [np.packbits(m).tobytes() if m.any() else None for m in np.split(earlier, ends[:-1])]
        keep = [i for i, m in enumerate(maps) if m is not None]
        return pa.table({"unit": column(table, "unit").take(pa.array(keep, pa.int64())), "owner": pa.array([owner] * len(keep), pa.int32()), "bitmap": pa.array([maps[i] for i in keep], pa.binary())})

    def cut_out(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids = column(table, "doc_id").to_numpy()
        made = list(_windows(table, window))
        h, _, least, place = distinct(table, made)
        own = _owners(h, owners)
        elsewhere = np.zeros(len(h), bool)
        for o, m in zip(replies.column("owner").to_pylist(), replies.column("bitmap").to_pylist(), strict=True):
            i, j = np.searchsorted(own, [o, o + 1])
            elsewhere[i:j] = np.unpackbits(np.frombuffer(m, np.uint8))[: j - i]
        least = np.where(elsewhere, np.iinfo(np.int64).min, least)
        out, upto = [], 0
        for b in made:
            mine = place[upto : upto + len(b.at)]
            upto += len(mine)
            out.append(_cut(table, b, least[mine] < ids[b.first + b.doc], window))
        return pa.concat_tables(out)

    def whole(batches):
        for batch in small(batches):
            for b in _windows(batch, window):
                yield from _cut(batch, b, np.zeros(len(b.at), bool), window).combine_chunks().to_batches()

    schema = "doc_id long, times long, n_words long, n_removed long, kept_text string, removed array<long>"
    blobs = dealt.applyInArrow(send, "owner int, unit int, blob binary")
    replies = deal(blobs, "owner").applyInArrow(answer, "unit int, owner int, bitmap binary")
    done = dealt.cogroup(deal(replies, "unit")).applyInArrow(cut_out, schema)
    every = done.unionByName(unknown.withColumn("times", F.lit(1).cast("long")).mapInArrow(whole, schema))
    return every.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def _once(batches):
    """Rows of a batch that are equal in id and text as one with their number, so that a row which is a third of the table stays small in its unit."""
    for batch in small(batches):
        text, ids = column(batch, "text").dictionary_encode(), column(batch, "doc_id")
        _, which = np.unique(ids.to_numpy(), return_inverse=True)
        _, first, times = np.unique(which * max(1, len(text.dictionary)) + text.indices.to_numpy(), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(first)), "text": column(batch, "text").take(pa.array(first)), "times": pa.array(times, pa.int64())})


def _cut(table: pa.Table | pa.RecordBatch, block: _Block, gone: np.ndarray, window: int) -> pa.Table:
    """The documents of a block without the words that the windows gone cover."""
    w, at = block.words, block.at
    n = len(w.start)
    edge = np.bincount(at[gone], minlength=n + 1) - np.bincount(at[gone] + window, minlength=n + 1)[: n + 1]
    lost = np.cumsum(edge)[:n] > 0
    docs_of = w.docs()
    kept = ~lost
    data, off = take_segments(w.buf, w.start[kept], w.end[kept], docs_of[kept], len(w.counts))
    # maximal intervals: a run of lost words within one document
    step = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0) | np.isin(np.arange(n + 1), w.first[1:-1]))
    begin = step[(step < n)]
    begin = begin[lost[begin]]
    stop = step[np.searchsorted(step, begin, "right")]
    where = docs_of[begin]
    spans = np.stack([begin - w.first[where], stop - 1 - w.first[where]], 1).ravel()
    per = np.bincount(where, minlength=len(w.counts))
    return pa.table(
        {
            "doc_id": column(table, "doc_id").slice(block.first, len(w.counts)),
            "times": column(table, "times").slice(block.first, len(w.counts)),
            "n_words": pa.array(w.counts, pa.int64()),
            "n_removed": pa.array(np.bincount(docs_of[lost], minlength=len(w.counts)), pa.int64()),
            "kept_text": strings(data, off),
            "removed": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * per)]), pa.int32()), pa.array(spans, pa.int64())),
        }
    )


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
t as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d),
g as (select doc_id, i, array_to_string(ws[i:i+12], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d)),
f as (select win, min(doc_id) as first_id from g group by win),
r as (select g.doc_id, g.i from g join f using (win) where f.first_id < g.doc_id),
c as (select distinct doc_id, i + k as p from r, (select unnest(range(0, 13)) as k)),
s as (select t.doc_id, string_agg(t.word, ' ' order by t.p) as kept, count(*) as n_kept from t anti join c on t.doc_id = c.doc_id and t.p = c.p group by t.doc_id)
select d.doc_id, len(ws) as n_words, len(ws) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s using (doc_id)
"""
