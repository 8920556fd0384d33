"""Source divergence audit: how far the term distribution of each source of a language is from those of its other sources.

Counting is prefiltered by a sketch. A first pass over the texts fills count-min sketches of the terms' document frequencies, one a
task, with counters that stop at the threshold; slices of them are merged in Spark. A merged cell is never under the frequency of a
term that falls into it (up to the threshold), so a term with a cell under the threshold is in too few documents and is discarded before
anything of it is shuffled. The second pass counts the survivors exactly, aggregated in the task before the shuffle; those that the sketch
let through by collisions go then. Sums over all kept terms for all pairs of sources are sparse: a term that both sources lack adds a
constant, one that a single source has adds what depends on its count alone (so counts are histograms), and only terms that both have are
joined, pair by pair, straight into a partial aggregate.

Sizes: the sketch is the only thing that goes through the driver and to all tasks; it has one cell for CELL_BYTES of text and row,
at most 2 ** MOST_BITS cells of two bits in all (64 MB); where distinct terms are many more, it lets more through and results stay.
Pairs of sources are the result itself, so sources are taken to be few beside documents. All arithmetic is in exact integers.

Nulls and edges: null text, lang and source count as ''; a group without terms, or of a language that keeps none, still has its pairs
(value 0 where nothing is kept); rows are documents of their own, so repeated rows and ids count each; very long texts are read whole;
ties in value are ranked by item; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cluster
from .arrays import U64, blocks, column, mix, runs, segment_hash, small, strings, take_segments, text_buffer
from .simhash import _LOWER

UNIT = 1_000_000_000
MIN_DOCS = 3
RANKS = 200
DEPTH = 3
#: Bytes of text to a cell of each of the sketch's DEPTH rows; log2 of the most cells that all rows have; log2 of the cells of a slice.
CELL_BYTES, MOST_BITS, SLICE_BITS = 64, 28, 16
#: Text whose terms are counted together before they are handed on.
BLOCK_BYTES = 4 << 20
_ROWS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], U64)
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def row_bits(text_bytes: int) -> int:
    """log2 of the cells of one sketch row."""
    most = MOST_BITS - int(np.ceil(np.log2(DEPTH)))
    return int(np.clip(np.ceil(np.log2(max(1, text_bytes / CELL_BYTES))), SLICE_BITS, most))


class Terms:
    """Terms of a block of documents: codes of distinct terms, their texts, and the document of every occurrence."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.n_docs = len(off) - 1
        start, end = runs(_TERM[buf], off)
        self.doc = np.searchsorted(off, start, "right") - 1
        data, at = take_segments(_LOWER[buf], start, end, np.arange(len(start)), len(start))
        coded = strings(data, at).dictionary_encode()
        self.code, self.texts = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def hashes(self) -> np.ndarray:
        buf, off = text_buffer(self.texts)
        return segment_hash(buf, off[:-1], off[1:])


def _blocks(batch, text: str):
    """(first row, terms) of each block of a batch."""
    buf, off = text_buffer(column(batch, text))
    for i, j in blocks(off, BLOCK_BYTES):
        yield i, Terms(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    x = values.dictionary_encode()
    return x.indices.to_numpy(zero_copy_only=False).astype(np.int64), x.dictionary


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of small non-negative integers and how often each occurs."""
    width = int(b.max()) + 1 if len(b) else 1
    u, n = np.unique(a * width + b, return_counts=True)
    return u // width, u % width, n


def _cells(terms: np.ndarray, langs: np.ndarray, bits: int) -> np.ndarray:
    """(DEPTH, n) cells of (term, lang) hashes in the table of all rows."""
    h = mix(terms ^ mix(langs + U64(1)))
    return np.stack([(mix(h * m) >> U64(64 - bits)).astype(np.int64) + (r << bits) for r, m in enumerate(_ROWS)])


def _hashed(values: pa.Array) -> np.ndarray:
    buf, off = text_buffer(values)
    return segment_hash(buf, off[:-1], off[1:])


def pack(cells: np.ndarray) -> bytes:
    """Counters of 0 to 3 as two bits each."""
    c = cells.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()


def sketch(docs: DataFrame, bits: int, min_docs: int = MIN_DOCS) -> np.ndarray:
    """Packed counters of the merged sketch of document frequencies. docs: lang, source, text. Counters stop at min_docs, 3 at most."""
    stop = min(min_docs, 3)

    def fill(batches):
        cells = np.zeros(DEPTH << bits, np.uint8)
        for batch in small(batches):
            lang, langs = _coded(column(batch, "lang"))
            hashed = _hashed(langs)
            for i, t in _blocks(batch, "text"):
                d, c, _ = _pairs(t.doc, t.code)  # once a document
                g, c, n = _pairs(lang[i : i + t.n_docs][d], c)
                for at in _cells(t.hashes()[c], hashed[g], bits):
                    u, inverse = np.unique(at, return_inverse=True)
                    cells[u] = np.minimum(cells[u] + np.bincount(inverse, n), stop).astype(np.uint8)
        parts = cells.reshape(-1, 1 << SLICE_BITS)
        for k in np.flatnonzero(parts.any(1)):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "cells": pa.array([pack(parts[k])], pa.binary())})

    def merge(batches):
        total: dict[int, np.ndarray] = {}  # the slices of this partition; what tasks send streams through
        for batch in batches:
            for k, x in zip(column(batch, "slice").to_pylist(), column(batch, "cells"), strict=True):
                more = unpack(x.as_py())
                total[k] = np.minimum(total[k] + more, stop) if k in total else more
        for k, x in total.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "cells": pa.array([pack(x)], pa.binary())})

    n_slices = DEPTH << (bits - SLICE_BITS)
    made = docs.select("lang", "text").mapInArrow(fill, "slice int, cells binary")
    dealt = made.repartition(cluster.tasks(docs.sparkSession, n_slices), "slice").mapInArrow(merge, "slice int, cells binary")
    out = np.zeros((n_slices, (1 << SLICE_BITS) // 4), np.uint8)
    for r in dealt.collect():  # 2 ** MOST_BITS cells of two bits at most
        out[r["slice"]] = np.frombuffer(r["cells"], np.uint8)
    return out.ravel()


def counts(docs: DataFrame, cells: np.ndarray, bits: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, docs of the terms that the sketch does not rule out."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    stop = min(min_docs, 3)

    def tally(batches):
        cells = shared.value
        for batch in small(batches):
            lang, langs = _coded(column(batch, "lang"))
            source, sources = _coded(column(batch, "source"))
            group = lang * len(sources) + source
            hashed = _hashed(langs)
            for i, t in _blocks(batch, "text"):
                mine = group[i : i + t.n_docs]
                d, c, n = _pairs(t.doc, t.code)
                key = mine[d] * max(1, len(t.texts)) + c
                u, inverse = np.unique(key, return_inverse=True)
                g, c = u // max(1, len(t.texts)), u % max(1, len(t.texts))
                at = _cells(t.hashes()[c], hashed[g // max(1, len(sources))], bits)
                some = ((cells[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3) >= stop).all(0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": langs.take(pa.array((g // max(1, len(sources)))[some])),
                        "source": sources.take(pa.array((g % max(1, len(sources)))[some])),
                        "term": t.texts.take(pa.array(c[some])),
                        "n": pa.array(np.bincount(inverse, n, len(u)).astype(np.int64)[some]),
                        "docs": pa.array(np.bincount(inverse, minlength=len(u)).astype(np.int64)[some]),
                    }
                )

    made = docs.mapInArrow(tally, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), by decimals of 38 digits."""
    return F.expr(f"1 + cast({UNIT} as decimal(10,0)) * cast({n} + 1 as decimal(20,0)) div cast({total} + {terms} as decimal(20,0))")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: every other source of the language and its divergence, all ranks; part term: the
    terms that stand out from the language, the first ranks alone."""
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    bits = row_bits(cluster.text_bytes(rows))
    with cluster.Scratch(spark) as scratch:
        found = counts(rows, sketch(rows, bits, min_docs), bits, min_docs)
        term = Window.partitionBy("lang", "term")  # a row a source
        found = found.withColumns({"docs": F.sum("docs").over(term), "all_n": F.sum("n").over(term)}).filter(F.col("docs") >= min_docs)
        kept = scratch.table(found.select("lang", "source", "term", "n", "all_n"))
        langs = kept.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_n"))
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.na.fill(0, ["group_n", "terms", "lang_n"])
        groups = scratch.table(groups.withColumn("p0", F.when(F.col("terms") > 0, _p("0L", "group_n", "terms")).otherwise(F.lit(1).cast("long"))))

        mine = kept.join(groups, ["lang", "source"]).withColumns({"p": _p("n", "group_n", "terms"), "q": _p("all_n", "lang_n", "terms")})
        value = mine.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        stand_out = value.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= ranks)  # Spark cuts each task's rows to the first ranks before the exchange

        out = scratch.table(stand_out.unionByName(_pair_sums(kept, groups).withColumn("rank", F.row_number().over(best))))
        return cluster.materialize(out)


def _pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value: of each ordered pair of sources the sum over all kept terms."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    every = groups.join(other, "lang").filter("source <> item")  # a row of the result each
    both_lack = every.select("lang", "source", "item", F.expr(f"terms * {_f('p0', 'q0')}").alias("value"))
    # terms of one source: what they add to what is counted as lacking depends on the count alone
    held = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).join(groups, ["lang", "source"]).withColumn("p", _p("n", "group_n", "terms"))
    held = held.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.expr(f"times * ({_f('p', 'q0')} - {_f('p0', 'q0')})")).alias("first"), F.sum(F.expr(f"times * ({_f('q0', 'p')} - {_f('q0', 'p0')})")).alias("second")
    )
    first = held.select("lang", "source", "item", F.col("first").alias("value"))
    second = held.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("second").alias("value"))
    # terms of both, joined on the term: rows meet as many others as there are sources, and go into a partial aggregate at once
    here = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", _p("n", "group_n", "terms").alias("p"), "p0")
    there = here.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = here.join(there.hint("merge"), ["lang", "term"]).filter("source <> item")
    shared = shared.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"{_f('p', 'q')} - {_f('p', 'q0')} - {_f('p0', 'q')} + {_f('p0', 'q0')}")).alias("value"))
    total = both_lack.unionByName(first).unionByName(second).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
o as (select lang, source, doc, unnest(ws) as term from d),
k as (select lang, term, count(*)::hugeint as n from o group by all having count(distinct doc) >= 3),
c as (select o.lang, o.source, o.term, count(*)::hugeint as n from o join k on o.lang = k.lang and o.term = k.term group by all),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from k group by lang),
g as (select d.lang, d.source, coalesce(any_value(v.v), 0)::hugeint as v, coalesce(any_value(v.n), 0)::hugeint as ln from d left join v on d.lang = v.lang group by all),
s as (select g.*, coalesce((select sum(c.n) from c where c.lang = g.lang and c.source = g.source), 0)::hugeint as gn from g),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (s.gn + s.v) as p, 1 + (1000000000 * (k.n + 1)) // (s.ln + s.v) as q
  from s join k on s.lang = k.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
e as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(e.value, 0) as value from s a join s b on a.lang = b.lang and a.source <> b.source
  left join e on e.lang = a.lang and e.source = a.source and e.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from p where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from r qualify part = 'pair' or rank <= 200
"""
