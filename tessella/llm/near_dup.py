"""Near-duplicates of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The pipeline's stage links by SimHash first, as op9 does: fingerprints within 3 of 64 bits. They cannot reach as far as a Jaccard of 0.8 (about 10 bits), so
its links are joined, in the same components, by those of a second search: candidates meet in bands of minima under
BANDS * ROWS linear hashes: two documents share a band with probability 1 - (1 - J ** ROWS) ** BANDS, 0.9996 at 0.8. Every link of bands
is verified on the whole shingle sets (as 64-bit hashes) before it counts. Members of a band's bucket are compared with one hub of
it, that which meets most others in all its buckets. Members that are not in the hub's component then are compared with all members of
other components, so no link of a bucket between components is missed: not as pairs, but in blocks of BLOCK by BLOCK texts whose sets
are together in a task, which hands out a spanning forest of its links.

Nulls and edges: words and case as in simhash; a text of fewer than five words is one shingle; texts without words are equal; a null
text counts as empty; very long texts are compared whole; a row with a null id takes part but never names a component; repeated rows and
ids are rows of their own, of which `keep_first` keeps one a component; an empty table gives an empty result; other columns are passed
on by `keep_first` whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster, simhash
from .arrays import U64, Words, blocks, column, mix, ragged, small, text_buffer, window_hash
from .components import components, first_of, named
from .simhash import _LOWER, _rows
from .tokens import forget

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Texts on a side of a block of comparisons.
BLOCK = 256
#: Texts of blocks that one group of Arrow data holds, on average.
CELL = 2000
_RNG = np.random.Generator(np.random.PCG64(58))
_MULTIPLY = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: pa.Array):
    """Yields (first text, hashes, bounds) of each block of texts: the sorted distinct shingles of each."""
    buf, off = text_buffer(texts)
    for i, j in blocks(off):
        w = Words(_LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i])
        counts, h = w.counts, w.hashes()
        per = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
        doc = np.repeat(np.arange(j - i), per)
        out = np.zeros(len(doc), U64)
        long = (counts >= WORDS)[doc]
        at = (np.repeat(w.first[:-1], per) + ragged(per)).astype(np.int64)
        out[long] = window_hash(h, WORDS)[at[long]]
        for k in np.flatnonzero((counts > 0) & (counts < WORDS)):
            a, b = int(w.first[k]), int(w.first[k + 1])
            out[np.searchsorted(doc, k)] = mix(window_hash(h[a:b], b - a) + U64(b - a))[0]
        order = np.lexsort((out, doc))
        out, doc = out[order], doc[order]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
        yield i, out[new], np.searchsorted(doc[new], np.arange(j - i + 1))


def _nodes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number of each set; zero of the empty one."""
    s = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(1)), dtype=U64)])
    return mix(s[at[1:]] - s[at[:-1]])


def _bands(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys; texts without words have none of use."""
    out = np.zeros((len(at) - 1, BANDS), U64)
    full = np.diff(at) > 0
    first = at[:-1][full]
    if len(first):
        for b in range(BANDS):
            key = np.full(len(first), U64(b))
            for k in range(b * ROWS, (b + 1) * ROWS):
                key = mix(key * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * _MULTIPLY[k] + _ADD[k], first))
            out[full, b] = key
    return out


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    z = np.sort(np.concatenate([x, y]), kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return both >= SIMILARITY * (len(z) - both)


def _similar_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of sets that are similar, by products of membership matrices over the hashes that two sets share."""
    sizes = np.array([len(x) for x in [*left, *right]])
    values, at, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    use = count[at] > 1
    place = (np.cumsum(count > 1) - 1)[at[use]]
    owner, n = owner[use], len(left)
    both = np.zeros((n, len(right)), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        i, j = np.searchsorted(place, [low, low + 4096])
        member = np.zeros((len(sizes), 4096), np.float32)
        member[owner[i:j], place[i:j] - low] = 1
        both += member[:n] @ member[n:].T
    union = sizes[:n, None] + sizes[None, n:] - both
    return np.nonzero(both >= SIMILARITY * union)


def _block_links(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """left, right: (node, root, set). A spanning forest of the links between texts of different roots."""
    x, y = _similar_pairs([r[2] for r in left], [r[2] for r in right])
    up: dict[int, int] = {}

    def find(r: int) -> int:
        while up.get(r, r) != r:
            r = up[r]
        return r

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(left[i][1]), find(right[j][1])
        if a != b:
            up[a] = b
            out.append((left[i][0], right[j][0]))
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, node (number of its shingle set), component_id (least id reachable over links)."""
    with cluster.Scratch(docs.sparkSession) as scratch:
        table, row = cluster.numbered(docs.select(id_col, text_col), scratch)
        return _labelled(_rows(table, F.col(row), id_col, text_col)).select("doc_id", "node", F.col("best.id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """docs with one row of each component, that with the least id (of equal ids, and of rows without one, the first); all columns stay. With bits, SimHash
    fingerprints that differ in so many bits at most are links as well."""
    table, row = cluster.numbered(docs)
    return cluster.without(table, row, _labelled(_rows(table, F.col(row), id_col, text_col), bits).filter("row <> best.row"))


def _labelled(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """rows: row, doc_id, text. Returns row, doc_id, node, best (the first row of its component)."""
    with cluster.Scratch(rows.sparkSession) as scratch:
        return _linked(rows, scratch, bits)


def _fingerprint_links(each: DataFrame, bits: int, scratch: cluster.Scratch) -> DataFrame:
    """Links a, b among nodes: those of one fingerprint with the least of them, and these where the fingerprints are linked."""
    held = scratch.table(each.select("node", "fp").distinct())
    named_by = scratch.table(held.groupBy("fp").agg(F.min("node").alias("by")))
    near = simhash.links(named_by.select("fp").repartition("fp"), bits)
    for end in "ab":
        near = near.join(named_by.select(F.col("fp").alias(end), F.col("by").alias(f"by_{end}")), end)
    same = held.join(named_by.hint("merge"), "fp").filter("node <> by").select(F.col("node").alias("a"), F.col("by").alias("b"))
    return scratch.table(near.select(F.col("by_a").alias("a"), F.col("by_b").alias("b")).unionByName(same))


def _linked(rows: DataFrame, scratch: cluster.Scratch, bits: int | None) -> DataFrame:
    spark = rows.sparkSession

    def sketch(batches):
        forget()  # a worker may have encoded the stage before
        for batch in small(batches):
            for i, h, at in shingles(column(batch, "text")):
                n = len(at) - 1
                data = _bands(h, at).astype("<u8").tobytes()
                off = pa.py_buffer((np.arange(n + 1) * 8 * BANDS).astype(np.int32).tobytes())
                fp = {} if bits is None else {"fp": pa.array(simhash.fingerprints(column(batch, "text").slice(i, n)).view(np.int64))}
                yield pa.RecordBatch.from_pydict(
                    {"row": column(batch, "row").slice(i, n), "doc_id": column(batch, "doc_id").slice(i, n), "node": pa.array(_nodes(h, at).view(np.int64)), "bands": pa.Array.from_buffers(pa.binary(), n, [None, off, pa.py_buffer(data)])} | fp
                )

    def spread(batches):
        for batch in batches:
            node = column(batch, "node").to_numpy()
            key = np.frombuffer(b"".join(column(batch, "bands").to_pylist()), "<i8")
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "node": pa.array(np.repeat(node, BANDS))})

    def texts(batches):
        for batch in small(batches):
            for i, h, at in shingles(column(batch, "text")):
                n = len(at) - 1
                yield pa.RecordBatch.from_pydict({"node": pa.array(_nodes(h, at).view(np.int64)), "text": column(batch, "text").slice(i, n)})

    def sets(batches):
        for batch in small(batches):
            for i, h, at in shingles(column(batch, "text")):
                n = len(at) - 1
                off = pa.py_buffer((at * 8).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_pydict({"node": column(batch, "node").slice(i, n), "s": pa.Array.from_buffers(pa.binary(), n, [None, off, pa.py_buffer(h.astype("<u8").tobytes())])})

    def verify(batches):
        for batch in batches:
            ok = [_similar(x.as_buffer(), y.as_buffer()) for x, y in zip(column(batch, "sa"), column(batch, "sb"), strict=True)]
            yield pa.RecordBatch.from_pydict({c: column(batch, c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")})

    def compare(table: pa.Table) -> pa.Table:
        unit, side, node, root = (column(table, c).to_numpy(zero_copy_only=False) for c in ("unit", "side", "node", "root"))
        sets = column(table, "s")
        order = np.lexsort((side, unit))
        cut = np.flatnonzero(np.diff(unit[order], prepend=unit[order[0]] - 1))
        found = []
        for i, j in zip(cut, [*cut[1:], len(order)], strict=True):
            sides: tuple[list, list] = ([], [])
            for k in order[i:j].tolist():
                sides[int(side[k])].append((int(node[k]), int(root[k]), np.frombuffer(sets[k].as_buffer(), "<u8")))
            if sides[0] and sides[1]:
                found += _block_links(*sides)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    each = scratch.table(rows.mapInArrow(sketch, "row long, doc_id long, node long, bands binary" + ("" if bits is None else ", fp long")))
    distinct = scratch.table(each.groupBy("node").agg(F.min(F.struct(*first_of())).alias("best"), F.first("bands").alias("bands")))
    keyed = distinct.filter("node <> 0").mapInArrow(spread, "key long, node long")
    # a bucket may hold any share of the texts: what is known of it is a table of its own, so that adaptive execution can split the merge join
    buckets = scratch.table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1"))
    members = scratch.table(keyed.join(buckets.hint("merge"), "key"))
    degree = members.groupBy("node").agg(F.sum("met").alias("degree"))
    hubs = scratch.table(members.select("key", "node").join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("hub")))
    members = scratch.table(members.join(hubs.hint("merge"), "key").select("key", "node", "hub", "met"))
    suspects = degree.select("node")
    known = scratch.table(rows.mapInArrow(texts, "node long, text string").join(suspects, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")).mapInArrow(sets, "node long, s binary"))

    stars = members.filter("node <> hub").select("node", "hub").distinct()
    pairs = stars.join(known.select("node", F.col("s").alias("sa")), "node").join(known.select(F.col("node").alias("hub"), F.col("s").alias("sb")), "hub")
    links = pairs.select(F.col("node").alias("a"), F.col("hub").alias("b"), "sa", "sb").mapInArrow(verify, "a long, b long")
    links = scratch.table(links if bits is None else links.unionByName(_fingerprint_links(each, bits, scratch)))
    roots = components(links, scratch)
    # members with the components that the stars gave; buckets that hold several are compared further
    for end in ("node", "hub"):
        up = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        members = members.join(up, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    members = scratch.table(members.select("key", "node", "met", "node_root", (F.col("node_root") != F.col("hub_root")).alias("outside")))
    open_keys = scratch.table(members.filter("outside").groupBy("key").agg(F.count(F.lit(1)).alias("out")))
    few = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    spots = members.join(open_keys.hint("merge"), "key")
    place = lambda c: F.pmod(F.xxhash64("node"), few(c)).cast("int")
    left = spots.filter("outside").select("key", "node", "node_root", F.lit(0).alias("side"), place("out").alias("i"), F.explode(F.sequence(F.lit(0), few("met") - 1)).alias("j"))
    right = spots.select("key", "node", "node_root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), few("out") - 1)).alias("i"), place("met").alias("j"))
    blocks_ = scratch.table(left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("unit"), "side", "node", F.col("node_root").alias("root")))
    n_cells = cluster.units(spark, blocks_.count(), CELL)
    filled = blocks_.join(known, "node").withColumn("cell", F.pmod("unit", F.lit(n_cells))).repartition(cluster.tasks(spark, n_cells), "cell")
    more = filled.groupBy("cell").applyInArrow(compare, "a long, b long")
    roots = components(links.unionByName(more), scratch)
    return named(each.select("row", "doc_id", "node"), distinct.select("node", "best"), roots, "node")
