"""Token-id files: a concatenated id array per segment, with Elias-Fano coded document bounds and select samples.

A token file is a Parquet folder of segments, so any store that Spark writes will do. A segment has
    part, segment   its place: segments in order of (part, segment) hold the documents in ascending doc_id order
    offset          ids of the part before it; the parts' totals give the rest
    doc_ids         its documents
    ids             their ids, end id included, little-endian, 2 bytes each if the vocabulary allows, else 4
    bounds          EliasFano.encode of the ends of its documents in ids

Nulls and edges: null text counts as empty (its end id alone is written); null ids come first; rows with equal ids are
ordered by a hash of their text, equal rows by their number, so that even they are spread over parts; a very long text is one long
document of its segment; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster
from .arrays import column, small
from .tokens import encoder, vocabulary, with_end

#: Bytes of text per part. Beyond cluster.MOST_TASKS parts they get longer instead; a task streams through its part, a segment at a time.
PART_BYTES = 16 << 20
SEGMENT_IDS = 1 << 20
#: Documents that the reader hands out at a time.
SLICE = 1024


class EliasFano:
    """A non-decreasing sequence below 2 ** 40 in about 2 + log2(top / n) bits a value, with select in constant reads.

    Layout: n, low bits a value, top (8 bytes each), samples (4 bytes for every 64th one of the upper bits), low bits, upper bits.
    """

    HEAD, EVERY = 24, 64

    def __init__(self, blob: bytes):
        self.n, self.low, self.top = (int(x) for x in np.frombuffer(blob, "<u8", 3))
        n_samples = -(-self.n // self.EVERY)
        at = self.HEAD + 4 * n_samples
        self.samples = np.frombuffer(blob, "<u4", n_samples, self.HEAD)
        n_low = (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(blob, np.uint8, n_low, at)
        self.highs = np.frombuffer(blob, np.uint8, -1, at + n_low)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = np.asarray(values, np.int64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (v >> low) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        upper[ones] = 1
        lows = ((v[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
        head = np.array([n, low, top], "<u8").tobytes()
        return head + ones[:: EliasFano.EVERY].astype("<u4").tobytes() + np.packbits(lows, bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes()

    def select(self, i: int) -> int:
        """The i-th value: from a sample, over at most EVERY ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // self.EVERY])
        left = i % self.EVERY
        byte, bit = divmod(at, 8)
        word = int(self.highs[byte]) >> bit << bit
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        value = (one - i) << self.low
        for b in range(self.low):
            k = i * self.low + b
            value |= (int(self.lows[k >> 3]) >> (k & 7) & 1) << b
        return value

    def selects(self, i: int, j: int) -> np.ndarray:
        """The values from the i-th to before the j-th: from the sample before i, over the upper bits up to the sample after j."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        k = i // self.EVERY
        at = int(self.samples[k])
        after = -(-j // self.EVERY)
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[at // 8 : stop], bitorder="little")) + at // 8 * 8
        ones = ones[ones >= at][i - k * self.EVERY :][: j - i]
        first = i * self.low // 8
        bits = np.unpackbits(self.lows[first : (j * self.low + 7) // 8], bitorder="little")[i * self.low - 8 * first :][: (j - i) * self.low].reshape(j - i, self.low)
        return ((ones - np.arange(i, j)) << self.low) | (bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low)))


def write_token_file(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes the segments under path."""
    spark = docs.sparkSession
    vocab = vocab or vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_parts = cluster.tasks(spark, cluster.units(spark, cluster.text_bytes(rows), PART_BYTES))
    kind = "<u2" if max(encoder(vocab).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    item = int(kind[-1])

    def encoded(batches):
        enc = encoder(vocab)
        for batch in small(batches):
            for i, ids, at in enc.encode(column(batch, "text")):
                ids, at = with_end(ids, at, end_id)
                n = len(at) - 1
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * item).astype(np.int32).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_pydict({c: column(batch, c).slice(i, n) for c in ("doc_id", "tie", "row")} | {"ids": blobs})

    # encoded before the sort: ids are half as long as texts, and the sort's sample reads the keys alone
    with cluster.Scratch(spark) as scratch:
        keyed = rows.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")
        known = scratch.table(keyed.mapInArrow(encoded, "doc_id long, tie long, row long, ids binary"))
        ordered = known.repartitionByRange(n_parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
        _segments(ordered, kind).write.option("compression", "zstd").parquet(path)


def _segments(ordered: DataFrame, kind: str) -> DataFrame:
    item = int(kind[-1])

    def segments(batches):
        part, n, offset = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        ends: list[np.ndarray] = []
        doc_ids: list[pa.Array] = []
        size = 0

        def flush():
            nonlocal n, offset, size
            out = pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "segment": pa.array([n], pa.int32()),
                    "offset": pa.array([offset], pa.int64()),
                    "n_ids": pa.array([size], pa.int64()),
                    "doc_ids": pa.array([pa.concat_arrays(doc_ids).to_pylist()], pa.list_(pa.int64())),
                    "ids": pa.array([b"".join(held)], pa.binary()),
                    "bounds": pa.array([EliasFano.encode(np.concatenate(ends))], pa.binary()),
                }
            )
            n, offset, size = n + 1, offset + size, 0
            held.clear(), ends.clear(), doc_ids.clear()
            return out

        for batch in batches:
            blobs = column(batch, "ids")
            off = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64) if len(blobs) else np.zeros(1, np.int64)
            data, i = blobs.buffers()[2], 0
            while i < len(blobs):  # up to the document that fills the segment
                j = min(len(blobs), int(np.searchsorted(off, off[i] + (SEGMENT_IDS - size) * item)))
                j = max(j, i + 1)
                held.append(data[int(off[i]) : int(off[j])].to_pybytes())
                ends.append((off[i + 1 : j + 1] - off[i]) // item + size)
                doc_ids.append(column(batch, "doc_id").slice(i, j - i))
                size += int(off[j] - off[i]) // item
                i = j
                if size >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    return ordered.mapInArrow(segments, "part int, segment int, offset long, n_ids long, doc_ids array<long>, ids binary, bounds binary")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 4 bytes each)."""
    stored = spark.read.parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per part: cluster.MOST_TASKS at most
    base, at = [], 0
    for r in totals:
        base.append((r["part"], at))
        at += r["n"]
    bases = spark.createDataFrame(base, "part int, base long")

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                bounds = EliasFano(batch.column("bounds")[row].as_buffer().to_pybytes())
                raw, doc_ids = batch.column("ids")[row].as_buffer(), batch.column("doc_ids")[row].values
                kind = np.dtype("<u2" if len(raw) == 2 * bounds.select(bounds.n - 1) else "<u4")
                first = batch.column("base")[row].as_py() + batch.column("offset")[row].as_py()
                begin = 0
                for i in range(0, bounds.n, SLICE):
                    ends = bounds.selects(i, min(i + SLICE, bounds.n))
                    ids = np.frombuffer(raw, kind, int(ends[-1]) - begin, begin * kind.itemsize).astype("<u4")
                    starts = np.concatenate([[begin], ends[:-1]])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(doc_ids.slice(i, len(ends))),
                            "start": pa.array(first + starts, pa.int64()),
                            "n_tokens": pa.array(ends - starts, pa.int64()),
                            "ids": pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.append(starts, ends[-1:]) - begin).astype(np.int32) * np.int32(4)), pa.py_buffer(ids.tobytes())]),
                        }
                    )
                    begin = int(ends[-1])

    joined = stored.select("part", "offset", "doc_ids", "ids", "bounds").join(F.broadcast(bases), "part")
    return joined.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, position: int) -> np.ndarray:
    """Ids of the document at a position of its file (0 is the first), by one select in its segment."""
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("part").agg(F.sum(F.size("doc_ids")).cast("long").alias("n")).orderBy("part").collect()  # a row per part
    for r in sizes:
        if position < r["n"]:
            break
        position -= r["n"]
    else:
        raise IndexError("no document there")
    for s in stored.filter(F.col("part") == r["part"]).select("segment", F.size("doc_ids").alias("n")).orderBy("segment").toLocalIterator():
        if position < s["n"]:
            break
        position -= s["n"]
    row = stored.filter((F.col("part") == r["part"]) & (F.col("segment") == s["segment"])).select("ids", "bounds").first()
    bounds = EliasFano(bytes(row["bounds"]))
    kind = np.dtype("<u2" if len(row["ids"]) == 2 * bounds.select(bounds.n - 1) else "<u4")
    a, b = bounds.select(position - 1) if position else 0, bounds.select(position)
    return np.frombuffer(row["ids"], kind, b - a, a * kind.itemsize).astype(np.int64)
