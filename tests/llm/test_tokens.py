"""Token files and packing against whole-text encoding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing, token_files, tokens

WHOLE = Tokenizer.from_file(tokens.vocabulary())
TEXTS = [None, "", " \n", "Hello, world!", "don't 's 're x y 12", "é é́ ́x ΑΣ ΣΑΣ İx", "<|endoftext|>a b<|startoftext|>", "a\x1cb \x85c d", "Über élève. ñandú?!", "x" * 5000, "word " * 3000, *(" ".join(random.Random(i).choices(["Ntbl", "eré,", "so.", "(a)", "1a2", "a's"], k=40 * i)) for i in range(12))]


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_words_encode_like_whole_texts(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert tokens.WordEncoder(tokens.vocabulary()).verify(texts)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    enc = tokens.WordEncoder(tokens.vocabulary())
    assert enc.verify([t or "" for t in TEXTS]) and enc.verify(["more words come here now"])


@given(st.lists(st.integers(0, 5000), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano(gaps):
    v = np.cumsum(np.array(gaps, np.int64))
    ef = token_files.EliasFano(token_files.EliasFano.encode(v))
    assert ef.selects(0, len(v)).tolist() == v.tolist()
    for i in range(0, len(v), 7):
        assert ef.selects(i, min(len(v), i + 70)).tolist() == v[i : i + 70].tolist()
    assert [ef.select(i) for i in range(len(v))] == v.tolist()


def docs(spark, texts, ids=None):
    ids = ids or random.Random(1).sample(range(10**6), len(texts))
    return spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), strict=True)), "doc_id long, text string, start string").repartition(3), ids


def test_token_file_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    df, ids = docs(spark, TEXTS)
    token_files.write_token_file(df, f"{tmp_path}/t")
    got = {r.doc_id: (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_token_file(spark, f"{tmp_path}/t").collect()}
    at = 0
    for i, t in sorted(zip(ids, TEXTS, strict=True)):
        want = ids_of(t)
        assert got[i] == (at, len(want), want)
        at += len(want)
    empty, _ = docs(spark, [])
    token_files.write_token_file(empty, f"{tmp_path}/e")
    assert token_files.read_token_file(spark, f"{tmp_path}/e").collect() == []


def test_token_file_slices_random_access_and_wide_end_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 3)
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 40)
    df, ids = docs(spark, TEXTS * 5, list(range(5 * len(TEXTS))))
    token_files.write_token_file(df, f"{tmp_path}/t", end_id=70_000)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_token_file(spark, f"{tmp_path}/t").collect()}
    want = {i: [*ids_of(t)[:-1], 70_000] for i, t in zip(ids, TEXTS * 5, strict=True)}
    assert got == want
    for k in (0, 1, len(want) // 2, len(want) - 1):
        assert token_files.read_document(spark, f"{tmp_path}/t", k).tolist() == want[k]


def test_equal_rows_spread_over_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 20_000)
    monkeypatch.setattr(packing, "PART_BYTES", 20_000)
    df = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'the same text' as text")
    token_files.write_token_file(df, f"{tmp_path}/t")
    parts = [r["n"] for r in spark.read.parquet(f"{tmp_path}/t").groupBy("part").agg({"n_ids": "sum"}).toDF("part", "n").collect()]
    assert len(parts) > 5 and max(parts) < sum(parts) / 4
    ranges = [r["count"] for r in packing.pack(df).selectExpr("sequence_id >> 40 as part").groupBy("part").count().collect()]
    assert len(ranges) > 5 and max(ranges) < sum(ranges) / 4


def test_hilbert_neighbours_differ_by_one():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert(side, 3)
    assert sorted(key) == list(range(512))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check_pieces(rows, by_doc, length):
    docs_of, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs_of[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs_of) == set(by_doc)
    for d, rs in docs_of.items():
        want, at = by_doc[d], 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert np.frombuffer(r.ids, "<u4").tolist() == want[at : at + r.length]
            at += r.length
        assert at == len(want)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at & (at - 1) == 0 and at < length


def test_pack(spark):
    df, ids = docs(spark, TEXTS)
    rows = packing.pack(df, 256).collect()
    check_pieces(rows, {i: ids_of(t) for i, t in zip(ids, TEXTS, strict=True)}, 256)
    assert [(r.ids_crc32) for r in packing.digest(packing.pack(df.limit(0))).collect()] == []


def test_pack_repeated_rows_and_null_ids(spark):
    df, _ = docs(spark, ["same text"] * 40, [None, 7] * 20)
    rows = packing.pack(df, 8).collect()
    assert sum(r.length for r in rows) == 40 * len(ids_of("same text"))


def test_key_order_puts_copies_together():
    enc = tokens.encoder(tokens.vocabulary())
    (_, ids, at), = enc.encode(pa.array(["one two three four"] * 2 + ["other things are said here"]))
    p = packing.project(ids, at)
    k = packing.keys(p, p.mean(0), p.std(0), np.array([1, 2, 3])) >> 32
    assert k[0] == k[1] != k[2]


def test_grid_is_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 2000)
    monkeypatch.setattr(packing, "SAMPLE", 1)
    seen, keys = [], packing.keys
    monkeypatch.setattr(packing, "keys", lambda points, mean, sd, tie: seen.append((mean, sd)) or keys(points, mean, sd, tie))
    df, ids = docs(spark, TEXTS * 8, list(range(8 * len(TEXTS))))
    rows = packing.pack(df, 256).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    enc = tokens.encoder(tokens.vocabulary())
    p = np.concatenate([packing.project(i, at) for _, i, at in enc.encode(pa.array([t or "" for t in TEXTS]))])
    assert np.allclose(seen[0][0], p.mean(0), atol=1e-6) and np.allclose(seen[0][1], p.std(0), atol=1e-6)
    check_pieces(rows.collect(), {i: ids_of(t) for i, t in zip(ids, TEXTS * 8, strict=True)}, 256)
