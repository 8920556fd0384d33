"""Substring dedup against a plain version; the exchange's coding; windows across document bounds."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import arrays
from tessella.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, size):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, ws in words:
        if i is not None:
            for k in range(len(ws) - size + 1):
                w = tuple(ws[k : k + size])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - size + 1):
            if i is not None and first[tuple(ws[k : k + size])] < i:
                gone |= set(range(k, k + size))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k - 1:
                spans[-1][1] = k
            else:
                spans.append([k, k])
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone), [x for s in spans for x in s]))
    return sorted(out, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "é", "𝄞x", "a-very-long-word"]), max_size=12).map(" \n".join), min_size=1, max_size=6), st.integers(1, 4))
def test_window_hashes_tell_windows_apart(texts, size):
    seen = {}
    for b in sd._windows(pa.table({"text": pa.array(texts)}), size):
        for k, d, h, m in zip(b.at.tolist(), b.doc.tolist(), b.hash.tolist(), b.more.tolist(), strict=True):
            ws = WORD.findall(texts[b.first + d])
            own = tuple(ws[k - b.words.first[d] :][:size])
            assert len(own) == size and seen.setdefault((h, m), own) == own
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50, unique=True), st.integers(1, 400))
def test_exchange_coding(hashes, docs):
    h = np.array(sorted(hashes), np.uint64)
    more = (h % np.uint64(65536)).astype(np.uint16)
    ids = np.random.default_rng(docs).integers(-docs, docs, len(h))
    assert [x.tolist() for x in sd.unpack(sd.pack(h, more, ids))] == [h.tolist(), more.tolist(), ids.tolist()]


def test_equal_first_parts_are_told_apart_by_the_second():
    h, more = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 0], np.uint16)
    s, m, least, place = sd._distinct(h, more, np.array([9, 8, 4, 3]))
    assert (s.tolist(), m.tolist(), least.tolist(), place.tolist()) == ([5, 5, 7], [1, 2, 0], [4, 8, 3], [0, 1, 0, 2])


def test_matches_plain(spark, monkeypatch):
    monkeypatch.setattr(sd, "UNIT_BYTES", 3000)
    monkeypatch.setattr(arrays, "BLOCK_BYTES", 700)
    rng = random.Random(7)
    passage = " ".join(rng.choices("abcdefgh", k=60))
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(0, 60))) + (" " + passage if i % 3 == 0 else "")) for i in rng.sample(range(500), 60)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (901, passage), (None, passage), (None, None), (902, ""), (903, " \n "), (904, "w " * 5000), (905, "w " * 300)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_words string").repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.removed) for r in sd.substring_dedup(df, 13).collect()), key=repr)
    assert got == plain(rows, 13)
    assert sd.digest(sd.substring_dedup(df.limit(0))).collect() == []
    by = {r.doc_id: r.kept_sha256 for r in sd.digest(sd.substring_dedup(df)).filter("doc_id = 905").collect()}
    assert by[905] == hashlib.sha256(b"").hexdigest()


def test_many_equal_rows(spark):
    """A hundred thousand rows equal in id and text, and others that share a passage with them."""
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.range(100_000).selectExpr("7L as doc_id", f"'{text}' as text").union(spark.createDataFrame([(8, "x " + text), (3, text[:40])], "doc_id long, text string"))
    got = sd.substring_dedup(df).groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()
    assert sorted(tuple(r) for r in got) == [(3, len(text[:40].split()), 0, text[:40].strip(), 1), (7, 20, 0, text, 100_000), (8, 21, 20, "x", 1)]
