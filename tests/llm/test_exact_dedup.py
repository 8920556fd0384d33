"""Exact dedup against a plain version; Golomb coding; clashing fingerprints."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import exact_dedup as xd


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=60), st.sampled_from([2**40, 2**45]))
def test_golomb_round_trip(values, span):
    v = np.array(sorted(values), np.int64)
    assert xd.golomb_decode(xd.golomb_encode(v, span)).tolist() == v.tolist()


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, done = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        stays = i == keep and (t or "") not in done  # one row of each text
        if stays:
            done.add(t or "")
        out.append((i, keep, len(ids), stays, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "é", "x" * 200_000, *(f"text {k}" for k in range(60))]
    rows = [(i, rng.choice(texts)) for i in rng.sample(range(10_000), 150)] + [(20_000 + k, "hot") for k in range(120)] + [(7, "same row")] * 3 + [(None, "é"), (None, "only null"), (None, "only null")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, sha string").repartition(6)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in xd.exact_dedup(df).collect()), key=repr)
    assert got == plain(rows)
    kept = xd.drop_copies(df)
    assert kept.columns == df.columns and sorted(r.text or "" for r in kept.collect()) == sorted({t or "" for _, t in rows})
    assert xd.exact_dedup(df.limit(0)).collect() == []


def test_matches_plain(spark):
    check(spark)


def test_clashing_fingerprints_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(xd, "_prints", lambda table: np.array([x.as_py()[0] << 40 & 0xF00000000000 for x in table.column("sha")], np.int64))
    check(spark)
