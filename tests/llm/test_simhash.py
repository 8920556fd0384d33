"""SimHash against brute force: fingerprints, the code's covering, links and components."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from tessella.llm import simhash


def brute_print(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w.decode() for w in low.encode().split()]
    shingles = [" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)] if len(ws) >= words else [" ".join(ws)] if ws else []
    sums = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            sums[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * sums[b] > len(shingles))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_match_brute_force():
    texts = [None, "", "  \n", "One", "one TWO", "a b c", "É x y z\tw", "a\x0bb\x0cc d", "w " * 3000, *(" ".join(random.Random(i).choices(["ab", "Cd", "é", "x" * 40], k=i)) for i in range(60))]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts, pa.string()))] == [brute_print(t) for t in texts]


def test_code_covers_and_reaches():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    first = simhash.anchors(x, 0)[1]
    for refined in (None, np.unique(first[:150]), np.unique(first)):
        who, anchor, home = simhash.anchors(x, 0, refined)
        assert home.all() and sorted(who.tolist()) == list(range(300))  # one home each
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in x], np.uint64)
        who2, anchor2, _ = simhash.anchors(x ^ flips, 3, refined)
        reach = set(zip(who2.tolist(), anchor2.tolist(), strict=True))
        assert all(k in reach for k in zip(who.tolist(), anchor.tolist(), strict=True))


def test_forest_links_what_a_home_is_near():
    rng = np.random.default_rng(2)
    for n, bits in ((1, 2), (40, 5), (300, 7), (300, 20)):
        fp = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64) * np.uint64(0x0101010101010101))
        home = rng.random(len(fp)) < 0.4
        a, b = simhash._forest(fp, home, 8)
        want = {(int(x), int(y)) for i, x in enumerate(fp) for j, y in enumerate(fp) if i < j and (int(x) ^ int(y)).bit_count() <= 8 and (home[i] or home[j])}
        assert all((int(min(x, y)), int(max(x, y))) in want for x, y in zip(a, b, strict=True))
        assert _sets(fp, want) == _sets(fp, zip(a.tolist(), b.tolist(), strict=True)) and len(a) < len(fp)


def _sets(fp, edges):
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in edges:
        root[find(x)] = find(y)
    return sorted(sorted(x for x in root if find(x) == r) for r in {find(x) for x in root})


def test_many_around_one_centre(spark):
    """Sixty thousand fingerprints, four bits or fewer from a centre: one anchor is home to nearly all, and its parts meet in blocks."""
    rng = np.random.default_rng(5)
    flips = np.zeros(60_000, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 60_000).astype(np.uint64)
    fp = np.unique(np.uint64(0x5A5A12343C3C9876) ^ flips)
    prints = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64)})).repartition(8)
    found = simhash.links(prints).distinct().toPandas().to_numpy().view(np.uint64)
    assert (np.bitwise_count(found[:, 0] ^ found[:, 1]) <= 3).all()
    at = np.searchsorted(fp, found)
    root = np.arange(len(fp))
    while True:  # the least member reachable, by repeated minima and jumps
        before = root.copy()
        np.minimum.at(root, at[:, 0], before[at[:, 1]])
        np.minimum.at(root, at[:, 1], before[at[:, 0]])
        root = root[root]
        if (root == before).all():
            break
    # by brute force in blocks: does any pair within the distance lie in two components?
    for i in range(0, 4000, 200):
        near = np.bitwise_count(fp[i : i + 200, None] ^ fp[None]) <= 3
        x, y = np.nonzero(near)
        assert (root[i + x] == root[y]).all()


@pytest.mark.parametrize("crowded", [10**9, 3, 0])
def test_components_match_brute_force(spark, monkeypatch, crowded):
    """As it is, with refined anchors in parts, and with all anchors refined and a part for every home."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "PART", max(1, crowded))
    monkeypatch.setattr(simhash, "WAVE", 2)
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=120)) for _ in range(25)]
    texts = [None, "", " ", *base]
    for t in base[:12]:
        for _ in range(6):
            ws = t.split()
            ws[rng.randrange(len(ws))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(ws))
    texts += [base[0]] * 30
    ids = rng.sample(range(1000), len(texts) - 1) + [None]
    df = spark.createDataFrame(list(zip(ids, texts, ["z"] * len(ids), strict=True)), "doc_id long, text string, anchor string").repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(df).collect())
    prints = [brute_print(t) for t in texts]
    want = sorted((i is None, i or 0, f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_components(ids, prints), strict=True))
    assert got == want
    assert len({c for *_, c in want}) < len(set(prints))  # some different fingerprints are linked


def test_empty_and_keep_first(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_dedup(empty).collect() == []
    df = spark.createDataFrame([(5, "a b c d", 1), (3, "a b c d", 2), (None, "a b c d", 3), (9, "other words entirely here now", 4)], "doc_id long, text string, component_id int")
    assert sorted((r.doc_id or -1) for r in simhash.keep_first(df).collect()) == [3, 9]
