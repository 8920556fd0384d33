"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import random
from itertools import combinations

import corpus_pipeline as cp
from tessella.llm import near_dup


def brute_set(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = low.encode().split()
    return {b" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else {b" ".join(ws)}


def brute(texts, ids):
    sets = [brute_set(t) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i, j in combinations(range(len(ids)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            pairs += 1
            root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return {(k, least.get(find(i))) for i, k in enumerate(ids)}, pairs


def made(seed=4):
    rng = random.Random(seed)
    texts = [None, "", " \n", "One two", "one  TWO", "one two three", "a b c d e", "w " * 3000, "W " * 9]
    for n in (25, 60, 130, 400, 2500):
        for _ in range(4):
            base = rng.choices([f"w{k}" for k in range(300)], k=n)
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, n // 60, n // 50, n // 45, n // 40, n // 20):
                ws = list(base)
                for _ in range(edits):
                    ws[rng.randrange(n)] = f"n{rng.randrange(99)}"
                texts.append(" ".join(ws))
                base = ws if rng.random() < 0.5 else base  # chains as well
    return texts, [*rng.sample(range(1000), len(texts) - 1), None]


def test_components_match_brute_force(spark):
    texts, ids = made()
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    want, pairs = brute(texts, ids)
    assert {(r.doc_id, r.component_id) for r in near_dup.near_dedup(df).collect()} == want
    assert pairs > 100
    got = {r.doc_id for r in cp.stage_simhash_dedup(spark, df, "").collect()}
    assert got == {k for k, c in want if k == c}


def test_all_documents_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    rows = docs.select("doc_id", "text").collect()
    want, pairs = brute([r.text for r in rows], [r.doc_id for r in rows])
    assert pairs and {(r.doc_id, r.component_id) for r in near_dup.near_dedup(docs).collect()} == want


def test_empty(spark):
    assert near_dup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_planted_pairs(spark):
    """1500 planted near copies of texts of 60 to 500 words, an edit at a time until just above 0.8; and as many that fall just under it."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    rows, over, under = [], [], []
    for k in range(1500):
        base = rng.choices(words, k=rng.randrange(60, 500))
        a, copy = brute_set(" ".join(base)), list(base)
        jaccard = lambda b: len(a & b) / len(a | b)
        while True:
            before = list(copy)
            at = rng.randrange(len(copy))
            copy[at : at + rng.choice([0, 1, 1])] = [f"n{rng.randrange(10**6)}"]
            if jaccard(brute_set(" ".join(copy))) < 0.8:
                break
            if rng.random() < 0.1:  # many stay well above
                before = list(copy)
                break
        rows.append((3 * k, " ".join(base)))
        if before != base:
            rows.append((3 * k + 1, " ".join(before)))
            over.append(3 * k)
        if jaccard(brute_set(" ".join(copy))) < 0.8:
            rows.append((10**6 + k, " ".join(rng.choices(words, k=30)) + " " + " ".join(copy)))  # further from either
            if all(len(x & y) < 0.8 * len(x | y) for y in [brute_set(rows[-1][1])] for x in (a, brute_set(" ".join(before)))):
                under.append((3 * k, 10**6 + k))
    got = {r.doc_id: r.component_id for r in near_dup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    linked = sum(got[k + 1] == k for k in over)
    assert len(over) > 1300 and linked >= 0.998 * len(over)  # 0.9996 of pairs at 0.8 share a band
    assert len(under) > 200 and all(got[a] != got[b] for a, b in under)
