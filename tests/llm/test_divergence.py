"""Source divergence: the whole result against plain counting, the sketch never under the true frequency, and edges."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessella.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, ranks=200):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        docs = [(TERM.findall(t.translate(LOWER)), s) for t, g, s in rows if g == lang]
        df = Counter(w for ws, _ in docs for w in set(ws))
        kept = sorted(w for w in df if df[w] >= 3)
        count = {s: Counter() for _, s in docs}
        for ws, s in docs:
            count[s].update(w for w in ws if df[w] >= 3)
        every = sum(count.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda x, q: (x - q) ** 2 // q
        for s, c in count.items():
            pairs = [(-sum(f(p(c, w), p(b, w)) for w in kept), o) for o, b in count.items() if o != s]
            terms = [(-f(p(c, w), p(every, w)), w) for w in kept if c[w] and p(c, w) > p(every, w)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                out += [(lang, s, part, i, -v, k + 1) for k, (v, i) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


def mine(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in dv.divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = ["Haus", "HAUS", "x1y", "ß", "Æther", "æther", "the", "of", "12", "naïve", "日本", "a_b", "\x80é", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(4) for j in range(4))]
    rows = [(i, " ".join(rng.choices(words, weights=[3] * 13 + [1] * 16, k=rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S2", None, "ü"])) for i in range(120)]
    rows += [(None, None, "en", "only nulls"), (5, "", "zz", "one"), (5, "", "zz", "two"), (6, "once alone", "yy", "single"), *[(7, "same same row", "rr", "a")] * 3, (8, "row", "rr", "b")]
    got = mine(spark, rows)
    assert got == brute(rows)
    assert ("zz", "one", "pair", "two", 0, 1) in got and not [r for r in got if r[0] == "yy"]
    assert mine(spark, rows, ranks=2) == brute(rows, 2)


def test_edges(spark):
    assert mine(spark, []) == []
    long = " ".join(["very"] * 300_000 + ["long"] * 200_000)
    rows = [(1, long, "en", "a"), (2, "very long", "en", "b"), (3, "long very other", "en", "b")]
    assert mine(spark, rows) == brute(rows)


def test_sketch_is_never_under(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"q{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(20) for b in range(20) for c in range(20)], k=30)), rng.choice(["en", "de"]), "s") for i in range(400)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    cells = dv.unpack(dv.sketch(df, 16).tobytes())
    real = Counter((g, w) for _, t, g, _ in rows for w in set(t.split()))
    for lang in ("en", "de"):
        terms = sorted({w for g, w in real if g == lang})
        at = dv._cells(dv._hashed(pa.array(terms)), dv._hashed(pa.array([lang] * len(terms))), 16)
        seen, want = cells[at].min(0), np.array([min(3, real[lang, w]) for w in terms])
        assert (seen >= want).all() and (seen == want).mean() > 0.9
    # what the sketch rules out is not counted at all, what it lets through is counted exactly
    found = {(r.lang, r.term): r.docs for r in dv.counts(df, dv.sketch(df, 16), 16).groupBy("lang", "term").agg({"docs": "sum"}).withColumnRenamed("sum(docs)", "docs").collect()}
    assert all(found[k] == n for k, n in real.items() if n >= 3)
    assert all(real[k] == n for k, n in found.items()) and len(found) < 0.75 * len(real)


def test_counters_are_packed():
    x = np.random.default_rng(1).integers(0, 4, 4096).astype(np.uint8)
    assert (dv.unpack(dv.pack(x)) == x).all()
    assert dv.row_bits(0) == dv.SLICE_BITS and (dv.DEPTH << dv.row_bits(10**18)) <= 2**dv.MOST_BITS
