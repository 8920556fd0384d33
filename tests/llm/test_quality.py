"""Rule ensemble: compiled expressions against numpy, held-out accuracy, edges."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import quality as q

rng = random.Random(8)
WORDS = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(500)]


def good():
    return "\n".join(" ".join(rng.choices(WORDS, k=rng.randrange(6, 20))).capitalize() + "." for _ in range(rng.randrange(2, 9)))


def bad():
    ws = rng.choices(WORDS, k=rng.randrange(30, 120))
    return rng.choice([" | ".join(ws), " ".join(w + "###" for w in ws), " ".join(ws).upper() + "!!", "\n".join([" ".join(ws[:5])] * 12)])


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, good() if i % 4 else bad(), "en", 1.5) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(0, 900)] + [(7, None, 1), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_expression(spark, tables):
    docs, labels = tables
    model = q.train(docs, labels)
    rows = {r.doc_id: r for r in q.score(docs, model).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.97
    texts = pa.array([r.text for r in docs.orderBy("doc_id").collect()])
    assert np.allclose(model.scores(q.statistics(texts)), [rows[i].score for i in range(900)], atol=1e-12)
    kept = {r.doc_id for r in q.keep_good(docs, model).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted == 1}
    assert q.keep_good(docs, model).columns == docs.columns


def test_edges(spark, tables):
    docs, labels = tables
    model = q.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (None, ""), (3, " \n"), (3, "x" * 100_000), (4, "w " * 50_000)], "doc_id long, text string")
    rows = q.score(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows[:3]}) == 1
    assert q.score(odd.limit(0), model).collect() == []
    assert q.train(docs, labels.limit(0)).scores(np.zeros((1, len(q.STATS))))[0] == 0.5
    assert q.train(docs, labels.filter("quality = 1")).scores(np.zeros((1, len(q.STATS))))[0] > 0.9


def test_statistics_by_hand():
    (x,) = q.statistics(pa.array(["The cat sat.\nThe cat sat.\nOn | THE mat##"]))
    s = dict(zip(q.STATS, x, strict=True))
    assert s["n_words"] == np.log1p(10) and s["dup_line_share"] == 1 / 3 and s["bar_share"] == 0.1 and s["tail_share"] == 0.1
    assert s["top_word_share"] == 0.2 and s["end_share"] == 0.2 and s["upper_share"] == 6 / 31


def test_keep_good_filters_on_the_compiled_column(spark, tables, monkeypatch):
    docs, labels = tables
    model = q.train(docs, labels)
    docs = docs.withColumn(q.STATS[0], docs["lang"])  # a name of a statistic
    want = {r.doc_id for r in q.score(docs, model).filter("predicted = 1").collect()}
    monkeypatch.setattr(model, "scores", None)
    kept = q.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert all(r[q.STATS[0]] == "en" for r in kept.collect())
