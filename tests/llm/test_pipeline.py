"""The pipeline, stage by stage, against brute force on the whole smallest tables and on a table of edges."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessella.llm import packing, pii, quality, simhash

from .test_near_dup import brute as brute_near
from .test_near_dup import brute_set
from .test_tokens import check_pieces, ids_of

SF = "/root/testdata/sf0.001"


def brute(spark, rows, sf_dir):
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = [rows]
    good = model.scores(quality.statistics(pa.array([r["text"] for r in rows], pa.string()))) >= quality.THRESHOLD
    rows = [r for r, g in zip(rows, good, strict=True) if g]
    out.append(rows)
    best = {}  # of equal texts the largest id stays, of rows equal in both any one
    for k, r in enumerate(rows):
        t = r["text"] or ""
        if t not in best or (r["doc_id"] is not None and (rows[best[t]]["doc_id"] is None or r["doc_id"] > rows[best[t]]["doc_id"])):
            best[t] = k
    rows = [rows[k] for k in sorted(best.values())]
    out.append(rows)
    named, _ = brute_near([r["text"] for r in rows], list(range(len(rows))))  # components by place
    least = {}
    for k, c in sorted(named):
        if c not in least or (rows[k]["doc_id"] is not None and (rows[least[c]]["doc_id"] is None or rows[k]["doc_id"] < rows[least[c]]["doc_id"])):
            least[c] = k
    rows = [rows[k] for k in sorted(least.values())]
    out.append(rows)
    spans = pii.find(pa.array([r["text"] for r in rows], pa.string()), pii.default_field())
    rows = [r | {"text": t, "n_chars": r["n_chars"] if t is None else len(t)} for r, s in zip(rows, spans, strict=True) for t in [pii._masked(r["text"], s)]]
    out.append(rows)
    return out


def as_set(rows):
    return sorted((tuple(sorted(r.items())) for r in rows), key=repr)


@pytest.mark.parametrize("edges", [False, True])
def test_stages(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if edges:
        text = docs.filter("doc_id = 9").first()["text"]
        more = [(1001, text, None, "s", 1), (1002, text, "en", None, None), (1003, text + " é a@b.org x", "en", "s", 3), (1004, "w " * 30_000, "en", "s", 4), (1005, "", None, None, 0), (1006, " \n", "en", "s", 2)]
        more += [(11, text + " and some more words that make it another text", "en", "s", 5), (1001, "one id, another text of its own", "en", "s", 6), (None, text, "en", "s", 7), (None, "no id " * 60, "en", "s", 8)]
        docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({c: F.lit(3) for c in ("_gone", "_row", "row", "fp", "node", "best", "unit", "__row", "n_words")})
        docs = docs.unionByName(docs.filter("doc_id in (1001, 1005, 12)"))
    want = brute(spark, [r.asDict() for r in docs.collect()], SF)
    now = docs
    for (name, stage), rows in zip(cp.STAGES[:-1], want[1:], strict=True):
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        assert as_set(r.asDict() for r in now.collect()) == as_set(rows), name
        now = spark.createDataFrame(now.collect(), docs.schema)
    assert 0 < len(want[4]) < len(want[0])
    once = now.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.pack(once).collect(), {r.doc_id: ids_of(r.text) for r in once.collect()}, 2048)
    assert cp.STAGES[-1][1](spark, now, SF).filter("length < 1").count() == 0


def test_a_table_of_two_columns(spark):
    docs = spark.createDataFrame([(1, "mail me at a@b.org " + "word " * 60), (2, None)], "doc_id long, text string")
    for _, stage in cp.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    assert [(r.doc_id, (r.text or "")[:18]) for r in docs.orderBy("doc_id").collect()] == [(1, "mail me at <email>"), (2, "")]


def test_run(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_null_labels_and_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_the_simhash_stage_links_by_fingerprints_too(spark):
    """Chains of both kinds: fingerprints at 3 bits or fewer whose texts have a Jaccard under 0.8, and the other way."""
    rng = random.Random(5)
    base = rng.choices([f"w{k}" for k in range(50)], k=12) * 40  # one edit in twelve words, in the fortieth round alone: many new shingles, hardly any weight
    other = list(base)
    for k in range(6):
        other[36 * k + 5] = f"n{k}"
    third = [*base, "a", "tail"]
    alone = rng.choices([f"v{k}" for k in range(300)], k=200)
    edited = ["x" if k % 50 == 25 else w for k, w in enumerate(alone)]
    texts = [" ".join(x) for x in (base, other, third, alone, edited)] + [None, ""]
    ids = [10, 20, 5, 40, 30, 2, 1]
    fp = simhash.fingerprints(pa.array(texts, pa.string()))
    assert int(fp[0] ^ fp[1]).bit_count() <= 3 and int(fp[3] ^ fp[4]).bit_count() > 3
    jaccard = lambda i, j: len(brute_set(texts[i]) & brute_set(texts[j])) / len(brute_set(texts[i]) | brute_set(texts[j]))
    assert jaccard(0, 1) < 0.8 <= jaccard(3, 4)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in cp.stage_simhash_dedup(spark, docs, "").collect()} == {5, 30, 1}
    # over a whole table: no two rows that stay have fingerprints within 3 bits
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fp = simhash.fingerprints(pa.array([r.text for r in cp.stage_simhash_dedup(spark, docs, "").select("text").collect()], pa.string()))
    assert min(int(np.bitwise_count(fp[i] ^ fp[i + 1 :]).min()) for i in range(len(fp) - 1)) > 3
