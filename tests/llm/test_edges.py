"""Repeated rows, null ids, very long texts, empty tables and clashing columns in the operators that judge row by row."""

import collections

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import license_scan, line_rules, pii, quality, secret_scan, sentencepiece_codec, token_files

from .test_quality import bad, good

SCHEMA = "doc_id long, text string, spans string, score string, kind int, label string, matches int"
LONG = "An ordinary line of words. " * 60_000 + "mail jo@example.com token: s3cr3tvalue9 " + "last words here " * 40_000
TEXTS = [(1, "Call +49 30 1234567 or write to a@b.de."), (1, "Call +49 30 1234567 or write to a@b.de."), (1, "other text of the same id"), (None, "Released under the MIT License."), (None, "Released under the MIT License."), (2, None), (3, ""), (4, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", 3, "z", 1) for i, t in TEXTS], SCHEMA).repartition(3)


OPERATORS = {
    "op2": lambda d: pii.find_pii(d).select("doc_id", F.col("spans").cast("string").alias("out")),
    "op5": lambda d: secret_scan.find_secrets(d).select("doc_id", F.col("spans").cast("string").alias("out")),
    "op7": lambda d: line_rules.line_rules(d).select("doc_id", F.concat_ws(",", "n_words", "n_dup_lines", "kept").alias("out")),
    "op8": lambda d: sentencepiece_codec.encode(d).select("doc_id", F.concat_ws(",", "n_tokens", F.crc32("ids")).alias("out")),
    "op12": lambda d: license_scan.scan_licenses(d).select("doc_id", F.concat_ws(",", "n_words", "labels").alias("out")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_are_judged_each(spark, docs, name):
    """Equal rows get equal results, as many as there are; a row alone gets what it gets among others (op12 but for its corpus's IDF, which these texts do not turn)."""
    got = collections.Counter((r.doc_id, r.out) for r in OPERATORS[name](docs).collect())
    assert sum(got.values()) == len(TEXTS) and sorted((i is None, i or 0) for i, _ in got.elements()) == sorted((i is None, i or 0) for i, _ in TEXTS)
    assert got[next(k for k in got if k[0] is None)] == 2 and max(v for k, v in got.items() if k[0] == 1) >= 2
    alone = collections.Counter()
    for i, t in dict.fromkeys(TEXTS):
        alone[OPERATORS[name](spark.createDataFrame([(i, t, "x", "y", 3, "z", 1)], SCHEMA)).first()["out"]] += TEXTS.count((i, t))
    assert alone == collections.Counter(out for (_, out), n in got.items() for _ in range(n))
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_token_files_of_very_long_texts(spark, docs, tmp_path):
    token_files.write_token_file(docs, f"{tmp_path}/t")
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_file(spark, f"{tmp_path}/t").collect())
    assert len(rows) == len(TEXTS) and [a + n for a, _, n in rows][:-1] == [a for a, _, _ in rows][1:]
    assert sum(n for _, i, n in rows if i == 4) > 450_000 and [n for _, i, n in rows if i in (2, 3)] == [1, 1]


def test_quality_with_null_ids_and_repeated_rows(spark):
    rows = [(i if i % 9 else None, good() if i % 4 else bad(), "en", 1.5) for i in range(700)]
    rows += rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i if i % 9 else None, int(i % 4 > 0), None) for i in range(700)] * 2, "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    known = [r for r in got if r.doc_id is not None and r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in known) > 0.95 * len(known)
    same = collections.Counter((r.doc_id, r.score) for r in got if r.doc_id is not None)
    assert {same[k] for k in same if k[0] < 50} == {2}


def test_masking_keeps_what_it_does_not_mask(spark, docs):
    out = {(r.doc_id, r.text and len(r.text) > 10**5): r for r in pii.mask_pii(docs).collect()}
    assert out[2, None].text is None and out[3, ""].text == "" and "jo@example.com" not in out[4, True].text and out[4, True].spans == "x"
    assert pa.array([out[4, True].text])[0].as_py().endswith("last words here ")
