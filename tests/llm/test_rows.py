"""Dedup drops rows, not ids: repeated ids with other texts, repeated rows, null ids and clashing columns, against brute force."""

import os
import random

import pytest

from pyspark.sql import functions as F

from tessella.llm import cluster, divergence, exact_dedup, near_dup, packing, simhash

from .test_simhash import brute_components, brute_print

SCHEMA = "doc_id long, text string, _gone long, _row string, unit int, kept int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, i, "x", 1, 2) for i, t in rows], SCHEMA).repartition(5)


def kept(df):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_repeated_ids_and_rows(spark):
    rows = [(5, "A a b c"), (5, "B other"), (9, "A a b c"), (7, "same row"), (7, "same row"), (None, "only null"), (None, "only null"), (None, "B other"), (3, None), (4, "")]
    want = [(5, "B other"), (9, "A a b c"), (7, "same row"), (None, "only null"), (4, "")]
    assert kept(exact_dedup.drop_copies(table(spark, rows))) == sorted(want, key=repr)
    flags = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert len(flags) == len(rows) and sum(r.kept for r in flags) == len(want)
    rows = [(5, "X x x x x x"), (3, "X x x x x x"), (5, "quite other words here it is"), (2, "x X x x x x"), (2, "X x x x x x"), (None, "alone and without an id"), (None, "alone and without an id")]
    for keep in (simhash.keep_first, near_dup.keep_first):
        got = kept(keep(table(spark, rows)))
        assert len(got) == 3 and got[0] in [(2, "x X x x x x"), (2, "X x x x x x")] and got[1:] == [(5, "quite other words here it is"), (None, "alone and without an id")]


def test_random_rows(spark):
    rng = random.Random(8)
    texts = [None, "", *(" ".join(rng.choices(["a", "B", "c"], k=rng.randrange(1, 4))) for _ in range(12))]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts)) for _ in range(150)]
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sorted((-1 if i is None else i, t or "") for i, t in kept(exact_dedup.drop_copies(table(spark, rows)))) == sorted((i, t) for t, i in best.items())
    # one row of each component, that with the least id
    comp = brute_components(list(range(len(rows))), [brute_print(t) for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        least.setdefault(c, []).append(10**9 if i is None else i)
    got = kept(simhash.keep_first(table(spark, rows)))
    assert sorted(10**9 if i is None else i for i, _ in got) == sorted(min(v) for v in least.values())


def test_many_equal_rows(spark):
    """A hundred thousand equal rows without an id spread over all units."""
    df = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'the same text' as text").union(spark.createDataFrame([(1, "another")], "doc_id long, text string"))
    assert {(r.doc_id, r.text) for r in exact_dedup.drop_copies(df).collect()} == {(None, "the same text"), (1, "another")}
    flags = exact_dedup.exact_dedup(df)
    assert [tuple(r) for r in flags.groupBy("kept", "group_size").count().orderBy("kept", "group_size").collect()] == [(False, 100_000, 99_999), (True, 1, 1), (True, 100_000, 1)]


def test_scratch_folder_must_be_named_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        cluster.scratch_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert "app" in cluster.scratch_dir(Session())


def test_scratch_holds_what_is_read_alone(spark):
    """After each operator only its result is left in the scratch folder; release takes that as well, but not what is still read."""
    root = cluster.scratch_dir(spark)
    cluster.release(spark)
    df = spark.createDataFrame([(i, f"some words here {i // 2} a b c d", "en") for i in range(40)], "doc_id long, text string, lang string")
    names = lambda: {p for p in os.listdir(root) if p.startswith(("table-", "work-", "tokens-"))} if os.path.isdir(root) else set()
    before = names()
    for f in (exact_dedup.exact_dedup, simhash.simhash_dedup, near_dup.near_dedup, packing.packed_digest, divergence.divergence):
        out = f(df.withColumn("source", F.lit("s")))
        assert len(names() - before) == 1, f
        assert out.count() >= 0
        cluster.release(spark, keep=out)
        assert out.count() >= 0 and len(names() - before) == 1
        cluster.release(spark)
        assert names() == before
    kept = exact_dedup.drop_copies(df)
    assert kept.count() == 20
    last = cluster.materialize(kept)
    cluster.release(spark, keep=last)
    assert len(names() - before) == 1 and last.count() == 20
    cluster.release(spark)
