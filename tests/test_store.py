"""The catalog: upsert by date, new columns, versions, writers that die or come second, alphas and what depends on what."""

import datetime as dt

import pytest

from tessella.plans.session import Session
from tessella.sources.catalog import Catalog
from tessella.sources.store import Conflict, Store

D = dt.date


def rows(spark, data, columns):
    return spark.createDataFrame(data, "date date, symbol string, " + ", ".join(f"{c} double" for c in columns))


def content(df, *columns):
    return {(r.date.isoformat(), r.symbol): tuple(r[c] for c in columns) for r in df.collect()}


def test_upsert_by_date_and_new_columns(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.upsert("funda", rows(spark, [(D(2024, 1, 30), "a", 1.0), (D(2024, 1, 31), "a", 2.0), (D(2024, 1, 31), "b", 3.0), (D(2024, 2, 1), "a", 4.0)], ["pbr"]), depends=["close", "book"], tags=["value"]) == 1
    assert s.upsert("funda", rows(spark, [(D(2024, 1, 31), "a", 20.0), (D(2024, 3, 1), "c", 5.0)], ["pbr"])) == 2
    want = {("2024-01-30", "a"): (1.0,), ("2024-01-31", "a"): (20.0,), ("2024-02-01", "a"): (4.0,), ("2024-03-01", "c"): (5.0,)}  # b of the 31st is replaced by none
    assert content(s.read("funda"), "pbr") == want
    assert s.upsert("funda", rows(spark, [(D(2024, 1, 31), "a", 7.0), (D(2024, 1, 31), "z", 8.0)], ["ev"])) == 3
    assert content(s.read("funda"), "pbr", "ev") == {k: (*v, None) for k, v in want.items()} | {("2024-01-31", "a"): (20.0, 7.0), ("2024-01-31", "z"): (None, 8.0)}
    assert content(s.read("funda", version=1), "pbr")[("2024-01-31", "b")] == (3.0,) and s.versions("funda") == [1, 2, 3]
    m = s.manifest("funda")
    first = s.manifest("funda", 1).months
    assert m.months["2024-02"] == first["2024-02"] and m.months["2024-01"] != first["2024-01"] and m.depends == ["book", "close"] and m.tags == ["value"]  # other months are not written again
    with pytest.raises(TypeError, match="pbr"):
        s.upsert("funda", spark.createDataFrame([(D(2024, 1, 1), "a", "x")], "date date, symbol string, pbr string"))
    with pytest.raises(KeyError):
        s.read("none")
    assert s.upsert("empty", rows(spark, [], ["v"])) == 1 and s.read("empty").count() == 0


def test_writers_that_die_or_come_second(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    s.upsert("d", rows(spark, [(D(2024, 1, 1), "a", 1.0)], ["v"]))
    with monkeypatch.context() as m:  # dies between the write and the commit
        m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.upsert("d", rows(spark, [(D(2024, 1, 1), "a", 9.0)], ["v"]))
    assert s.versions("d") == [1] and content(s.read("d"), "v") == {("2024-01-01", "a"): (1.0,)}
    (tmp_path / "d" / "_versions" / "00000002.json").write_text('{"version": 2, "mon')  # dies while it writes the manifest
    assert s.versions("d") == [1] and content(s.read("d"), "v") == {("2024-01-01", "a"): (1.0,)}
    assert s.upsert("d", rows(spark, [(D(2024, 1, 2), "a", 2.0)], ["v"])) == 3 and s.read("d").count() == 2
    seen = s.versions("d")[-1]
    s.upsert("d", rows(spark, [(D(2024, 1, 3), "a", 3.0)], ["v"]), base=seen)
    before = sorted(p.name for p in (tmp_path / "d").iterdir())
    with pytest.raises(Conflict):
        s.upsert("d", rows(spark, [(D(2024, 1, 3), "a", 4.0)], ["v"]), base=seen)
    assert content(s.read("d"), "v")[("2024-01-03", "a")] == (3.0,) and sorted(p.name for p in (tmp_path / "d").iterdir()) == before


def test_alphas_can_be_made_again(spark, tmp_path):
    spark.createDataFrame([(D(2024, 1, d), x, float(d * k)) for d in range(1, 6) for k, x in enumerate("abc", 1)], "date date, symbol string, value double").createOrReplaceTempView("store_v")
    session = Session(Catalog(spark, {"close": {"db_type": "table", "table": "store_v"}, "ret": {"db_type": "table", "table": "store_v"}}), "close", returns="ret")
    s = Store(spark, str(tmp_path))
    session.set_scaler("DollarNeutral")
    signal = session.ops.rank(session("close"))
    assert s.save_alpha("momentum", session, signal, tags=["momentum"]) == "momentum_v1" and s.save_alpha("momentum", session, -signal) == "momentum_v2"
    stored = s.manifest("momentum_v1")
    assert stored.kind == "alpha" and stored.depends == ["close"] and list(s.entities(kind="alpha", tag="momentum")) == ["momentum_v1"]
    session.set_scaler("LongOnly")
    again = {(r.date.isoformat(), r.symbol): (r.value,) for r in session.evaluate(stored.spec).to_df().collect()}
    assert again == content(s.read("momentum_v1"), "weight")
    s.upsert("pbr", rows(spark, [(D(2024, 1, 1), "a", 1.0)], ["pbr"]), depends=["close"])
    s.upsert("composite", rows(spark, [(D(2024, 1, 1), "a", 1.0)], ["v"]), depends=["pbr.pbr"])
    assert s.dependents("close") == ["composite", "momentum_v1", "momentum_v2", "pbr"] and s.dependents("pbr") == ["composite"] and s.dependents("composite") == []
    with pytest.raises(ValueError, match="name"):
        s.save_alpha("own", session.set_scaler(lambda c: c), signal)
