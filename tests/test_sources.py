"""Reshaping, events, returns, partitioned sink and pruned load; daily figures; registered queries."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella import queries
from tessella.plans.portfolio import metrics
from tessella.plans.session import Session
from tessella.sources import reshape
from tessella.sources.catalog import Catalog


def test_melt_pivot_types(spark):
    wide = spark.createDataFrame([("A", "price", "10", None), ("A", "status", "ok", "halt"), ("B", "price", "7.5", "x")], "Symbol string, Item string, `2024-01-01` string, `20240102` string")
    assert reshape.identify_columns(wide)[0] == ["2024-01-01", "20240102"]
    long = reshape.melt_to_long(wide)
    items = reshape.pivot_items(long, ["date", "Symbol"], items=["price", "status"])
    typed = reshape.typed_columns(reshape.rename_columns(items, {"Symbol": "symbol"}), millions=["price"], flags={"status": "ok"})
    got = {(r.date.day, r.symbol): (r.price, r.status) for r in typed.collect()}
    assert got == {(1, "A"): (10_000_000, False), (2, "A"): (None, True), (1, "B"): (7_500_000, True), (2, "B"): (None, True)}
    assert reshape.typed_columns(items, doubles=["price"], required=["price"]).count() == 2


def test_event_dates_are_compared_as_dates(spark):
    rows = [("20241205", "A"), ("2024-12-05 10:00", "A"), ("2025-01-01", "A"), ("junk", "B"), (None, "B"), ("2024/03/04", "B")]
    got = reshape.event_flags(spark.createDataFrame(rows, "event_date string, symbol string"), end="2024-12-31").collect()
    assert sorted((str(r.date), r.symbol, r.value) for r in got) == [("2024-03-04", "B", True), ("2024-12-05", "A", True)]


def test_parse_events(spark):
    lines = spark.createDataFrame([('{"k": "A", "d": "20240215"}',), ("broken",)], "value string")
    out = reshape.parse_events(spark, lines, "k string, d string", {"k": "symbol", "d": "event_date"}, "event_date")
    assert [(r.symbol, r.year, r.month) for r in out.filter("symbol is not null").collect()] == [("A", 2024, 2)]


def test_partitioned_round_trip_is_pruned(spark, tmp_path):
    days = [dt.date(2023, 12, 30), dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    prices = spark.createDataFrame([(d, s, float(i + 1)) for i, d in enumerate(days) for s in ("A", "B")], "date date, symbol string, adj_close double")
    reshape.write_partitioned(prices, f"{tmp_path}/price")
    catalog = Catalog(spark, {"close": {"table": "price", "value_col": "adj_close"}}, root=str(tmp_path))
    s = Session(catalog, "close", start="2024-01-01")
    assert s.field("close").to_df().count() == 4
    plan = s.field("close").to_df()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [" in plan
    assert catalog.list_fields() == ["close"] and catalog.get_field_config("close")["value_col"] == "adj_close"
    with pytest.raises(KeyError):
        catalog.field("none")
    rets = reshape.calculate_returns(prices).orderBy("date", "symbol").collect()
    assert [r["return"] for r in rets] == [1.0, 1.0, 0.5, 0.5]


def test_metrics(spark):
    r = [0.0, 0.1, -0.2, 0.05]
    df = spark.createDataFrame([(dt.date(2024, 1, i + 1), v) for i, v in enumerate(r)], "date date, value double")
    m = metrics(df).first()
    mean = sum(r) / 4
    sd = math.sqrt(sum((v - mean) ** 2 for v in r) / 3)
    assert abs(m.total_return - (1.1 * 0.8 * 1.05 - 1)) < 1e-12 and abs(m.sharpe - mean / sd * math.sqrt(252)) < 1e-9
    assert abs(m.max_drawdown + 0.2) < 1e-12 and m.win_rate == 0.5
    assert metrics(df.withColumn("value", F.lit(0.0))).first().sharpe == 0.0


SAMPLE = ["ts_mean", "ts_arg_max", "rank", "label_quantile", "group_scale", "flagship_momentum", "metrics", "double_sort", "forward_fill", "ship_rolling_rank", "etl_melt_pivot"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "lineitem", "supplier", "nation"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["date", "symbol", "value"]


def test_rolling_chain_needs_one_exchange_per_axis(spark):
    s = queries.ev_session(spark, "/root/testdata/sf0.001")
    y = s("y")
    panel = s.ops.ts_mean(y, window=5) - s.ops.ts_std_dev(y, window=5) + s.ops.ts_max(y, window=5)
    before, after = (p.to_df()._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(symbol") for p in (y, panel))
    assert after <= before + 1


def test_tasks_of_the_time_axis_grow_with_the_cells(spark, monkeypatch):
    monkeypatch.setattr("tessella.plans.session.CELLS", 1000)
    s = queries.ship_session(spark, "/root/testdata/sf0.001")  # 10 suppliers by some 2,300 days
    most = s.frame().groupBy(F.spark_partition_id()).agg(F.countDistinct("symbol").alias("n"), F.count("*").alias("cells")).collect()
    cells = sum(r.cells for r in most)
    assert s.frame().rdd.getNumPartitions() == -(-cells // 1000) and sum(r.n for r in most) == 10 and len(most) > 5
