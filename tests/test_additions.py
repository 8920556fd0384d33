"""Steps, recorded outputs, plans, vendor tables, workbooks and monthly documents."""

import datetime as dt
import json
import zipfile

import pytest

from tessella.functions import cells
from tessella.plans.session import Session
from tessella.queries import QUERIES, ev_session
from tessella.sources import months, reshape, vendor
from tessella.sources.catalog import Catalog
from tessella.sources.excel import read_excel

SF = "/root/testdata/sf0.001"


def small(spark, rows, **fields):
    spark.createDataFrame([(dt.date(2024, 1, d), s, v) for d, s, v in rows], "date date, symbol string, value double").createOrReplaceTempView("additions")
    return Session(Catalog(spark, {"v": {"db_type": "table", "table": "additions"}} | fields), "v", returns="v")


def values(panel):
    return {(r.date.day, r.symbol): r.value for r in panel.to_df().collect()}


def test_infinite_cells_never_make_nan(spark):
    s = small(spark, [(1, "a", 2.0), (1, "b", -3.0), (2, "a", 5.0), (2, "b", 0.0)])
    inf = s.ops.divide(s("v"), s("v") - s("v"))
    assert set(values(inf).values()) == {cells.INF, -cells.INF, None}
    for p in (inf - inf, inf * 0.0, inf + (-inf), s.ops.zscore(inf), s.ops.mean(inf, demean=True), inf - s.ops.cross_mean(inf)):
        assert all(v is None or v == v for v in values(p).values())
    assert set(values((inf - inf) > 5.0).values()) == {False}


def test_group_scale_positive_rejects_a_negative_without_a_label(spark):
    s = small(spark, [(1, "a", -1.0), (1, "b", 2.0)])
    g = s.ops.composite_group(s("v"), s.ops.log(s("v")))  # no label where the logarithm is missing
    with pytest.raises(Exception, match="negative"):
        s.ops.group_scale_positive(s("v"), g).to_df().collect()


def test_steps_follow_the_scaler(spark):
    s = ev_session(spark, SF)
    s._fields["ret"] = s("y") / 100.0
    st = s.steps(s.ops.rank(s.ops.ts_mean(s("y"), window=3) - 1.0), "LongOnly")
    assert [p.expr.split("(")[0] for p in st.signals] == ["Field", "ts_mean", "subtract", "rank"]
    long, neutral = (sorted((r.date, round(r.value, 9)) for r in x.daily_pnl().collect()) for x in (st, st.with_scaler("DollarNeutral")))
    assert long != neutral and len(long) == len(neutral) == 30
    direct = s.set_scaler("DollarNeutral")
    assert direct.get_active_scaler() is not None
    assert neutral == sorted((r.date, round(r.value, 9)) for r in s.daily_pnl(s.to_portfolio_returns(s.to_weights(st.signal(3)))).collect())


def test_recorded_outputs_are_kept_until_released(spark):
    s = ev_session(spark, SF)
    p = s.ops.ts_mean(s("x"), window=5, record_output=True)
    q = s.ops.rank(p)
    df = q.get_cached_step(1)
    assert df is p.to_df() and df.is_cached and df.count() == 450
    s.persist()
    before = sorted(map(repr, q.to_df().collect()))
    assert s.frame().is_cached
    late = s("h")  # a field read after persist
    assert late.to_df().count() == 450 and sorted(map(repr, q.to_df().collect())) == before
    s.release()
    assert not df.is_cached and sorted(map(repr, q.to_df().collect())) == before


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_plans(spark):
    s = ev_session(spark, SF)
    text = plan(s.ops.ts_mean(s("x"), window=5).to_df())
    assert text.count("FileScan") == 2 and text.count("Join") == 0  # cells, and the symbols of the grid
    ranked = plan(s.ops.rank(s.ops.ts_mean(s("x"), window=5)).to_df())
    assert ranked.count("Exchange hashpartitioning") == text.count("Exchange hashpartitioning") + 1  # the date, once


def test_vendor_layouts(spark):
    df = spark.createDataFrame([("A", "2.01", "9007199254740993", "정상", "x"), ("B", "x", None, None, "일반"), ("C", "-0.0000005", "7.5", "정지", None)], "symbol string, market_cap_million string, adj_close string, trading_halt_status string, management_classification string")
    got = {r.symbol: r for r in vendor.preprocess_price(df).collect()}
    assert set(got) == {"A", "C"} and got["A"].market_cap == 2_010_000 and got["A"].adj_close == 9007199254740993
    assert (got["A"].is_trading_suspended, got["A"].is_issue, got["C"].is_trading_suspended, got["C"].is_issue) == (False, True, True, True)
    funda = vendor.preprocess_fundamentals(spark.createDataFrame([("A", 1.5)], "symbol string, sales_thousand double")).first()
    assert funda.sales == 1500.0
    monthly = vendor.preprocess_monthly(spark.createDataFrame([("12", "3", None)], "monthly_adj_open string, monthly_market_cap_million string, monthly_trading_halt_status string")).first()
    assert (monthly.monthly_adj_open, monthly.monthly_market_cap, monthly.monthly_is_trading_suspended) == (12, 3_000_000, True)


def test_profile_and_counts(spark):
    df = spark.createDataFrame([("a", 1), ("ab", None), ("a", 3), (None, 3)], "t string, n int")
    assert {(r.value, r.n) for r in reshape.value_counts(df, "t").collect()} == {("a", 2), ("ab", 1), (None, 1)}
    assert {(r.value, r.n) for r in reshape.value_counts(df, "t", contains="b").collect()} == {("ab", 1)}
    assert [r.t for r in reshape.distinct_values(df, "t", limit=2).collect()] == [None, "a"]
    assert [(r.name, r.n, r.missing, r.n_distinct) for r in reshape.profile(df).collect()] == [("t", 4, 1, 2), ("n", 4, 1, 2)]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{ref}"><v>{v}</v></c>'
    words = ["title", "Symbol", "Item", "2024-01-01", "A1", "price"]
    rows = [("1", [("A1", 0)]), ("9", [("A9", 1), ("B9", 2), ("D9", 3)]), ("10", [("A10", 4), ("B10", 5), ("D10", "12.5")])]
    body = "".join(f'<row r="{r}">{"".join(cell(*c) for c in cs)}</row>' for r, cs in rows)
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{w}</t></si>' for w in words)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    df = read_excel(spark, f"{tmp_path}/w.xlsx")
    assert df.columns == ["Symbol", "Item", "2024-01-01"] and [tuple(r) for r in df.collect()] == [("A1", "price", "12.5")]
    assert [tuple(r) for r in reshape.melt_to_long(df).collect()] == [("A1", "price", dt.date(2024, 1, 1), "12.5")]


def test_months_stop_skip_and_decode(spark, tmp_path):
    asked = []
    stored = {(2024, 2): json.dumps({"comp": [{"a": 1}, {"a": 2}]}).encode(), (2024, 1): json.dumps({"comp": [{"a": "가"}]}, ensure_ascii=False).encode("euc-kr"), (2023, 11): json.dumps({"comp": []}).encode()}

    def get(url):
        y, m = map(int, url.split("/")[-1].split("-"))
        asked.append((y, m))
        return stored.get((y, m), b"<html>" if m == 12 else None)

    run = lambda: months.fetch_months(spark, "http://x/{year:04d}-{month:02d}", "comp", f"{tmp_path}/m", 2024, 2, get, most_failures=3)
    assert run() == [(2024, 2), (2024, 1), (2023, 11)] and asked[-1] == (2023, 8)
    assert sorted(json.loads(r.value)["a"] for r in months.stored_months(spark, f"{tmp_path}/m").filter("year = 2024 and month = 1").collect()) == ["가"]
    asked.clear()
    assert run() == [] and not {(2024, 2), (2024, 1), (2023, 11)} & set(asked)  # the empty month is kept as well


def test_relative_paths_in_queries(spark):
    c = Catalog(spark, {"q": {"query": "select cast(ts as date) as date, user_id as symbol, max(value) as value from parquet.`events.parquet` group by 1, 2"}}, root=SF)
    assert Session(c, "q")("q").to_df().count() == 450
    assert "etl_sheet" in QUERIES
