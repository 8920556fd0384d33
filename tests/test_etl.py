"""Workbooks with date cells, end-to-end ETL, pruned folders, and the monthly documents as a source that tasks read."""

import datetime as dt
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessella.sources import etl, months, reshape
from tessella.sources.catalog import Catalog
from tessella.sources.excel import read_excel, serial_date
from tessella.sources.fields import load_cells

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows, from_1904=False):
    """rows: lists of cells: text, number, truth, or a date (as a number with a date style)."""
    words: list[str] = []

    def cell(v):
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            words.append(v)
            return f'<c t="s"><v>{len(words) - 1}</v></c>'
        if isinstance(v, (dt.date, dt.datetime)):
            base = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
            at = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
            return f'<c s="{2 if isinstance(v, dt.datetime) else 1}"><v>{(at - base).total_seconds() / 86400}</v></c>'
        return f'<c s="3"><v>{v}</v></c>'

    body = "".join(f"<row>{''.join(cell(v) for v in r)}</row>" for r in rows)  # no references: cells and rows count on
    formats = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="&quot;day&quot; 0.00"/></numFmts>'
    styles = f'<styleSheet {NS}>{formats}<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr date1904="{int(from_1904)}"/></workbook>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si><t>{w}</t></si>' for w in words)}</sst>")


SHEET = [
    ["a vendor's title"], [None, dt.date(2020, 1, 1)],
    ["Symbol", "Symbol Name", "Kind", "Item", "Item Name ", "Frequency", dt.date(2024, 1, 2), dt.date(2024, 2, 29), dt.datetime(2024, 3, 1, 0, 0)],
    ["A1", "One", "CS", "S1", "Price", "DAILY", 12.5, "7.25", None], ["A1", "One", "CS", "S2", "Cap", "DAILY", 3, 4.5, 1],
    ["B2", "Two", "CS", "S1", "Price", "DAILY", None, 8, 9], ["B2", "Two", "CS", "S2", "Cap", "DAILY", 1, None, None], ["B2", "Two", "CS", "S3", "Halt", "DAILY", True, "정상", False],
]
NAMES = {"Price": "adj_close", "Cap": "market_cap_million", "Halt": "trading_halt_status"}


@pytest.mark.parametrize("from_1904", [False, True])
def test_date_headers(spark, tmp_path, from_1904):
    workbook(tmp_path / "w.xlsx", SHEET, from_1904)
    df = read_excel(spark, f"{tmp_path}/w.xlsx")
    assert df.columns[-3:] == ["2024-01-02", "2024-02-29", "2024-03-01"]
    assert reshape.identify_columns(df)[0] == df.columns[-3:]
    cells = {(r.Symbol, r["Item Name "]): r["2024-01-02"] for r in df.collect()}
    assert cells == {("A1", "Price"): "12.5", ("A1", "Cap"): "3", ("B2", "Price"): None, ("B2", "Cap"): "1", ("B2", "Halt"): "TRUE"}


def test_serial_dates():
    assert serial_date("45292") == "2024-01-01" and serial_date("45292.75") == "2024-01-01 18:00:00"
    assert serial_date("1") == "1900-01-01" and serial_date("61") == "1900-03-01" and serial_date("0", True) == "1904-01-01"


def test_names_that_are_dates(spark):
    df = spark.createDataFrame([("s", 1, 2, 3, 4, 5, 6)], ["Symbol", "99999999", "2024.01.02", "2024-2-3", "20240304", "2024/05/06 00:00:00", "2024-13-01"])
    assert reshape.identify_columns(df)[0] == ["2024.01.02", "2024-2-3", "20240304", "2024/05/06 00:00:00"]
    long = reshape.melt_to_long(df, ["Symbol"])
    assert sorted(tuple(r) for r in long.collect()) == [("s", dt.date(2024, 1, 2), "2"), ("s", dt.date(2024, 2, 3), "3"), ("s", dt.date(2024, 3, 4), "4"), ("s", dt.date(2024, 5, 6), "5")]
    with pytest.raises(ValueError, match="one date"):
        reshape.melt_to_long(spark.createDataFrame([(1, 2)], ["2024-01-01", "20240101"]))
    with pytest.raises(ValueError, match="no column"):
        reshape.melt_to_long(spark.createDataFrame([(1,)], ["Symbol"]))


def test_workbook_to_partitions(spark, tmp_path):
    workbook(tmp_path / "w.xlsx", SHEET)
    etl.workbook_to_parquet(spark, f"{tmp_path}/w.xlsx", f"{tmp_path}/price", "price", NAMES)
    back = spark.read.parquet(f"{tmp_path}/price")
    got = {(r.date, r.symbol): (r.adj_close, r.market_cap, r.is_trading_suspended, r.frequency, r.year, r.month, r.day) for r in back.collect()}
    assert got == {
        ("2024-01-02", "A1"): (13, 3_000_000, True, "DAILY", 2024, 1, 2), ("2024-02-29", "A1"): (7, 4_500_000, True, "DAILY", 2024, 2, 29),
        ("2024-02-29", "B2"): (8, None, False, "DAILY", 2024, 2, 29), ("2024-03-01", "B2"): (9, None, True, "DAILY", 2024, 3, 1),
    }
    etl.workbook_to_parquet(spark, f"{tmp_path}/w.xlsx", f"{tmp_path}/groups", "groups", {"Halt": "status"})
    groups = spark.read.parquet(f"{tmp_path}/groups")
    assert groups.count() == 6 and {"year", "month", "Price", "Cap", "status"} <= set(groups.columns) and "day" not in groups.columns
    one = etl.load_relational(spark, f"{tmp_path}/w.xlsx", f"{tmp_path}/one")
    assert set(one.columns) == {"date", "symbol", "symbol_name", "Price", "Cap", "Halt"} and one.count() == 6
    assert etl.load_relational(spark, f"{tmp_path}/w.xlsx").filter("symbol = 'A1' and date = date'2024-01-02'").first().Price == "12.5"


def test_folders_are_pruned_by_month_and_day(spark, tmp_path):
    days = [dt.date(2023, 12, 30) + dt.timedelta(days=9 * k) for k in range(12)]
    df = spark.createDataFrame([(d, s, float(d.day)) for d in days for s in "ab"], "date date, symbol string, value double")
    for day in (True, False):
        path = f"{tmp_path}/{day}/f"
        reshape.write_partitioned(df, path, day=day)
        c = Catalog(spark, {"v": {"table": path}})
        got = load_cells(c, "v", "2024-01-17", "2024-02-12")
        want = [d for d in days if dt.date(2024, 1, 17) <= d <= dt.date(2024, 2, 12)]
        assert sorted({r.date for r in got.collect()}) == want
        # files that cannot be read, in all folders outside of the range but the first one, whose schema is looked at
        parts = lambda d: f"year={d.year}/month={d.month}/day={d.day}" if day else f"year={d.year}/month={d.month}"
        inside, outside = {parts(d) for d in want}, {parts(d) for d in days[1:]} - {parts(d) for d in want} - {parts(days[0])}
        assert len(outside) >= (8 if day else 2)
        for p in outside:
            (tmp_path / str(day) / "f" / p / "part-broken.parquet").write_bytes(b"no parquet")
        assert sorted({r.date for r in load_cells(c, "v", "2024-01-17", "2024-02-12").collect()}) == want and inside
        with pytest.raises(Exception, match="(?i)parquet"):
            load_cells(c, "v", "2024-01-17").collect()
    path = f"{tmp_path}/whole"
    reshape.write_partitioned(df, path)
    c = Catalog(spark, {"v": {"table": path}})
    assert load_cells(c, "v").count() == 24 and load_cells(c, "v", start="2024-03-01").count() == sum(d >= dt.date(2024, 3, 1) for d in days) * 2


def test_months_as_a_source(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            y, m = map(int, self.path.strip("/").split("-"))
            asked.append((y, m))
            body = json.dumps({"comp": [{"y": y, "m": m, "k": k} for k in range(m % 3)]}).encode()
            self.send_response(404 if m == 5 else 200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        months.register(spark)
        df = spark.read.format("tessella_months").options(url=f"http://127.0.0.1:{server.server_port}/{{year}}-{{month}}", key="comp", start="2023-11", end="2024-06").load()
        assert df.count() == sum(m % 3 for m in (11, 12, 1, 2, 3, 4, 6)) and sorted(set(asked)) == [(2023, 11), (2023, 12), *[(2024, m) for m in range(1, 7)]]
        asked.clear()
        got = df.filter("year = 2024 and month in (2, 4, 5) and month < 5 and value like '%k%'").collect()
        assert sorted((r.year, r.month, json.loads(r.value)["k"]) for r in got) == [(2024, 2, 0), (2024, 2, 1), (2024, 4, 0)] and sorted(set(asked)) == [(2024, 2), (2024, 4)]
        asked.clear()
        assert df.filter(F.col("year") > 2030).collect() == [] and asked == []
    finally:
        server.shutdown()
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
