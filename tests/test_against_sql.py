"""Registered queries against their SQL on tables that are made to bring them apart: prices of 0, sums and quotients at the edge of a comparison or a rounding."""

import datetime as dt
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella import queries


def events(path, rows, files=1):
    """rows: (day, user, type, value); event ids count them. Written to several files, every other one backwards, for the query."""
    cols = [(i, dt.datetime(2024, 1, d, 1), u, k, v) for i, (d, u, k, v) in enumerate(rows)]
    t = pa.table([pa.array(c) for c in zip(*cols, strict=True)], ["event_id", "ts", "user_id", "event_type", "value"]).set_column(1, "ts", pa.array([c[1] for c in cols], pa.timestamp("us")))
    (path / "events.parquet").mkdir()
    for k in range(files):
        part = t.take(list(range(k, len(cols), files))[:: -1 if k % 2 else 1])
        pq.write_table(part, path / "events.parquet" / f"part-{k}.parquet")
    return t


def both(spark, path, rows, name, files=1):
    t = events(path, rows, files)  # noqa: F841
    got = queries.QUERIES[name](spark, str(path))
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("create table events as select * from t")
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]}) order by 1, 2").fetchall()
    return sorted((str(r[0]), *r[1:]) for r in got.collect()), [(str(r[0]), *r[1:]) for r in want]


def test_returns_after_a_price_of_zero(spark, tmp_path):
    got, want = both(spark, tmp_path, [(1, 1, "click", 2.0), (2, 1, "view", 0.0), (3, 1, "view", 4.0), (4, 1, "error", 5.0), (1, 2, "view", 0.0), (2, 2, "view", 0.0)], "etl_returns")
    assert got == want and [r[2] for r in got] == [-1.0, 0.25]


#: User 1: 2 * 0.3 against 0.1 + 0.2 + 0.3, which is over 0.6 if added in this order and 0.6 in the opposite one. User 2: 0.3 + 0.2 + 0.1 is 0.6. User 3: 2 * (0.1 + 0.2)
#: against the same sum as user 1's, of which the last two are in a file of their own.
TIES = [(1, 1, "error", 0.1), (1, 1, "error", 0.2), (1, 1, "click", 0.3), (1, 2, "click", 0.3), (1, 2, "error", 0.2), (1, 2, "error", 0.1), (2, 1, "view", None), (2, 2, "error", 7.0)]
TIES += [(1, 3, "click", 0.1), (1, 3, "click", 0.2), (1, 4, "error", 1.0), (1, 3, "error", 0.3)]


@pytest.mark.parametrize("name", ["equal", "greater_than", "less_than", "greater_or_equal", "less_or_equal"])
def test_comparisons_of_sums_do_not_depend_on_files(spark, tmp_path, name):
    got, want = both(spark, tmp_path, TIES, name, files=2)
    assert got == want and [r[2] for r in got[:3]] == {"equal": [0, 1, 1], "greater_than": [0, 0, 0], "less_than": [1, 0, 0], "greater_or_equal": [0, 1, 1], "less_or_equal": [1, 1, 1]}[name]


def test_returns_at_half_a_digit_are_rounded_as_sql_does(spark, tmp_path):
    """Quotients by 1.28 and the like end in the seventh digit, on a half; doubles lie on either side of it."""
    rows = [(d, u, "click", v) for u in range(1500) for d, v in ((1, 1.28 * (1 + u % 7)), (2, (2 * u + 1) / 100))]
    got, want = both(spark, tmp_path, rows, "etl_zero_price")
    assert got == want and len(got) == 1500


@pytest.mark.parametrize("name", ["label_quantile", "double_sort"])
def test_edges_between_neighbouring_doubles_are_those_of_the_sql(spark, tmp_path, name):
    """Up to a dozen values a day, most of them of a pair that differs in the last bit: an edge is interpolated between them, and one more rounding puts it on the other one."""
    rows = []
    for day in range(1, 25):
        n = 3 + day % 8
        v = 0.05 + 0.06 * day
        near = (v, math.nextafter(v, 9))
        middle = [near[0]] * (n // 3) + [near[1]] * (n - n // 3) if day % 2 else [near[0]] * (n - n // 3) + [near[1]] * (n // 3)
        rows += [(day, 10 * day + i, "click", x) for i, x in enumerate([v / 2, *middle, v * 2] if day % 3 else middle)]
    rows += [(25, i, "click", 0.3) for i in (1, 2, 4, 5)] + [(26, 1, "click", 0.3), (27, 1, "view", None), (27, 2, "error", 1.0), *[(28, i, "click", 10.0 * i) for i in range(1, 8)]]
    got, want = both(spark, tmp_path, rows, name)
    assert got == want and sum(r[2] is not None for r in got) > 150
