"""The registered queries of the panel engine and their DuckDB SQL: one per operator, each over a whole table.

The panel ev is events by day and user: x (sum of the values of some types, often missing), y (sum of all), g (least type). Its
universe are the observed cells but for some users on some days. The panel ship is lineitem by day and supplier.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.registry import NUMERIC, REGISTRY, register_grouped
from .plans import ic
from .plans.ledger import Costs, accounts, positions
from .plans.panel import Panel
from .plans.portfolio import additive_drawdown, cumulative_pnl, metrics
from .plans.session import Session
from .sources import reshape, vendor
from .sources.catalog import Catalog
from .sources.fields import load_cells

DIGITS = 6


def _trimmed_mean_gap(batches, share: float = 0.1):
    """Each value less the mean of its date without the least and the greatest tenth: what a column function would need a sort and a second window for."""
    kept = list(batches)  # a date's symbols
    x = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in kept])
    seen = np.sort(x[~np.isnan(x)])
    cut = int(len(seen) * share)
    mean = seen[cut : len(seen) - cut].mean() if len(seen) else np.nan
    for b in kept:
        yield pa.array(b.column(3).to_numpy(zero_copy_only=False) - mean, from_pandas=True)


if "trimmed_mean_gap" not in REGISTRY:
    register_grouped("trimmed_mean_gap", _trimmed_mean_gap, (NUMERIC,), by="date")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _source(sf_dir: str, table: str) -> str:
    return f"parquet.`{sf_dir}/{table}.parquet`"


def ev_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    # the values of a cell are added in order of event_id: how a table is split does not change a sum's last bit, nor what is equal to it
    total = lambda v: f"aggregate(array_sort(collect_list(case when {v} then struct(event_id, value) end)), cast(null as double), (a, e) -> coalesce(a, 0d) + e.value)"
    q = (
        "select cast(ts as date) as date, user_id as symbol, "
        + total("event_type in ('click', 'view') and value is not null") + " as x, " + total("value is not null") + " as y, min(event_type) as g, max(event_type) as h,"
        " max(event_type = 'purchase') as bought from " + _source(sf_dir, "events") + " where cast(ts as date) between :start_date and :end_date group by 1, 2"
    )
    return Catalog(
        spark,
        {
            "x": {"query": q, "value_col": "x"},
            "y": {"query": q, "value_col": "y"},
            "g": {"query": q, "value_col": "g", "data_type": "group"},
            "h": {"query": q, "value_col": "h", "data_type": "group"},
            "bought": {"query": q, "value_col": "bought", "data_type": "event"},
            "last_x": {"query": q, "value_col": "x", "forward_fill": "value"},
            "row_x": {"query": q, "value_col": "x", "forward_fill": "row"},
        },
    )


def ev_session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(ev_catalog(spark, sf_dir), "y", returns="ret", member=~((F.col("symbol") % 7 == 3) & (F.day("date") % 5 == 0)))


EV = """
with raw as (select cast(ts as date) as date, user_id as symbol, sum(case when event_type in ('click', 'view') then value end) as x, sum(value) as y,
  min(event_type) as g, max(event_type) as h, max(event_type = 'purchase') as bought from events group by 1, 2),
dd as (select date, row_number() over (order by date) as t from (select distinct date from raw)),
c as (select dd.date, s.symbol, dd.t, r.x as rx, r.y as ry, r.g as rg, r.h as rh, r.bought as rb, (r.y is not null and not (s.symbol % 7 = 3 and day(dd.date) % 5 = 0)) as u
  from dd cross join (select distinct symbol from raw) s left join raw r on r.date = dd.date and r.symbol = s.symbol),
p as (select date, symbol, t, u, case when u then rx end as x, case when u then ry end as y, case when u then rg end as g, case when u then rh end as h, case when u then rb end as bought from c)
"""
WINDOWS = """ window wt as (partition by symbol order by t), w5 as (partition by symbol order by t rows between 4 preceding and current row),
 w3 as (partition by symbol order by t rows between 2 preceding and current row), w8 as (partition by symbol order by t rows between 7 preceding and current row), wd as (partition by date), wg as (partition by date, g), ws as (partition by symbol)"""


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS and without a negative zero, truth as 1 and 0, dates as ISO text: equal in either engine. Doubles are rounded as SQL does it, by the
    product with 10 ** DIGITS: the decimal text of a double, which F.round goes by, may lie on the other side of a half."""
    kinds = dict(df.dtypes)
    power = 10.0**DIGITS
    near = lambda c: F.when(F.abs(F.col(c) * power) < float("inf"), F.round(F.col(c) * power) / power).otherwise(F.col(c)) + 0.0
    same = lambda c: near(c).alias(c) if kinds[c] == "double" else F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c).cast("double").alias(c) if kinds[c] == "boolean" else F.col(c)
    return df.select(*[same(c) for c in df.columns])


def ev(name: str, sql: str, kind: str = "double", masked: bool = True):
    """Registers a function of a session that gives a panel; sql is its expression over p."""

    def add(f: Callable[[Session], Panel]):
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(ev_session(spark, sf_dir)).to_df())
        e = f"case when u then {sql} end" if masked else f"({sql})"
        ORACLES[name] = f"{EV} select date, symbol, {dict(double=f'round({e}, {DIGITS}) + 0.0', boolean=f'({e})::int::double').get(kind, e)} as value from p{WINDOWS}"
        return f

    return add


def observed(e: str, x: str, w: str, least: int) -> str:
    return f"case when count({x}) over {w} >= {least} then {e} end"


# ---- time axis ----

ev("ts_mean", observed("avg(x) over w5", "x", "w5", 2))(lambda s: s.ops.ts_mean(s("x"), window=5))
ev("ts_std_dev", observed("stddev_samp(x) over w5", "x", "w5", 3))(lambda s: s.ops.ts_std_dev(s("x"), window=5))
ev("ts_max", observed("max(x) over w8", "x", "w8", 2))(lambda s: s.ops.ts_max(s("x"), window=8))
ev("ts_min", observed("min(x) over w8", "x", "w8", 2))(lambda s: s.ops.ts_min(s("x"), window=8))
ev("ts_sum", observed("sum(x) over w8", "x", "w8", 2))(lambda s: s.ops.ts_sum(s("x"), window=8))
ev("ts_delay", "lag(x, 3) over wt")(lambda s: s.ops.ts_delay(s("x"), window=3))
ev("ts_delta", "x - lag(x, 3) over wt")(lambda s: s.ops.ts_delta(s("x"), window=3))
ev("ts_count_nans", "case when count(*) over w5 >= 2 then sum(case when x is null then 1.0 else 0.0 end) over w5 end")(lambda s: s.ops.ts_count_nans(s("x"), window=5))
ev("ts_any", observed("bool_or(coalesce(x > 60, false)) over w5", "case when u then true end", "w5", 1), "boolean")(lambda s: s.ops.ts_any(s("x") > 60, window=5))
ev("ts_all", observed("coalesce(sum(case when u and x > 20 then 1 else 0 end) over w3, 0) = 3", "case when u then true end", "w3", 1), "boolean")(lambda s: s.ops.ts_all(s("x") > 20, window=3))
ev("ts_product", "case when count(z) over w3 >= 1 and count(z) over w3 = count(*) over w3 then product(z) over w3 end")(lambda s: s.ops.ts_product(s("x") / 50.0, window=3))
ORACLES["ts_product"] = ORACLES["ts_product"].replace("from p window", "from (select *, x / 50.0 as z from p) window")
ev("ts_arg_max", "0")(lambda s: s.ops.ts_arg_max(s("x"), window=5))
ORACLES["ts_arg_max"] = f"{EV} select date, symbol, case when u and n >= 2 then (t + m.at)::double end as value from (select *, count(x) over w5 as n, max(case when x is not null then {{'v': x, 'at': -t}} end) over w5 as m from p{WINDOWS})"
ev("ts_arg_min", "0")(lambda s: s.ops.ts_arg_min(s("x"), window=5))
ORACLES["ts_arg_min"] = f"{EV} select date, symbol, case when u and n >= 2 then (t - m.at)::double end as value from (select *, count(x) over w5 as n, min(case when x is not null then {{'v': x, 'at': t}} end) over w5 as m from p{WINDOWS})"
_A, _B = "case when y is not null then x end", "case when x is not null then y end"
ev("ts_corr", observed(f"covar_samp({_A}, {_B}) over w8 / nullif(sqrt(var_samp({_A}) over w8 * var_samp({_B}) over w8), 0)", _A, "w8", 5))(lambda s: s.ops.ts_corr(s("x"), s("y"), window=8))
ev("ts_covariance", observed(f"covar_samp({_A}, {_B}) over w8", _A, "w8", 5))(lambda s: s.ops.ts_covariance(s("x"), s("y"), window=8))
ev("ts_zscore", observed("(x - avg(x) over w8) / nullif(stddev_samp(x) over w8, 0)", "x", "w8", 4))(lambda s: s.ops.ts_zscore(s("x"), window=8))
ev("ts_rank", "0")(lambda s: s.ops.ts_rank(s("x"), window=8))
ORACLES["ts_rank"] = f"""{EV} select date, symbol, round(case when u and x is not null and len(a) >= 4 then case when len(a) <= 1 then 0.5 else len(list_filter(a, lambda z: z < x)) / (len(a) - 1.0) end end, 6) + 0.0 as value
 from (select *, list(x) filter (where x is not null) over w8 as a from p{WINDOWS})"""

# ---- cross-section ----

_RANK = "case when {x} is not null then (rank() over (partition by {k} order by {x} nulls last) + (count(*) over (partition by {k}, {x}) - 1) / 2.0) / count({x}) over (partition by {k}) end"
ev("rank", _RANK.format(x="x", k="date"))(lambda s: s.ops.rank(s("x")))
ev("mean", "avg(x) over wd")(lambda s: s.ops.mean(s("x")))
ev("mean_demean", "x - avg(x) over wd")(lambda s: s.ops.mean(s("x"), demean=True))
ev("zscore", "(x - avg(x) over wd) / nullif(stddev_samp(x) over wd, 0)")(lambda s: s.ops.zscore(s("x")))
_SCALE = "case when {d} > 0 then {d} / nullif(sum(case when {d} > 0 then {d} end) over {w}, 0) * {l} when {d} < 0 then {d} / nullif(abs(sum(case when {d} < 0 then {d} end) over {w}), 0) * {s} else {d} end"
ev("scale", _SCALE.format(d="d", w="wd", l=2.0, s=1.0))(lambda s: s.ops.scale(s.ops.mean(s("x"), demean=True), long=2.0, short=-1.0))
ORACLES["scale"] = ORACLES["scale"].replace("from p window", "from (select *, x - avg(x) over (partition by date) as d from p) window")
ev("label_quantile", "0", "string")(lambda s: s.ops.label_quantile(s("x"), bins=3, labels=["low", "mid", "high"]))
ORACLES["label_quantile"] = f"""{EV}, q as (select *, count(x) over wd as n, rank() over (partition by date order by x nulls last) as r, dense_rank() over (partition by date order by x nulls last) as k,
  quantile_cont(x, [0.0, 0.3333333333333333, 0.6666666666666666, 1.0]) over wd as e from p{WINDOWS}),
 b as (select *, max(case when x is not null then k end) over (partition by date) as nu from q)
 select date, symbol, case when u and x is not null then ['low', 'mid', 'high'][1 + case when nu = 1 then 0 when nu < 3 or len(list_distinct(e)) <= 3 then least(r * 3 // n, 2)
  else greatest(len(list_filter(e, lambda z: z < x)) - 1, 0) end] end as value from b"""

# ---- groups ----

ev("group_rank", "case when g is not null then " + _RANK.format(x="x", k="date, g") + " end")(lambda s: s.ops.group_rank(s("x"), s("g")))
for _n, _f in (("max", "max"), ("min", "min"), ("sum", "sum")):
    ev(f"group_{_n}", f"case when x is not null and g is not null then {_f}(x) over wg end")(lambda s, n=_n: getattr(s.ops, f"group_{n}")(s("x"), s("g")))
ev("group_count", "case when g is not null then count(g) over wg end::double")(lambda s: s.ops.group_count(s("g")))
ev("group_neutralize", "case when g is not null then x - avg(x) over wg end")(lambda s: s.ops.group_neutralize(s("x"), s("g")))
ev("group_scale", _SCALE.format(d="x", w="wg", l=3.0, s=0.0))(lambda s: s.ops.group_scale(s("x"), s("g"), long=3.0, short=0.0))
ev("group_scale_positive", "case when g is not null then x / nullif(sum(x) over wg, 0) end")(lambda s: s.ops.group_scale_positive(s("x"), s("g")))

# ---- one value a date ----


def _daily(name: str, op: str, e: str):
    QUERIES[name] = lambda spark, sf_dir: _rounded((lambda s: getattr(s.ops, op)(s("x")).to_df())(ev_session(spark, sf_dir)))
    ORACLES[name] = f"{EV} select date, round({e}, 6) + 0.0 as value from p group by date"


_daily("cross_sum", "cross_sum", "coalesce(sum(x), 0.0)")
_daily("cross_mean", "cross_mean", "avg(x)")
_daily("cross_median", "cross_median", "median(x)")
_daily("cross_std", "cross_std", "stddev_samp(x)")
ev("broadcast_arithmetic", "x - avg(x) over wd")(lambda s: s("x") - s.ops.cross_mean(s("x")))
QUERIES["universe_count"] = lambda spark, sf_dir: _rounded(ev_session(spark, sf_dir).universe_count())
ORACLES["universe_count"] = f"{EV} select date, sum(u::int)::bigint as value from p group by date"

# ---- cells ----

_X, _Y = "x", "y"
for _n, _e in (("add", "x + y"), ("subtract", "x - y"), ("multiply", "x * y")):
    ev(_n, _e)(lambda s, n=_n: getattr(s.ops, n)(s("x"), s("y")))
ev("divide", "case when y - y = 0 and x > 0 then 'inf'::double end")(lambda s: s.ops.divide(s("x"), s("y") - s("y")))
ev("divide_plain", "x / nullif(y, 0)")(lambda s: s.ops.divide(s("x"), s("y")))
ev("power", "pow(x, 0.5)")(lambda s: s.ops.power(s("x"), 0.5))
ev("power_zero", "1.0")(lambda s: s.ops.power(s("x"), 0.0))
ev("negate", "-x")(lambda s: s.ops.negate(s("x")))
ev("abs", "abs(x - 50)")(lambda s: s.ops.abs(s("x") - 50.0))
ev("log", "case when x = 0 then '-inf'::double when x > 0 then ln(x) end")(lambda s: s.ops.log(s("x")))
ev("sign", "sign(x - 50)::double")(lambda s: s.ops.sign(s("x") - 50.0))
ev("constant", "2.5", masked=False)(lambda s: s.ops.constant(2.5))
for _n, _o in (("greater_than", ">"), ("less_than", "<"), ("greater_or_equal", ">="), ("less_or_equal", "<="), ("equal", "=")):
    ev(_n, f"coalesce(2 * x {_o} y, false)", "boolean")(lambda s, n=_n: getattr(s.ops, n)(s("x") * 2.0, s("y")))
ev("not_equal", "coalesce(x <> y, true)", "boolean")(lambda s: s.ops.not_equal(s("x"), s("y")))
ev("and", "coalesce(x <> 0, false) and coalesce(bought, false)", "boolean")(lambda s: getattr(s.ops, "and")(s("x"), s("bought")))
ev("or", "coalesce(x <> 0, false) or g is not null", "boolean")(lambda s: getattr(s.ops, "or")(s("x"), s("g")))
ev("not", "not coalesce(x > 40, false)", "boolean")(lambda s: ~(s("x") > 40.0))
ev("is_nan", "x is null", "boolean")(lambda s: s.ops.is_nan(s("x")))
ev("if_else", "case when coalesce(x > 40, false) then x else y end")(lambda s: s.ops.if_else(s("x") > 40.0, s("x"), s("y")))
ev("map_values", "case g when 'click' then 1.0 when 'view' then -1.0 end")(lambda s: s.ops.map_values(s("g"), mapping={"click": 1.0, "view": -1.0}))
ev("map_labels", "case g when 'click' then 'C' when 'view' then 'V' else g end", "string")(lambda s: s.ops.map_values(s("g"), mapping={"click": "C", "view": "V"}))
ev("composite_group", "g || '&' || h", "string")(lambda s: s.ops.composite_group(s("g"), s("h")))
ev("mask_assignment", "case when coalesce(x > 40, false) then 0.0 else x end")(lambda s: s("x").where(s("x") > 40.0, 0.0))
ev("event_field", "bought", "boolean")(lambda s: s("bought"))

# ---- carried forward ----

ev("forward_fill", "last_value(rx ignore nulls) over (partition by symbol order by t rows between unbounded preceding and current row)")(lambda s: s("last_x"))
ORACLES["forward_fill"] = ORACLES["forward_fill"].replace("from p window", "from (select p.*, c.rx from p join c using (date, symbol)) window")
ev("forward_fill_rows", "0")(lambda s: s("row_x"))
ORACLES["forward_fill_rows"] = f"{EV} select date, symbol, round(case when u then (last_value(case when ry is not null then {{'v': rx}} end ignore nulls) over (partition by symbol order by t rows between unbounded preceding and current row)).v end, 6) + 0.0 as value from c"

# ---- portfolio ----

_GN = """d as (select *, x - avg(x) over (partition by date) as d from p),
w as (select *, case when d is not null then coalesce(greatest(d, 0) / nullif(sum(greatest(d, 0)) over (partition by date), 0), 0) * {l} + coalesce(least(d, 0) / nullif(-sum(least(d, 0)) over (partition by date), 0), 0) * {s} else 0.0 end as w from d)"""


def _weights(name: str, sql: str, scaler: str, **params):
    QUERIES[name] = lambda spark, sf_dir: _rounded((lambda s: s.set_scaler(scaler, **params).to_weights(s("x")).to_df())(ev_session(spark, sf_dir)))
    ORACLES[name] = sql


_weights("scaler_gross_net", f"{EV}, {_GN.format(l=0.6, s=0.4)} select date, symbol, round(w, 6) + 0.0 as value from w", "GrossNet", gross=1.0, net=0.2)
_weights("scaler_dollar_neutral", f"{EV}, {_GN.format(l=1.0, s=1.0)} select date, symbol, round(w, 6) + 0.0 as value from w", "DollarNeutral")
_weights("scaler_long_only", f"{EV} select date, symbol, round(coalesce(greatest(x, 0) / nullif(sum(greatest(x, 0)) over (partition by date), 0) * 1.5, 0), 6) + 0.0 as value from p", "LongOnly", target_gross=1.5)
ORACLES["scaler_long_only"] = ORACLES["scaler_long_only"].replace("coalesce(greatest(x, 0)", "coalesce(case when x is not null then greatest(x, 0) end")
_weights("scaler_long_only_strict", f"{EV} select date, symbol, round(case when x is not null then greatest(x, 0) / nullif(sum(greatest(x, 0)) over (partition by date), 0) end, 6) + 0.0 as value from p", "LongOnlyStrict")
_weights(
    "scaler_gross_net_renormalised",
    f"{EV}, v as (select *, case when x is not null then coalesce(greatest(x, 0) / nullif(sum(greatest(x, 0)) over (partition by date), 0), 0) * 1.25 end as v from p) select date, symbol, round(v / nullif(sum(abs(v)) over (partition by date), 0) * 2.0, 6) + 0.0 as value from v",
    "GrossNetRenormalised", target_gross=2.0, target_net=0.5,
)


def _backtest(spark: SparkSession, sf_dir: str) -> tuple[Session, Panel, Panel]:
    """A short momentum signal on y, ranked within g, dollar-neutral; returns are changes of y over its level."""
    s = ev_session(spark, sf_dir)
    y = s("y")
    s._fields["ret"] = (y - s.ops.ts_delay(y, window=1)) / (y + 100.0)
    signal = s.ops.group_rank(s.ops.ts_mean(y, window=3) - s.ops.ts_mean(y, window=5), s("g"))
    return s, s.set_scaler("DollarNeutral").to_weights(signal), signal


_BT = f"""{EV}, m as (select *, case when count(y) over w3 >= 1 then avg(y) over w3 end - case when count(y) over w5 >= 2 then avg(y) over w5 end as m0, (y - lag(y) over wt) / (y + 100.0) as ret from p{WINDOWS}),
m1 as (select *, case when u then m0 end as m from m),
r as (select * exclude (x), case when u and m is not null and g is not null then (rank() over (partition by date, g order by m nulls last) + (count(*) over (partition by date, g, m) - 1) / 2.0) / count(m) over (partition by date, g) end as x from m1),
{_GN.format(l=1.0, s=1.0).replace("from p", "from r")},
b as (select date, symbol, u, ret, w, lag(w) over (partition by symbol order by t) as w0, lag(greatest(w, 0)) over (partition by symbol order by t) as wl, lag(least(w, 0)) over (partition by symbol order by t) as wn from w),
pr as (select date, symbol, case when u then w0 * ret end as r, case when u then wl * ret end as rl, case when u then wn * ret end as rs from b),
dy as (select date, coalesce(sum(r), 0.0) as pnl from pr group by date)"""


def _bt(name: str, f: Callable, sql: str):
    QUERIES[name] = lambda spark, sf_dir: _rounded(f(*_backtest(spark, sf_dir)))
    ORACLES[name] = f"{_BT} {sql}"


_bt("flagship_momentum", lambda s, w, _: s.to_portfolio_returns(w).to_df(), "select date, symbol, round(r, 6) + 0.0 as value from pr")
_bt("long_returns", lambda s, w, _: s.to_long_returns(w).to_df(), "select date, symbol, round(rl, 6) + 0.0 as value from pr")
_bt("short_returns", lambda s, w, _: s.to_short_returns(w).to_df(), "select date, symbol, round(rs, 6) + 0.0 as value from pr")
_bt("daily_pnl", lambda s, w, _: s.daily_pnl(s.to_portfolio_returns(w)), "select date, round(pnl, 6) + 0.0 as value from dy")
_bt("cumulative_pnl", lambda s, w, _: cumulative_pnl(s.daily_pnl(s.to_portfolio_returns(w))), "select date, round(sum(pnl) over (order by date), 6) + 0.0 as value from dy")
_bt("additive_drawdown", lambda s, w, _: additive_drawdown(s.daily_pnl(s.to_portfolio_returns(w))), "select date, round(c - max(c) over (order by date), 6) + 0.0 as value from (select date, sum(pnl) over (order by date) as c from dy)")
_bt(
    "metrics",
    lambda s, w, _: metrics(s.daily_pnl(s.to_portfolio_returns(w))),
    "select round(product(1 + pnl) - 1, 6) + 0.0 as total_return, round(case when stddev_samp(pnl) = 0 then 0.0 else avg(pnl) / stddev_samp(pnl) * sqrt(252.0) end, 6) + 0.0 as sharpe, round(min(wealth / peak - 1), 6) + 0.0 as max_drawdown,"
    " round(avg((pnl > 0)::int), 6) + 0.0 as win_rate from (select *, max(wealth) over (order by date) as peak from (select *, product(1 + pnl) over (order by date) as wealth from dy))",
)
_bt("spec_round_trip", lambda s, w, signal: s.evaluate(__import__("json").loads(signal.to_json())).to_df(), "select date, symbol, round(x, 6) + 0.0 as value from r")


def peer_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return of a symbol's group without itself, y-weighted, top tenth of the ranks held long."""
    s, _, _ = _backtest(spark, sf_dir)
    r, cap, g = s("ret"), s("y"), s("g")
    peers = (s.ops.group_sum(cap * r, g) - cap * r) / (s.ops.group_sum(cap, g) - cap)
    top = s.ops.if_else(s.ops.rank(peers) > 0.9, peers, 0.0)
    return _rounded(s.set_scaler("LongOnly").to_weights(top).to_df())


QUERIES["peer_returns"] = peer_returns
ORACLES["peer_returns"] = f"""{EV}, m as (select *, (y - lag(y) over wt) / (y + 100.0) as ret from p{WINDOWS}), k as (select *, y * ret as cr from m),
s as (select *, case when cr is not null then sum(cr) over (partition by date, g) end - cr as a, sum(y) over (partition by date, g) - y as b from k),
e as (select *, case when u then case when b = 0 then case when a > 0 then 'inf'::double when a < 0 then '-inf'::double end else a / b end end as pe from s),
f as (select *, case when u then case when coalesce({_RANK.format(x="pe", k="date")} > 0.9, false) then pe else 0.0 end end as x from (select * exclude (x) from e))
select date, symbol, round(coalesce(case when x is not null then greatest(x, 0) end / nullif(sum(greatest(x, 0)) over (partition by date), 0), 0), 6) + 0.0 as value from f"""


def double_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sizes by three values: labels, composite groups, leg weights of a third, value weights within the groups."""
    s = ev_session(spark, sf_dir)
    size = s.ops.label_quantile(s("y"), bins=2, labels=["small", "big"])
    value = s.ops.label_quantile(s("x"), bins=3, labels=["low", "mid", "high"])
    both = s.ops.composite_group(size, value)
    legs = s.ops.map_values(both, mapping={"small&high": 0.5, "big&high": 0.5, "small&low": -0.5, "big&low": -0.5, "small&mid": 0.0, "big&mid": 0.0})
    return _rounded((legs * s.ops.group_scale_positive(s("y"), both)).to_df())


QUERIES["double_sort"] = double_sort
ORACLES["double_sort"] = f"""{EV}, q as (select *, quantile_cont(x, [0.0, 0.3333333333333333, 0.6666666666666666, 1.0]) over wd as e, quantile_cont(y, [0.0, 0.5, 1.0]) over wd as ey,
  count(x) over wd as n, count(y) over wd as ny, rank() over (partition by date order by x nulls last) as r, rank() over (partition by date order by y nulls last) as ry,
  dense_rank() over (partition by date order by x nulls last) as k, dense_rank() over (partition by date order by y nulls last) as ky from p{WINDOWS}),
 b as (select *, max(case when x is not null then k end) over (partition by date) as nu, max(case when y is not null then ky end) over (partition by date) as nuy from q),
 l as (select *, case when u and x is not null then case when nu = 1 then 0 when nu < 3 or len(list_distinct(e)) <= 3 then least(r * 3 // n, 2) else greatest(len(list_filter(e, lambda z: z < x)) - 1, 0) end end as bx,
  case when u and y is not null then case when nuy = 1 then 0 when nuy < 2 or len(list_distinct(ey)) <= 2 then least(ry * 2 // ny, 1) else greatest(len(list_filter(ey, lambda z: z < y)) - 1, 0) end end as bv from b)
 select date, symbol, round(case when u then (case bx when 2 then 0.5 when 0 then -0.5 when 1 then 0.0 end) * (y / nullif(sum(y) over (partition by date, bx, bv), 0)) end, 6) + 0.0 as value from l"""


def set_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev_session(spark, sf_dir)
    small = s.with_universe(s("y") > 50.0)
    return _rounded(small.ops.rank(small("x")).to_df())


QUERIES["set_universe"] = set_universe
ORACLES["set_universe"] = f"{EV}, n as (select date, symbol, case when u and y > 50 then x end as x, coalesce(u and y > 50, false) as u from p) select date, symbol, round(case when u then {_RANK.format(x='x', k='date')} end, 6) + 0.0 as value from n"


# ---- ship: sparse, larger ----


def ship_session(spark: SparkSession, sf_dir: str) -> Session:
    q = "select cast(l_shipdate as date) as date, l_suppkey as symbol, sum(l_extendedprice) as value from " + _source(sf_dir, "lineitem") + " group by 1, 2"
    return Session(Catalog(spark, {"price": {"query": q}, "carried": {"query": q, "forward_fill": True}}), "price")


SHIP = """with raw as (select cast(l_shipdate as date) as date, l_suppkey as symbol, sum(l_extendedprice) as x from lineitem group by 1, 2),
dd as (select date, row_number() over (order by date) as t from (select distinct date from raw)),
p as (select dd.date, s.symbol, dd.t, r.x, r.x is not null as u from dd cross join (select distinct symbol from raw) s left join raw r on r.date = dd.date and r.symbol = s.symbol)"""


def ship_rolling_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ship_session(spark, sf_dir)
    return _rounded(s.ops.rank(s.ops.ts_sum(s("price"), window=20)).to_df().filter("value is not null"))


QUERIES["ship_rolling_rank"] = ship_rolling_rank
ORACLES["ship_rolling_rank"] = f"""{SHIP}, m as (select *, case when u and count(x) over w >= 6 then round(sum(x) over w, 2) end as m from p window w as (partition by symbol order by t rows between 19 preceding and current row))
select date, symbol, round({_RANK.format(x='m', k='date')}, 6) + 0.0 as value from m where u qualify value is not null"""


def ship_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sums per supplier nation, as a hash aggregate over a dimension join."""
    line, sup, nat = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "nation"))
    by = line.groupBy(F.trunc("l_shipdate", "month").cast("date").alias("month"), "l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    out = by.join(sup.select("s_suppkey", "s_nationkey"), by["l_suppkey"] == F.col("s_suppkey")).join(nat.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return out.groupBy("month", F.col("n_name").alias("nation")).agg(F.round(F.sum("v"), 2).alias("value")).withColumn("month", F.col("month").cast("string"))


QUERIES["ship_monthly"] = ship_monthly
ORACLES["ship_monthly"] = """select cast(date_trunc('month', l_shipdate) as date) as month, n_name as nation, round(sum(l_extendedprice), 2) as value
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2"""

# ---- reshaping ----


def etl_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = load_cells(ev_catalog(spark, sf_dir), "y").withColumnRenamed("value", "adj_close")
    return _rounded(reshape.calculate_returns(prices, after_zero="missing"))


QUERIES["etl_returns"] = etl_returns
ORACLES["etl_returns"] = f"{EV} select date, symbol, round(ret, 6) + 0.0 as return from (select date, symbol, y / nullif(lag(y) over (partition by symbol order by date), 0) - 1 as ret from raw) where ret is not null"


def etl_melt_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a wide sheet (item rows, date columns), melted to long rows and items turned into columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    wide = events.withColumn("d", F.date_format("ts", "yyyy-MM-dd")).groupBy(F.col("user_id").alias("Symbol"), F.col("event_type").alias("Item")).pivot("d")
    long = reshape.melt_to_long(wide.agg(F.round(F.sum("value"), 2)), ["Symbol", "Item"]).withColumn("value", F.col("value").cast("double")).filter("value is not null")
    items = reshape.pivot_items(long.withColumn("Item", F.when(F.col("Item").isin("click", "view"), F.col("Item")).otherwise("other")).groupBy("date", "Symbol", "Item").agg(F.round(F.sum("value"), 2).alias("value")), ["date", "Symbol"], items=["click", "view", "other"])
    return _rounded(reshape.rename_columns(items, {"Symbol": "symbol", "click": "clicks", "view": "views", "other": "others", "absent": "x"}))


QUERIES["etl_melt_pivot"] = etl_melt_pivot
ORACLES["etl_melt_pivot"] = """select cast(ts as date) as date, user_id as symbol, round(sum(case when event_type = 'click' then value end), 2) as clicks, round(sum(case when event_type = 'view' then value end), 2) as views,
round(sum(case when coalesce(event_type, '') not in ('click', 'view') then value end), 2) as others from events group by 1, 2"""


def etl_event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    bounds = events.agg(F.min("ts").cast("date").cast("string").alias("first"), F.max("ts").cast("date").cast("string").alias("last")).first()  # the table's own, so that no row is outside
    return _rounded(reshape.event_flags(events.select(text.alias("event_date"), F.col("user_id").alias("symbol")), start=bounds["first"], end=bounds["last"]))


QUERIES["etl_event_flags"] = etl_event_flags
ORACLES["etl_event_flags"] = "select distinct cast(ts as date) as date, user_id as symbol, 1.0::double as value from events where cast(ts as date) between (select min(cast(ts as date)) from events) and (select max(cast(ts as date)) from events)"


def etl_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reshape.describe(load_cells(ev_catalog(spark, sf_dir), "y"), "date", "symbol", "value"))


QUERIES["etl_describe"] = etl_describe
ORACLES["etl_describe"] = f"{EV} select count(*) as n, count(distinct symbol) as n_symbols, min(date) as first_date, max(date) as last_date, round(avg(y), 6) + 0.0 as mean, round(stddev_samp(y), 6) + 0.0 as std from raw"


def etl_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheet over all days and all items of the table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    wide = events.withColumn("d", F.date_format("ts", "yyyy-MM-dd")).groupBy(F.col("user_id").alias("Symbol"), F.col("event_type").alias("Item")).pivot("d").agg(F.round(F.sum("value"), 2))
    long = reshape.melt_to_long(wide, ["Symbol", "Item"]).withColumn("value", F.col("value").cast("double")).filter("value is not null")
    items = reshape.pivot_items(long, ["date", "Symbol"])  # whatever items there are
    names = [c for c in items.columns if c not in ("date", "Symbol")]
    again = items.unpivot(["date", "Symbol"], names, "item", "value").filter("value is not null")  # a row an item, so that the result's columns do not depend on the table
    return _rounded(reshape.rename_columns(again, {"Symbol": "symbol"}))


QUERIES["etl_sheet"] = etl_sheet
ORACLES["etl_sheet"] = "select cast(ts as date) as date, user_id as symbol, event_type as item, round(sum(value), 2) as value from events group by 1, 2, 3 having sum(value) is not null"


def etl_all_event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return _rounded(reshape.event_flags(events.select(text.alias("event_date"), F.col("user_id").alias("symbol"))))


QUERIES["etl_all_event_flags"] = etl_all_event_flags
ORACLES["etl_all_event_flags"] = "select distinct cast(ts as date) as date, user_id as symbol, 1.0::double as value from events"


def etl_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, typed again: prices as exact integers, capital in millions, fundamentals in thousands, a status as a flag."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    df = p.select(F.col("p_partkey").alias("symbol"), F.round(price).cast("string").alias("adj_close"), price.cast("string").alias("market_cap_million"), F.col("p_retailprice").alias("sales_thousand"), F.when(F.col("p_partkey") % 5 != 0, F.when(F.col("p_partkey") % 2 == 0, vendor.TRADING).otherwise("halt")).alias("trading_halt_status"))
    return _rounded(vendor.preprocess_price(df))


QUERIES["etl_typed"] = etl_typed
ORACLES["etl_typed"] = """select p_partkey as symbol, cast(round(cast(p_retailprice as decimal(18,2))) as bigint) as adj_close, cast(cast(p_retailprice as decimal(18,2)) * 1000000 as bigint) as market_cap,
round(p_retailprice * 1000, 6) + 0.0 as sales, (case when p_partkey % 5 <> 0 and p_partkey % 2 = 0 then 0.0 else 1.0 end)::double as is_trading_suspended from part"""


def etl_zero_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that are 0 every third day: infinite on the day after, missing where 0 follows 0."""
    prices = load_cells(ev_catalog(spark, sf_dir), "y").withColumn("adj_close", F.when(F.day("date") % 3 == 0, 0.0).otherwise(F.col("value")))
    return _rounded(reshape.calculate_returns(prices))


QUERIES["etl_zero_price"] = etl_zero_price
ORACLES["etl_zero_price"] = f"""{EV}, z as (select date, symbol, case when day(date) % 3 = 0 then 0.0 else y end as p from raw),
b as (select date, symbol, p, lag(p) over (partition by symbol order by date) as q from z)
select date, symbol, case when q = 0 then case when p > 0 then 'inf'::double else '-inf'::double end else round(p / q - 1, 6) + 0.0 end as return from b where q is not null and not (q = 0 and p = 0)"""


def etl_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reshape.value_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type"))


QUERIES["etl_value_counts"] = etl_value_counts
ORACLES["etl_value_counts"] = "select event_type as value, count(*) as n, round(count(*) / sum(count(*)) over (), 6) + 0.0 as share from events group by 1"


def etl_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.profile(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")).drop("type")


QUERIES["etl_profile"] = etl_profile
ORACLES["etl_profile"] = " union all ".join(f"select '{c}' as name, count(*) as n, count(*) - count({c}) as missing, count(distinct {c}) as n_distinct from customer" for c in ("c_custkey", "c_nationkey", "c_mktsegment"))

# ---- infinite cells, specs, steps ----

ev("infinite_arithmetic", "case when y - y = 0 and x > 0 then null else 1.0 end")(lambda s: (lambda z: s.ops.if_else(z > 5.0, z - z, 1.0))(s.ops.divide(s("x"), s("y") - s("y"))))
ev("infinite_window", observed("avg(z) over w5", "z", "w5", 2))(lambda s: s.ops.ts_mean(s.ops.if_else(s("x") > 60.0, s.ops.divide(s("x"), s("y") - s("y")), s("x")), window=5))
ORACLES["infinite_window"] = ORACLES["infinite_window"].replace("from p window", "from (select *, case when x > 60 then null else x end as z from p) window")
_again = lambda s, panel: s.evaluate(__import__("json").loads(panel.to_json()))
ev("spec_broadcast", "x - avg(x) over wd")(lambda s: _again(s, s("x") - s.ops.cross_mean(s("x"))))
ev("spec_labels", "coalesce(g = h, false)", "boolean")(lambda s: _again(s, s("g") == s("h")))
ev("spec_number_keys", "case sign(x - 50) when 1 then 10.0 when -1 then -10.0 else sign(x - 50)::double end")(lambda s: _again(s, s.ops.map_values(s.ops.sign(s("x") - 50.0), mapping={1.0: 10.0, -1.0: -10.0})))
_bt("pnl_by_step", lambda s, w, signal: (lambda st: st.with_scaler("DollarNeutral").cumulative_pnl(len(st) - 1))(s.steps(signal, "LongOnly")), "select date, round(sum(pnl) over (order by date), 6) + 0.0 as value from dy")

# ---- state along time, look-back by value, regression ----

_FOLD = """{ev}, o as (select *, row_number() over (partition by symbol order by t) as k from p where u and {given}),
f as (select symbol, date, k, {start} as v from o where k = 1 union all select o.symbol, o.date, o.k, {step} as v from f join o on o.symbol = f.symbol and o.k = f.k + 1)
select p.date, p.symbol, round(f.v, 6) + 0.0 as value from p left join f on f.symbol = p.symbol and f.date = p.date"""


def _fold(name: str, given: str, step: str, f: Callable):
    QUERIES[name] = lambda spark, sf_dir: _rounded(f(ev_session(spark, sf_dir)).to_df())
    ORACLES[name] = "with recursive" + _FOLD.format(ev=EV, given=given, start="x", step=step).lstrip().removeprefix("with")


_fold("hump", "x is not null", "case when abs(o.x - f.v) <= 15 then f.v else f.v + 15 * sign(o.x - f.v) end", lambda s: s.ops.hump(s("x"), hump=15.0))
_fold("ts_decay", "x is not null", "f.v / 3 + o.x * 2 / 3", lambda s: s.ops.ts_decay(s("x"), weight=1 / 3))
_fold("ts_delta_limit", "x is not null and y is not null", "f.v + least(greatest(o.x - f.v, -0.2 * abs(o.y)), 0.2 * abs(o.y))", lambda s: s.ops.ts_delta_limit(s("x"), s("y"), weight=0.2))
ev("trade_when", "0")(lambda s: s.ops.trade_when(s("x") > 60.0, s.ops.rank(s("x")), s("y") < 25.0))
ORACLES["trade_when"] = f"""{EV}, r as (select *, case when u then {_RANK.format(x='x', k='date')} end as r from p),
e as (select *, case when u and y < 25 then {{'v': null::double}} when u and x > 60 then {{'v': r}} end as e from r)
select date, symbol, round(case when u then (last_value(e ignore nulls) over (partition by symbol order by t rows between unbounded preceding and current row)).v end, 6) + 0.0 as value from e"""
ev("jump_decay", "0")(lambda s: s.ops.jump_decay(s("x"), window=8, sensitivity=1.0, force=0.25))
ORACLES["jump_decay"] = f"""{EV}, d as (select *, lag(x) over wt as b, case when count(x) over w8 >= 5 then stddev_samp(x) over w8 end as sd from p{WINDOWS})
select date, symbol, round(case when u then case when coalesce(abs(x - b) > sd, false) then b + (x - b) * 0.25 else x end end, 6) + 0.0 as value from d"""
_LIST = "list({x}) filter ({x} is not null) over {w}"
ev("kth_element", "0")(lambda s: s.ops.kth_element(s("x"), window=8, k=2, ignore="NAN 0"))
ORACLES["kth_element"] = f"{EV} select date, symbol, round(case when u then a[len(a) - 1] end, 6) + 0.0 as value from (select *, list(x) filter (x is not null and x <> 0) over w8 as a from p{WINDOWS})"
ev("ts_backfill", "0")(lambda s: s.ops.ts_backfill(s("x"), window=5))
ORACLES["ts_backfill"] = f"{EV} select date, symbol, round(case when u then coalesce(x, a[len(a)]) end, 6) + 0.0 as value from (select *, list(x) filter (x is not null) over (partition by symbol order by t rows between 5 preceding and 1 preceding) as a from p)"
ev("last_diff_value", "0")(lambda s: s.ops.last_diff_value(s.ops.sign(s("x") - 50.0), window=8))
ORACLES["last_diff_value"] = f"""{EV}, g as (select * exclude (x), sign(x - 50)::double as x from p), l as (select *, list(x) filter (x is not null) over w8 as a from g{WINDOWS})
select date, symbol, round(case when u then list_filter(a, lambda z: z <> x)[-1] end, 6) + 0.0 as value from l"""
ev("days_from_last_change", "0")(lambda s: s.ops.days_from_last_change(s.ops.sign(s("x") - 50.0)))
ORACLES["days_from_last_change"] = f"""{EV}, g as (select * exclude (x), sign(x - 50)::double as x from p),
b as (select *, last_value(x ignore nulls) over (partition by symbol order by t rows between unbounded preceding and 1 preceding) as b from g),
hh as (select *, max(case when x is not null and (b is null or x <> b) then t end) over (partition by symbol order by t rows between unbounded preceding and current row) as chg from b)
select date, symbol, round(case when u and x is not null then (t - chg)::double end, 6) + 0.0 as value from hh"""
_REG = f"""{EV}, l as (select *, lag(y) over wt as z from p{WINDOWS}),
m as (select *, case when z is not null then x end as a, case when x is not null then z end as b from l),
r as (select *, count(a) over w8 as n, avg(a) over w8 as ma, avg(b) over w8 as mb, regr_slope(a, b) over w8 as beta, var_samp(a) over w8 * (count(a) over w8 - 1) as sst, var_samp(b) over w8 * (count(b) over w8 - 1) as sxx, covar_samp(a, b) over w8 as cab from m{WINDOWS}),
e as (select *, greatest(0, sst - cab * cab / nullif(sxx, 0) * (n - 1) * (n - 1)) as sse from r)
select date, symbol, round(case when u and n >= 5 then {{}} end, 6) + 0.0 as value from e"""
for _n, _k, _e in (
    ("error", 0, "x - (ma + cab * (n - 1) / nullif(sxx, 0) * (z - mb))"), ("alpha", 1, "ma - cab * (n - 1) / nullif(sxx, 0) * mb"), ("beta", 2, "cab * (n - 1) / nullif(sxx, 0)"), ("estimate", 3, "ma + cab * (n - 1) / nullif(sxx, 0) * (z - mb)"),
    ("sse", 4, "sse"), ("sst", 5, "sst"), ("r2", 6, "1 - sse / nullif(sst, 0)"), ("mse", 7, "sse / (n - 2)"), ("beta_error", 8, "sqrt(sse / (n - 2) / nullif(sxx, 0))"), ("alpha_error", 9, "sqrt(sse / (n - 2) * (1 / n::double + mb * mb / nullif(sxx, 0)))"),
):
    ev(f"ts_regression_{_n}", "0")(lambda s, k=_k: s.ops.ts_regression(s("x"), s("y"), window=8, lag=1, rettype=k) / 997.0)  # no result lies on the edge of rounding
    ORACLES[f"ts_regression_{_n}"] = _REG.format(f"({_e}) / 997")

ev("grouped_by_date", "0")(lambda s: s.ops.trimmed_mean_gap(s("x")) / 997.0)
ORACLES["grouped_by_date"] = f"""{EV}, r as (select *, row_number() over (partition by date order by x nulls last, symbol) as r, count(x) over (partition by date) as n from p),
m as (select date, avg(case when x is not null and r > n // 10 and r <= n - n // 10 then x end) as m from r group by date)
select p.date, p.symbol, round(case when u then (x - m) / 997 end, 6) + 0.0 as value from p join m using (date)"""

# ---- factors, groups over days, limits, information coefficients ----

ev("vector_neut", "x - y * sum(case when y is not null then x * y end) over wd / nullif(sum(case when x is not null then y * y end) over wd, 0)")(lambda s: s.ops.vector_neut(s("x"), s("y")))
ev("group_backfill", "0")(lambda s: s.ops.group_backfill(s("x"), s("g"), window=3, std=1.5))
ORACLES["group_backfill"] = f"""{EV}, k as (select a.g, a.date, v.x from (select distinct g, t, date from p where g is not null) a join p v on v.g = a.g and v.t between a.t - 2 and a.t and v.x is not null
   and v.t in (select distinct t from p z where z.g = a.g)),
m as (select g, date, avg(x) as m, coalesce(stddev_samp(x), 0) as sd from k group by all),
w as (select k.g, k.date, avg(least(greatest(k.x, m - 1.5 * sd), m + 1.5 * sd)) as w from k join m on m.g = k.g and m.date = k.date group by all)
select p.date, p.symbol, round(case when u and p.g is not null then coalesce(x, w) end, 6) + 0.0 as value from p left join w on w.g = p.g and w.date = p.date"""
_FACTORS = f"""{EV}, d as (select date, count(*) as n, avg(y) as my, avg(x) as mx, avg(z) as mz, covar_pop(y, x) as xy, covar_pop(y, z) as zy, var_pop(x) as xx, var_pop(z) as zz, covar_pop(x, z) as xz, var_pop(y) as yy
  from (select date, y, x, (symbol % 11)::double as z from p where u and x is not null and y is not null) group by date),
b as (select *, (xy * zz - zy * xz) / (xx * zz - xz * xz) as b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) as b2 from d)"""


def _of_two(s: Session) -> tuple[DataFrame, Panel]:
    """y on x and on the symbol's remainder by 11."""
    code = Panel(s, s.column(F.col("symbol") % 11.0), "numeric", 0, "code", {"const": 0.0})
    return s.factor_regression(s("y"), [s("x"), code])


QUERIES["factor_betas"] = lambda spark, sf_dir: _rounded(_of_two(ev_session(spark, sf_dir))[0].select("date", "n", "alpha", F.get("betas", F.lit(0)).alias("beta_x"), F.get("betas", F.lit(1)).alias("beta_z"), "r2"))
ORACLES["factor_betas"] = f"{_FACTORS} select date, n, round(my - b1 * mx - b2 * mz, 6) + 0.0 as alpha, round(b1, 6) + 0.0 as beta_x, round(b2, 6) + 0.0 as beta_z, round((b1 * xy + b2 * zy) / yy, 6) + 0.0 as r2 from b"
ev("factor_residual", "0")(lambda s: _of_two(s)[1])
ORACLES["factor_residual"] = f"{_FACTORS} select p.date, p.symbol, round(case when u then y - (my - b1 * mx - b2 * mz) - b1 * x - b2 * (symbol % 11) end, 6) + 0.0 as value from p join b using (date)"
ev("position_limits", "0", masked=False)(lambda s: s.limit_leverage(s.cap_positions(s.set_scaler("DollarNeutral").to_weights(s("x")), limit=0.02), gross=1.7, net=0.1))
ORACLES["position_limits"] = f"""{EV}, {_GN.format(l=1.0, s=1.0)},
r as (select date, symbol, u, w, sign(w) as sd, row_number() over o as i, sum(abs(w)) over (partition by date, sign(w)) as total, sum(abs(w)) over (o rows between current row and unbounded following) as rest
  from (select date, symbol, u, case when u then w end as w from w) window o as (partition by date, sign(w) order by abs(w) desc nulls last)),
f as (select *, (total - (i - 1) * 0.02) / nullif(rest, 0) as f from r),
g as (select *, min(case when f * abs(w) <= 0.02 * (1 + 1e-12) then {{'i': i, 'f': f}} end) over (partition by date, sd) as st from f),
lim as (select date, symbol, case when w is not null then sd * least(0.02, coalesce(st.f * abs(w), 0.02)) end as w from g),
n as (select *, coalesce(sum(case when w > 0 then w end) over (partition by date), 0) as up, coalesce(-sum(case when w < 0 then w end) over (partition by date), 0) as down from lim),
q as (select date, symbol, case when w > 0 and up - down > 0.1 then w * (down + 0.1) / up when w < 0 and down - up > 0.1 then w * (up + 0.1) / down else w end as w from n)
select date, symbol, round(case when sum(abs(w)) over (partition by date) > 1.7 then w * 1.7 / sum(abs(w)) over (partition by date) else w end, 6) + 0.0 as value from q"""
_IC = f"""{EV}, h as (select *, lead(y, 1) over wt / nullif(y, 0) - 1 as h1, lead(y, 3) over wt / nullif(y, 0) - 1 as h3 from p{WINDOWS}),
e as (select date, 1 as horizon, x as a, h1 as b from h where u union all select date, 3, x, h3 from h where u),
k as (select * from e where a is not null and b is not null),
r as (select date, horizon, rank() over (partition by date, horizon order by a) + (count(*) over (partition by date, horizon, a) - 1) / 2.0 as a, rank() over (partition by date, horizon order by b) + (count(*) over (partition by date, horizon, b) - 1) / 2.0 as b from k),
i as (select date, horizon, covar_samp(a, b) / nullif(sqrt(var_samp(a) * var_samp(b)), 0) as ic, count(*) as n from r group by 1, 2)"""
QUERIES["rank_ic"] = lambda spark, sf_dir: (lambda s: _rounded(s.rank_ic(s("x"), s("y"), [1, 3])))(ev_session(spark, sf_dir))
ORACLES["rank_ic"] = f"{_IC} select date, horizon, round(ic, 6) + 0.0 as ic, n from i"
QUERIES["ic_decay"] = lambda spark, sf_dir: (lambda s: _rounded(ic.decay(s.rank_ic(s("x"), s("y"), [1, 3]))))(ev_session(spark, sf_dir))
ORACLES["ic_decay"] = f"{_IC} select horizon, round(avg(ic), 6) + 0.0 as mean, round(stddev_samp(ic), 6) + 0.0 as std, round(avg(ic) / stddev_samp(ic), 6) + 0.0 as ir, round(avg((ic > 0)::int), 6) + 0.0 as positive, count(*) as n from i where ic is not null group by 1"
QUERIES["ic_rolling"] = lambda spark, sf_dir: (lambda s: _rounded(ic.rolling_ic(s.rank_ic(s("x"), s("y"), [1, 3]), 5)))(ev_session(spark, sf_dir))
ORACLES["ic_rolling"] = f"{_IC} select date, horizon, round(avg(ic) over (partition by horizon order by date rows between 4 preceding and current row), 6) + 0.0 as value from i"

_COSTS = Costs(commission=0.0013, min_fee=1.7, slippage_bps=4.3, impact=0.11)


def _ledger(s: Session) -> DataFrame:
    """Momentum, dollar-neutral and long only, at prices of 100 and a fiftieth of y, and volumes of 5000 y."""
    w = {k: s.set_scaler(k).to_weights(s.ops.ts_mean(s("y"), window=3)) for k in ("DollarNeutral", "LongOnly")}
    return s.ledger(w, s("y") / 50.0 + 100.0, s("y") * 5000.0, costs=_COSTS)


_LEDGER = f"""{EV}, m as (select *, case when u and count(y) over w3 >= 1 then avg(y) over w3 end as x0 from p{WINDOWS}), k as (select * exclude (x), x0 as x from m),
{_GN.format(l=1.0, s=1.0).replace("from p", "from k")},
two as (select date, t, symbol, y, 'DollarNeutral' as strategy, w from w union all select date, t, symbol, y, 'LongOnly', coalesce(case when x is not null then greatest(x, 0) end / nullif(sum(greatest(x, 0)) over (partition by date), 0), 0) from k),
arr as (select strategy, t, date, list(w order by symbol) as ws, list(case when y is not null then y / 50 + 100 end order by symbol) as ps, list(case when y > 0 then y * 5000 end order by symbol) as vs, list(symbol order by symbol) as ids, count(*) as n from two group by 1, 2, 3),
f as (select distinct strategy, 0::bigint as t, 1000000.0::double as cash, list_transform(ps, lambda z: 0.0::double) as sh, list_transform(ps, lambda z: 0.0::double) as lp, 0.0::double as paid, 0.0::double as fees, list_transform(ps, lambda z: 0.0::double) as tr, 0.0::double as equity, null::date as date, ids from arr
union all select strategy, t, cash - paid - fees, sh2, lp2, paid, fees, tr, cash - paid - fees + list_sum(list_transform(range(1, n + 1), lambda i: sh2[i] * lp2[i])), date, ids
 from (select *, list_sum(pd) as paid, list_sum(list_transform(range(1, n + 1), lambda i: case when tr[i] = 0 then 0.0 else greatest(1.7, 0.0013 * abs(pd[i])) end)) as fees
  from (select *, list_transform(range(1, n + 1), lambda i: case when tr[i] = 0 then 0.0 else tr[i] * ps[i] * (1 + sign(tr[i]) * (0.00043 + 0.11 * sqrt(abs(tr[i]) / vs[i]))) end) as pd, list_transform(range(1, n + 1), lambda i: sh[i] + tr[i]) as sh2
   from (select *, list_transform(range(1, n + 1), lambda i: case when vs[i] is null then 0.0 else sign(ws[i]) * floor(abs(ws[i] * eq / ps[i]) + 0.5) - sh[i] end) as tr
    from (select a.strategy, a.t, a.date, a.ws, a.ps, a.vs, a.ids, a.n, f.cash, f.sh, list_transform(range(1, a.n + 1), lambda i: coalesce(a.ps[i], f.lp[i])) as lp2,
      f.cash + list_sum(list_transform(range(1, a.n + 1), lambda i: f.sh[i] * coalesce(a.ps[i], f.lp[i]))) as eq from f join arr a on a.strategy = f.strategy and a.t = f.t + 1)))))"""
QUERIES["ledger_accounts"] = lambda spark, sf_dir: _rounded(accounts(_ledger(ev_session(spark, sf_dir))))
ORACLES["ledger_accounts"] = "with recursive" + _LEDGER.lstrip().removeprefix("with") + " select strategy, date, list_sum(list_transform(tr, lambda z: abs(z))) as traded, round(paid, 6) + 0.0 as paid, round(fees, 6) + 0.0 as commission, round(cash, 6) + 0.0 as cash, round(equity, 6) + 0.0 as equity from f where t > 0"
QUERIES["ledger_shares"] = lambda spark, sf_dir: _rounded(positions(_ledger(ev_session(spark, sf_dir))).filter("shares <> 0").select("strategy", "date", "symbol", "shares"))
ORACLES["ledger_shares"] = "with recursive" + _LEDGER.lstrip().removeprefix("with") + " select * from (select strategy, date, unnest(ids) as symbol, unnest(sh) as shares from f where t > 0) where shares <> 0"

# a spec of weights keeps its scaler, whatever the session's is by then
_bt("spec_weights", lambda s, w, signal: s.set_scaler("LongOnly").evaluate(__import__("json").loads(w.to_json())).to_df(), "select date, symbol, round(w, 6) + 0.0 as value from w")
_bt("pnl_of_returns", lambda s, w, signal: s.steps(s.to_portfolio_returns(w), "LongOnly").daily_pnl(), "select date, round(pnl, 6) + 0.0 as value from dy")

_DATES = {"ic_decay": (), "ship_monthly": ("month",), "etl_describe": ("first_date", "last_date"), "metrics": (), "etl_typed": (), "etl_value_counts": (), "etl_profile": ()}
for _n, _sql in ORACLES.items():
    if _dates := _DATES.get(_n, ("date",)):
        ORACLES[_n] = f"select * replace ({', '.join(f'cast({d} as varchar) as {d}' for d in _dates)}) from ({_sql})"


def entry(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return QUERIES["flagship_momentum"](spark, sf_dir or os.environ.get("TESSELLA_DATA", "/root/testdata/sf0.001"))
