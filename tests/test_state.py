"""Grouped operators, folds along time, look-back by value, regressions, turnover targets, steps and specs of weights."""

import datetime as dt
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.operators import REGISTRY
from tessella.operators.grouped import fold
from tessella.operators.registry import NUMERIC, register_grouped
from tessella.plans import turnover
from tessella.plans.session import Session
from tessella.queries import ev_session
from tessella.sources.catalog import Catalog

from .test_panel import close, col, make, values

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_fold_keeps_its_state_over_missing_cells(spark):
    s = make(spark, {"x": [[1.0, None], [1.4, None], [None, 5.0], [3.0, 4.0], [-9.0, None], [2.0, 5.1]]}, universe=[[True, True]] * 4 + [[False, True]] + [[True, True]])
    assert values(s.ops.hump(s("x"), hump=0.5)) == [[1.0, None], [1.0, None], [None, 5.0], [1.5, 4.5], [None, None], [1.5, 5.0]]
    close(values(s.ops.ts_decay(s("x"), weight=0.5)), [[1.0, None], [1.2, None], [None, 5.0], [2.1, 4.5], [None, None], [2.05, 4.8]])
    close(values(s.ops.ts_delta_limit(s("x"), 2.0, weight=0.1)), [[1.0, None], [1.2, None], [None, 5.0], [1.4, 4.8], [None, None], [1.6, 5.0]])


def test_grouped_functions_stream_in_order(spark):
    """A symbol's history comes in several batches, in order of time, once; the function may look ahead."""

    def number(batches, start=0):
        n, last = start, -1
        waiting = []
        for b in batches:
            ts = b.column("t").to_pylist()
            assert ts == sorted(ts) and ts[0] > last and len(set(b.column("symbol").to_pylist())) == 1
            last = ts[-1]
            waiting.append(b.num_rows)
            if len(waiting) > 1:  # one batch behind
                k = waiting.pop(0)
                yield pa.array(np.arange(n, n + k, dtype=float))
                n += k
        for k in waiting:
            yield pa.array(np.arange(n, n + k, dtype=float))
            n += k

    if "numbered_cells" not in REGISTRY:
        register_grouped("numbered_cells", number, (NUMERIC,))
        register_grouped("short_values", lambda batches: (pa.array([1.0]) for b in batches), (NUMERIC,))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        s = ev_session(spark, SF)
        p = s.ops.numbered_cells(s("x"), start=3)
        got = {}
        for r in s.frame(p).select("symbol", "t", p.name, "in_universe").collect():
            got.setdefault(r.symbol, []).append((r.t, r[p.name], r.in_universe))
        for rows in got.values():
            assert all(v == t + 2 for t, v, u in rows if u) and all(v is None for _, v, u in rows if not u)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    with pytest.raises(Exception, match="values for"):
        s.ops.short_values(s("x")).to_df().collect()
    with pytest.raises(ValueError):
        register_grouped("by_week", number, (NUMERIC,), by="week")
    with pytest.raises(TypeError):
        s.ops.hump(s("g"))


def test_grouped_operators_use_the_frames_exchange(spark):
    s = ev_session(spark, SF)
    field, humped = plan(s("x").to_df()), plan(s.ops.hump(s("x")).to_df())
    assert humped.count("Exchange hashpartitioning") == field.count("Exchange hashpartitioning") and "FlatMapGroupsInArrow" in humped
    assert plan(s.ops.ts_mean(s("x"), window=3).to_df()).count("FlatMapGroupsInArrow") == 0  # what a result does not use is not run
    ranked = plan(s.ops.hump(s.ops.rank(s("x"))).to_df())
    assert ranked.count("Exchange hashpartitioning") == field.count("Exchange hashpartitioning") + 2  # by date, and back
    assert plan(s.ops.trimmed_mean_gap(s("x")).to_df()).count("Exchange hashpartitioning") == field.count("Exchange hashpartitioning") + 1


def test_grouped_by_date_and_empty(spark):
    s = make(spark, {"x": [[float(k) for k in range(20)] + [None], [None] * 21]})
    got = values(s.ops.trimmed_mean_gap(s("x")))
    assert sorted(v for v in got[0] if v is not None) == [k - 9.5 for k in range(20)] and got[0].count(None) == 1 and got[1] == [None] * 21
    e = Session(Catalog(spark, {}), spark.createDataFrame([], "date date, symbol string, in_universe boolean"))
    assert e.ops.hump(e.constant(1.0)).to_df().collect() == []
    spec = json.loads(s.ops.hump(s("x"), hump=2.0).to_json())
    assert values(s.evaluate(spec)) == values(s.ops.hump(s("x"), hump=2.0))


def test_own_fold(spark):
    if "longest_run" not in REGISTRY:
        register_grouped("longest_run", fold(lambda state, x: ((0 if x is None or x <= 0 else state + 1),) * 2, 0), (NUMERIC,))
    s = make(spark, {"x": col(1.0, 2.0, -1.0, 3.0, None, 4.0, 5.0)})
    assert values(s.ops.longest_run(s("x"))) == col(1.0, 2.0, 0.0, 1.0, 0.0, 1.0, 2.0)


def test_trade_when_and_jumps(spark):
    s = make(spark, {"x": col(0.0, 1.0, 0.0, 1.0, 0.0, None), "y": col(5.0, 6.0, 7.0, None, 9.0, 1.0), "z": col(-1.0, -1.0, None, 0.0, 2.0, -1.0)})
    assert values(s.ops.trade_when(s("x"), s("y"), s("z"))) == col(None, 6.0, 6.0, None, None, None)
    assert values(s.ops.trade_when(s("x") == 1.0, s("y"), -1.0)) == col(None, 6.0, 6.0, None, None, None)
    s = make(spark, {"x": col(1.0, 2.0, 1.0, 2.0, 12.0, 13.0)})
    sd = np.std([1.0, 2.0, 12.0], ddof=1)
    assert 0.5 * sd < 10 and 0.5 * np.std([1.0, 2.0], ddof=1) < 1 < 0.5 * sd  # the last change is no jump
    close(values(s.ops.jump_decay(s("x"), window=3)), col(1.0, 1.1, 1.9, 1.1, 3.0, 13.0))


def test_look_back_by_value(spark):
    s = make(spark, {"x": col(3.0, 0.0, None, 5.0, 5.0, None, None, 4.0)})
    x = s("x")
    assert values(s.ops.kth_element(x, window=3, k=1)) == col(3.0, 0.0, 0.0, 5.0, 5.0, 5.0, 5.0, 4.0)
    assert values(s.ops.kth_element(x, window=4, k=2, ignore="NAN 0")) == col(None, None, None, 3.0, 5.0, 5.0, 5.0, 5.0)
    assert values(s.ops.ts_backfill(x, window=2)) == col(3.0, 0.0, 0.0, 5.0, 5.0, 5.0, 5.0, 4.0)
    assert values(s.ops.ts_backfill(x, window=1)) == col(3.0, 0.0, 0.0, 5.0, 5.0, 5.0, None, 4.0)
    assert values(s.ops.last_diff_value(x, window=5)) == col(None, 3.0, None, 0.0, 0.0, None, None, 5.0)
    assert values(s.ops.days_from_last_change(x)) == col(0.0, 0.0, None, 0.0, 1.0, None, None, 0.0)
    with pytest.raises(ValueError):
        s.ops.kth_element(x, window=3, k=0)
    with pytest.raises(ValueError):
        s.ops.ts_backfill(x, window=0)


def test_regression_against_numpy(spark):
    rng = random.Random(6)
    for offset in (0.0, 1e9):
        x = [None if rng.random() < 0.15 else offset + rng.gauss(0, 3) for _ in range(9)]
        y = [None if v is None or rng.random() < 0.1 else 2.0 * (v - offset) + rng.gauss(0, 1) for v in x]
        s = make(spark, {"x": col(*x), "y": col(*y)})
        got = [[r[0] for r in values(s.ops.ts_regression(s("y"), s("x"), window=6, rettype=k))] for k in range(10)]
        for i in range(9):
            pairs = [(a, b) for a, b in zip(x[max(0, i - 5) : i + 1], y[max(0, i - 5) : i + 1], strict=True) if a is not None and b is not None]
            if len(pairs) < 4:
                assert all(g[i] is None for g in got)
                continue
            a, b = (np.array(v) for v in zip(*pairs, strict=True))
            n, c = len(a), a - a.mean()
            beta = (c @ (b - b.mean())) / (c @ c)
            alpha, fit = b.mean() - beta * a.mean(), b.mean() + beta * c
            sse, sst = ((b - fit) ** 2).sum(), ((b - b.mean()) ** 2).sum()
            here = None if x[i] is None else b.mean() + beta * (x[i] - a.mean())
            want = [None if here is None or y[i] is None else y[i] - here, alpha, beta, here, sse, sst, 1 - sse / sst, sse / (n - 2), math.sqrt(sse / (n - 2) / (c @ c)), math.sqrt(sse / (n - 2) * (1 / n + a.mean() ** 2 / (c @ c)))]
            for k, (g, w) in enumerate(zip(got, want, strict=True)):
                assert (g[i] is None) == (w is None) and (w is None or abs(g[i] - w) <= 1e-6 * max(1.0, abs(w))), (offset, k, i)
    s = make(spark, {"x": col(*[2.0] * 6), "y": col(*map(float, range(6)))})
    assert values(s.ops.ts_regression(s("y"), s("x"), window=5, rettype=2)) == col(*[None] * 6)
    with pytest.raises(ValueError):
        s.ops.ts_regression(s("y"), s("x"), window=5, rettype=10)


def test_turnover_targets(spark, monkeypatch):
    rng = random.Random(2)
    x = [[None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in range(12)] for _ in range(10)]
    s = make(spark, {"x": x, "v": [[abs(rng.gauss(0, 1)) for _ in range(12)] for _ in range(10)]})

    def measured(panel):
        rows = values(panel)
        days = []
        for d, row in enumerate(rows):
            moved = 0.0
            for k, v in enumerate(row):
                last = next((rows[e][k] for e in range(d - 1, -1, -1) if rows[e][k] is not None), None)
                moved += abs(v - last) if v is not None and last is not None else 0.0
            days.append(moved / sum(abs(v) for v in row if v is not None))
        return sum(days) / len(days)

    rounds = []
    real = turnover.turnovers
    monkeypatch.setattr(turnover, "turnovers", lambda *a: rounds.append(1) or real(*a))
    assert abs(measured(s.ts_target_tvr_decay(s("x"), target_tvr=0.4)) - 0.4) < 0.004
    assert len(rounds) == 3  # a job a round
    assert abs(measured(s.ts_target_tvr_delta_limit(s("x"), s("v"), target_tvr=0.5)) - 0.5) < 0.005
    assert abs(measured(s.ts_target_tvr_delta_limit(s("x"), 1.0, target_tvr=99.0, lambda_max=0.1)) - measured(s.ops.ts_delta_limit(s("x"), 1.0, weight=0.1))) < 1e-9


def test_steps_count_weights_and_returns_as_they_are(spark):
    s = ev_session(spark, SF)
    s._fields["ret"] = s("y") / 100.0
    w = s.set_scaler("DollarNeutral").to_weights(s.ops.rank(s("y")))
    r = s.to_portfolio_returns(w)
    n = len(s._steps)
    st = s.steps(r, "LongOnly")
    assert len(s._steps) == n  # nothing is evaluated again
    assert [p.tag for p in st.signals] == ["numeric", "numeric", "weight", "port_return"] and st.weights(2) is w and st.weights(3) is None and st.returns(3) is r
    pnl = lambda df: sorted((x.date, x.value) for x in df.collect())
    assert pnl(st.daily_pnl()) == pnl(s.daily_pnl(r)) == pnl(st.daily_pnl(2)) and pnl(st.daily_pnl(1)) != pnl(st.daily_pnl())
    y = s("y")
    assert len(s.steps((y + y) * (y + 1.0))) == 4  # each panel once


def test_weights_keep_their_scaler(spark):
    s = make(spark, {"x": [[1.0, 2.0, -3.0]]})
    w = s.set_scaler("LongOnly", target_gross=3.0).to_weights(s("x"))
    text = w.to_json()
    s.set_scaler("DollarNeutral")
    close(values(s.evaluate(json.loads(text))), [[1.0, 2.0, 0.0]])
    own = s.set_scaler(lambda c: c * 2).to_weights(s("x"))
    for p in (own, own + 1.0):
        with pytest.raises(ValueError, match="name"):
            p.to_json()
    assert dt.date(2024, 1, 1) in {r.date for r in own.to_df().collect()}


def test_a_smaller_universe_keeps_the_frame(spark):
    s = ev_session(spark, SF)
    small = s.with_universe(s("y") > 50.0)
    text, whole = plan(small.ops.rank(small("x")).to_df()), plan(s.ops.rank(s("x")).to_df())
    assert text.count("Exchange hashpartitioning") == whole.count("Exchange hashpartitioning") and text.count("FileScan") == whole.count("FileScan")
    smaller = small.with_universe(small.ops.hump(small("x")) > 20.0)  # a mask that a function of batches makes
    got = {(r.date, r.symbol): r.value for r in smaller("x").to_df().collect()}
    base = {(r.date, r.symbol): r.value for r in small("x").to_df().collect()}
    humped = {(r.date, r.symbol): r.value for r in small.ops.hump(small("x")).to_df().collect()}
    assert got == {k: v if humped[k] is not None and humped[k] > 20.0 else None for k, v in base.items()}
    assert values(s("x")) != values(small("x")) and small.universe_count().count() == s.universe_count().count()
    with pytest.raises(ValueError):
        small.ops.rank(s("x"))
