"""Panel engine: literal cases of the semantic rules, the contract of operators, and loading."""

import datetime as dt
import json
import math

import pytest

from tessella.operators import REGISTRY, list_operators, list_operators_by_category, register_operator
from tessella.plans.panel import dependencies
from tessella.plans.session import Session
from tessella.sources.catalog import Catalog, register_reader

D = [dt.date(2024, 1, d) for d in range(1, 11)]
INF = math.inf


def make(spark, columns: dict, universe=None, types=None, fill=None):
    """columns: name -> rows by date of values by symbol (None is missing)."""
    types, fill = types or {}, fill or {}
    config = {}
    shape = next(iter(columns.values()))
    symbols = [f"S{k}" for k in range(len(shape[0]))]
    kinds = {"numeric": "double", "group": "string", "boolean": "boolean", "event": "boolean", "object": "string"}
    for name, rows in columns.items():
        kind = types.get(name, "numeric")
        cells = [(D[i], s, v) for i, row in enumerate(rows) for s, v in zip(symbols, row, strict=True)]
        spark.createDataFrame(cells, f"date date, symbol string, value {kinds[kind]}").createOrReplaceTempView(f"v_{name}")
        config[name] = {"db_type": "table", "table": f"v_{name}", "data_type": kind, "forward_fill": fill.get(name, False)}
    u = universe or [[True] * len(symbols) for _ in shape]
    cells = [(D[i], s, v) for i, row in enumerate(u) for s, v in zip(symbols, row, strict=True)]
    return Session(Catalog(spark, config), spark.createDataFrame(cells, "date date, symbol string, in_universe boolean"))


def values(panel):
    rows = panel.to_df().collect()
    if "symbol" not in rows[0]:
        return [r.value for r in sorted(rows, key=lambda r: r.date)]
    out = {}
    for r in rows:
        out.setdefault(r.date, {})[r.symbol] = r.value
    return [[out[d][s] for s in sorted(out[d])] for d in sorted(out)]


def close(a, b):
    flat = lambda x: [y for row in x for y in (row if isinstance(row, list) else [row])]
    a, b = flat(a), flat(b)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x is None) == (y is None) and (x is None or x == y or abs(x - y) < 1e-9), (a, b)


def col(*v):
    return [[x] for x in v]


def test_rolling_needs_its_share_of_observations(spark):
    s = make(spark, {"x": col(1.0, None, 3.0, None, None, 6.0)})
    close(values(s.ops.ts_mean(s("x"), window=4)), col(None, None, 2.0, 2.0, None, 4.5))
    close(values(s.ops.ts_sum(s("x"), window=4)), col(1.0, 1.0, 4.0, 4.0, 3.0, 9.0))
    close(values(s.ops.ts_std_dev(s("x"), window=1)), col(None, None, None, None, None, None))


def test_product_is_missing_where_a_value_is(spark):
    s = make(spark, {"x": [[2.0, 3.0], [-1.5, 4.0], [6.0, None], [0.5, 2.0], [4.0, 8.0]]})
    close(values(s.ops.ts_product(s("x"), window=2)), [[2.0, 3.0], [-3.0, 12.0], [-9.0, None], [3.0, None], [2.0, 16.0]])


def test_all_of_a_holed_window_is_false(spark):
    s = make(spark, {"b": col(True, True, None, True, True, True)}, types={"b": "boolean"})
    assert values(s.ops.ts_all(s("b"), window=3)) == col(False, False, False, False, False, True)
    assert values(s.ops.ts_any(s("b"), window=2)) == col(True, True, True, True, True, True)


def test_arg_max_takes_the_oldest_of_ties(spark):
    s = make(spark, {"x": col(5.0, 5.0, 1.0, 5.0)})
    close(values(s.ops.ts_arg_max(s("x"), window=3)), col(0.0, 1.0, 2.0, 2.0))
    close(values(s.ops.ts_arg_min(s("x"), window=3)), col(0.0, 1.0, 0.0, 1.0))


def test_corr_of_a_constant_is_missing(spark):
    s = make(spark, {"x": col(1.0, 2.0, 3.0, 4.0), "y": col(2.0, 2.0, 2.0, 2.0), "z": col(2.0, 4.0, 6.0, 8.0)})
    close(values(s.ops.ts_corr(s("x"), s("y"), window=3)), col(None, None, None, None))
    close(values(s.ops.ts_corr(s("x"), s("z"), window=3)), col(None, 1.0, 1.0, 1.0))
    close(values(s.ops.ts_zscore(s("y"), window=3)), col(None, None, None, None))


def test_ts_rank_ties_take_the_low_rank(spark):
    s = make(spark, {"x": col(3.0, 3.0, 5.0, 1.0, None)})
    close(values(s.ops.ts_rank(s("x"), window=4)), col(None, 0.0, 1.0, 0.0, None))


def test_count_nans_counts_masked_cells(spark):
    s = make(spark, {"x": col(1.0, 2.0, None, 4.0)}, universe=col(True, False, True, True))
    close(values(s.ops.ts_count_nans(s("x"), window=2)), col(0.0, None, 2.0, 1.0))


def test_cross_section(spark):
    s = make(spark, {"x": [[1.0, 2.0, 2.0, None], [None, None, None, None], [4.0, None, None, None]]})
    close(values(s.ops.rank(s("x"))), [[1 / 3, 2.5 / 3, 2.5 / 3, None], [None] * 4, [1.0, None, None, None]])
    close(values(s.ops.mean(s("x"))), [[5 / 3] * 4, [None] * 4, [4.0] * 4])
    close(values(s.ops.zscore(s("x")))[2], [None] * 4)
    assert values(s.ops.cross_sum(s("x"))) == [5.0, 0.0, 4.0]
    assert values(s.ops.cross_median(s("x"))) == [2.0, None, 4.0]
    assert values(s.ops.cross_std(s("x")))[1:] == [None, None]


def test_scale_and_its_errors(spark):
    s = make(spark, {"x": [[9.0, -5.0, 0.0, 3.0, -15.0]], "up": [[6.0, None, 10.0, 4.0, None]]})
    close(values(s.ops.scale(s("x"), long=2.0)), [[1.5, -0.25, 0.0, 0.5, -0.75]])
    close(values(s.ops.scale(s("up"), long=1.0, short=0.0)), [[0.3, None, 0.5, 0.2, None]])
    with pytest.raises(Exception, match="no negative value"):
        values(s.ops.scale(s("up")))


def test_label_quantile(spark):
    s = make(spark, {"x": [[7.0, -2.0, 7.0, -2.0, -2.0, -2.0, 7.0, 7.0], [0.25] * 8, [None] * 8, [80.0, 10.0, 70.0, 20.0, 60.0, 30.0, 50.0, 40.0]]})
    got = values(s.ops.label_quantile(s("x"), bins=4, labels=["q1", "q2", "q3", "q4"]))
    # two values: ranks 1 and 5 of 8; all distinct: two in each bin
    assert got == [["q3", "q1", "q3", "q1", "q1", "q1", "q3", "q3"], ["q1"] * 8, [None] * 8, ["q4", "q1", "q4", "q1", "q3", "q2", "q3", "q2"]]
    with pytest.raises(ValueError):
        s.ops.label_quantile(s("x"), bins=3, labels=["a"])


def test_label_quantile_takes_zeros_of_either_sign_as_equal_edges(spark):
    s = make(spark, {"x": [[-1.0, -0.0, 0.0, 0.0, 1.0], [0.0, 0.0, -0.0, 3.0, -2.0], [-0.0, 0.0, -0.0, 0.0, None]]})
    got = values(s.ops.label_quantile(s("x"), bins=3, labels=["low", "mid", "high"]))
    # two edges are 0: ranks 1, 2 and 5 of 5
    assert got == [["low", "mid", "mid", "mid", "high"], ["mid", "mid", "mid", "high", "low"], ["low"] * 4 + [None]]


def test_groups_leave_out_missing_values_and_labels(spark):
    g = [["A", "A", "B", None, "B"]]
    s = make(spark, {"x": [[1.0, 3.0, None, 9.0, 4.0]], "g": g, "n": [[1.0, -3.0, 2.0, 1.0, 4.0]]}, types={"g": "group"})
    assert values(s.ops.group_sum(s("x"), s("g"))) == [[4.0, 4.0, None, None, 4.0]]
    assert values(s.ops.group_count(s("g"))) == [[2.0, 2.0, 2.0, None, 2.0]]
    assert values(s.ops.group_neutralize(s("x"), s("g"))) == [[-1.0, 1.0, None, None, 0.0]]
    assert values(s.ops.group_rank(s("x"), s("g"))) == [[0.5, 1.0, None, None, 1.0]]
    close(values(s.ops.group_scale_positive(s("x"), s("g"))), [[0.25, 0.75, None, None, 1.0]])
    with pytest.raises(Exception, match="negative"):
        values(s.ops.group_scale_positive(s("n"), s("g")))


def test_power_log_divide_sign(spark):
    s = make(spark, {"a": [[1.0, None, 0.0, 7.0, -3.0, 6.25]], "b": [[None, 3.0, 4.0, 0.0, 1.5, 0.5]], "z": [[0.0] * 6]})
    close(values(s.ops.power(s("a"), s("b"))), [[1.0, None, 0.0, 1.0, None, 2.5]])
    close(values(s.ops.log(s("a"))), [[0.0, None, -INF, math.log(7), None, math.log(6.25)]])
    close(values(s.ops.divide(s("a"), s("z"))), [[INF, None, None, INF, -INF, INF]])
    close(values(s.ops.sign(s("a"))), [[1.0, None, 0.0, 1.0, -1.0, 1.0]])


def test_comparison_and_logic_of_missing(spark):
    s = make(spark, {"a": [[1.0, None, 0.0]], "b": [[1.0, None, 2.0]], "g": [["k", None, "m"]], "e": [[True, None, False]]}, types={"g": "group", "e": "event"})
    a, b = s("a"), s("b")
    assert values(a == b) == [[True, False, False]] and values(a != b) == [[False, True, True]]
    assert values(a >= b) == [[True, False, False]]
    assert values(a & s("g")) == [[True, False, False]] and values(a | s("g")) == [[True, False, True]]
    assert values(~s("e")) == [[False, True, True]]
    assert values(s("g") == "m") == [[False, False, True]]
    assert values(s.ops.if_else(s("e"), a, 7.0)) == [[1.0, 7.0, 7.0]]
    assert values(s.ops.is_nan(a)) == [[False, True, False]]
    with pytest.raises(TypeError):
        s.ops.if_else(a, a, b)
    with pytest.raises(TypeError):
        s.ops.ts_any(a, window=3)
    with pytest.raises(TypeError):
        a > s("g")


def test_labels(spark):
    s = make(spark, {"g": [["left", "right", None, "?"]], "h": [["x", None, "y", "z"]]}, types={"g": "group", "h": "group"})
    assert values(s.ops.map_values(s("g"), mapping={"left": 1, "right": -1})) == [[1.0, -1.0, None, None]]
    assert values(s.ops.map_values(s("g"), mapping={"left": "L"})) == [["L", "right", None, "?"]]
    assert values(s.ops.composite_group(s("g"), s("h"))) == [["left&x", None, None, "?&z"]]


def test_masks(spark):
    s = make(spark, {"x": [[1.0, 2.0], [3.0, None]]}, universe=[[True, False], [True, True]])
    x = s("x")
    assert values(x) == [[1.0, None], [3.0, None]]
    assert values(x > 0) == [[True, None], [True, False]]
    assert values(x.where(x > 2, 0.0)) == [[1.0, None], [0.0, None]]
    assert values(s.constant(2.0)) == [[2.0, 2.0], [2.0, 2.0]]
    assert values(x - s.ops.cross_mean(x)) == [[0.0, None], [0.0, None]]
    with pytest.raises(TypeError):
        s.ops.rank(s.ops.cross_mean(x))


def test_forward_fill_modes(spark):
    rows = col(1.0, None, None, 4.0, None)
    s = make(spark, {"v": rows, "r": rows}, fill={"v": True, "r": "row"})
    assert values(s("v")) == col(1.0, 1.0, 1.0, 4.0, 4.0)
    assert values(s("r")) == col(1.0, None, None, 4.0, None)


def test_earlier_reports_are_carried_onto_the_grid(spark):
    spark.createDataFrame([(D[0], "S0", 5.0), (D[3], "S0", None)], "date date, symbol string, value double").createOrReplaceTempView("v_old")
    cells = spark.createDataFrame([(D[i], "S0", True) for i in range(2, 6)], "date date, symbol string, in_universe boolean")
    s = Session(Catalog(spark, {"v": {"db_type": "table", "table": "v_old", "forward_fill": "value"}, "r": {"db_type": "table", "table": "v_old", "forward_fill": "row"}}), cells)
    assert values(s("v")) == col(5.0, 5.0, 5.0, 5.0) and values(s("r")) == col(5.0, None, None, None)


def test_two_rows_of_a_cell_are_an_error(spark):
    spark.createDataFrame([(D[0], "S0", 1.0)] * 2, "date date, symbol string, value double").createOrReplaceTempView("v_twice")
    s = Session(Catalog(spark, {"x": {"db_type": "table", "table": "v_twice"}}), spark.createDataFrame([(D[0], "S0", True)], "date date, symbol string, in_universe boolean"))
    with pytest.raises(Exception, match="two rows"):
        values(s("x"))


def test_windows_and_names(spark):
    s = make(spark, {"x": col(1.0, 2.0)})
    for w in (0, -1, 2.0, True, None):
        with pytest.raises(ValueError):
            s.ops.ts_mean(s("x"), window=w)
    with pytest.raises(AttributeError):
        s.ops.no_such_operator
    with pytest.raises(RuntimeError):
        register_operator("ts_mean", None, ("numeric",))
    assert len(REGISTRY) >= 57 and "ts_mean (timeseries)" in list_operators() and "group_rank" in list_operators_by_category()["group"]
    close(values(s.ops.ts_mean(s("x"), window=50)), col(None, None))


def test_own_operator_and_reader(spark):
    if "twice" not in REGISTRY:
        register_operator("twice", lambda x: x * 2, (frozenset({"numeric"}),))
    register_reader("rows", lambda sp, f: sp.createDataFrame([("2024-01-01", "S0", 4.0)], "date string, symbol string, value double"))
    s = Session(Catalog(spark, {"x": {"db_type": "rows"}}), "x", start="2024-01-01", end="2024-12-31")
    assert values(s.ops.twice(s("x"))) == [[8.0]]


def test_lineage_and_json(spark):
    s = make(spark, {"x": col(1.0, 2.0, 4.0), "g": col("a", "a", "b")}, types={"g": "group"})
    a = s.ops.ts_mean(s("x"), window=2, record_output=True)
    b = s.ops.rank(a) + 1
    assert (a.step, b.step) == (1, 3) and b.list_cached_steps() == [1]
    assert [r.value for r in b.get_cached_step(1).orderBy("date").collect()] == [1.0, 1.5, 3.0]
    assert b.get_cached_step(9) is None
    spec = json.loads(b.to_json())
    assert dependencies(spec) == {"x"} and values(s.evaluate(spec)) == values(b)
    with pytest.raises(ValueError):
        s.evaluate({"op": "nope", "args": [], "params": {}})


def test_scalers_and_backtest(spark):
    ret = [[0.5, 0.25, 0.125], [0.04, -0.07, 0.09], [-0.06, 0.11, 0.08]]
    x = [[1.0, 2.0, 3.0], [3.0, None, 1.0], [2.0, 2.0, 2.0]]
    s = make(spark, {"x": x, "returns": ret}, universe=[[True] * 3, [True, True, False], [True] * 3])
    with pytest.raises(RuntimeError):
        s.to_weights(s("x"))
    with pytest.raises(KeyError):
        s.set_scaler("Nope")
    w = s.set_scaler("DollarNeutral").to_weights(s("x"))
    close(values(w), [[-1.0, 0.0, 1.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    r = s.to_portfolio_returns(w)
    close(values(r), [[None] * 3, [-0.04, 0.0, None], [0.0, 0.0, 0.0]])
    close(values(s.to_long_returns(w))[1], [0.0, 0.0, None])
    close(values(s.to_short_returns(w))[1], [-0.04, 0.0, None])
    close([row.value for row in s.daily_pnl(r).orderBy("date").collect()], [0.0, -0.04, 0.0])
    with pytest.raises(TypeError):
        s.to_portfolio_returns(s("x"))
    close(values(s.set_scaler("LongOnly", target_gross=2.0).to_weights(s("x")))[0], [1 / 3, 2 / 3, 1.0])
    close(values(s.set_scaler("GrossNet", gross=1.0, net=0.5).to_weights(s("x")))[0], [-0.25, 0.0, 0.75])
    close(values(s.set_scaler("GrossNetRenormalised").to_weights(s("x")))[0], [1 / 3, 2 / 3, 1.0])
    close(values(s.set_scaler(lambda c: c * 0 + 1).to_weights(s("x")))[0], [1.0, 1.0, 1.0])


def test_universe_only_shrinks(spark):
    s = make(spark, {"x": [[1.0, 5.0], [3.0, 4.0]]}, universe=[[True, True], [True, False]])
    small = s.with_universe(s("x") > 2)
    assert values(small("x")) == [[None, 5.0], [3.0, None]]
    assert sorted((r.date.day, r.value) for r in s.universe_count().collect()) == [(1, 2), (2, 1)]
    assert s.is_in_universe("2024-01-01", "S1") and not s.is_in_universe("2024-01-02", "S1")
    wider = spark.createDataFrame([(D[1], "S1", True)], "date date, symbol string, in_universe boolean")
    with pytest.raises(ValueError):
        s.restricted_to(wider)
    with pytest.raises(ValueError):
        small.ops.rank(s("x"))


def test_empty_panel(spark):
    s = Session(Catalog(spark, {}), spark.createDataFrame([], "date date, symbol string, in_universe boolean"))
    assert s.ops.rank(s.constant(1.0)).to_df().collect() == []
