"""Factor regressions, group backfill over days, position limits, information coefficients and the share ledger, against plain code."""

import math
import random
import statistics

import numpy as np
import pytest

from tessella.plans import ic
from tessella.plans.ledger import Costs, accounts, positions
from tessella.queries import ev_session

from .test_panel import D, close, make, values
from .test_state import plan

SF = "/root/testdata/sf0.001"


def table(rng, days, symbols, missing=0.1, scale=1.0):
    return [[None if rng.random() < missing else scale * rng.gauss(0, 1) for _ in range(symbols)] for _ in range(days)]


@pytest.mark.parametrize("intercept", [True, False])
def test_factor_regression(spark, intercept):
    rng = random.Random(1)
    n = 30
    y, a, b = table(rng, 5, n), table(rng, 5, n), [[1e6 + (v or 0.0) for v in row] for row in table(rng, 5, n)]
    twice = [[None if v is None else 2 * v for v in row] for row in a]
    a[3] = [None] * n  # nothing complete
    twice[3] = [1.0] * n
    b[4] = [5.0] * n  # constant: dependent with the intercept
    s = make(spark, {"y": y, "a": a, "b": b, "c": twice})
    for names in (("a", "b"), ("a", "c"), ("a",)):
        solved, residual = s.factor_regression(s("y"), [s(f) for f in names], intercept)
        got, left = {r.date: r for r in solved.collect()}, values(residual)
        assert got[D[3]].n == 0 and got[D[3]].betas is None and set(left[3]) == {None}
        for d in (0, 1, 2, 4):
            f = {"a": a, "b": b, "c": twice}
            rows = [k for k in range(n) if y[d][k] is not None and all(f[m][d][k] is not None for m in names)]
            x, t = np.array([[f[m][d][k] for m in names] for k in rows]), np.array([y[d][k] for k in rows])
            design = np.column_stack([x, np.ones(len(rows))]) if intercept else x
            size = np.abs(design).max(0)
            fit = design @ (np.linalg.pinv(design / size, rcond=1e-9) @ t / size)
            assert got[D[d]].n == len(rows) and (got[D[d]].rank == 1 or names == ("a", "b"))
            mine = [left[d][int(k)] for k in _by_symbol(rows, n)]
            want = [v for _, v in sorted((f"S{k}", t[i] - fit[i]) for i, k in enumerate(rows))]
            assert np.allclose(mine, want, atol=1e-5)
            total = ((t - t.mean()) ** 2).sum() if intercept else (t**2).sum()
            assert abs(got[D[d]].r2 - (1 - ((t - fit) ** 2).sum() / total)) < 1e-6
    same = s.evaluate(residual.spec)
    close(values(same), left)
    assert s.factor_regression(s("y"), [s("a"), s("c")])[0].filter("n > 0").select("rank").distinct().collect()[0].rank == 1


def _by_symbol(rows, n):
    """Places of these symbols in the order of their names."""
    names = sorted(f"S{k}" for k in range(n))
    return sorted(names.index(f"S{k}") for k in rows)


def test_regression_plan_sends_a_row_a_date(spark):
    s = ev_session(spark, SF)
    solved, _ = s.factor_regression(s("y"), [s("x")])
    assert plan(solved).count("Exchange hashpartitioning") == plan(s("x").to_df()).count("Exchange hashpartitioning") + 1 and "partial_covar_pop" in plan(solved)


def test_vector_neut(spark):
    s = make(spark, {"x": [[1.0, 2.0, None, 4.0], [1.0, 2.0, 3.0, 4.0]], "y": [[2.0, -1.0, 3.0, None], [0.0, 0.0, 0.0, 0.0]]})
    close(values(s.ops.vector_neut(s("x"), s("y"))), [[1.0, 2.0, None, None], [1.0, 2.0, 3.0, 4.0]])
    s = make(spark, {"x": [[3.0, 1.0]], "y": [[1.0, 1.0]]})
    close(values(s.ops.vector_neut(s("x"), s("y"))), [[1.0, -1.0]])


def test_group_backfill(spark):
    s = make(spark, {"x": [[5.0, 9.0, None], [5.0, 2.0, 2.0], [2.0, None, -4.0], [4.0, 7.0, None]], "g": [["k"] * 3] * 4}, types={"g": "group"})
    got = values(s.ops.group_backfill(s("x"), s("g"), window=4))
    assert abs(got[3][2] - 32 / 9) < 1e-12 and got[3][:2] == [4.0, 7.0] and abs(got[0][2] - 7.0) < 1e-12
    rng = random.Random(3)
    x, g = table(rng, 8, 12, 0.4), [[rng.choice(["a", "b", None]) for _ in range(12)] for _ in range(8)]
    x[6] = [None] * 12
    s = make(spark, {"x": x, "g": g}, types={"g": "group"})
    got = values(s.ops.group_backfill(s("x"), s("g"), window=3, std=1.0))
    order = sorted(range(12), key=lambda k: f"S{k}")
    for d in range(8):
        for at, k in enumerate(order):
            if x[d][k] is not None or g[d][k] is None:
                assert got[d][at] == (x[d][k] if g[d][k] is not None else None)
                continue
            days = [e for e in range(d + 1) if g[d][k] in g[e]][-3:]  # the days on which the label is there
            seen = [x[e][j] for e in days for j in range(12) if g[e][j] == g[d][k] and x[e][j] is not None]
            if not seen:
                assert got[d][at] is None
                continue
            m, sd = statistics.fmean(seen), statistics.stdev(seen) if len(seen) > 1 else 0.0
            assert abs(got[d][at] - statistics.fmean(min(max(v, m - sd), m + sd) for v in seen)) < 1e-9


def test_position_limits(spark):
    w = [[0.5, 0.3, 0.1, 0.1, -0.4, -0.6], [0.25, 0.25, 0.25, 0.25, None, -1.0], [0.9, 0.0, None, 0.1, -0.5, -0.5], [None] * 6]
    s = make(spark, {"w": w})
    got = values(s.cap_positions(s("w"), 0.3))
    close(got[0], [0.3, 0.3, 0.2, 0.2, -0.3, -0.3])
    close(got[1], [0.25, 0.25, 0.25, 0.25, None, -0.3])
    close(got[2], [0.3, 0.0, None, 0.3, -0.3, -0.3])  # what fits under the caps
    assert got[3] == [None] * 6
    close(values(s.cap_positions(s("w"), 0.3, "hard"))[0], [0.3, 0.3, 0.1, 0.1, -0.3, -0.3])
    with pytest.raises(ValueError):
        s.cap_positions(s("w"), 0.3, "soft")
    rng = random.Random(4)
    s = make(spark, {"w": [[rng.choice([-1, 1]) * rng.choice([0.01, 0.02, 0.05, 0.2]) for _ in range(40)] for _ in range(6)]})
    before, after = values(s("w")), values(s.cap_positions(s("w"), 0.06))
    for x, y in zip(before, after, strict=True):
        for side in (1, -1):
            a, b = [v * side for v in x if v * side > 0], [v * side for v in y if v * side > 0]
            assert max(b) <= 0.06 + 1e-9 and abs(sum(b) - min(sum(a), 0.06 * len(a))) < 1e-9
            free = [(u, v) for u, v in zip(a, b, strict=True) if v < 0.06 - 1e-9]
            assert not free or max(v / u for u, v in free) - min(v / u for u, v in free) < 1e-9  # in proportion
    lim = s.limit_leverage(s("w"), gross=1.0, net=0.2)
    assert lim.tag == "weight"
    for row in values(lim):
        assert sum(map(abs, row)) <= 1.0 + 1e-9 and abs(sum(row)) <= 0.2 + 1e-9


def ranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def test_information_coefficients(spark):
    rng = random.Random(5)
    x = [[None if v is None else round(v, 1) for v in row] for row in table(rng, 9, 15)]
    p = [[None if rng.random() < 0.1 else round(100 + rng.gauss(0, 5), 1) for _ in range(15)] for _ in range(9)]
    s = make(spark, {"x": x, "p": p})
    df = s.rank_ic(s("x"), s("p"), [1, 2, 5])
    got = {(r.date, r.horizon): (r.ic, r.n) for r in df.collect()}
    for h in (1, 2, 5):
        for d in range(9):
            both = [(x[d][k], p[d + h][k] / p[d][k] - 1) for k in range(15) if d + h < 9 and None not in (x[d][k], p[d][k], p[d + h][k])]
            if len(both) < 2:
                assert (D[d], h) not in got or len(both) == 1
                continue
            a, b = (ranks(v) for v in zip(*both, strict=True))
            assert got[D[d], h][1] == len(both) and abs(got[D[d], h][0] - np.corrcoef(a, b)[0, 1]) < 1e-9
    d = {r.horizon: r for r in ic.decay(df).collect()}
    one = [v for (_, h), (v, _) in got.items() if h == 1]
    assert abs(d[1].mean - statistics.fmean(one)) < 1e-12 and abs(d[1].ir - statistics.fmean(one) / statistics.stdev(one)) < 1e-9 and d[1].n == len(one)
    series = [got[D[k], 1][0] for k in range(8)]
    assert np.allclose([r.value for r in ic.rolling_ic(df, 3).filter("horizon = 1").orderBy("date").collect()], [statistics.fmean(series[max(0, k - 2) : k + 1]) for k in range(8)])
    e = ev_session(spark, SF)
    base = plan(e("x").to_df()).count("Exchange hashpartitioning")
    assert plan(e.rank_ic(e("x"), e("y"), [1, 2, 3, 5, 8])).count("Exchange hashpartitioning") == base + 1  # all horizons, ranks and the correlation
    with pytest.raises(ValueError):
        s.rank_ic(s("x"), s("p"), [0])


def plain_ledger(ws, ps, vs, cash, c, rnd):
    shares, last, out = {}, {}, []
    for w, p, v in zip(ws, ps, vs, strict=True):
        last |= {k: x for k, x in enumerate(p) if x}
        equity = cash + sum(n * last[k] for k, n in shares.items())
        paid = fees = traded = 0.0
        for k in range(len(p)):
            if not p[k] or not v[k]:
                continue
            trade = rnd((w[k] or 0.0) * equity / p[k]) - shares.get(k, 0)
            if trade:
                cost = trade * p[k] * (1 + math.copysign(c.slippage_bps / 1e4 + c.impact * math.sqrt(abs(trade) / v[k]), trade))
                paid, fees, traded = paid + cost, fees + max(c.min_fee, c.commission * abs(cost)), traded + abs(trade)
                shares[k] = shares.get(k, 0) + trade
        cash -= paid + fees
        out.append((traded, paid, fees, cash, cash + sum(n * last[k] for k, n in shares.items()), {k: n for k, n in shares.items() if n}))
    return out


def test_ledger(spark):
    rng = random.Random(6)
    p = [[None if rng.random() < 0.15 else 50 + 10 * rng.random() for _ in range(7)] for _ in range(10)]
    v = [[None if rng.random() < 0.1 else 1e5 * rng.random() for _ in range(7)] for _ in range(10)]
    w = {k: [[None if rng.random() < 0.1 else rng.uniform(-0.3, 0.4) for _ in range(7)] for _ in range(10)] for k in ("one", "two")}
    s = make(spark, {"p": p, "v": v} | w)
    costs = Costs(commission=0.002, min_fee=15.0, slippage_bps=7, impact=0.2)
    panels = {k: s.set_scaler(lambda c: c).to_weights(s(k)) for k in w}
    for rounding, rnd in (("round", lambda x: math.copysign(math.floor(abs(x) + 0.5), x)), ("floor", math.floor), ("ceil", math.ceil)):
        rows = s.ledger(panels, s("p"), s("v"), cash=100_000.0, costs=costs, rounding=rounding).cache()
        for k in w:
            want = plain_ledger(w[k], p, v, 100_000.0, costs, rnd)
            got = accounts(rows).filter(f"strategy = '{k}'").orderBy("date").collect()
            assert len(got) == 10
            for r, x in zip(got, want, strict=True):
                assert np.allclose([r.traded, r.paid, r.commission, r.cash, r.equity], x[:5], rtol=1e-9, atol=1e-6)
            held = {}
            for r in positions(rows).filter(f"strategy = '{k}' and shares <> 0").collect():
                held.setdefault(r.date, {})[int(r.symbol[1:])] = r.shares
            assert [held.get(D[d], {}) for d in range(10)] == [x[5] for x in want]
        rows.unpersist()
    with pytest.raises(TypeError):
        s.ledger(s("p"), s("p"))
    with pytest.raises(ValueError, match="volume"):
        s.ledger(panels, s("p"), costs=costs)
    with pytest.raises(ValueError, match="rounding"):
        s.ledger(panels, s("p"), rounding="up")


def test_no_frame_of_position_limits_is_added_up_anew_for_every_row(spark):
    s = ev_session(spark, "/root/testdata/sf0.001")
    panel = s.cap_positions(s.set_scaler("DollarNeutral").to_weights(s("x")), limit=0.02)
    plan = panel.to_df()._jdf.queryExecution().analyzed().toString().lower()
    assert "rowframe, unboundedpreceding$(), currentrow$()" in plan and "currentrow$(), unboundedfollowing$()" not in plan
