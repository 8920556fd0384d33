"""Time axis: windows of rows of one symbol on the dense grid. `ratio` of a window must be observed, else the result is missing."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def time():
    return Window.partitionBy("symbol").orderBy("t")


def rows(window: int):
    return time().rowsBetween(1 - window, 0)


def least(window: int, ratio: float) -> int:
    return max(1, int(window * ratio))


def finite(x: Column) -> Column:
    """A window looks at finite values alone: an infinite one counts as missing."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def observed(e: Column, x: Column, window: int, ratio: float) -> Column:
    return F.when(F.count(x).over(rows(window)) >= least(window, ratio), e)


def ts_mean(x: Column, window: int, ratio: float = 0.5) -> Column:
    x = finite(x)
    return observed(F.avg(x).over(rows(window)), x, window, ratio)


def ts_std_dev(x: Column, window: int, ratio: float = 0.7) -> Column:
    x = finite(x)
    return observed(F.stddev_samp(x).over(rows(window)), x, window, ratio)


def ts_max(x: Column, window: int, ratio: float = 0.3) -> Column:
    x = finite(x)
    return observed(F.max(x).over(rows(window)), x, window, ratio)


def ts_min(x: Column, window: int, ratio: float = 0.3) -> Column:
    x = finite(x)
    return observed(F.min(x).over(rows(window)), x, window, ratio)


def ts_sum(x: Column, window: int, ratio: float = 0.3) -> Column:
    x = finite(x)
    return observed(F.sum(x).over(rows(window)), x, window, ratio)


def ts_delay(x: Column, window: int) -> Column:
    return F.lag(x, window).over(time())


def ts_delta(x: Column, window: int) -> Column:
    return x - ts_delay(x, window)


def ts_count_nans(x: Column, window: int, ratio: float = 0.5) -> Column:
    """Missing rows in the window, cells outside the universe included; the ratio is of rows, not of observations."""
    w = rows(window)
    return F.when(F.count(F.lit(1)).over(w) >= least(window, ratio), F.sum(x.isNull().cast("double")).over(w))


def ts_any(b: Column, window: int) -> Column:
    return observed(F.max(b).over(rows(window)), b, window, 0.0)


def ts_all(b: Column, window: int, ratio: float = 0.5) -> Column:
    """True only if the whole window is there and true: a short or holed window is False, not missing."""
    return observed(F.sum(b.cast("int")).over(rows(window)) == window, b, window, ratio)


def ts_product(x: Column, window: int, ratio: float = 0.6) -> Column:
    """Unlike sums, a product is missing if any value in its window is."""
    x = finite(x)
    w = rows(window)
    n = F.count(x).over(w)
    return F.when((n >= least(window, ratio)) & (n == F.count(F.lit(1)).over(w)), F.product(x).over(w))


def ts_arg_max(x: Column, window: int, ratio: float = 0.5) -> Column:
    """Rows since the maximum, 0 for today; of equal ones the oldest."""
    x = finite(x)
    at = F.max(F.when(x.isNotNull(), F.struct(x.alias("v"), (-F.col("t")).alias("at")))).over(rows(window))["at"]
    return observed((F.col("t") + at).cast("double"), x, window, ratio)


def ts_arg_min(x: Column, window: int, ratio: float = 0.5) -> Column:
    x = finite(x)
    at = F.min(F.when(x.isNotNull(), F.struct(x.alias("v"), F.col("t").alias("at")))).over(rows(window))["at"]
    return observed((F.col("t") - at).cast("double"), x, window, ratio)


def _paired(x: Column, y: Column) -> tuple[Column, Column]:
    x, y = finite(x), finite(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def ts_corr(x: Column, y: Column, window: int, ratio: float = 0.7) -> Column:
    """Pearson over complete pairs; missing where either side is constant."""
    a, b = _paired(x, y)
    w = rows(window)
    spread = F.sqrt(F.var_samp(a).over(w) * F.var_samp(b).over(w))
    return observed(F.covar_samp(a, b).over(w) / F.nullif(spread, F.lit(0.0)), a, window, ratio)


def ts_covariance(x: Column, y: Column, window: int, ratio: float = 0.7) -> Column:
    a, b = _paired(x, y)
    return observed(F.covar_samp(a, b).over(rows(window)), a, window, ratio)


def ts_zscore(x: Column, window: int, ratio: float = 0.5) -> Column:
    w, seen = rows(window), finite(x)
    return observed((x - F.avg(seen).over(w)) / F.nullif(F.stddev_samp(seen).over(w), F.lit(0.0)), seen, window, ratio)


def ts_rank(x: Column, window: int, ratio: float = 0.5) -> Column:
    """Share of the window's other values below today's; 0.5 if there is no other."""
    x = finite(x)
    a = F.collect_list(x).over(rows(window))
    below = F.size(F.filter(a, lambda z: z < x))
    return observed(F.when(x.isNotNull(), F.when(F.size(a) <= 1, F.lit(0.5)).otherwise(below / F.nullif(F.size(a) - 1, F.lit(0)))), x, window, ratio)


def _upto(order: str):
    return Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(x: Column, order: str = "t") -> Column:
    """The last value that is there."""
    return F.last(x, ignorenulls=True).over(_upto(order))


def forward_fill_rows(x: Column, reported: Column, order: str = "t") -> Column:
    """The value of the last reported row, missing if that row's is."""
    return F.last(F.when(reported, F.struct(x.alias("v"))), ignorenulls=True).over(_upto(order))["v"]


# ---- state and look-back by value ----


def trade_when(enter: Column, signal: Column, leave: Column) -> Column:
    """Missing from a cell where leave is positive (or true), the signal's value from one where enter is, else what was there before. The last such cell decides."""
    on = lambda c: c.cast("double") > 0
    event = F.when(on(leave), F.struct(F.lit(None).cast("double").alias("v"))).when(on(enter), F.struct(signal.alias("v")))
    return F.last(event, ignorenulls=True).over(_upto("t"))["v"]


def jump_decay(x: Column, window: int, sensitivity: float = 0.5, force: float = 0.1) -> Column:
    """x; where it is further from the value before than sensitivity deviations of the window, that value and the share force of the change."""
    before = ts_delay(x, 1)
    return F.when(F.abs(x - before) > sensitivity * ts_std_dev(x, window), before + (x - before) * force).otherwise(x)


def _countable(x: Column, ignore: str) -> Column:
    """x, missing where it is one of the ignored values: NAN and numbers, in one text."""
    for w in ignore.split():
        if w.upper() != "NAN":
            x = F.when(x != float(w), x)
    return x


def kth_element(x: Column, window: int, k: int = 1, ignore: str = "NAN") -> Column:
    """The kth latest value of the window that is not ignored. Bounded frames of lists hold at most `window` values."""
    if k < 1:
        raise ValueError("k is 1 or more")
    seen = F.collect_list(_countable(x, ignore)).over(rows(window))
    return F.get(F.reverse(seen), F.lit(k - 1))


def ts_backfill(x: Column, window: int, k: int = 1, ignore: str = "NAN") -> Column:
    """x, and where it is missing (or ignored) the kth latest value of the `window` cells before."""
    x = _countable(x, ignore)
    seen = F.collect_list(x).over(time().rowsBetween(-window, -1))
    return F.coalesce(x, F.get(F.reverse(seen), F.lit(k - 1)))


def last_diff_value(x: Column, window: int) -> Column:
    """The latest value of the window that differs from today's; missing values are passed over."""
    seen = F.collect_list(x).over(rows(window))
    return F.get(F.reverse(F.filter(seen, lambda z: z != x)), F.lit(0))


def days_from_last_change(x: Column) -> Column:
    """Cells since the value last changed (0 on the day of a change), since the first one where it never did; missing values are no change."""
    before = F.last(x, ignorenulls=True).over(time().rowsBetween(Window.unboundedPreceding, -1))
    changed = F.when(x.isNotNull() & (before.isNull() | (x != before)), F.col("t"))
    return F.when(x.isNotNull(), (F.col("t") - F.last(changed, ignorenulls=True).over(_upto("t"))).cast("double"))


#: Results of a regression by number: error, intercept, slope, estimate, sums of squares of error and in total, R squared, mean square of error, errors of slope and intercept.
REGRESSION = ("error", "alpha", "beta", "estimate", "sse", "sst", "r2", "mse", "beta_error", "alpha_error")


def ts_regression(y: Column, x: Column, window: int, lag: int = 0, rettype: int = 0, ratio: float = 0.7) -> Column:
    """Least squares of y on x (lag cells before) over the window's complete pairs. Moments are sample ones, centred at the window's mean, so large offsets keep their
    digits. Missing where x is constant; errors need three pairs."""
    if not 0 <= rettype < len(REGRESSION):
        raise ValueError(f"rettype is 0 to {len(REGRESSION) - 1}")
    x = ts_delay(x, lag) if lag else x
    a, b = _paired(x, y)
    w = rows(window)
    n, mean_x, mean_y = F.count(a).over(w), F.avg(a).over(w), F.avg(b).over(w)
    var_x, var_y, both = F.var_samp(a).over(w), F.var_samp(b).over(w), F.covar_samp(a, b).over(w)
    beta = both / F.nullif(var_x, F.lit(0.0))
    estimate = mean_y + beta * (x - mean_x)
    sst = var_y * (n - 1)
    sse = F.greatest(F.lit(0.0), sst - beta * both * (n - 1))
    mse = F.when(n > 2, sse / (n - 2))
    out = {
        "error": y - estimate, "alpha": mean_y - beta * mean_x, "beta": beta, "estimate": estimate, "sse": sse, "sst": sst, "r2": 1 - sse / F.nullif(sst, F.lit(0.0)), "mse": mse,
        "beta_error": F.sqrt(mse / F.nullif(var_x * (n - 1), F.lit(0.0))), "alpha_error": F.sqrt(mse * (1 / n + mean_x * mean_x / F.nullif(var_x * (n - 1), F.lit(0.0)))),
    }[REGRESSION[rettype]]
    return observed(out, a, window, ratio)
