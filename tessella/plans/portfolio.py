"""Weight scalers as column functions, daily series and performance figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.across import day

YEAR = 252


def _legs(x: Column, gross: float, net: float) -> Column:
    """Positives scaled to half of gross + net, negatives to half of gross - net, by date; a missing cell is 0."""
    up, down = F.when(x > 0, x).otherwise(0.0), F.when(x < 0, x).otherwise(0.0)
    share = lambda side, total: F.coalesce(side / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    return share(up, F.sum(up).over(day())) * ((gross + net) / 2) + share(down, -F.sum(down).over(day())) * ((gross - net) / 2)


def gross_net(x: Column, gross: float = 1.0, net: float = 0.0) -> Column:
    """Demeaned by date, then each side scaled to its target; missing cells weigh 0."""
    return _legs(x - F.avg(x).over(day()), gross, net)


def dollar_neutral(x: Column) -> Column:
    return gross_net(x, 2.0, 0.0)


def long_only(x: Column, target_gross: float = 1.0) -> Column:
    """Negatives weigh 0, the rest is scaled to the target; missing cells weigh 0."""
    up = F.when(x > 0, x).otherwise(F.when(x.isNotNull(), 0.0))
    return F.coalesce(up / F.nullif(F.sum(up).over(day()), F.lit(0.0)) * target_gross, F.lit(0.0))


def gross_net_renormalised(x: Column, target_gross: float = 2.0, target_net: float = 0.0) -> Column:
    """No demeaning; each side is scaled, then the date to the gross target, so one-sided dates reach it too. Missing stays missing."""
    w = F.when(x.isNotNull(), _legs(x, target_gross, target_net))
    return w / F.nullif(F.sum(F.abs(w)).over(day()), F.lit(0.0)) * target_gross


def long_only_strict(x: Column, target_long: float = 1.0) -> Column:
    """Positives scaled to the target; missing stays missing, and so does a date without a positive."""
    up = F.when(x > 0, x).otherwise(F.when(x.isNotNull(), 0.0))
    return up / F.nullif(F.sum(up).over(day()), F.lit(0.0)) * target_long


SCALERS = {
    "GrossNet": gross_net,
    "DollarNeutral": dollar_neutral,
    "LongOnly": long_only,
    "GrossNetRenormalised": gross_net_renormalised,
    "LongOnlyStrict": long_only_strict,
}


@dataclass(frozen=True)
class Scaler:
    """A function of a column with its parameters, and its name if it is one of SCALERS: only then can a spec say it."""

    name: str | None
    function: Callable[..., Column]
    params: dict

    def __call__(self, x: Column) -> Column:
        return self.function(x, **self.params)


def list_scalers() -> list[str]:
    return sorted(SCALERS)


def daily_pnl(returns: DataFrame) -> DataFrame:
    """date, value: the sum by date, 0 where nothing is there."""
    return returns.groupBy("date").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def cumulative_pnl(daily: DataFrame) -> DataFrame:
    """date, value: running sums. A daily series has a row a date, so one task orders it."""
    return daily.select("date", F.sum("value").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def metrics(daily: DataFrame) -> DataFrame:
    """One row: total_return, sharpe, max_drawdown, win_rate of a daily series date, value."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = daily.filter("value is not null").withColumn("wealth", F.product(1 + F.col("value")).over(upto))
    r = r.withColumn("peak", F.max("wealth").over(upto))
    sd = F.stddev_samp("value")
    return r.agg(
        (F.product(1 + F.col("value")) - 1).alias("total_return"),
        F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise(F.avg("value") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"),
        F.min(F.col("wealth") / F.col("peak") - 1).alias("max_drawdown"),
        F.avg((F.col("value") > 0).cast("double")).alias("win_rate"),
    )


def additive_drawdown(daily: DataFrame) -> DataFrame:
    """date, value: running sum less its running maximum."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = cumulative_pnl(daily)
    return c.select("date", (F.col("value") - F.max("value").over(upto)).alias("value"))
