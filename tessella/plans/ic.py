"""Information coefficients: rank correlations of a signal with the returns over several horizons after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling


def _rank(x: str, keys: list[str]) -> Column:
    order = Window.partitionBy(*keys).orderBy(x)
    return F.rank().over(order) + (F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / F.lit(2.0)


def rank_ic(frame: DataFrame, signal: Column, price: Column, horizons: list[int]) -> DataFrame:
    """date, horizon, ic, n: the rank correlation of the signal with the change of the price over the next `horizon` cells, over symbols that have both.
    All horizons are leads of one order by symbol; then one exchange by date and horizon serves both ranks and the correlation. Missing where one side is constant."""
    if not horizons or min(horizons) < 1:
        raise ValueError("horizons are 1 or more")
    later = [F.struct(F.lit(h).alias("horizon"), (F.lead(price, h).over(rolling.time()) / F.nullif(price, F.lit(0.0)) - 1).alias("change")) for h in horizons]
    cells = frame.select("date", "symbol", F.when(F.col("in_universe"), signal).alias("signal"), F.array(*later).alias("later")).filter("signal is not null")
    each = cells.select("date", "signal", F.inline("later")).filter("change is not null and not isnan(change)")  # a row a horizon, of two numbers
    keys = ["date", "horizon"]
    ranked = each.select(*keys, _rank("signal", keys).alias("a"), _rank("change", keys).alias("b"))
    spread = F.sqrt(F.var_samp("a") * F.var_samp("b"))
    return ranked.groupBy(*keys).agg((F.covar_samp("a", "b") / F.nullif(spread, F.lit(0.0))).alias("ic"), F.count(F.lit(1)).alias("n"))


def decay(ics: DataFrame) -> DataFrame:
    """horizon, mean, std, ir (mean over std), positive (share of dates), n: the dates' coefficients by horizon."""
    sd = F.stddev_samp("ic")
    return ics.filter("ic is not null").groupBy("horizon").agg(F.avg("ic").alias("mean"), sd.alias("std"), (F.avg("ic") / F.nullif(sd, F.lit(0.0))).alias("ir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count(F.lit(1)).alias("n"))


def rolling_ic(ics: DataFrame, window: int) -> DataFrame:
    """date, horizon, value: the mean coefficient of the last dates. A row a date and horizon, so a horizon is one task's."""
    w = Window.partitionBy("horizon").orderBy("date").rowsBetween(1 - window, 0)
    return ics.select("date", "horizon", F.avg("ic").over(w).alias("value"))
