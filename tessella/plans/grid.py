"""The universe grid: every date with every symbol, and a dense date ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dates are collected to number them; a calendar is bounded, and this is its check.
MOST_DATES = 200_000


def calendar(cells: DataFrame) -> list[str]:
    """The dates of cells (column date), in order, as ISO text."""
    dates = [r["d"] for r in cells.select(F.col("date").cast("string").alias("d")).distinct().filter("d is not null").orderBy("d").limit(MOST_DATES + 1).collect()]
    if len(dates) > MOST_DATES:
        raise ValueError(f"over {MOST_DATES} dates")
    return dates


def grid(symbols: DataFrame, dates: list[str]) -> DataFrame:
    """date, symbol, t for every symbol and date. The calendar is one constant array, so this is an explode, not a join."""
    numbered = F.posexplode(F.split(F.lit(",".join(dates)), ",")).alias("t", "date")
    out = symbols.select("symbol", numbered) if dates else symbols.select("symbol", F.lit(0).alias("t"), F.lit(None).cast("string").alias("date")).limit(0)
    return out.select(F.col("date").cast("date").alias("date"), "symbol", (F.col("t") + 1).cast("long").alias("t"))
