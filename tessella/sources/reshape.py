"""Vendor tables to panels: wide sheets to long rows, items to columns, typed columns, returns, events, and partitioned Parquet."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells

#: Forms of a date in a column's name: what it looks like, and how it is read.
_DATES = (
    (re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?"), (1, 3, 4)),
    (re.compile(r"(\d{4})(\d{2})(\d{2})"), (1, 2, 3)),
)


def named_date(name: str) -> dt.date | None:
    """The date that a column's name is: year, month and day with -, / or . between them (a time may follow) or as 8 digits; None of any other, and of a day that there is not."""
    for form, parts in _DATES:
        if m := form.fullmatch(name.strip()):
            try:
                return dt.date(*[int(m[p]) for p in parts])
            except ValueError:
                return None
    return None


def identify_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(columns that are dates by name, the others)."""
    dates = [c for c in df.columns if named_date(c)]
    return dates, [c for c in df.columns if c not in dates]


def parse_date(text: Column) -> Column:
    """A date of 8 digits, or of the first 10 characters in ISO form (or with slashes); anything else is missing."""
    head = F.replace(F.left(text, F.lit(10)), F.lit("/"), F.lit("-"))
    return F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd")).otherwise(F.try_to_date(head, "yyyy-MM-dd"))


def melt_to_long(df: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """A row per id and date column: the ids, date, value. Two columns of one date are an error."""
    dates, rest = identify_columns(df)
    ids = ids or rest
    days = [named_date(c).isoformat() for c in dates]
    if not days:
        raise ValueError("no column is a date by its name")
    if len(set(days)) < len(days):
        raise ValueError("two columns have one date")
    typed = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("string").alias(d) for c, d in zip(dates, days, strict=True)])
    return typed.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{d}`") for d in days], "date", "value").withColumn("date", F.col("date").cast("date"))


def pivot_items(df: DataFrame, keys: list[str], item: str = "Item", value: str = "value", items: list[str] | None = None) -> DataFrame:
    """Items to columns, the first value that is there; name the items to save a scan for them."""
    return df.groupBy(*keys).pivot(item, items).agg(F.first(value, ignorenulls=True))


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def typed_columns(df: DataFrame, integers=(), doubles=(), millions=(), thousands=(), flags: dict[str, str] | None = None, required=()) -> DataFrame:
    """Numbers from text (what is none is missing); integers and millions are exact and rounded, thousands are doubles; a flag is true where the text is not the normal one, or missing; rows without the required columns go."""
    out = {}
    exact = lambda c: F.col(c).try_cast("decimal(30,8)")
    for c in integers:
        out[c] = F.round(exact(c)).try_cast("bigint")
    for c in doubles:
        out[c] = F.col(c).try_cast("double")
    for c in millions:
        out[c] = F.round(exact(c) * F.lit(1_000_000)).try_cast("bigint")
    for c in thousands:
        out[c] = F.col(c).try_cast("double") * 1e3
    for c, normal in (flags or {}).items():
        out[c] = F.coalesce(F.col(c) != normal, F.lit(True))
    out = {c: e for c, e in out.items() if c in df.columns}
    df = df.withColumns(out) if out else df
    return df.dropna(subset=[c for c in required if c in df.columns]) if required else df


def partition_columns(df: DataFrame, date: str = "date", day: bool = False) -> DataFrame:
    """year, month (and day) of the date, and the date as ISO text."""
    d = F.col(date).cast("date")
    out = df.withColumn("year", F.year(d)).withColumn("month", F.month(d))
    out = out.withColumn("day", F.day(d)) if day else out
    return out.withColumn(date, F.date_format(d, "yyyy-MM-dd"))


def write_partitioned(df: DataFrame, path: str, date: str = "date", day: bool = False, mode: str = "overwrite") -> None:
    """Hive-partitioned Parquet; a folder is written by few tasks, and a large one by several."""
    out = partition_columns(df, date, day)
    keys = ["year", "month", "day"] if day else ["year", "month"]
    out.repartition(*keys, F.pmod(F.xxhash64(*[c for c in out.columns if c not in keys][:2]), F.lit(4))).write.mode(mode).partitionBy(*keys).parquet(path)


def calculate_returns(prices: DataFrame, price: str = "adj_close", after_zero: str = "infinite") -> DataFrame:
    """date, symbol, return: change on the symbol's row before, over rows with a price; first rows go. After a price of 0 it is infinite, or missing and goes."""
    if after_zero not in ("infinite", "missing"):
        raise ValueError(f"a return after 0 is infinite or missing, not {after_zero}")
    w = Window.partitionBy("symbol").orderBy("date")
    p = F.col(price).cast("double")
    before = F.lag(p).over(w)
    change = cells.divide(p, before) if after_zero == "infinite" else p / F.nullif(before, F.lit(0.0))
    rows = prices.filter(p.isNotNull()).withColumn("return", change - 1)
    return rows.filter(F.col("return").isNotNull()).select("date", "symbol", "return")


def event_flags(events: DataFrame, date: str = "event_date", start: str | None = None, end: str | None = None) -> DataFrame:
    """date, symbol, value = true, once per date and symbol; dates in either text form, compared as dates."""
    out = events.select(parse_date(F.col(date)).alias("date"), "symbol").filter("date is not null")
    out = out.filter(F.col("date") >= F.lit(start).cast("date")) if start else out
    out = out.filter(F.col("date") <= F.lit(end).cast("date")) if end else out
    return out.groupBy("date", "symbol").agg(F.max(F.lit(True)).alias("value"))


def parse_events(spark: SparkSession, lines: DataFrame, schema: str, names: dict[str, str], date: str) -> DataFrame:
    """JSON records (column value) to renamed columns with year and month."""
    parsed = rename_columns(lines.select(F.from_json("value", schema).alias("r")).select("r.*"), names)
    d = parse_date(F.col(date))
    return parsed.withColumn("year", F.year(d)).withColumn("month", F.month(d))


def describe(df: DataFrame, date: str, symbol: str, value: str) -> DataFrame:
    """One row: rows, distinct symbols, first and last date, mean and spread of the value."""
    v = F.col(value)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(symbol).alias("n_symbols"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")
    )


def value_counts(df: DataFrame, column: str, contains: str | None = None) -> DataFrame:
    """value, n, share: how often each value occurs, missing included; only those that contain a text, if one is given."""
    rows = df.select(F.col(column).alias("value"))
    rows = rows.filter(F.col("value").cast("string").contains(contains)) if contains is not None else rows
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.select("value", "n", (F.col("n") / total).alias("share"))


def distinct_values(df: DataFrame, *columns: str, limit: int = 20) -> DataFrame:
    """The first distinct combinations in order: a report, so limited."""
    return df.select(*columns).distinct().orderBy(*columns).limit(limit)


def profile(df: DataFrame) -> DataFrame:
    """A row per column: name, type, rows, missing, distinct values (exact). Each column is counted by itself: its values are grouped, then the groups counted, so no row is multiplied."""
    out = None
    for c, t in df.dtypes:
        each = df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        row = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("n_distinct"))
        row = row.select(F.lit(c).alias("name"), F.lit(t).alias("type"), "n", "missing", "n_distinct")
        out = row if out is None else out.unionByName(row)
    return out
