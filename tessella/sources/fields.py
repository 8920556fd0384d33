"""Loading a field's cells: one row per date and symbol, NULL for what is missing."""

from __future__ import annotations

from datetime import date as Date
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import READERS, Catalog, Field


def _between(e: Column, start, end) -> list[Column]:
    out = [] if start is None else [e >= F.lit(str(start)).cast("date")]
    return out if end is None else [*out, e <= F.lit(str(end)).cast("date")]


def source_of(f: Field) -> tuple:
    """Fields of one source are read together."""
    return (f.query, "") if f.query else (f.db_type, f.table), f.index_col, f.security_col


def _pruned(rows: DataFrame, start, end, taken: set[str]) -> DataFrame:
    """rows without the folders year=, month=, day= that lie outside of [start, end]: compared part by part, so that a condition names nothing but them."""
    parts: list[str] = []
    for c in ("year", "month", "day"):
        if c not in rows.columns or c in taken:
            break
        parts.append(c)
    for day, side in ((start, 1), (end, -1)):
        if day is None or not parts:
            continue
        want = [int(x) for x in str(day)[:10].split("-")]
        first = F.col(parts[0]).cast("int")
        rows = rows.filter((first >= want[0]) if side > 0 else (first <= want[0]))
        keep = F.lit(True)
        for c, w in reversed(list(zip(parts, want, strict=False))):
            e = F.col(c).cast("int")
            keep = ((e > w) if side > 0 else (e < w)) | ((e == w) & keep)
        rows = rows.filter(keep)
    return rows


def load_rows(catalog: Catalog, names: list[str], start: Date | str | None = None, end: Date | str | None = None, buffer_days: int = 0) -> DataFrame:
    """date, symbol and a column per name, as the one source of these fields has them, within [start - buffer_days, end]; unchecked."""
    spark, every = catalog.spark, [catalog.field(n) for n in names]
    f = every[0]
    if start is not None and buffer_days:
        start = (start if isinstance(start, Date) else Date.fromisoformat(str(start))) - timedelta(days=buffer_days)
    if f.query:
        rows = spark.sql(f.query, args={"start_date": str(start or "0001-01-01"), "end_date": str(end or "9999-12-31")})
    else:
        if f.db_type not in READERS:
            raise KeyError(f"no reader {f.db_type}")
        rows = READERS[f.db_type](spark, f)
        # columns of the layout prune folders; the date filter is pushed into the files
        rows = _pruned(rows, start, end, {f.index_col, f.security_col, *[x.value_col for x in every]})
    raw = dict(rows.dtypes)
    day = F.col(f.index_col) if raw[f.index_col] == "date" else F.col(f.index_col).cast("date")
    if raw[f.index_col] == "string" and not f.query:  # stored as text in ISO form, where text order is date order: pushed down as text
        text = F.col(f.index_col)
        rows = rows.filter((text >= str(start)) if start is not None else F.lit(True)).filter((F.substring(text, 1, 10) <= str(end)) if end is not None else F.lit(True))
    for c in _between(day, start, end):
        rows = rows.filter(c)
    values = [_value(x, raw[x.value_col]).alias(n) for n, x in zip(names, every, strict=True)]
    return rows.select(day.alias("date"), F.col(f.security_col).alias("symbol"), *values).filter("date is not null and symbol is not null")


def _value(f: Field, kind: str) -> Column:
    value = F.col(f.value_col)
    if f.tag in ("numeric", "weight", "port_return"):
        value = value.cast("double")
        return F.when(~F.isnan(value), value)
    if f.tag == "boolean":
        return value.cast("boolean")
    return value.cast("string") if f.tag == "group" and kind != "string" else value


def once(names: list[str], label: str) -> list[Column]:
    """Aggregates that give a cell's values, and an error where the cell has two rows."""
    twice = F.count(F.lit(1)) > 1
    return [F.when(twice, F.raise_error(F.lit(f"field {label}: two rows of one date and symbol"))).otherwise(F.first(n)).alias(n) for n in names]


def load_cells(catalog: Catalog, name: str, start: Date | str | None = None, end: Date | str | None = None, buffer_days: int = 0) -> DataFrame:
    """date, symbol, value within [start - buffer_days, end]. Two rows of a cell are an error when they are read."""
    rows = load_rows(catalog, [name], start, end, buffer_days).withColumnRenamed(name, "value")
    return rows.groupBy("date", "symbol").agg(*once(["value"], name))
