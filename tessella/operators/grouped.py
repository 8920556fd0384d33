"""Grouped operators: functions of Arrow batches over all cells of a symbol in order of time, of a date in order of symbols, or of a label (the last
input) in order of time and symbols.

They are for what columns cannot say, such as an output that depends on the output of the day before. A group streams: its function gets an
iterator of batches (date, symbol, t, then the inputs x0, x1, ...; missing is null) and yields for each of them, in turn, an array of as many
values. Groups come by the exchange that the frame has already where it is dealt by the same key; their rows are ordered by the sort that a
window over the same key would use.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ORDER = {"symbol": ("t",), "date": ("symbol",), "label": ("t", "symbol")}
KINDS = {"numeric": "double", "boolean": "boolean", "group": "string", "object": "string"}


def grouped_column(df: DataFrame, name: str, function: Callable[..., Iterator[pa.Array]], by: str, inputs: list[Column], params: dict, kind: str) -> DataFrame:
    """df with the column name: what function yields for the groups of df."""
    given = [f"_in{i}" for i in range(len(inputs))]
    key = given[-1] if by == "label" else by
    df = df.select("*", *[c.alias(n) for n, c in zip(given, inputs, strict=True)])
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*ORDER[by])))  # the window deals and sorts, if the frame is not dealt so
    kept = [c for c in df.columns if c not in ("_place", *given)]
    out = StructType([df.schema[c] for c in kept]).add(StructField(name, _type(kind)))
    said = pa.schema([pa.field(name, _ARROW[kind])]).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def feed():
            for b in batches:
                waiting.append(b)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("date", "symbol", "t", *given)], names=["date", "symbol", "t", *[f"x{i}" for i in range(len(given))]])

        for values in function(feed(), **params):
            b = waiting.popleft()
            if len(values) != b.num_rows:
                raise ValueError(f"{name}: {len(values)} values for {b.num_rows} cells")
            values = values if isinstance(values, pa.Array) else pa.array(values, said)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], values.cast(said)], names=[*kept, name])
        if waiting:
            raise ValueError(f"{name}: a batch got no values")

    return df.groupBy(key).applyInArrow(run, out)


_ARROW = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _type(kind: str):
    return StructType.fromDDL(f"v {kind}")[0].dataType


def fold(step: Callable, start=None) -> Callable[..., Iterator[pa.Array]]:
    """A function by symbol of step(state, *values, **params) -> (state, value): a cell at a time in order of time, None where one is missing."""

    def run(batches, **params):
        state = start
        for b in batches:
            out = []
            for values in zip(*[c.to_pylist() for c in b.columns[3:]], strict=True):
                state, value = step(state, *values, **params)
                out.append(value)
            yield pa.array(out, pa.float64())

    return run


def humped(before: float | None, x: float | None, hump: float = 0.01) -> tuple[float | None, float | None]:
    """hump: a change up to the threshold is none, a larger one is cut to it; where x is missing the output is, and the last one counts on."""
    if x is None or not math.isfinite(x):
        return before, None
    if before is None:
        return x, x
    change = x - before
    y = before if abs(change) <= hump else before + math.copysign(hump, change)
    return y, y


def delta_limited(before: float | None, x: float | None, y: float | None, weight: float = 1.0) -> tuple[float | None, float | None]:
    """x, but for a change of at most weight * |y| from the last output; where x or y is missing the output is."""
    if x is None or y is None or not math.isfinite(x) or not math.isfinite(y):
        return before, None
    if before is None:
        return x, x
    most = weight * abs(y)
    z = before + min(max(x - before, -most), most)
    return z, z


def decayed(before: float | None, x: float | None, weight: float = 0.5) -> tuple[float | None, float | None]:
    """weight of the last output and the rest of x; where x is missing the output is, and the last one counts on."""
    if x is None or not math.isfinite(x):
        return before, None
    y = x if before is None else weight * before + (1 - weight) * x
    return y, y


def by_day(day: Callable[..., list]) -> Callable[..., Iterator[pa.Array]]:
    """A function by label of day(state, inputs, **params): the inputs of a day's cells as lists, state a dict that lasts; it gives the cells' values.
    A day may lie in several batches; only its cells, and what state keeps, are in memory."""

    def run(batches, **params):
        state: dict = {}
        sizes: deque[int] = deque()  # cells of the batches that have no values yet
        values: list = []
        cells: list = []
        t = None
        for b in batches:
            sizes.append(b.num_rows)
            for at, *x in zip(b.column("t").to_pylist(), *[c.to_pylist() for c in b.columns[3:]], strict=True):
                if at != t and cells:
                    values += day(state, [list(c) for c in zip(*cells, strict=True)], **params)
                    cells = []
                t = at
                cells.append(x)
            while sizes and len(values) >= sizes[0]:
                n = sizes.popleft()
                yield pa.array(values[:n], pa.float64())
                values = values[n:]
        if cells:
            values += day(state, [list(c) for c in zip(*cells, strict=True)], **params)
        for n in sizes:
            yield pa.array(values[:n], pa.float64())
            values = values[n:]

    return run


def backfilled(state: dict, inputs: list, window: int = 5, std: float = 4.0) -> list:
    """group_backfill: a missing value is the mean of the label's values of the last days, those beyond std deviations of their mean cut to that. A day is kept
    as its sorted values and their running sums, so a cut sum is two searches in each day."""
    x, labels = inputs
    if labels[0] is None:
        return [None] * len(x)
    days = state.setdefault("days", deque(maxlen=window))
    values = sorted(v for v in x if v is not None and math.isfinite(v))
    own = sum(values) / len(values) if values else 0.0
    days.append((values, np.concatenate([[0.0], np.cumsum(values)]), own, sum((v - own) ** 2 for v in values)))  # count, mean and squares about it merge over days
    n = sum(len(v) for v, *_ in days)
    if not n or all(v is not None for v in x):
        return x
    mean = sum(len(v) * m for v, _, m, _ in days) / n
    squares = sum(q + len(v) * (m - mean) ** 2 for v, _, m, q in days)
    sd = math.sqrt(squares / (n - 1)) if n > 1 else 0.0
    low, high, total = mean - std * sd, mean + std * sd, 0.0
    for v, s, *_ in days:
        i, j = bisect_left(v, low), bisect_right(v, high)
        total += low * i + float(s[j] - s[i]) + high * (len(v) - j)
    return [total / n if v is None else v for v in x]
