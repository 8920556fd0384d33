"""Weights of a smoothing operator that bring a signal to a target turnover.

The turnover of a date is the sum of the changes of all symbols over the sum of their sizes; a signal's is the mean over its dates. All
candidates of a round are evaluated in one pass over the cells: a task carries the last outputs of its symbol for every candidate, and hands out
sums by date (as many rows as the calendar has dates). The bracket around the target then narrows to two neighbours, so a search has as many jobs as rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: By operator: what it makes of the last outputs, a cell's inputs and the candidate weights, all candidates at once.
STEPS: dict[str, Callable] = {
    "ts_decay": lambda before, w, x: w * before + (1 - w) * x,
    "ts_delta_limit": lambda before, w, x, y: before + np.clip(x - before, -w * abs(y), w * abs(y)),
}


def turnovers(frame: DataFrame, inputs: list[Column], op: str, weights: np.ndarray) -> np.ndarray:
    """The mean turnover under each weight; NaN where no date has any size."""
    step, k, given = STEPS[op], len(weights), [f"x{i}" for i in range(len(inputs))]
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("t"))
    cells = frame.filter("in_universe").select("date", "symbol", place.alias("place"), *[c.cast("double").alias(n) for n, c in zip(given, inputs, strict=True)])

    def run(batches):
        sums: dict = {}
        before = symbol = None
        for b in batches:
            for date, who, *x in zip(*[b.column(c).to_pylist() for c in ("date", "symbol", *given)], strict=True):
                if who != symbol:
                    before, symbol = None, who
                if any(v is None or not np.isfinite(v) for v in x):
                    continue
                after = np.full(k, x[0]) if before is None else step(before, weights, *x)
                total = sums.setdefault(date, np.zeros((2, k)))
                total[0] += 0 if before is None else np.abs(after - before)
                total[1] += np.abs(after)
                before = after
        yield pa.RecordBatch.from_pydict({"date": pa.array(list(sums), pa.date32()), "moved": pa.array([s[0] for s in sums.values()], pa.list_(pa.float64())), "size": pa.array([s[1] for s in sums.values()], pa.list_(pa.float64()))})

    made = cells.mapInArrow(run, "date date, moved array<double>, size array<double>")
    each = made.groupBy("date").agg(*[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("moved", "size") for i in range(k)])
    row = each.agg(*[F.avg(F.col(f"moved{i}") / F.nullif(F.col(f"size{i}"), F.lit(0.0))).alias(f"t{i}") for i in range(k)]).first()
    return np.array([np.nan if row[i] is None else row[i] for i in range(k)])


def search(frame: DataFrame, inputs: list[Column], op: str, low: float, high: float, target: float, points: int = 16, rounds: int = 3) -> tuple[float, float]:
    """(weight, its turnover) nearest to the target among all candidates; where nothing brackets it, an end of the range."""
    best: tuple[float, float] | None = None
    for _ in range(rounds):
        weights = np.linspace(low, high, points)
        got = turnovers(frame, inputs, op, weights)
        off = np.where(np.isnan(got), np.inf, np.abs(got - target))
        i = int(np.argmin(off))
        if best is None or off[i] < abs(best[1] - target):
            best = float(weights[i]), float(got[i])
        over = np.flatnonzero(np.diff(np.sign(got - target)) != 0)
        j = int(over[0]) if len(over) else min(max(i - 1, 0), points - 2)
        low, high = float(weights[j]), float(weights[j + 1])
    return best
