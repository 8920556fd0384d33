"""Regression of a panel on several others by date.

A date's Gram matrix is an aggregate that merges: counts, means and co-moments of its complete cells, so a task hands out one row a date. The small
systems are solved in batches of dates, and what they give goes back to the cells by a broadcast of one row a date (a calendar is checked to be bounded).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Singular values below this share of the largest count as zero.
TOLERANCE = 1e-10


def by_date(frame: DataFrame, y: Column, factors: list[Column], intercept: bool = True) -> DataFrame:
    """date, n, rank, alpha, betas (an array), r2. Cells that lack y or a factor take no part. Where factors are linearly dependent on a date (rank under their number) betas are
    those of least norm; a date with fewer than one complete cell has none. Without an intercept r2 is about zero, else about the mean."""
    given = [F.when(F.abs(c) < float("inf"), c.cast("double")) for c in (*factors, y)]
    whole = given[0].isNotNull()
    for c in given[1:]:
        whole = whole & c.isNotNull()
    k = len(factors)
    names = [f"v{i}" for i in range(k + 1)]
    cells = frame.filter("in_universe").select("date", *[c.alias(n) for n, c in zip(names, given, strict=True)], whole.alias("whole"))
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    moment = lambda i, j: F.covar_pop(*[F.when(F.col("whole"), F.col(names[q])) for q in (i, j)]) if intercept else F.avg(F.when(F.col("whole"), F.col(names[i]) * F.col(names[j])))
    sums = cells.groupBy("date").agg(
        F.count(F.when(F.col("whole"), True)).alias("n"), F.array(*[F.avg(F.when(F.col("whole"), F.col(c))) for c in names]).alias("mean"), F.array(*[moment(i, j) for i, j in pairs]).alias("co")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, alpha, betas, r2 = [], [], [], []
            for n, mean, co in zip(*[b.column(c).to_pylist() for c in ("n", "mean", "co")], strict=True):
                if not n:
                    for out in (rank, alpha, betas, r2):
                        out.append(None)
                    continue
                m = np.zeros((k + 1, k + 1))
                for (i, j), v in zip(pairs, co, strict=True):
                    m[i, j] = m[j, i] = v
                size = np.sqrt(np.maximum(np.diag(m)[:k], 0))
                unit = np.where(size > 0, size, 1.0)
                values, vectors = np.linalg.eigh(m[:k, :k] / np.outer(unit, unit))  # in units of each factor's spread
                live = values > TOLERANCE * max(values.max(), 0) if k else np.zeros(0, bool)
                live &= values > 0
                beta = vectors[:, live] @ ((vectors[:, live].T @ (m[:k, k] / unit)) / values[live]) / unit
                left = m[k, k] - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta
                rank.append(int(live.sum()))
                betas.append(beta.tolist())
                alpha.append(float(mean[k] - beta @ np.array(mean[:k])) if intercept else 0.0)
                r2.append(float(1 - left / m[k, k]) if m[k, k] > 0 else None)
            yield pa.RecordBatch.from_pydict({"date": b.column("date"), "n": b.column("n"), "rank": pa.array(rank, pa.int32()), "alpha": pa.array(alpha, pa.float64()), "betas": pa.array(betas, pa.list_(pa.float64())), "r2": pa.array(r2, pa.float64())})

    return sums.mapInArrow(solve, "date date, n long, rank int, alpha double, betas array<double>, r2 double")


def residual(frame: DataFrame, solved: DataFrame, name: str, y: Column, factors: list[Column]) -> DataFrame:
    """frame with the column name: y less what the date's regression makes of the factors; missing where one of them is."""
    fit = F.col("_alpha")
    for i, f in enumerate(factors):
        fit = fit + F.get("_betas", F.lit(i)) * f
    small = solved.select("date", F.col("alpha").alias("_alpha"), F.col("betas").alias("_betas"))
    return frame.join(F.broadcast(small), "date", "left").withColumn(name, F.when(F.col("in_universe"), y - fit)).drop("_alpha", "_betas")
