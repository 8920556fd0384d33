"""Share ledger: what strategies hold in whole shares and in cash, day by day, with commissions, slippage and market impact.

A day's trades depend on the cash and shares that the day before has left, over all symbols together, so a strategy's days are one stream in order of
time; strategies are side by side. In memory are a day's cells, and the shares and last price of every symbol.

Rules of a day: equity is cash and all shares at the day's prices (the last known where one is missing). A symbol with a price trades to weight * equity / price
in whole shares; one without, or whose impact needs a volume that is missing, keeps its shares. A missing weight is zero. A trade is paid at the price, moved
against it by slippage and by impact * sqrt(size / volume), and bears a commission of a rate with a minimum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """commission: a share of what is traded, min_fee at least; slippage_bps: hundredths of a percent; impact: coefficient of the square root of size over volume."""

    commission: float = 0.001
    min_fee: float = 1.0
    slippage_bps: float = 5.0
    impact: float = 0.0


ROUNDING = {"round": lambda x: math.copysign(math.floor(abs(x) + 0.5), x), "floor": math.floor, "ceil": math.ceil}
SCHEMA = "shares double, trade double, paid double, commission double, cash double, equity double"


class Account:
    def __init__(self, cash: float, costs: Costs, rounding: str):
        self.cash, self.costs, self.round = cash, costs, ROUNDING[rounding]
        self.shares: dict = {}
        self.price: dict = {}

    def day(self, cells: list[tuple]) -> list[tuple]:
        """cells: symbol, weight, price, volume. Returns symbol, shares, trade, paid, commission of those that trade or hold, then the account: None, shares held in all, shares traded, paid, commission, cash, equity."""
        for symbol, _, price, _ in cells:
            if price is not None and price > 0:
                self.price[symbol] = price
        equity = self.cash + math.fsum(n * self.price[s] for s, n in self.shares.items())
        if not math.isfinite(equity):
            raise ValueError("the account's equity is not finite")
        out, c = [], self.costs
        for symbol, weight, price, volume in cells:
            held = self.shares.get(symbol, 0.0)
            trade = 0.0
            if price is not None and price > 0 and (not c.impact or (volume is not None and volume > 0)):
                trade = float(self.round((weight or 0.0) * equity / price)) - held
            if trade:
                side = math.copysign(1.0, trade)
                paid = trade * price * (1 + side * (c.slippage_bps / 1e4 + (c.impact * math.sqrt(abs(trade) / volume) if c.impact else 0.0)))
                out.append((symbol, held + trade, trade, paid, max(c.min_fee, c.commission * abs(paid))))
                self.shares[symbol] = held + trade
                if not self.shares[symbol]:
                    del self.shares[symbol]
            elif held:
                out.append((symbol, held, 0.0, 0.0, 0.0))
        paid, fees = math.fsum(x[3] for x in out), math.fsum(x[4] for x in out)
        self.cash -= paid + fees
        worth = self.cash + math.fsum(n * self.price[s] for s, n in self.shares.items())
        return [(*x, None, None) for x in out] + [(None, math.fsum(self.shares.values()), math.fsum(abs(x[2]) for x in out), paid, fees, self.cash, worth)]


def ledger(frame: DataFrame, weights: dict[str, Column], price: Column, volume: Column | None = None, cash: float = 1_000_000.0, costs: Costs = Costs(), rounding: str = "round") -> DataFrame:
    """strategy, date, symbol, shares, trade, paid, commission, cash, equity: a row for each holding or trade of a day, and one without a symbol for its account."""
    if rounding not in ROUNDING:
        raise ValueError(f"rounding is one of {', '.join(ROUNDING)}")
    if costs.impact and volume is None:
        raise ValueError("impact needs a volume")
    kind = frame.schema["symbol"].dataType.simpleString()
    volume = F.lit(None) if volume is None else volume
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), w.cast("double").alias("weight")) for k, w in weights.items()]))
    rows = frame.select("date", "symbol", price.cast("double").alias("price"), volume.cast("double").alias("volume"), each.alias("s")).select("s.*", "date", "symbol", "price", "volume")
    # the window deals by strategy and orders by date
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("strategy").orderBy("date", "symbol")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, day, cells, name = Account(cash, costs, rounding), None, [], None
        out: list[tuple] = []

        def flush(at):
            made = list(zip(*out, strict=True)) if out else [()] * 9
            out.clear()
            kinds = [pa.string(), pa.date32(), at, *[pa.float64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=["strategy", "date", "symbol", "shares", "trade", "paid", "commission", "cash", "equity"])

        for b in batches:
            at = b.schema.field("symbol").type
            for name, date, *cell in zip(*[b.column(c).to_pylist() for c in ("strategy", "date", "symbol", "weight", "price", "volume")], strict=True):
                if date != day and cells:
                    out += [(name, day, *x) for x in account.day(cells)]
                    cells = []
                day = date
                cells.append(tuple(cell))
            if out:
                yield flush(at)
        if cells:
            out += [(name, day, *x) for x in account.day(cells)]
            yield flush(at)

    return rows.groupBy("strategy").applyInArrow(run, f"strategy string, date date, symbol {kind}, {SCHEMA}")


def accounts(rows: DataFrame) -> DataFrame:
    """strategy, date, traded, paid, commission, cash, equity of each day."""
    return rows.filter("symbol is null").select("strategy", "date", F.col("trade").alias("traded"), "paid", "commission", "cash", "equity")


def positions(rows: DataFrame) -> DataFrame:
    return rows.filter("symbol is not null").drop("cash", "equity")
