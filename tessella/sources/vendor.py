"""Vendor tables to clean ones: daily prices, fundamentals and monthly prices, by declared layouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .reshape import typed_columns

# fixed values: the vendor's texts for a share that trades and one that is in order
TRADING, IN_ORDER = "정상", "일반"


@dataclass(frozen=True)
class Layout:
    """prefix is put before every name. millions and thousands lose their suffix; flags: column, new column, normal text."""

    integers: tuple = ()
    doubles: tuple = ()
    flags: tuple = (("trading_halt_status", "is_trading_suspended", TRADING), ("management_classification", "is_issue", IN_ORDER))
    required: tuple = ()
    prefix: str = ""


PRICE = Layout(("adj_close", "trading_value", "listed_shares_common", "float_shares"), ("float_ratio_pct",), required=("adj_close",))
FUNDAMENTALS = Layout(flags=())
MONTHLY = Layout(("adj_open", "adj_close", "trading_volume", "trading_value", "listed_shares_common", "float_shares"), ("return_pct",), prefix="monthly_")


def preprocess(df: DataFrame, layout: Layout) -> DataFrame:
    """df typed by the layout: columns ending in _million become exact integers and those in _thousand doubles, in single units and without the
    suffix; a status is true where its text is not the normal one, or missing; columns that df lacks are passed over."""
    name = lambda c: layout.prefix + c
    millions = [c for c in df.columns if c.endswith("_million")]
    thousands = [c for c in df.columns if c.endswith("_thousand")]
    flags = [(name(a), name(b), normal) for a, b, normal in layout.flags if name(a) in df.columns]
    out = typed_columns(df, [name(c) for c in layout.integers], [name(c) for c in layout.doubles], millions, thousands, {a: normal for a, _, normal in flags}, [name(c) for c in layout.required])
    return out.withColumnsRenamed({c: c.rsplit("_", 1)[0] for c in millions + thousands} | {a: b for a, b, _ in flags})


def preprocess_price(df: DataFrame) -> DataFrame:
    return preprocess(df, PRICE)


def preprocess_fundamentals(df: DataFrame) -> DataFrame:
    return preprocess(df, FUNDAMENTALS)


def preprocess_monthly(df: DataFrame) -> DataFrame:
    return preprocess(df, MONTHLY)
