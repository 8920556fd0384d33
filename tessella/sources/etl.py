"""From a vendor's workbook to partitioned Parquet: read, melt, items to columns, names, types, partitions, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reshape, vendor
from .excel import read_excel

# fixed values: the vendor's column of items (some sheets have a space behind it), and what goes with it
ITEM, ITEM_CODE = "Item Name", "Item"


@dataclass(frozen=True)
class Dataset:
    """names: columns and items to ours; layout: types; frequency: where the sheet has no such column; day: partitions by day as well."""

    names: dict[str, str] = field(default_factory=dict)
    layout: vendor.Layout | None = None
    frequency: str | None = None
    day: bool = False


#: Kinds of workbooks; give names of columns with `dataclasses.replace`, or `names` to transform.
DATASETS = {
    "groups": Dataset(),
    "price": Dataset(layout=vendor.PRICE, frequency="DAILY", day=True),
    "fundamentals": Dataset(layout=vendor.FUNDAMENTALS, frequency="MONTHLY"),
    "price_monthly": Dataset(layout=vendor.MONTHLY, frequency="MONTHLY"),
}


def relational(sheet: DataFrame, items: list[str] | None = None) -> DataFrame:
    """A wide sheet (a row an item and symbol, a column a date) as a row a date and symbol, with a column for each item: its first value. Name the items to save a scan for them."""
    item = next((c for c in sheet.columns if c.strip() == ITEM), None)
    if item is None:
        raise ValueError(f"no column {ITEM}")
    long = reshape.melt_to_long(sheet).withColumnRenamed(item, ITEM)
    keys = [c for c in long.columns if c not in (ITEM, ITEM_CODE, "value")]
    return reshape.pivot_items(long, keys, ITEM, items=items)


def transform(sheet: DataFrame, dataset: Dataset | str, names: dict[str, str] | None = None, items: list[str] | None = None) -> DataFrame:
    """The rows of a sheet as the dataset has them: named, with a frequency, typed; without those that lack what the layout asks for."""
    dataset = DATASETS[dataset] if isinstance(dataset, str) else dataset
    out = reshape.rename_columns(relational(sheet, items), {"Symbol": "symbol", "Symbol Name": "symbol_name", "Kind": "kind", "Frequency": "frequency"} | dataset.names | (names or {}))
    if "frequency" not in out.columns:
        out = out.withColumn("frequency", F.lit(dataset.frequency).cast("string"))
    return vendor.preprocess(out, dataset.layout) if dataset.layout else out


def workbook_to_parquet(spark: SparkSession, workbook: str, path: str, dataset: Dataset | str, names: dict[str, str] | None = None, items: list[str] | None = None, header: str = "Symbol") -> None:
    """Reads a workbook (or several of one header), transforms it and writes it by year and month (and day)."""
    dataset = DATASETS[dataset] if isinstance(dataset, str) else dataset
    reshape.write_partitioned(transform(read_excel(spark, workbook, header), dataset, names, items), path, day=dataset.day)


def load_relational(spark: SparkSession, workbook: str, path: str | None = None, header: str = "Symbol") -> DataFrame:
    """A single workbook as date, symbol, symbol_name (if there is one) and a column an item, as text; written to path, if one is given, and read again."""
    sheet = read_excel(spark, workbook, header)
    keep = {"Symbol", "Symbol Name", ITEM}
    dates, rest = reshape.identify_columns(sheet)
    out = relational(sheet.select(*[F.col(f"`{c}`") for c in [*[c for c in rest if c.strip() in keep], *dates]]))
    out = reshape.rename_columns(out, {"Symbol": "symbol", "Symbol Name": "symbol_name"})
    if path is None:
        return out
    out.repartitionByRange("date", "symbol").sortWithinPartitions("date", "symbol").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
