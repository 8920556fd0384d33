"""A catalog of fields: where each comes from, its tag, and whether it is carried forward."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

READERS: dict[str, Callable[[SparkSession, Field], DataFrame]] = {}
TAGS = {"numeric", "weight", "port_return", "group", "boolean", "object"}


@dataclass(frozen=True)
class Field:
    """table: a path (of the reader's format) or a view's name; or query: SQL with the named parameters :start_date and :end_date."""

    name: str
    data_type: str = "numeric"
    db_type: str = "parquet"
    table: str = ""
    query: str = ""
    index_col: str = "date"
    security_col: str = "symbol"
    value_col: str = "value"
    forward_fill: str | bool = False  # "value": the last observed value; "row": the last reported row, observed or not

    @property
    def tag(self) -> str:
        kind = "boolean" if self.data_type == "event" else self.data_type
        if kind not in TAGS:
            raise ValueError(f"field {self.name}: no type {self.data_type}")
        return kind


def register_reader(db_type: str, reader: Callable[[SparkSession, Field], DataFrame]) -> None:
    """reader gives a field's table, unfiltered; filters and columns are pushed into it."""
    READERS[db_type] = reader


for _format in ("parquet", "orc", "json"):
    register_reader(_format, lambda spark, f, kind=_format: spark.read.format(kind).load(f.table))
register_reader("csv", lambda spark, f: spark.read.csv(f.table, header=True))
register_reader("table", lambda spark, f: spark.table(f.table))


class Catalog:
    def __init__(self, spark: SparkSession, config: dict[str, dict], root: str = ""):
        """root: what relative tables, and relative paths in queries, are below."""
        self.spark = spark
        known = {f.name for f in fields(Field)}
        self._fields = {}
        for name, c in config.items():
            c = {k: v for k, v in c.items() if k in known}
            if root and c.get("db_type", "parquet") != "table" and c.get("table") and "://" not in c["table"] and not c["table"].startswith("/"):
                c["table"] = f"{root}/{c['table']}"
            if root and c.get("query"):  # paths of the form parquet.`path` that are relative
                c["query"] = re.sub(r"(\b(?:parquet|orc|csv|json)\.`)(?!/|[a-zA-Z][\w+.-]*:)", lambda m: f"{m[1]}{root}/", c["query"])
            if c.get("forward_fill") is True:
                c["forward_fill"] = "value"
            self._fields[name] = Field(name=name, **c)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, root: str = "") -> Catalog:
        """A JSON file, or a YAML file where a YAML library is installed."""
        with open(path) as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                return cls(spark, yaml.safe_load(f), root)
            return cls(spark, json.load(f), root)

    def field(self, name: str) -> Field:
        if name not in self._fields:
            raise KeyError(f"no field {name}")
        return self._fields[name]

    def list_fields(self) -> list[str]:
        return sorted(self._fields)

    def get_field_config(self, name: str) -> dict:
        return vars(self.field(name))
