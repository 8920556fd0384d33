"""Monthly JSON documents over HTTP: fetched backwards, stored by year and month, those stored before not fetched again; or read by tasks.

`spark.read.format("tessella_months")` (after `register`) has a partition a month, fetched in its task; filters on year and month are pushed down
where spark.sql.python.filterPushdown.enabled is set, and months that they exclude are never asked for.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual


def http_get(url: str) -> bytes | None:
    """The body of a JSON answer, None of any other."""
    try:
        with urlopen(Request(url), timeout=30) as r:
            return r.read() if r.status == 200 and "application/json" in r.headers.get("Content-Type", "") else None
    except OSError:
        return None


def records(body: bytes | None, key: str) -> list[dict] | None:
    """The list under key of a document in UTF-8 or EUC-KR; None if there is no such thing."""
    for encoding in ("utf-8", "euc-kr") if body else ():
        try:
            found = json.loads(body.decode(encoding))
            return found[key] if isinstance(found, dict) and isinstance(found.get(key), list) else None
        except ValueError:
            continue
    return None


def _kept(spark: SparkSession, path: str) -> set[tuple[int, int]]:
    """Months that have a folder under path, be it an empty one; folders are listed, nothing is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/year=*/month=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return {(int(x.getPath().getParent().getName()[5:]), int(x.getPath().getName()[6:])) for x in found}


def fetch_months(
    spark: SparkSession, url: str, key: str, path: str, year: int, month: int, get: Callable[[str], bytes | None] = http_get, most_failures: int = 10, most_months: int | None = None, pause: float = 0.0
) -> list[tuple[int, int]]:
    """Stores the records of each month under path (column value, one JSON text a record), from the given month back until so many months in a
    row fail. url has {year} and {month}; between two requests it waits pause seconds. Returns the months that were fetched. A month without
    records gets its empty folder, so it is not asked for again. One month's document passes through the driver, no more."""
    have = _kept(spark, path)
    failed, seen, fetched = 0, 0, []
    while failed < most_failures and (most_months is None or seen < most_months):
        if (year, month) in have:
            failed = 0
        else:
            if seen and pause:
                time.sleep(pause)
            found = records(get(url.format(year=year, month=month)), key)
            failed = failed + 1 if found is None else 0
            if found is not None:
                folder = f"{path}/year={year}/month={month}"
                spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in found], "value string").coalesce(1).write.mode("overwrite").parquet(folder)
                fetched.append((year, month))
        seen += 1
        year, month = (year, month - 1) if month > 1 else (year - 1, 12)
    return fetched


def stored_months(spark: SparkSession, path: str) -> DataFrame:
    """value, year, month of all stored records."""
    return spark.read.parquet(path)


class _Month(InputPartition):
    def __init__(self, year: int, month: int):
        super().__init__((year, month))
        self.year, self.month = year, month


class MonthsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.key = options["url"], options["key"]
        (y, m), (last_y, last_m) = (map(int, options[k].split("-")) for k in ("start", "end"))
        self.months = [(k // 12, k % 12 + 1) for k in range(12 * y + m - 1, 12 * last_y + last_m)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if column in (("year",), ("month",)) and type(f) in tests:
                at, test = int(column == ("month",)), tests[type(f)]
                self.months = [m for m in self.months if test(m[at], f.value)]
            elif not (column in (("year",), ("month",)) and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Month(*m) for m in self.months] or [_Month(0, 0)]

    def read(self, partition: _Month) -> Iterator[tuple]:
        if partition.year:
            for r in records(http_get(self.url.format(year=partition.year, month=partition.month)), self.key) or []:
                yield json.dumps(r, ensure_ascii=False), partition.year, partition.month


class MonthsSource(DataSource):
    """Options: url with {year} and {month}, key of the list of records, start and end as YYYY-MM. A month that fails or has no record has no row."""

    @classmethod
    def name(cls) -> str:
        return "tessella_months"

    def schema(self) -> str:
        return "value string, year int, month int"

    def reader(self, schema) -> DataSourceReader:
        return MonthsReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format tessella_months known, and its filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MonthsSource)
