"""A catalog of what research makes: datasets that grow by dates and columns, versioned alphas, and what depends on what.

An entity is a folder: Parquet by month, and a manifest a version (JSON) that says which folder holds each month, the columns, and what it was made of. A
write puts whole months into a new folder and then creates the next manifest; until then, and if the writer dies before, readers see the version
before. Of two writers from one version the second's manifest exists already: it gets an error and its folder goes. Old versions stay readable.
The manifests are small (a line a month); rows never pass through the driver.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ("date", "symbol")


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass
class Manifest:
    version: int = 0
    kind: str = "dataset"
    schema: str = ""  # JSON of the columns
    months: dict[str, str] = field(default_factory=dict)  # month to folder
    depends: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    description: str = ""
    spec: dict | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- files ----

    def _path(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        at, fs = self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _load(self, name: str, number: int) -> Manifest | None:
        at, fs = self._path(name, "_versions", f"{number:08d}.json")
        stream = fs.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return Manifest(**json.loads(text))
        except ValueError:  # a writer that died while it wrote the manifest
            return None

    def versions(self, name: str) -> list[int]:
        """Versions that were committed."""
        return [n for n in self._numbers(name) if self._load(name, n)]

    def _numbers(self, name: str) -> list[int]:
        return [int(f[:-5]) for f in self._names(name, "_versions") if re.fullmatch(r"\d{8}\.json", f)]

    def manifest(self, name: str, version: int | None = None) -> Manifest:
        for n in reversed(self._numbers(name)):
            if version in (None, n) and (m := self._load(name, n)):
                return m
        raise KeyError(f"no {name}" + (f" of version {version}" if version else ""))

    def _commit(self, name: str, made: Manifest) -> int:
        at, fs = self._path(name, "_versions", f"{made.version:08d}.json")
        try:
            stream = fs.create(at, False)
        except Exception as e:
            if "exist" in str(e):
                raise Conflict(f"{name}: version {made.version} is there already") from None
            raise
        try:
            stream.write(json.dumps(asdict(made)).encode())
        finally:
            stream.close()
        return made.version

    # ---- datasets ----

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """date, symbol and all columns; a column is missing where it was not there yet."""
        m = self.manifest(name, version)
        schema = StructType.fromJson(json.loads(m.schema))
        paths = [f"{self.root}/{name}/{folder}/month={month}" for month, folder in sorted(m.months.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, name: str, rows: DataFrame, depends=(), tags=(), description: str = "", kind: str = "dataset", spec: dict | None = None, base: int | None = None) -> int:
        """Adds the rows (date, symbol and columns). On their dates they replace what their columns held; other dates, and other columns, stay. New columns are added. Returns the version.
        base: the version that the writer has seen, the last one by default."""
        if any(k not in rows.columns for k in KEYS):
            raise ValueError("rows need date and symbol")
        try:
            old = self.manifest(name, base)
        except KeyError:
            if base:
                raise
            old = Manifest(kind=kind)
        rows = rows.withColumn("date", F.col("date").cast("date"))
        months = [r["m"] for r in rows.select(F.date_format("date", "yyyy-MM").alias("m")).distinct().filter("m is not null").collect()]  # a row a month
        kept = StructType.fromJson(json.loads(old.schema)) if old.schema else StructType()
        for f in rows.schema:
            if f.name in kept.names and kept[f.name].dataType != f.dataType:
                raise TypeError(f"{name}.{f.name} is {kept[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        mine = [c for c in rows.columns if c not in KEYS]
        here = [m for m in months if m in old.months]
        if here:
            before = self.spark.read.schema(kept).parquet(*[f"{self.root}/{name}/{old.months[m]}/month={m}" for m in here])
            given = rows.select("date").distinct().withColumn("_given", F.lit(True))
            before = before.join(F.broadcast(given), "date", "left").select(*KEYS, *[F.when(F.col("_given").isNull(), F.col(c)).alias(c) if c in mine else F.col(c) for c in kept.names if c not in KEYS])
            both = before.unionByName(rows, allowMissingColumns=True).groupBy(*KEYS)
            rows = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in dict.fromkeys([*[c for c in kept.names if c not in KEYS], *mine])])
            live = [F.col(c).isNotNull() for c in rows.columns if c not in KEYS]
            for e in live[1:]:
                live[0] = live[0] | e
            rows = rows.filter(live[0]) if live else rows  # a row that was replaced by none
        for f in rows.schema:
            if f.name not in kept.names:
                kept = kept.add(f)
        folder = f"data-{uuid.uuid4().hex}"
        month = F.date_format("date", "yyyy-MM")
        rows.filter("date is not null and symbol is not null").withColumn("month", month).repartition("month", F.pmod(F.xxhash64("symbol"), F.lit(4))).write.partitionBy("month").parquet(f"{self.root}/{name}/{folder}")
        written = {f[6:] for f in self._names(name, folder) if f.startswith("month=")}
        made = Manifest(max(self._numbers(name) if base is None else [base], default=0) + 1, old.kind, kept.json(), {k: v for k, v in old.months.items() if k not in months} | dict.fromkeys(sorted(written), folder))
        made.depends, made.tags = sorted({*old.depends, *depends}), sorted({*old.tags, *tags})
        made.description, made.spec = description or old.description, spec or old.spec
        try:
            return self._commit(name, made)
        except Conflict:
            at, fs = self._path(name, folder)
            fs.delete(at, True)
            raise

    # ---- alphas ----

    def save_alpha(self, name: str, session, signal, tags=(), description: str = "") -> str:
        """Signal, weights and returns of a panel under the session's scaler, with its spec and the fields that it reads, as <name>_v1, _v2, ...; returns the name that it got."""
        from ..plans.panel import dependencies

        weights = session.to_weights(signal)
        returns = session.to_portfolio_returns(weights)
        rows = session._together(signal, weights, returns).select(*KEYS, *[p.on_grid().alias(n) for n, p in (("signal", signal), ("weight", weights), ("port_return", returns))])
        weights.to_json()  # a scaler without a name cannot be made again
        taken = [int(m[1]) for x in self._names() if (m := re.fullmatch(re.escape(name) + r"_v(\d+)", x))]
        n = max(taken, default=0) + 1
        while True:
            try:
                self.upsert(f"{name}_v{n}", rows, sorted(dependencies(weights.spec)), tags, description, "alpha", weights.spec)
                return f"{name}_v{n}"
            except Conflict:
                n += 1

    # ---- what there is ----

    def entities(self, kind: str | None = None, tag: str | None = None) -> dict[str, Manifest]:
        out = {}
        for name in self._names():
            if self.versions(name):
                m = self.manifest(name)
                if kind in (None, m.kind) and (tag is None or tag in m.tags):
                    out[name] = m
        return out

    def dependents(self, name: str) -> list[str]:
        """Entities that depend on a field or entity, directly or by others."""
        every, found, open_ = self.entities(), set(), [name]
        while open_:
            at = open_.pop()
            new = [n for n, m in every.items() if n not in found and n != name and (at in m.depends or any(d.split(".")[0] == at for d in m.depends))]
            found |= set(new)
            open_ += new
        return sorted(found)
