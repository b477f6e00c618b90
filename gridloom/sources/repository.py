"""Saved results: written once, read back as sources of later batches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.spec import ASSET, DATE, MASK, NUMERIC, STEP, CompileError
from gridloom.plans.compiler import Domain, InputSpec
from gridloom.sources.panel import SourceError


class RepositoryError(SourceError):
    """A factor that cannot be saved or is not there."""


def _digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a sum of their hashes, which does not depend on their order."""
    h = F.xxhash64("date", "asset", "step", "value").cast("decimal(38,0)")
    found = rows.agg(F.count("*").alias("n"), F.sum(h).alias("s")).first()
    return found.n, str(found.s)


class FactorRepository:
    """One folder a factor: values by date in Parquet, its coordinates in a table beside them, its shape as JSON.

    A factor is written into a folder of its own and takes its name by one rename, so it is there whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def exists(self, name: str) -> bool:
        files, path = self._path(f"{self.path}/{name}")
        return files.exists(path)

    def save(self, result: DataFrame, name: str, domain: Domain, steps: int) -> None:
        """Store the column ``name`` of a result. An existing factor is not overwritten."""
        if not name or set(name) & set("/\\") or name.startswith(("_", ".")):
            raise RepositoryError(f"{name!r} is no name for a factor")
        if self.exists(name):
            raise RepositoryError(f"{name} already exists")
        kind = MASK if dict(result.dtypes)[name] == "boolean" else NUMERIC
        staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        files, there = self._path(staging)
        try:
            rows = result.select("date", "asset", "step", F.col(name).alias("value"))
            rows.repartition("date").write.partitionBy("date").parquet(f"{staging}/values")
            saved = self.spark.read.schema(f"asset {dict(rows.dtypes)['asset']}, step int, value {dict(rows.dtypes)['value']}, date string").parquet(f"{staging}/values")
            axes = [saved.select(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("value")).distinct() for axis in ("date", "asset", "step")]
            coordinates = axes[0].union(axes[1]).union(axes[2])
            coordinates.coalesce(1).write.parquet(f"{staging}/axes")
            n, digest = _digest(saved)
            shape = json.dumps({"asset": domain.asset, "freq": domain.freq, "steps": steps, "kind": kind, "code": dict(rows.dtypes)["asset"], "rows": n, "digest": digest})
            self.spark.createDataFrame([(shape,)], "value string").coalesce(1).write.text(f"{staging}/shape")
            if not files.rename(there, self._path(f"{self.path}/{name}")[1]):
                raise RepositoryError(f"{name} already exists")
        finally:
            files.delete(there, True)

    def import_rows(self, rows: DataFrame, name: str, asset: str, freq: str = "1d", steps: int = 1) -> None:
        """Save rows (date, asset, value, and step if there are several) from elsewhere as a factor; each coordinate comes once."""
        full = rows if "step" in rows.columns else rows.withColumn("step", F.lit(0))
        g = full.groupBy(F.regexp_replace(F.col("date").cast("string"), "[-/.]", "").alias("date"), "asset", F.col("step").cast("int").alias("step")).agg(F.count("*").alias("__n"), F.first("value").alias("value"))
        once = F.when(F.col("__n") > 1, F.raise_error(F.lit("a coordinate comes twice"))).otherwise(F.col("value"))
        self.save(g.select("date", "asset", "step", once.alias(name)), name, Domain("", "", asset=asset, freq=freq), steps)

    def verify(self, name: str) -> None:
        """Fail unless the values are those that were saved."""
        shape = self.shape(name)
        if [*_digest(self.load(name))] != [shape["rows"], shape["digest"]]:
            raise RepositoryError(f"{name} is not as it was saved")

    def shape(self, name: str) -> dict:
        if not self.exists(name):
            raise RepositoryError(f"no factor {name}")
        return json.loads(self.spark.read.text(f"{self.path}/{name}/shape").first()[0])

    def axis(self, name: str, axis: str) -> list[str]:
        """The saved dates, assets or steps, as text."""
        return sorted(r.value for r in self.spark.read.parquet(f"{self.path}/{name}/axes").filter(F.col("axis") == axis).collect())

    def load(self, name: str, dates: list[str] | None = None) -> DataFrame:
        """date, asset, step, value; only the folders of the dates are read."""
        shape = self.shape(name)
        df = self.spark.read.schema(f"asset {shape['code']}, step int, value {'boolean' if shape['kind'] == MASK else 'double'}, date string").parquet(f"{self.path}/{name}/values")
        return df if dates is None else df.filter(F.col("date").between(dates[0], dates[-1]))


class RepositoryProvider:
    """Another provider's sources and the saved factors, as ``factor:name``."""

    def __init__(self, base, repository: FactorRepository):
        self.base, self.repository = base, repository

    def calendar(self):
        return self.base.calendar()

    def freeze(self, dates: list[str], codes: dict[str, list]) -> None:
        if hasattr(self.base, "freeze"):
            self.base.freeze(dates, codes)

    def assets(self, asset: str, dates: list[str]) -> list:
        return self.base.assets(asset, dates)

    def describe(self, key: str) -> InputSpec:
        if not key.startswith("factor:"):
            return self.base.describe(key)
        s = self.repository.shape(key[7:])
        return InputSpec(s["asset"], s["freq"], s["steps"], s["kind"])

    def same_scan(self, a: str, b: str) -> bool:
        return not (a.startswith("factor:") or b.startswith("factor:")) and self.base.same_scan(a, b)

    def load(self, keys: list[str], dates: list[str], codes: list, steps: int) -> DataFrame:
        """Rows on grid positions. Every date, asset and step that is read must have been saved."""
        if not keys[0].startswith("factor:"):
            return self.base.load(keys, dates, codes, steps)
        name = keys[0][7:]
        for axis, wanted in (("date", dates), ("asset", list(map(str, codes)))):
            if missing := sorted(set(wanted) - set(self.repository.axis(name, axis))):
                raise CompileError(f"{keys[0]} has no {axis} {missing[0]}")
        order = sorted(map(int, self.repository.axis(name, "step")))
        if len(order) != steps:
            raise CompileError(f"{keys[0]} has {len(order)} steps, not {steps}")
        rows = self.repository.load(name, dates)
        kind = dict(rows.dtypes)["asset"]
        axis = lambda values, name, to, t: self.base.spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} {t}, {to} int")
        out = rows.join(axis(codes, "asset", ASSET, kind), "asset").join(axis(dates, "date", DATE, "string"), "date").join(axis(order, "step", "__step", "int"), "step")
        return out.select(DATE, ASSET, F.col("__step").alias(STEP), F.col("value").alias(keys[0]))
