"""A catalog of tables: a configuration names them, their columns are found by scanning, keys resolve to panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.calendar import day_of, in_days
from gridloom.sources.builders import any_flag, dated_files, map_codes
from gridloom.sources.panel import Panel, SourceError, TableProvider

_WHERE = {"path", "format", "options", "table", "frame", "files", "filter", "flag"}
_KNOWN = _WHERE | {"asset", "freq", "steps", "date", "code", "step", "fields", "rename", "kinds", "defaults", "static", "checked", "spelling", "labels", "identity", "unmatched", "reports", "any_flag", "positions"}


class CatalogError(SourceError):
    """Settings that do not fit each other or the tables they name."""


class Catalog:
    """Datasets, stored axes and code maps by name.

    A dataset has its place (``path``, ``table``, a ``frame``, JDBC and other sources by ``format`` and ``options``, or ``files``:
    a pattern with ``{date}`` for one file a date), asset, date, code and optionally freq, steps, step, fields (a whitelist),
    rename (field -> column), kinds, defaults, filter, flag (a column that must be 1), static, checked, spelling (of string
    dates, for the scan), labels (HHMM of the steps of ``files``), reports (published, ended, rank), any_flag (field -> state
    columns of which one must be 1), positions; and identity ``outer`` if its codes are those of the asset's code map, with
    unmatched ``fail`` if every code must be in it.

    ``calendar``: a place with date; ``axes``: for each asset type a place with code, and date if it changes over time;
    ``codes``: for each asset type a place with outer, inner, and date if it changes over time. They are read instead of the datasets' own rows.
    """

    def __init__(self, spark: SparkSession, config: dict[str, dict], calendar: dict | None = None, axes: dict[str, dict] | None = None, codes: dict[str, dict] | None = None):
        self.spark, self.config, seen = spark, config, {}
        self.stored, self.axes, self.codes = calendar, axes or {}, codes or {}
        self.panels: dict[str, Panel] = {}
        for name, c in config.items():
            if set(c) - _KNOWN or not {"asset", "code"} <= set(c) or not ({"path", "table", "frame", "options", "files"} & set(c)):
                raise CatalogError(f"{name}: unknown or missing settings")
            if not c.get("static") and not {"date", "files"} & set(c):
                raise CatalogError(f"{name}: a dated table needs its date column")
            if c.get("identity", "inner") not in ("inner", "outer") or (c.get("identity") == "outer" and c["asset"] not in self.codes):
                raise CatalogError(f"{name}: outer codes need a code map of {c['asset']}")
            fields = self._fields(name, c)
            for f in fields:
                key = f"{c['asset']}.{c.get('freq', '1d')}.{f}"
                if key in seen:
                    raise CatalogError(f"{key} is in {seen[key]} and in {name}")
                seen[key] = name
            reports = tuple(c["reports"]) if "reports" in c else None
            plain = {k: c[k] for k in ("freq", "steps", "kinds", "defaults", "static", "checked", "positions") if k in c}
            self.panels[name] = Panel(lambda dates=None, c=c, f=fields: self.rows(c, f, dates), c["asset"], fields=fields, bounded=True, reports=reports, **plain)

    def _fields(self, name: str, c: dict) -> tuple[str, ...]:
        if "any_flag" in c:
            return tuple(c["any_flag"])
        if "files" in c:
            if not c.get("fields"):
                raise CatalogError(f"{name}: files need their fields")
            return tuple(c["fields"])
        columns, rename = self.scan(c).columns, c.get("rename", {})
        taken = {c.get("date"), c["code"], c.get("step"), *c.get("reports", ())}
        fields = tuple(c.get("fields") or [x for x in columns if x not in taken])
        missing = ({rename.get(f, f) for f in fields} | {x for x in taken if x}) - set(columns)
        if missing:
            raise CatalogError(f"{name}: no column {sorted(missing)}")
        return fields

    def scan(self, c: dict) -> DataFrame:
        if "frame" in c:
            return c["frame"]
        if "table" in c:
            return self.spark.table(c["table"])
        reader = self.spark.read.format(c.get("format", "parquet")).options(**c.get("options", {}))
        return reader.load(c["path"]) if "path" in c else reader.load()

    def _place(self, c: dict, dates: list[str] | None) -> DataFrame:
        """The rows of a place, restricted to the dates on the raw date column where that can be compared."""
        df = self.scan(c)
        if c.get("filter"):
            df = df.filter(c["filter"])
        if c.get("flag"):
            df = df.filter(F.col(c["flag"]) == 1)
        if "date" in c and dates is not None:
            kind = dict(df.dtypes)[c["date"]]
            raw = in_days(F.col(c["date"]), kind, dates[0], dates[-1], c.get("spelling"))
            df = df.filter(raw if raw is not None else day_of(F.col(c["date"]), kind).between(dates[0], dates[-1]))
        return df

    def _day(self, c: dict, df: DataFrame):
        return day_of(F.col(c["date"]), dict(df.dtypes)[c["date"]]).alias("date")

    def rows(self, c: dict, fields: tuple[str, ...], dates: list[str] | None = None) -> DataFrame:
        if "files" in c:
            if dates is None:
                raise CatalogError("files of one date each need a stored calendar and axis")
            out = dated_files(self.spark, c["files"], dates, c["code"], list(fields), c.get("step"), c.get("labels"))
        else:
            df = self._place(c, dates)
            head = [self._day(c, df)] if "date" in c else []
            rename = c.get("rename", {})
            if "any_flag" in c:
                out = any_flag(df.withColumn("__day", head[0]), "__day", c["code"], c["any_flag"])
            else:
                values = [F.col(f"`{rename.get(f, f)}`").alias(f) for f in fields]
                out = df.select(*head, F.col(c["code"]).alias("code"), *([F.col(c["step"]).alias("step")] if "step" in c else []), *c.get("reports", ()), *values)
        if c.get("identity") == "outer":
            m = self.codes[c["asset"]]
            table = self._place(m, dates)
            dated = "date" in m
            names = [F.col(m["outer"]).alias("outer"), F.col(m["inner"]).alias("inner"), *([self._day(m, table)] if dated else [])]
            out = map_codes(out, table.select(*names).distinct(), dated, c.get("unmatched") == "fail")
        return out

    def keys(self) -> list[str]:
        return sorted(f"{p.asset}.{p.freq}.{f}" for p in self.panels.values() for f in p.fields)

    def search(self, text: str) -> list[str]:
        return [k for k in self.keys() if text.lower() in k.lower()]

    def provider(self, calendar: list | None = None, assets: dict[str, list] | None = None) -> TableProvider:
        days = calendar
        if days is None and self.stored is not None:
            df = self._place(self.stored, None)
            days = df.select(self._day(self.stored, df))
        axes = {}
        for asset, c in self.axes.items():
            df = self._place(c, None)
            axes[asset] = df.select(F.col(c["code"]).alias("code"), *([self._day(c, df)] if "date" in c else []))
        return TableProvider(self.spark, self.panels, days, assets, axes)
