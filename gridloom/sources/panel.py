"""Providers: they say what a source is, and bring its rows onto grid positions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.calendar import date_key
from gridloom.operators.spec import ASSET, CODE, DATE, MASK, NUMERIC, STEP, CompileError
from gridloom.plans.compiler import InputSpec
from gridloom.sources.builders import point_in_time


class SourceError(ValueError):
    """A source that cannot be used as it is declared."""


@dataclass
class Panel:
    """A table of rows (date YYYYMMDD, code[, step position], fields). ``static`` rows have no date and hold for all.

    Rows that break the declared shape fail the query that reads them: a coordinate that comes twice, a day that is not in
    the calendar, a step outside the axis, a value that its kind does not allow. A panel whose table is grouped by its
    coordinates cannot have them and may say so by ``checked=False``. Rows of codes that are not asked for are not read.
    """

    table: Callable[..., DataFrame]  # of the read dates (None: all) if ``bounded``, else of nothing
    asset: str
    freq: str = "1d"
    steps: int = 1
    kinds: dict[str, str] = field(default_factory=dict)  # field -> kind, numeric if not named
    defaults: dict[str, float] = field(default_factory=dict)  # value of coordinates that have no row
    fields: tuple[str, ...] = ()
    static: bool = False
    checked: bool = True
    bounded: bool = False  # the table restricts itself to the dates, on its raw columns
    reports: tuple[str, str, str] | None = None  # (published, ended, rank): reports whose steps are chosen by the formula
    flat: bool = False  # rows (position, fields): (date * assets + asset) * steps + step over the dates and assets that are read
    positions: dict[str, str] = field(default_factory=dict)  # code field -> asset type on whose axis its codes become positions

    def rows(self, dates: list[str] | None = None) -> DataFrame:
        if self.bounded:
            return self.table(dates)
        return self.table() if dates is None or self.static or self.flat else self.table().filter(F.col("date").between(dates[0], dates[-1]))


#: Parameters of report sources and what they are if a formula does not say.
REPORTS = {"quarters": 1, "publ_date_limit": -180}


class TableProvider:
    """Panels over any DataFrames (parquet, JDBC, memory): keys are ``asset.freq.field``, with ``|name=value`` for reports.

    The calendar and the assets come from lists, from stored tables (``calendar``: a table with a date column; ``axes``: tables with
    code, and date where the axis changes over time), or else from the panels' own rows. Each is read once and kept.
    """

    def __init__(self, spark: SparkSession, panels: dict[str, Panel], calendar: list | DataFrame | None = None, assets: dict[str, list] | None = None, axes: dict[str, DataFrame] | None = None):
        self.spark, self.panels, self.axes = spark, panels, dict(axes or {})
        self._days = calendar if isinstance(calendar, DataFrame) else None
        self._calendar = sorted(map(date_key, calendar)) if calendar is not None and self._days is None else None
        self._assets = dict(assets or {})
        self._found: dict[tuple, list] = {}
        self._tables: dict[tuple, DataFrame] = {}
        self._frozen: dict[str, list] = {}

    def freeze(self, dates: list[str], codes: dict[str, list]) -> None:
        """The axes of the task, for sources that point into another asset type's axis."""
        self._frozen = codes

    def _find(self, key: str) -> tuple[Panel, str, dict[str, int]]:
        plain, *extra = key.split("|")
        asset, freq, name = plain.split(".", 2)
        given = dict(x.split("=", 1) for x in extra)
        for p in self.panels.values():
            if (p.asset, p.freq) == (asset, freq) and name in p.fields:
                if set(given) - set(REPORTS if p.reports else ()):
                    raise CompileError(f"{plain} has no parameter {sorted(given)[0]}")
                try:
                    params = {k: int(v) for k, v in (REPORTS | given).items()} if p.reports else {}
                except ValueError:
                    raise CompileError(f"{key}: parameters are whole numbers") from None
                if params.get("quarters", 1) < 1:
                    raise CompileError(f"{key}: quarters must be positive")
                return p, name, params
        raise CompileError(f"{plain} is not a known source")

    def calendar(self) -> list[str]:
        if self._calendar is None:
            dated = [self._days.select("date")] if self._days is not None else [p.rows().select("date") for p in self.panels.values() if not (p.static or p.flat)]
            self._calendar = sorted(date_key(r.date) for r in reduce(DataFrame.union, dated).filter("date IS NOT NULL").distinct().collect())
        return self._calendar

    def assets(self, asset: str, dates: list[str]) -> list:
        """Codes with a row in the read dates, history included, sorted; or the fixed list."""
        if asset in self._assets:
            return self._assets[asset]
        key = (asset, dates[0], dates[-1])
        if key not in self._found:
            if asset in self.axes:
                axis = self.axes[asset]
                found = [(axis.filter(F.col("date").between(dates[0], dates[-1])) if "date" in axis.columns else axis).select("code")]
            else:
                found = [p.rows(dates).select("code") for p in self.panels.values() if p.asset == asset and not p.flat]
            if not found:
                raise CompileError(f"no panel of asset type {asset}")
            self._found[key] = sorted(r.code for r in reduce(DataFrame.union, found).filter("code IS NOT NULL").distinct().collect())
        return self._found[key]

    def describe(self, key: str) -> InputSpec:
        p, name, params = self._find(key)
        return InputSpec(p.asset, p.freq, params.get("quarters", p.steps), p.kinds.get(name, NUMERIC))

    def same_scan(self, a: str, b: str) -> bool:
        (p, _, x), (q, _, y) = self._find(a), self._find(b)
        return p is q and x == y

    def load(self, keys: list[str], dates: list[str], codes: list, steps: int) -> DataFrame:
        """Rows on grid positions with a column for each key; without date positions if they hold for every date."""
        p, _, params = self._find(keys[0])
        names = {k: self._find(k)[1] for k in keys}
        rows = p.rows(dates)
        if p.reports:
            rows = point_in_time(rows, "date", "code", *p.reports, list(dict.fromkeys(names.values())), params["quarters"], params["publ_date_limit"])
        stepped = p.steps > 1 or bool(p.reports)
        given = F.lit(0)
        if p.flat:
            at, n = F.col("position"), len(codes) * steps
            rows = rows.withColumn(ASSET, (F.expr(f"position div {steps}") % len(codes)).cast("int")).withColumn("step", at % steps)
            given, stepped = F.when((at >= 0) & (at < len(dates) * n), F.expr(f"position div {n}").cast("int")), True
        else:
            rows = rows.join(self._axis(codes, "code", ASSET), "code")
        if not (p.static or p.flat):
            rows = rows.join(self._axis(dates, "date", DATE), "date", "left" if p.checked else "inner")
            given = F.col(DATE)
        step = F.col("step") if stepped else F.lit(0)
        kinds = {k: p.kinds.get(n, NUMERIC) for k, n in names.items()}
        keep = [F.col(f"`{n}`").alias(k) for k, n in names.items()]
        if p.checked:
            out = checked_rows(rows, given, step, len(dates), steps, keep, kinds)
        else:
            out = rows.select(given.alias(DATE), ASSET, step.cast("int").alias(STEP), *keep)
        for k, n in names.items():
            if n in p.positions:
                axis = self._axis(self._frozen.get(p.positions[n]) or self.assets(p.positions[n], dates), "at_code", "at")
                out = out.join(axis, F.col(f"`{k}`") == F.col("at_code"), "left").drop(k, "at_code").withColumnRenamed("at", k)
        on = [ASSET, STEP] if p.static else [DATE, ASSET, STEP]  # static rows hold for every date of the task
        given = {k: p.defaults[n] for k, n in names.items() if n in p.defaults}
        if given:  # a default is for coordinates without a row; a row's own NULL stays
            i, n = F.col("id"), len(codes) * steps
            places = [F.expr(f"id div {n}").cast("int").alias(DATE)] * (not p.static) + [(F.expr(f"id div {steps}") % len(codes)).cast("int").alias(ASSET), (i % steps).cast("int").alias(STEP)]
            grid = self.spark.range(n if p.static else len(dates) * n).select(*places)
            full = grid.join(out.withColumn("__row", F.lit(True)), on, "left")
            out = full.select(*on, *[(F.when(F.col("__row"), F.col(f"`{k}`")).otherwise(F.lit(given[k])) if k in given else F.col(f"`{k}`")).alias(k) for k in keys])
        return out.select(*on, *[F.col(f"`{k}`") for k in keys])

    def _axis(self, values: list, name: str, position: str) -> DataFrame:
        """(value, position) of an axis, made once; Spark decides by its size how to join it."""
        key = (name, len(values), values[0] if values else None, values[-1] if values else None, hash(tuple(values)))
        if key not in self._tables:
            kind = "string" if values and isinstance(values[0], str) else "bigint"
            self._tables[key] = self.spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} {kind}, {position} int")
        return self._tables[key]


def checked_rows(rows: DataFrame, date: Column, step: Column, dates: int, steps: int, values: list[Column], kinds: dict[str, str]) -> DataFrame:
    """Rows on positions, each coordinate once. What breaks the shape fails the query: the check rides on a grouping by the
    coordinates, whose partitioning the join with the grid needs anyway, so no second job reads the source."""
    d = rows.select(date.alias(DATE), ASSET, step.cast("double").alias(STEP), *values)
    wrong = [(F.col(DATE).isNull(), "a day is not in the calendar")]
    at = F.col(STEP)
    wrong.append((at.isNull() | (at != F.floor(at)) | (at < 0) | (at >= steps), "a step is outside the axis"))
    for k, kind in kinds.items():
        c = F.col(f"`{k}`").cast("double")
        if kind == MASK:
            wrong.append((F.coalesce(~c.isin(0.0, 1.0), F.lit(False)), f"{k}: a mask is 0 or 1"))
        elif kind == CODE:
            wrong.append((F.coalesce(c != F.floor(c), F.lit(False)), f"{k}: a code is a whole number"))
    first = F.coalesce(*[F.when(c, F.lit(text)) for c, text in wrong])
    # no null, which a join would drop unseen: an unknown day stands at the last one, which every result has
    d = d.select(F.coalesce(F.col(DATE), F.lit(dates - 1)).alias(DATE), ASSET, F.coalesce(at.cast("int"), F.lit(0)).alias(STEP), *[F.col(f"`{k}`") for k in kinds], first.alias("__wrong"))
    g = d.groupBy(DATE, ASSET, STEP).agg(F.count("*").alias("__n"), F.max("__wrong").alias("__wrong"), *[F.first(F.col(f"`{k}`")).alias(k) for k in kinds])
    problem = F.coalesce("__wrong", F.when(F.col("__n") > 1, F.lit("a coordinate comes twice")))
    return g.select(DATE, ASSET, STEP, *[F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col(f"`{k}`")).alias(k) for k in kinds])


def memory_provider(spark: SparkSession, dates: list, codes: dict[str, list], arrays: dict[str, list], kinds: dict[str, str] | None = None) -> TableProvider:
    """A provider over nested lists: ``arrays[key][date][asset]`` or ``[date][asset][step]``, None for missing.

    Days and codes must not repeat, and every array must have a cell for each day, code and step.
    """
    days, panels = [date_key(d) for d in dates], {}
    for name, axis in (("a day", days), *(("a code", c) for c in codes.values())):
        if len(set(axis)) != len(axis):
            raise SourceError(f"{name} comes twice")
    for key, values in arrays.items():
        asset, freq, name = key.split(".", 2)
        if asset not in codes:
            raise SourceError(f"{key}: no codes of {asset}")
        deep = [[list(cell) if isinstance(cell, list | tuple) else [cell] for cell in row] for row in values]
        if len(deep) != len(days) or any(len(row) != len(codes[asset]) for row in deep) or len({len(cell) for row in deep for cell in row}) > 1:
            raise SourceError(f"{key}: the array does not fit {len(days)} days and {len(codes[asset])} codes")
        rows = [(days[d], codes[asset][a], s, None if v is None else float(v)) for d, row in enumerate(deep) for a, cell in enumerate(row) for s, v in enumerate(cell)]
        code = "string" if isinstance(codes[asset][0], str) else "bigint"
        df = spark.createDataFrame(rows, f"date string, code {code}, step int, `{name}` double")
        panels[key] = Panel(lambda df=df: df, asset, freq, len(deep[0][0]), {name: (kinds or {}).get(key, NUMERIC)}, fields=(name,))
    return TableProvider(spark, panels, days, codes)
