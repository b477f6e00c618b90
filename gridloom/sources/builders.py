"""Derived sources as DataFrames: as-of factors, state masks, point-in-time reports, code maps, dated files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: State columns whose 1 makes an asset untradable (fixed values).
UNTRADABLE = (
    "IfSpecialTrade",
    "IfSuspended",
    "IfNewListed",
    "IfLimitup",
    "IfLimitup_",
    "IfLimitdown",
    "IfLimitdown_",
    "IfSuspendedNextday",
    "IfLimitupNextday",
    "IfLimitup_Nextday",
    "IfLimitdownNextday",
    "IfLimitdown_Nextday",
    "IfLimitupNext5day",
    "IfLimitup_Next5day",
    "IfLimitdownNext5day",
    "IfLimitdown_Next5day",
)


def panel_fields(table: DataFrame, date: str, code: str, fields: dict[str, str], flag: str | None = None, constants: dict[str, float] | None = None, where=None) -> DataFrame:
    """(date, code, fields): renamed columns and constants, rows whose flag is 1; filters reach the scan."""
    rows = table if flag is None else table.filter(F.col(flag) == 1)
    rows = rows if where is None else rows.filter(where)
    return rows.select(F.col(date).alias("date"), F.col(code).alias("code"), *[F.col(c).alias(n) for n, c in fields.items()], *[F.lit(v).alias(n) for n, v in (constants or {}).items()])


def as_of(rows: DataFrame, events: DataFrame, key: str, at: str, effective: str, value: str, name: str, default=None) -> DataFrame:
    """``rows`` with the value of the latest event of the same key that is effective at ``at`` or before.

    Both sides are merged into one ordered stream for each key and the last value is carried forward: one shuffle,
    no pairs of rows and events. Of events at one moment the largest value counts.
    """
    marked = rows.select(*rows.columns, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__value"))
    news = events.groupBy(F.col(key), F.col(effective).alias("__at")).agg(F.max(value).alias("__value"))
    news = news.select(*[(F.col(c) if c == key else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns], "__at", F.lit(0).alias("__side"), "__value")
    stream = marked.unionByName(news)
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("__value", ignorenulls=True).over(w)
    found = found if default is None else F.coalesce(found, F.lit(default))
    return stream.withColumn(name, found).filter("__side = 1").select(*rows.columns, name)


def any_flag(table: DataFrame, date: str, code: str, columns: tuple[str, ...] | dict[str, tuple[str, ...]] = UNTRADABLE, name: str = "untradable") -> DataFrame:
    """(date, code, masks): whether any state column of a mask is 1; a missing state is not."""
    masks = columns if isinstance(columns, dict) else {name: columns}

    def one(some) -> Column:
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{c}`"), F.lit(0)) == 1 for c in some])
        return F.when(hit, 1.0).otherwise(0.0)

    return table.select(F.col(date).alias("date"), F.col(code).alias("code"), *[one(some).alias(n) for n, some in masks.items()])


def point_in_time(table: DataFrame, date: str, code: str, published: str, ended: str, rank: str, values: str | list[str], quarters: int = 1, limit_days: int = -180) -> DataFrame:
    """(date, code, step, values): the last ``quarters`` reports known at a date, the oldest at step 0.

    Reports published earlier than ``limit_days`` after their period's end do not count.
    """
    known = table.filter((F.col(published) >= F.date_add(F.col(ended), limit_days)) & (F.col(rank) >= 1) & (F.col(rank) <= quarters))
    names = [values] if isinstance(values, str) else values
    return known.select(F.col(date).alias("date"), F.col(code).alias("code"), (F.lit(quarters) - F.col(rank)).cast("int").alias("step"), *[F.col(f"`{v}`").alias(v) for v in names])


def report_tables(spark: SparkSession, items: DataFrame, name: str, table: str, column: str, settings: dict) -> dict[str, dict]:
    """Catalog settings of the report tables that a list of items names and that exist with the item's column.

    ``items`` has a row an item: its name, its table and its column there. Every dataset gets ``settings`` besides.
    """
    wanted: dict[str, dict[str, str]] = {}
    for r in items.select(F.col(name).alias("n"), F.col(table).alias("t"), F.col(column).alias("c")).distinct().collect():  # a list of names
        wanted.setdefault(r.t, {})[r.n] = r.c
    out = {}
    for t, fields in sorted(wanted.items()):
        have = set(spark.table(t).columns) if spark.catalog.tableExists(t) else set()
        if some := {n: c for n, c in fields.items() if c in have}:
            out[t] = settings | {"table": t, "fields": sorted(some), "rename": some}
    return out


def bond_stocks(bonds: DataFrame, terms: DataFrame, bond: str, nature: str, stock: str, natures=(10, 29)) -> DataFrame:
    """(code, stock): the stock under each convertible bond, for bonds of the given natures that both tables have."""
    kept = bonds.filter(F.col(nature).isin(*natures)).select(F.col(bond).alias("code"))
    return kept.join(terms.select(F.col(bond).alias("code"), F.col(stock).alias("stock")), "code")


def map_codes(rows: DataFrame, codes: DataFrame, dated: bool = False, strict: bool = False) -> DataFrame:
    """Rows with their outer code replaced by the inner one; rows without a match are dropped, or fail if ``strict``.

    ``codes`` has (outer, inner), and date if the map changes over time. Codes compare as text.
    """
    keys = ["date", "outer"] if dated else ["outer"]
    mapped = rows.withColumn("outer", F.col("code").cast("string")).join(codes.withColumn("outer", F.col("outer").cast("string")), keys, "left" if strict else "inner")
    inner = F.col("inner") if not strict else F.coalesce("inner", F.raise_error(F.concat(F.lit("no inner code for "), F.coalesce("outer", F.lit("NULL")))).cast(dict(codes.dtypes)["inner"]))
    return mapped.select(*[inner.alias(c) if c == "code" else F.col(f"`{c}`") for c in rows.columns])


def dated_files(spark: SparkSession, pattern: str, dates: list[str], code: str, fields: list[str], step: str | None = None, labels: list[int] | None = None) -> DataFrame:
    """One parquet file a date: only the files of the dates are listed, only the fields are read, a missing file fails.

    ``step`` holds HHMM labels; those of ``labels`` become positions, other rows are dropped.
    """
    paths = [pattern.format(date=d) for d in dates]
    df = spark.read.parquet(*paths)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{8})[^/]*$", 1)
    out = [day.alias("date"), F.col(code).alias("code"), *[F.col(f).cast("double").alias(f) for f in fields]]
    if step is None:
        return df.select(*out)
    position = F.array_position(F.array(*map(F.lit, labels)), F.col(step).cast("int")).cast("int") - 1
    return df.select(*out, position.alias("step")).filter("step >= 0")
