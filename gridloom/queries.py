"""The library's registered queries: formula batches over panels of the driver's tables, each with SQL for the same.

Panels: EV, events by day and user (x = sum of value, y = count); EV4, the same by quarter of the day as four session
steps; LI, line items by month and supplier with nation (group), balance (weight) and positive balance (member).
Results are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.engine import Engine
from gridloom.formula import FormulaBatch
from gridloom.functions.calendar import in_days
from gridloom.operators.cross_section import CENTRE, TAILS
from gridloom.plans.compiler import Domain
from gridloom.sources.panel import Panel, TableProvider

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The panels of a session and folder: their calendar and axes are read once.
_providers: dict[tuple, TableProvider] = {}


def _kept(make):
    def provider(spark: SparkSession, sf: str) -> TableProvider:
        key = (make.__name__, spark.sparkContext.applicationId, sf)
        if key not in _providers:
            _providers[key] = make(spark, sf)
        return _providers[key]

    return provider


def _between(df: DataFrame, column: str, dates: list[str] | None) -> DataFrame:
    return df if dates is None else df.filter(in_days(F.col(column), dict(df.dtypes)[column], dates[0], dates[-1]))


@_kept
def events_provider(spark: SparkSession, sf: str) -> TableProvider:
    raw = _table(spark, sf, "events")

    def cells(dates, *by):
        """Added up in the order of the file, as the SQL does it on one thread, however the file is split: the last bit of a sum decides comparisons."""
        place = (F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        rows = _between(raw, "ts", dates).select(F.date_format("ts", "yyyyMMdd").alias("date"), F.col("user_id").alias("code"), F.expr("hour(ts) div 6").cast("int").alias("step"), "value", *place)
        return rows.repartition(*by).sortWithinPartitions(*by, "f", "b", "i").groupBy(*by).agg(F.sum("value").alias("x"), F.count("*").cast("double").alias("y"))

    users = raw.select(F.col("user_id").alias("code")).distinct()
    panels = {  # grouped by their coordinates, so there is nothing to check
        "daily": Panel(lambda dates=None: cells(dates, "date", "code"), "stk", fields=("x", "y"), checked=False, bounded=True),
        "steps": Panel(lambda dates=None: cells(dates, "date", "code", "step"), "stk", "60min", 4, fields=("x", "y"), checked=False, bounded=True),
        "bonds": Panel(lambda: users.select((F.col("code") + 1000).alias("code"), F.pmod(F.col("code") * 7 + 3, F.lit(10)).alias("underlying_stk")), "cb", kinds={"underlying_stk": "code"}, fields=("underlying_stk",), static=True),
    }
    days = raw.select(F.date_format("ts", "yyyyMMdd").alias("date"))
    return TableProvider(spark, panels, days, axes={"stk": users})


@_kept
def lineitem_provider(spark: SparkSession, sf: str) -> TableProvider:
    raw, sup = _table(spark, sf, "lineitem"), _table(spark, sf, "supplier")

    def items(dates=None):
        # a month's rows are all those up to the day before the next month
        until = [dates[0], (datetime.strptime(dates[-1], "%Y%m%d") + timedelta(days=31)).strftime("%Y%m%d")] if dates else None
        d = _between(raw, "l_shipdate", until).select(F.date_format(F.date_trunc("month", "l_shipdate"), "yyyyMMdd").alias("date"), F.col("l_suppkey").alias("code"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"), "l_quantity")
        d = d if dates is None else d.filter(F.col("date") <= dates[-1])
        return d.groupBy("date", "code").agg(F.sum("x").alias("x"), F.sum("l_quantity").alias("y"))

    panels = {
        "monthly": Panel(items, "stk", fields=("x", "y"), checked=False, bounded=True),
        "suppliers": Panel(lambda: sup.select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("balance")), "stk", kinds={"nation": "code"}, fields=("nation", "balance"), static=True),
    }
    days = raw.select(F.date_format(F.date_trunc("month", "l_shipdate"), "yyyyMMdd").alias("date"))
    return TableProvider(spark, panels, days)


EVENTS = """
    raw AS (SELECT CAST(ts AS DATE) AS d, user_id AS asset, CAST(floor(hour(ts) / 6) AS INT) AS q, value FROM events),
    dates AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS t, strftime(d, '%Y%m%d') AS date FROM (SELECT DISTINCT d FROM raw)),
    assets AS (SELECT asset, CAST(row_number() OVER (ORDER BY asset) - 1 AS INT) AS a FROM (SELECT DISTINCT asset FROM raw)),
"""
DAILY = (
    EVENTS
    + """
    g AS (
        SELECT t, date, asset, a, 0 AS s, 0 AS step, x, y FROM dates CROSS JOIN assets
        LEFT JOIN (SELECT d, asset, sum(value) AS x, CAST(count(*) AS DOUBLE) AS y FROM raw GROUP BY 1, 2) USING (d, asset)
    )
"""
)
STEPS = (
    EVENTS
    + """
    g AS (
        SELECT t, date, asset, a, s, [930, 1030, 1300, 1400][s + 1] AS step, x, y FROM dates CROSS JOIN assets CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS s)
        LEFT JOIN (SELECT d, asset, q AS s, sum(value) AS x, CAST(count(*) AS DOUBLE) AS y FROM raw GROUP BY 1, 2, 3) USING (d, asset, s)
    )
"""
)
ITEMS = """
    raw AS (SELECT date_trunc('month', l_shipdate) AS d, l_suppkey AS asset, l_extendedprice * (1 - l_discount) AS x, l_quantity AS y FROM lineitem),
    dates AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS t, strftime(d, '%Y%m%d') AS date FROM (SELECT DISTINCT d FROM raw)),
    assets AS (SELECT asset, CAST(row_number() OVER (ORDER BY asset) - 1 AS INT) AS a FROM (SELECT DISTINCT asset FROM raw UNION SELECT s_suppkey FROM supplier)),
    g AS (
        SELECT t, date, asset, a, 0 AS s, 0 AS step, x, y, s_nationkey AS nation, s_acctbal AS balance FROM dates CROSS JOIN assets
        LEFT JOIN (SELECT d, asset, sum(x) AS x, sum(y) AS y FROM raw GROUP BY 1, 2) USING (d, asset)
        LEFT JOIN supplier ON s_suppkey = asset
    )
"""
_PANELS = {
    "daily": (events_provider, DAILY, 'x = get_lf("stk", "x")\ny = get_lf("stk", "y")', "1d"),
    "steps": (events_provider, STEPS, 'x = get_hf("stk", "60min", "x")\ny = get_hf("stk", "60min", "y")', "60min"),
    "items": (lineitem_provider, ITEMS, 'x = get_lf("stk", "x")\ny = get_lf("stk", "y")\nnation = get_lf("stk", "nation")\nbalance = get_lf("stk", "balance")', "1d"),
}


def sixth(c: Column) -> Column:
    """Rounded to six places as the SQL does it: the millionfold is rounded, not the shortest decimal of the value."""
    return F.when(F.abs(c) < 1e300, F.round(c * 1e6) / 1e6).otherwise(c)


def rounded(df: DataFrame, names) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("date", "asset", "step", *[(sixth(F.col(n)) if kinds[n] == "double" else F.col(n)).alias(n) for n in names])


def family(name: str, panel: str, columns: dict[str, tuple[str, str]], more: str = "", output: str = "g", masks: tuple[str, ...] = (), freq: str | None = None, asset: str = "stk", select: str | None = None) -> None:
    """Register a batch: column -> (formula, SQL over g). ``more`` holds CTEs after g, ``output`` the one to select from."""
    provider, sql, inputs, own_freq = _PANELS[panel]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        p = provider(spark, sf)
        days = p.calendar()
        batch = FormulaBatch.from_text(inputs, {k: f if "\n" in f or " = " in f else f"out = {f}" for k, (f, _) in columns.items()})
        return rounded(Engine(spark, p).compute(batch, Domain(days[0], days[-1], asset=asset, freq=freq or own_freq)), columns)

    QUERIES[name] = query
    places = [f"{v} AS {k}" if k in masks else f"round(CASE WHEN isfinite(({v})::DOUBLE) THEN ({v})::DOUBLE END, 6) AS {k}" for k, (_, v) in columns.items()]
    ORACLE_SQL[name] = f"WITH {sql}{more} SELECT {select or 'date, asset, step'}, {', '.join(places)} FROM {output}"


def _over(w: int) -> str:
    return f"OVER (PARTITION BY a, s ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


CS = "OVER (PARTITION BY t, s)"


def _clamp(v: str, sq: str, m: str) -> str:
    return f"(CASE WHEN abs({v}) <= 1e-12 * greatest(1, {sq}, {m} * {m}) THEN 0 ELSE {v} END)"


def _var(x: str, over: str) -> str:
    return _clamp(f"(var_pop({x}) {over})", f"(avg({x} * {x}) {over})", f"(avg({x}) {over})")


def _corr(x: str, y: str, over: str) -> str:
    px, py = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    return f"CASE WHEN {_var(px, over)} > 0 AND {_var(py, over)} > 0 THEN (covar_pop({px}, {py}) {over}) / sqrt({_var(px, over)}) / sqrt({_var(py, over)}) END"


# --- elementwise -----------------------------------------------------------------------------

family(
    "flagship_events_zscore",
    "daily",
    {"factor": ("m = ts_mean(x, 5, min_periods=1)\nfactor = cs_zscore(m)", f"(m - avg(m) {CS}) / nullif(sqrt({_var('m', CS)}), 0)")},
    f", h AS (SELECT *, avg(x) {_over(5)} AS m FROM g)",
    "h",
)
family(
    "fx_elementwise",
    "daily",
    {
        "add_": ("x + y", "x + y"), "subtract_": ("x - y", "x - y"), "multiply_": ("x * y", "x * y"), "divide_": ("x / (y - 2)", "x / nullif(y - 2, 0)"),
        "neg_": ("-x", "-x"), "abs_": ("abs(x - 100)", "abs(x - 100)"), "abs_val_": ("abs_val(x - 100)", "abs(x - 100)"),
        "ln_": ("ln(x - 50)", "CASE WHEN x > 50 THEN ln(x - 50) END"), "log_": ("log(x)", "CASE WHEN x > 0 THEN ln(x) END"), "log10_": ("log10(x)", "CASE WHEN x > 0 THEN log10(x) END"),
        "sqrt_": ("sqrt(x - 50)", "CASE WHEN x >= 50 THEN sqrt(x - 50) END"), "sign_": ("sign(x - 100)", "sign(x - 100)"), "power2_": ("power2(x)", "x * x"), "power3_": ("power3(y)", "y * y * y"),
        "curt_": ("curt(x - 100)", "cbrt(x - 100)"), "inv_": ("inv(y - 2)", "1 / nullif(y - 2, 0)"), "exp_": ("exp(y)", "exp(y)"),
        "power_": ("y ** 1.5", "pow(y, 1.5)"), "power_zero": ("x ** 0", "1.0"), "protected_sqrt_": ("protected_sqrt(x - 100)", "sign(x - 100) * sqrt(abs(x - 100))"),
        "protected_log_": ("protected_log(x - 100)", "sign(x - 100) * ln(abs(x - 100) + 1)"), "sin_": ("sin(y)", "sin(y)"), "cos_": ("cos(y)", "cos(y)"), "tan_": ("tan(y)", "tan(y)"),
        "sigmoid_": ("sigmoid(y - 2)", "1 / (1 + exp(-(y - 2)))"), "hardsigmoid_": ("hardsigmoid(y - 2)", "CASE WHEN y IS NOT NULL THEN least(greatest((y - 1) / 2, 0), 1) END"),
        "leakyrelu_": ("leakyrelu(x - 100)", "CASE WHEN x - 100 > 0 THEN x - 100 ELSE 0.1 * (x - 100) END"),
        "gelu_": ("gelu(y - 2)", "0.5 * (y - 2) * (1 + tanh(sqrt(2 / pi()) * ((y - 2) + 0.044715 * (y - 2) * (y - 2) * (y - 2))))"),
        "series_min_": ("series_min(x, y)", "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END"), "series_max_": ("series_max(x, y)", "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END"),
        "one_": ("one(x)", "CASE WHEN x IS NOT NULL THEN 1.0 END"),
    },
)
family(
    "fx_logic",
    "daily",
    {
        "greater_equal_": ("y >= 2", "y >= 2"), "greater_": ("x > 100", "x > 100"), "less_equal_": ("y <= 2", "y <= 2"), "less_": ("x < 100", "x < 100"), "equal_": ("y == 2", "y = 2"), "not_equal_": ("y != 2", "y <> 2"),
        "and_": ("mask_and(x > 100, delay(y, 1) > 1)", "x > 100 AND p > 1"), "or_": ("mask_or(x > 100, delay(y, 1) > 1)", "x > 100 OR p > 1"), "not_": ("mask_not(x > 100)", "NOT x > 100"),
        "where_": ("where(x > 100, x, y)", "CASE WHEN x > 100 THEN x WHEN NOT x > 100 THEN y END"), "where_missing": ("where(delay(x, 1) > 100, y, 7)", "CASE WHEN q > 100 THEN y WHEN NOT q > 100 THEN 7 END"),
        "apply_mask_": ("apply_mask(x, y > 1)", "CASE WHEN y > 1 THEN x END"), "if_then_else_": ("if_then_else(x, delay(x, 1), y, -y)", "CASE WHEN x >= q THEN y WHEN x < q THEN -y END"),
    },
    ", h AS (SELECT *, lag(y) OVER (PARTITION BY a ORDER BY t) AS p, lag(x) OVER (PARTITION BY a ORDER BY t) AS q FROM g)",
    "h",
    masks=("greater_equal_", "greater_", "less_equal_", "less_", "equal_", "not_equal_", "and_", "or_", "not_"),
)

# --- dates ------------------------------------------------------------------------------------

_LAG = "(lag({}, {}) OVER (PARTITION BY a, s ORDER BY t))"
family(
    "fx_lag_fill",
    "daily",
    {
        "delay_": ("delay(x, 2)", _LAG.format("x", 2)), "delay_none": ("delay(x, 0)", "x"), "ffill_": ("ffill(x, 0, 2)", f"last_value(x IGNORE NULLS) {_over(3)}"), "ts_ffill_": ("ts_ffill(x, 1)", f"last_value(x IGNORE NULLS) {_over(2)}"),
        "ts_diff_": ("ts_diff(x, 1)", f"x - {_LAG.format('x', 1)}"), "ts_pct_change_": ("ts_pct_change(x, 3)", f"(x - {_LAG.format('x', 3)}) / nullif({_LAG.format('x', 3)}, 0)"),
        "delay_assets": ("delay(x, 1, axis=1)", "lag(x) OVER (PARTITION BY t, s ORDER BY a)"), "ffill_assets": ("ffill(x, axis=1)", "last_value(x IGNORE NULLS) OVER (PARTITION BY t, s ORDER BY a)"),
    },
)
_O5 = _over(5)


def _need(sql: str, n: int, over: str = _O5, x: str = "x") -> str:
    return f"CASE WHEN count({x}) {over} >= {n} THEN {sql} END"


family(
    "fx_rolling",
    "daily",
    {
        "ts_mean_": ("ts_mean(x, 5, min_periods=2)", _need(f"avg(x) {_O5}", 2)), "ts_mean_full": ("ts_mean(x)", _need(f"avg(x) {_O5}", 5)), "ts_sum_": ("ts_sum(x, 5, 2)", _need(f"sum(x) {_O5}", 2)),
        "ts_std_": ("ts_std(x, 5, min_periods=2)", _need(f"sqrt({_var('x', _O5)})", 2)), "ts_var_": ("ts_var(y, 5, min_periods=2)", _need(_var("y", _O5), 2)), "ts_min_": ("ts_min(x, 5, min_periods=2)", _need(f"min(x) {_O5}", 2)),
        "ts_max_": ("ts_max(x, 5, min_periods=2)", _need(f"max(x) {_O5}", 2)), "ts_max_to_min_": ("ts_max_to_min(x, 5, min_periods=2)", _need(f"max(x) {_O5} - min(x) {_O5}", 2)),
        "ts_median_": ("ts_median(x, 5, min_periods=2)", _need(f"median(x) {_O5}", 2)), "ts_quantile_": ("ts_quantile(x, 10, 0.3, min_periods=2)", _need(f"quantile_cont(x, 0.3) {_over(10)}", 2, _over(10))),
        "ts_cumprod_": ("ts_cumprod(y / 10, 5, min_periods=2)", _need(f"product(1 + y / 10) {_O5}", 2)),
        "ts_argmin_": ("ts_argmin(y, 5, min_periods=2)", _need(f"t + (min(CASE WHEN y IS NOT NULL THEN {{'v': y, 'n': -t}} END) {_O5}).n", 2)),
        "ts_argmax_": ("ts_argmax(y, 5, min_periods=2)", _need(f"t - (max(CASE WHEN y IS NOT NULL THEN {{'v': y, 'n': t}} END) {_O5}).n", 2)),
        "ts_tbeta_": ("ts_tbeta(x, 5, min_periods=2)", _need(f"covar_pop(x, CASE WHEN x IS NOT NULL THEN t END) {_O5} / nullif(var_pop(CASE WHEN x IS NOT NULL THEN t END) {_O5}, 0)", 2)),
        "ts_mean_assets": ("ts_mean(x, 3, min_periods=1, axis=1)", "avg(x) OVER (PARTITION BY t, s ORDER BY a ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    },
)
_SUM = "list_sum(list_transform({}, lambda v: {}))"
_W10 = "exp((v.t - t) * (ln(2) / 5))"


def _list_moment(pairs: str, stat: str) -> str:
    n = f"len({pairs})"
    mean = {c: f"({_SUM.format(pairs, 'v.' + c)} / {n})" for c in "xy"}
    square = {c: f"({_SUM.format(pairs, f'v.{c} * v.{c}')} / {n})" for c in "xy"}
    centred = lambda a, b: f"({_SUM.format(pairs, f'(v.{a} - {mean[a]}) * (v.{b} - {mean[b]})')} / {n})"
    if stat == "mean":
        return mean["x"]
    var = {c: _clamp(centred(c, c), square[c], mean[c]) for c in "xy"}
    if stat == "std":
        return f"sqrt({var['x']})"
    return f"CASE WHEN {n} >= 2 AND {var['x']} > 0 AND {var['y']} > 0 THEN {centred('x', 'y')} / sqrt({var['x']}) / sqrt({var['y']}) END"


family(
    "fx_rolling_arrays",
    "daily",
    {
        "ts_rank_": ("ts_rank(y, 5, min_periods=2)", "CASE WHEN len(ys) >= 2 AND y IS NOT NULL THEN (len(list_filter(ys, lambda v: v < y)) + 0.5 * (len(list_filter(ys, lambda v: v = y)) - 1)) / (len(ys) - 1) END"),
        "ts_ewm_mean_": ("ts_ewm_mean(x, min_periods=2)", f"CASE WHEN len(tx) >= 2 THEN {_SUM.format('tx', _W10 + ' * v.x')} / {_SUM.format('tx', _W10)} END"),
        "ts_ewm_std_": ("ts_ewm_std(x, min_periods=2)", f"CASE WHEN len(tx) >= 2 THEN sqrt(greatest(0, {_SUM.format('tx', _W10 + ' * (v.x - em) * (v.x - em)')} / {_SUM.format('tx', _W10)})) END"),
    },
    f""", h AS (
        SELECT *, list_filter(list(y) {_O5}, lambda v: v IS NOT NULL) AS ys, list_filter(list(CASE WHEN x IS NOT NULL THEN {{'t': t, 'x': x}} END) {_over(10)}, lambda v: v IS NOT NULL) AS tx FROM g
    ), k AS (SELECT *, {_SUM.format('tx', _W10 + ' * v.x')} / {_SUM.format('tx', _W10)} AS em FROM h)""",
    "k",
)
family(
    "fx_rolling_pairs",
    "daily",
    {
        "ts_corr_": ("ts_corr(x, y, 6, min_periods=3)", f"CASE WHEN n >= 3 THEN {_corr('x', 'y', _over(6))} END"),
        "ts_cov_": ("ts_cov(x, y, 6, min_periods=3)", f"CASE WHEN n >= 3 THEN covar_samp(x, y) {_over(6)} END"),
        "ts_beta_": ("ts_beta(y, x, 6, min_periods=3)", f"CASE WHEN n >= 3 THEN (covar_pop(x, y) {_over(6)}) / nullif({_var('(CASE WHEN x IS NOT NULL THEN y END)', _over(6))}, 0) END"),
        "ts_rankcorr_": ("ts_rankcorr(x, y, 6, min_periods=3)", f"CASE WHEN n >= 3 THEN {_list_moment('rk', 'corr')} END"),
        "ts_split_mean_": ("ts_split_mean(x, y, 6, top=2, min_periods=3)", f"CASE WHEN n >= 3 THEN {_list_moment('top', 'mean')} END"),
        "ts_split_std_": ("ts_split_std(x, y, 6, top=2, min_periods=3)", f"CASE WHEN n >= 3 THEN {_list_moment('top', 'std')} END"),
        "ts_split_corr_": ("ts_split_corr(x, y, 6, top=3, min_periods=3)", f"CASE WHEN n >= 3 THEN {_list_moment('top3', 'corr')} END"),
    },
    f""", h AS (SELECT *, list_filter(list(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {{'x': x, 'y': y}} END) {_over(6)}, lambda v: v IS NOT NULL) AS p FROM g),
    k AS (
        SELECT *, len(p) AS n,
            list_transform(p, lambda u: {{'x': len(list_filter(p, lambda w: w.x < u.x)) + (len(list_filter(p, lambda w: w.x = u.x)) + 1) / 2.0, 'y': len(list_filter(p, lambda w: w.y < u.y)) + (len(list_filter(p, lambda w: w.y = u.y)) + 1) / 2.0}}) AS rk,
            list_filter(p, lambda u: u.y >= list_reverse_sort(list_transform(p, lambda w: w.y))[least(2, len(p))]) AS top,
            list_filter(p, lambda u: u.y >= list_reverse_sort(list_transform(p, lambda w: w.y))[least(3, len(p))]) AS top3
        FROM h
    )""",
    "k",
)

# --- assets of a date --------------------------------------------------------------------------

_M = "(CASE WHEN y > 1 THEN x END)"
_N = "(count(x) OVER w)"
family(
    "fx_cs_reduce",
    "daily",
    {
        "cs_mean_": ("cs_mean(x, y > 1)", f"avg({_M}) {CS}"), "cs_sum_": ("cs_sum(x)", f"sum(x) {CS}"), "cs_std_": ("cs_std(x)", f"sqrt({_var('x', CS)})"), "cs_var_": ("cs_var(x)", f"var_pop(x) {CS}"),
        "cs_median_": ("cs_median(x, y > 1)", f"median({_M}) {CS}"), "cs_quantile_": ("cs_quantile(x, q=0.2)", f"quantile_cont(x, 0.2) {CS}"), "cs_max_": ("cs_max(x)", f"max(x) {CS}"), "cs_min_": ("cs_min(x)", f"min(x) {CS}"),
        "cs_skew_": ("cs_skew(x)", f"CASE WHEN count(x) {CS} >= 3 THEN skewness(x) {CS} END"),
        "cs_kurt_": ("cs_kurt(x)", f"CASE WHEN count(x) {CS} >= 4 THEN kurtosis(x) {CS} + 3 END"),
        "cs_cv_": ("cs_cv(x)", f"stddev_pop(x) {CS} / nullif(avg(x) {CS}, 0)"), "cs_mad_": ("cs_mad(x)", f"median(abs(x - md)) {CS}"),
        "cs_entropy_": ("cs_entropy(x)", f"ln(sum(x) {CS}) - (sum(CASE WHEN x > 0 THEN x * ln(x) END) {CS}) / (sum(x) {CS})"), "cs_count_": ("cs_count(x, y > 1)", f"count({_M}) {CS}"),
        "cs_cumprod_": ("cs_cumprod(y / 1000)", f"product(1 + y / 1000) {CS}"), "cs_cov_": ("cs_cov(x, y)", f"covar_samp(x, y) {CS}"), "cs_beta_": ("cs_beta(y, x)", f"(covar_pop(x, y) {CS}) / nullif({_var('y', CS)}, 0)"),
        "cs_corr_": ("cs_corr(x, y)", _corr("x", "y", CS)), "cs_spearman_": ('cs_corr(x, y, method="spearman")', _corr("rx", "ry", CS)),
        "cs_rel_entropy_": ("cs_rel_entropy(x, y)", f"sum(x / sx * ln((x / sx) / (y / sy))) {CS}"), "cs_count_of_mean": ("cs_count(cs_mean(x))", f"CASE WHEN count(x) {CS} > 0 THEN 1 ELSE 0 END"),
    },
    f""", h AS (
        SELECT *, median(x) {CS} AS md, sum(x) {CS} AS sx, sum(y) {CS} AS sy,
            CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY t, s ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY t, s, x) - 1) / 2.0 END AS rx,
            CASE WHEN y IS NOT NULL THEN rank() OVER (PARTITION BY t, s ORDER BY y NULLS LAST) + (count(*) OVER (PARTITION BY t, s, y) - 1) / 2.0 END AS ry FROM g
    )""",
    "h",
)


def _ordinal(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN row_number() OVER (PARTITION BY t, s ORDER BY {x} NULLS LAST, a) / (count({x}) {CS})::DOUBLE END)"


def _ols(y: str, e: str) -> str:
    py, pe = f"(CASE WHEN {e} IS NOT NULL THEN {y} END)", f"(CASE WHEN {y} IS NOT NULL THEN {e} END)"
    return f"CASE WHEN count({pe}) {CS} >= 2 THEN {y} - avg({py}) {CS} - coalesce((covar_pop({py}, {pe}) {CS}) / nullif({_var(pe, CS)}, 0), 0) * ({e} - avg({pe}) {CS}) END"


family(
    "fx_cs_transform",
    "daily",
    {
        "cs_zscore_": ("cs_zscore(x, y > 1)", f"(x - avg({_M}) {CS}) / nullif(sqrt({_var(_M, CS)}), 0)"), "rank_": ("rank(y)", _ordinal("y")), "rank_masked": ("rank(x, y > 1)", _ordinal(_M)),
        "winsorize_": ("winsorize(x, lower=0.1, upper=0.8)", f"CASE WHEN x IS NOT NULL THEN least(greatest(x, quantile_cont(x, 0.1) {CS}), quantile_cont(x, 0.8) {CS}) END"),
        "neutralize_": ("neutralize(x, y)", _ols("x", "y")), "ols_": ("ols(x, y)", _ols("y", "x")), "cs_min_max_scale_": ("cs_min_max_scale(x)", f"(x - min(x) {CS}) / nullif(max(x) {CS} - min(x) {CS}, 0)"),
        "location_": ("location(x)", "CASE WHEN x IS NOT NULL THEN a + 1 END"), "umr_": ("umr(x, y)", f"(x - avg(x) {CS}) * y"),
        "rank_add_": ("rank_add(x, y)", f"{_ordinal('x')} + {_ordinal('y')}"), "rank_sub_": ("rank_sub(x, y)", f"{_ordinal('x')} - {_ordinal('y')}"),
        "rank_mul_": ("rank_mul(x, y)", f"{_ordinal('x')} * {_ordinal('y')}"), "rank_div_": ("rank_div(x, y)", f"{_ordinal('x')} / {_ordinal('y')}"),
    },
)


def _polynomial(r: str, powers) -> str:
    out = repr(powers[0])
    for c in powers[1:]:
        out = f"({out} * {r} + {c!r})"
    return out


def _inverse_erf(y: str) -> str:
    """Normal percentage point of (y + 1) / 2 over the root of two, by the same published coefficients."""
    near, far = f"(0.180625 - {y} * {y} / 4)", f"(sqrt(-ln(0.5 - abs({y}) / 2)) - 1.6)"
    centre = f"{y} / 2 * {_polynomial(near, CENTRE[0])} / {_polynomial(near, CENTRE[1])}"
    return f"(CASE WHEN abs({y}) <= 0.85 THEN {centre} ELSE sign({y}) * {_polynomial(far, TAILS[0])} / {_polynomial(far, TAILS[1])} END) / sqrt(2)"


family(
    "fx_gauss_rank",
    "daily",
    {name: (f, _inverse_erf(f"greatest(least({v}, 0.999999), -0.999999)") + f" + 0 * {v}") for name, f, v in (("gauss_rank", "cs_gauss_rank(x)", "gx"), ("gauss_rank_masked", "cs_gauss_rank(x, y > 1)", "gm"), ("gauss_rank_ties", "cs_gauss_rank(y)", "gy"))},
    f", h AS (SELECT *, ({_ordinal('x')} - 0.5) * 2 AS gx, ({_ordinal(_M)} - 0.5) * 2 AS gm, ({_ordinal('y')} - 0.5) * 2 AS gy FROM g)",
    "h",
)
_G = "OVER (PARTITION BY t, s, nation)"
_WX, _WW = "(CASE WHEN balance > 0 THEN x END)", "(CASE WHEN balance > 0 AND x IS NOT NULL THEN balance END)"
_IN = "(CASE WHEN balance > 0 THEN x END)"
family(
    "fx_group_member",
    "items",
    {
        "group_mean_": ("group_mean(x, nation)", f"avg(x) {_G}"), "group_sum_": ("group_sum(x, nation)", f"sum(x) {_G}"), "group_std_": ("group_std(x, nation)", f"sqrt({_var('x', _G)})"), "group_demean_": ("group_demean(x, nation)", f"x - avg(x) {_G}"),
        "group_zscore_": ("group_zscore(x, nation)", f"(x - avg(x) {_G}) / nullif(sqrt({_var('x', _G)}), 0)"), "group_mean_weighted": ("group_mean(x, nation, weight=balance)", f"(sum({_WX} * balance) {_G}) / (sum({_WW}) {_G})"),
        "group_mean_masked": ("group_mean(x, nation, y > 300)", f"CASE WHEN y > 300 THEN avg(CASE WHEN y > 300 THEN x END) {_G} END"),
        "member_mean_": ("member_mean(x, balance > 0)", f"avg({_IN}) {CS}"), "member_sum_": ("member_sum(x, balance > 0)", f"sum({_IN}) {CS}"), "member_std_": ("member_std(x, balance > 0)", f"sqrt({_var(_IN, CS)})"),
        "member_mean_weighted": ("member_mean(x, balance > 0, weight=balance)", f"(sum({_WX} * balance) {CS}) / (sum({_WW}) {CS})"),
        "member_demean_": ("member_demean(x, balance > 0)", f"CASE WHEN balance > 0 THEN x - avg({_IN}) {CS} END"), "member_zscore_": ("member_zscore(x, balance > 0)", f"CASE WHEN balance > 0 THEN (x - avg({_IN}) {CS}) / nullif(sqrt({_var(_IN, CS)}), 0) END"),
        "index_member_stat_": ('index_member_stat(x, balance > 0, method="sum")', f"sum({_IN}) {CS}"),
    },
)

# --- steps -------------------------------------------------------------------------------------

_ST = "OVER (PARTITION BY t, a)"
_FLAT = "OVER (PARTITION BY a ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"
_AT = "(max(CASE WHEN s = {} THEN x END) OVER (PARTITION BY t, a))"
_SL = "(lag(x) OVER (PARTITION BY t, a ORDER BY s))"
family(
    "fx_steps",
    "steps",
    {
        "step_mean_": ("step_mean(x)", f"avg(x) {_ST}"), "step_sum_": ("step_sum(x)", f"coalesce(sum(x) {_ST}, 0)"), "step_std_": ("step_std(x)", f"sqrt({_var('x', _ST)})"), "step_max_": ("step_max(x)", f"max(x) {_ST}"), "step_min_": ("step_min(x)", f"min(x) {_ST}"),
        "step_first_": ("step_first(x)", _AT.format(0)), "step_last_": ("step_last(x)", _AT.format(3)), "get_step_": ("get_step(x, -2)", _AT.format(2)),
        "slice_step_": ("step_sum(slice_step(x, 1, 3))", f"coalesce(sum(CASE WHEN s IN (1, 2) THEN x END) {_ST}, 0)"),
        "step_kurtosis_": ("step_kurtosis(x)", f"CASE WHEN count(x) {_ST} >= 4 THEN kurtosis(x) {_ST} END"),
        "step_corr_": ("step_corr(x, y)", f"CASE WHEN var_pop(x) {_ST} > 0 AND var_pop(y) {_ST} > 0 THEN (covar_pop(x, y) {_ST}) / (stddev_pop(x) {_ST}) / (stddev_pop(y) {_ST}) END"),
        "step_delay_": ("step_delay(x)", _SL), "step_diff_": ("step_diff(x)", f"x - {_SL}"), "step_pct_change_": ("step_pct_change(x)", f"CASE WHEN {_SL} <> 0 THEN (x - {_SL}) / {_SL} ELSE x - {_SL} END"),
        "intraday_flat_mean_": ("intraday_flat_mean(x, window_days=3)", f"CASE WHEN t >= 2 THEN avg(x) {_FLAT} END"), "intraday_flat_std_": ("intraday_flat_std(x, 3)", f"CASE WHEN t >= 2 THEN sqrt({_var('x', _FLAT)}) END"),
        "intraday_by_step_mean_": ("intraday_by_step_mean(x, 3)", f"CASE WHEN t >= 2 THEN avg(x) {_over(3)} END"), "intraday_by_step_std_": ("intraday_by_step_std(x, 3)", f"CASE WHEN t >= 2 THEN sqrt({_var('x', _over(3))}) END"),
        "select_step": ("select_by_pos(x, 1, axis=2, keepdims=True)", _AT.format(1)), "cs_by_step": ("cs_mean(x)", f"avg(x) {CS}"),
    },
)
_DAY = {"mean": f"avg(x) {_ST}", "sum": f"coalesce(sum(x) {_ST}, 0)", "std": f"sqrt({_var('x', _ST)})", "last": _AT.format(3)}
family("fx_resample", "steps", {f"resample_{m}": (f'resample(x, "1d", "{m}")', v) for m, v in _DAY.items()} | {"get_hf_resample": ('get_hf("stk", "60min", "x", "1d", "sum")', _DAY["sum"])}, output="(SELECT * FROM g)")
family(
    "fx_align",
    "steps",
    {"align_frequency_": ('align_frequency(x, "30min", "ffill")', "x")},
    ", f AS (SELECT g.* EXCLUDE (step), [930, 1000, 1030, 1100, 1300, 1330, 1400, 1430][2 * s + j + 1] AS step FROM g CROSS JOIN (SELECT unnest([0, 1]) AS j))",
    "f",
    freq="30min",
)
family(
    "fx_assets",
    "daily",
    {
        "select_by_pos_": ("x - select_by_pos(x, 3, axis=1, keepdims=True)", "x - (max(CASE WHEN a = 3 THEN x END) OVER (PARTITION BY t))"),
        "select_asset_": ("x - select_asset(x, 2)", "x - (max(CASE WHEN asset = 2 THEN x END) OVER (PARTITION BY t))"),
    },
)
family(
    "fx_lookup",
    "daily",
    {"project_": ("project_stk_to_cb(x)", "b.x"), "lookup_by_col_": ('lookup_by_col(y, get_lf("cb", "underlying_stk"))', "b.y")},
    ", m AS (SELECT g.t, g.date, g.asset + 1000 AS asset, g.step, (g.asset * 7 + 3) % 10 AS c FROM g)",
    "m LEFT JOIN g b ON b.t = m.t AND b.a = m.c",
    asset="cb",
    select="m.date, m.asset, m.step",
)


# --- sources, sinks and the stream --------------------------------------------------------------


def source_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Latest order value of a customer's stand-in at each shipment, 1 where there is none yet."""
    from gridloom.sources.builders import as_of

    items = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("key"), "l_shipdate")
    orders = _table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderdate", "o_totalprice")
    out = as_of(items, orders, "key", "l_shipdate", "o_orderdate", "o_totalprice", "factor", 1.0)
    return out.select("l_orderkey", "l_linenumber", "key", F.round("factor", 6).alias("factor"))


def source_any_flag(spark: SparkSession, sf: str) -> DataFrame:
    from gridloom.sources.builders import any_flag

    t = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1).alias("a"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("b"))
    return any_flag(t, "l_orderkey", "l_linenumber", ("a", "b")).select(F.col("date").alias("l_orderkey"), F.col("code").alias("l_linenumber"), "untradable")


def source_point_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's last three orders as reports, the oldest at step 0."""
    from pyspark.sql import Window

    from gridloom.sources.builders import point_in_time

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    t = _table(spark, sf, "orders").select(F.lit("20990101").alias("d"), "o_custkey", F.date_add(F.to_date("o_orderdate"), 30).alias("pub"), F.to_date("o_orderdate").alias("ended"), F.row_number().over(w).alias("rank"), "o_totalprice")
    return point_in_time(t, "d", "o_custkey", "pub", "ended", "rank", "o_totalprice", 3, 10)


def _months(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))


def source_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A configured table end to end: a whitelist of fields, rows that must not repeat, a default for absent ones."""
    from gridloom.sources.catalog import Catalog

    best = _months(spark, sf).groupBy("month", "o_custkey").agg(F.max("o_totalprice").alias("best"), F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    orders = {"frame": best, "asset": "stk", "date": "month", "code": "o_custkey", "fields": ["best", "total"], "defaults": {"best": 0.0}}
    provider = Catalog(spark, {"orders": orders}, axes={"stk": {"frame": _table(spark, sf, "orders"), "code": "o_custkey"}}).provider()
    days = provider.calendar()
    batch = FormulaBatch.from_text('b = get_lf("stk", "best")\nt = get_lf("stk", "total")', {"recent": "recent = ts_sum(b, 3, min_periods=1)", "share": "share = t / cs_sum(t)"})
    return rounded(Engine(spark, provider).compute(batch, Domain(days[0], days[-1])), ["recent", "share"])


def source_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports known at a date, by get_fund's parameters: each customer's last orders stand for reports published up to a month late."""
    from pyspark.sql import Window

    from gridloom.sources.catalog import Catalog

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = _months(spark, sf).withColumn("last", F.row_number().over(Window.partitionBy("o_custkey", "month").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    past = [F.struct(F.lit(r).alias("rank"), F.lag("o_totalprice", r - 1).over(w).alias("price"), F.lag("o_orderkey", r - 1).over(w).alias("key"), F.lag("o_orderdate", r - 1).over(w).alias("ended")) for r in (1, 2, 3, 4)]
    known = o.withColumn("past", F.array(*past)).select("month", "o_custkey", "last", F.explode("past").alias("p")).filter("last = 1 AND p.key IS NOT NULL").select("month", "o_custkey", "p.rank", "p.price", F.to_date("p.ended").alias("ended"), F.date_add(F.to_date("p.ended"), (F.col("p.key") % 60 - 30).cast("int")).alias("published"))
    reports = {"frame": known, "asset": "stk", "date": "month", "code": "o_custkey", "fields": ["price"], "reports": ["published", "ended", "rank"]}
    provider = Catalog(spark, {"reports": reports}).provider()
    days = provider.calendar()
    formulas = {"newest": 'o = get_step(get_fund("stk", "price", quarters=3, publ_date_limit=0), 2)', "oldest": 'o = get_step(get_fund("stk", "price", quarters=3, publ_date_limit=0), 0)', "any": 'o = step_sum(get_fund("stk", "price", quarters=2))', "one": 'o = get_fund("stk", "price")'}
    return rounded(Engine(spark, provider).compute(FormulaBatch.from_text("", formulas), Domain(days[0], days[-1])), list(formulas))


def source_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A table with outer codes (supplier names), read through the code map; bonds (customers) point to stocks by code."""
    from gridloom.sources.builders import bond_stocks
    from gridloom.sources.catalog import Catalog

    supplier, customer = _table(spark, sf, "supplier"), _table(spark, sf, "customer")
    items = _table(spark, sf, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("month"), "l_suppkey").agg(F.sum("l_quantity").alias("x"))
    named = items.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").drop("l_suppkey")
    bonds = bond_stocks(customer, customer.select("c_custkey", (F.col("c_custkey") % 50 + 1).alias("under")), "c_custkey", "c_nationkey", "under", (1, 2, 3))
    config = {
        "sales": {"frame": named, "asset": "stk", "date": "month", "code": "s_name", "identity": "outer", "unmatched": "fail"},
        "bonds": {"frame": bonds, "asset": "cb", "code": "code", "static": True, "rename": {"underlying_stk": "stock"}, "fields": ["underlying_stk"], "kinds": {"underlying_stk": "code"}, "positions": {"underlying_stk": "stk"}},
    }
    axes = {"stk": {"frame": supplier, "code": "s_suppkey"}}
    provider = Catalog(spark, config, axes=axes, codes={"stk": {"frame": supplier, "outer": "s_name", "inner": "s_suppkey"}}).provider()
    days = provider.calendar()
    out = Engine(spark, provider).compute(FormulaBatch.from_lines('under = project_stk_to_cb(ts_sum(get_lf("stk", "x"), 2, min_periods=1))'), Domain(days[0], days[-1], asset="cb"))
    return rounded(out, ["under"])


def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour bars by event type, from a stream over the events file: closed windows from the sink, open ones from their events."""
    from gridloom.streaming.bars import stream_to_bars

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    read = lambda reader: reader.schema(schema).option("pathGlobFilter", "events*.parquet")
    stamped = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    bars = stream_to_bars(stamped(read(spark.readStream).parquet(sf)), stamped(spark.read.parquet(f"{sf}/events.parquet")), "ts", "event_type", "value")
    return bars.select(F.date_format("start", "yyyyMMddHH").alias("start"), "code", F.round("x", 6).alias("x"), "y")


QUERIES |= {f.__name__: f for f in (source_as_of, source_any_flag, source_point_in_time, source_catalog, source_reports, source_codes, stream_bars)}
ORACLE_SQL |= {
    "source_as_of": """
        WITH o AS (SELECT o_custkey AS key, o_orderdate, max(o_totalprice) AS v FROM orders GROUP BY 1, 2)
        SELECT l_orderkey, l_linenumber, l_suppkey AS key, round(coalesce(v, 1), 6) AS factor FROM lineitem l ASOF LEFT JOIN o ON l.l_suppkey = o.key AND l.l_shipdate >= o.o_orderdate
    """,
    "source_any_flag": "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS untradable FROM lineitem",
    "source_point_in_time": """
        SELECT '20990101' AS date, o_custkey AS code, CAST(3 - r AS INT) AS step, o_totalprice
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3
    """,
    "source_catalog": """
        WITH r AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS date, o_custkey AS asset, max(o_totalprice) AS b, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2),
        g AS (SELECT date, asset, coalesce(b, 0) AS b, t FROM (SELECT DISTINCT date FROM r) CROSS JOIN (SELECT DISTINCT asset FROM r) LEFT JOIN r USING (date, asset))
        SELECT date, asset, 0 AS step, round(sum(b) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS recent, round(t / sum(t) OVER (PARTITION BY date), 6) AS share FROM g
    """,
    "source_reports": """
        WITH o AS (SELECT *, date_trunc('month', o_orderdate) AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
        ends AS (SELECT o_custkey AS c, m, max(n) AS n FROM o GROUP BY 1, 2),
        known AS (
            SELECT c, ends.m, ends.n - o.n + 1 AS r, o_totalprice AS v, o_orderkey % 60 - 30 AS late
            FROM ends JOIN o ON o.o_custkey = c AND o.n BETWEEN ends.n - 3 AND ends.n
        ),
        v AS (
            SELECT c, m, max(v) FILTER (r = 1 AND late >= 0) AS newest, max(v) FILTER (r = 3 AND late >= 0) AS oldest, sum(v) FILTER (r <= 2) AS s, max(v) FILTER (r = 1) AS one FROM known GROUP BY 1, 2
        )
        SELECT strftime(d.m, '%Y%m%d') AS date, a.c AS asset, 0 AS step, round(newest, 6) AS newest, round(oldest, 6) AS oldest, round(coalesce(s, 0), 6) AS "any", round(one, 6) AS one
        FROM (SELECT DISTINCT m FROM ends) d CROSS JOIN (SELECT DISTINCT c FROM ends) a LEFT JOIN v ON v.m = d.m AND v.c = a.c
    """,
    "source_codes": """
        WITH x AS (SELECT date_trunc('month', l_shipdate) AS m, l_suppkey AS s, sum(l_quantity) AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
        g AS (SELECT d.m, s_suppkey AS s, x FROM (SELECT DISTINCT m FROM x) d CROSS JOIN supplier LEFT JOIN x ON x.m = d.m AND x.s = s_suppkey),
        w AS (SELECT m, s, sum(x) OVER (PARTITION BY s ORDER BY m ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM g),
        b AS (SELECT c_custkey AS c, c_custkey % 50 + 1 AS s FROM customer WHERE c_nationkey IN (1, 2, 3))
        SELECT strftime(d.m, '%Y%m%d') AS date, c AS asset, 0 AS step, round(v, 6) AS under FROM (SELECT DISTINCT m FROM x) d CROSS JOIN b LEFT JOIN w ON w.m = d.m AND w.s = b.s
    """,
    "stream_bars": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y%m%d%H') AS start, event_type AS code, round(sum(value), 6) AS x, count(*) AS y FROM events GROUP BY 1, 2",
}
