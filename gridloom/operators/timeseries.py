"""Lags, rolling windows, and the step axis.

On the dense grid a frame of rows is a frame of calendar positions. Statistics without a native framed form work on the
window's own values as an array, which is at most ``window`` long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import clamped, corr, fin, fused, ratio, var_pop
from gridloom.operators.spec import NUMERIC, REQUIRED, STEP, CompileError, Operator, check_axis, register

_N, _NN = (NUMERIC,), (NUMERIC, NUMERIC)


def _back(name):
    return lambda p: (p[name] or 0) if p.get("axis", 0) == 0 else 0


def _history(p):
    return p["window"] - 1 if p["axis"] == 0 else 0


def _lagged(s, x, periods, axis):
    return x if periods == 0 else F.lag(x, periods).over(s.along(axis))


def _fill(s, x, axis, limit):
    first = Window.unboundedPreceding if limit is None else -limit
    return F.last(x, ignorenulls=True).over(s.along(axis).rowsBetween(first, 0))


def _ffill_check(p):
    check_axis(p)
    if p.get("axis", 0) == 0 and p["limit"] is None:
        raise CompileError("ffill along dates needs a limit")


register(
    Operator("delay", _N, lambda s, x, periods, axis: _lagged(s, x, periods, axis), params={"periods": 1, "axis": 0}, lookback=_back("periods"), check=check_axis),
    Operator("ffill", _N, lambda s, x, axis, limit: _fill(s, x, axis, limit), params={"axis": 0, "limit": None}, lookback=_back("limit"), check=_ffill_check),
    Operator("ts_ffill", _N, lambda s, x, limit: _fill(s, x, 0, limit), params={"limit": None}, lookback=_back("limit"), check=_ffill_check),
    Operator("ts_diff", _N, lambda s, x, periods, axis: fin(x - _lagged(s, x, periods, axis)), params={"periods": 1, "axis": 0}, lookback=_back("periods"), check=check_axis),
    Operator("ts_pct_change", _N, lambda s, x, periods, axis: ratio(x - (p := _lagged(s, x, periods, axis)), p), params={"periods": 1, "axis": 0}, lookback=_back("periods"), check=check_axis),
    Operator("step_delay", _N, lambda s, x, periods: _lagged(s, x, periods, 2), params={"periods": 1}, check=check_axis),
    Operator("step_diff", _N, lambda s, x, periods: fin(x - _lagged(s, x, periods, 2)), params={"periods": 1}, check=check_axis),
    # a previous value of 0 gives the plain difference here, unlike ts_pct_change
    Operator("step_pct_change", _N, lambda s, x, periods: fin(F.when((p := _lagged(s, x, periods, 2)) != 0, F.try_divide(x - p, p)).otherwise(x - p)), params={"periods": 1}, check=check_axis),
)


def _rolling(name, f, window=5, inputs=1, least=1, before=None, after=None):
    """f(stage, frame aggregate, columns, parameters); a result needs min_periods complete samples.

    ``before`` and ``after``: parameters that come before and after the window."""

    def build(s, *columns, window, min_periods, axis, **p):
        over = s.last(axis, window)
        agg = lambda c: c.over(over)
        whole = columns[0] if inputs == 1 else F.when(columns[0].isNotNull() & columns[1].isNotNull(), columns[0])
        need = max(min_periods or window, least)
        return F.when(agg(F.count(whole)) >= need, f(s, agg, *columns, axis=axis, **p))

    register(Operator(name, (NUMERIC,) * inputs, build, params={**(before or {}), "window": window, **(after or {}), "min_periods": None, "axis": 0}, lookback=_history, check=check_axis))


def _argument(s, agg, x, axis, largest):
    at = s.position(axis)
    if largest:  # of equal values the most recent
        return (at - agg(F.max(F.when(x.isNotNull(), F.struct(x.alias("v"), at.alias("t")))))["t"]).cast("double")
    return (at + agg(F.min(F.when(x.isNotNull(), F.struct(x.alias("v"), (-at).alias("t")))))["t"]).cast("double")


def _rank(s, agg, x, axis):
    values = s.temp(agg(F.collect_list(x)))
    n = F.size(values)
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull(), F.when(n == 1, F.lit(0.5)).otherwise(F.try_divide(below + 0.5 * (equal - 1), (n - 1).cast("double"))))


def _sum(values: Column, f) -> Column:
    return F.aggregate(F.transform(values, f), F.lit(0.0), lambda a, v: a + v)


def _ewm(s, agg, x, axis, halflife, deviation):
    at = s.position(axis)
    held = s.temp(agg(F.collect_list(F.when(x.isNotNull(), F.struct(at.alias("t"), x.alias("x"))))))
    weight = lambda v: F.exp((v["t"] - at) * (math.log(2) / halflife))
    total = s.temp(_sum(held, weight))
    mean = s.temp(ratio(_sum(held, lambda v: weight(v) * v["x"]), total))
    if not deviation:
        return mean
    square = ratio(_sum(held, lambda v: weight(v) * v["x"] * v["x"]), total)
    return F.sqrt(clamped(ratio(_sum(held, lambda v: weight(v) * (v["x"] - mean) * (v["x"] - mean)), total), square, mean))


def _pairs(s, agg, x, y):
    return s.temp(agg(F.collect_list(F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))))))


def _moments(s, pairs, stat):
    n = F.size(pairs).cast("double")

    def mean_of(f):
        return F.try_divide(_sum(pairs, f), n)

    mean = {"x": s.temp(mean_of(lambda v: v["x"])), "y": s.temp(mean_of(lambda v: v["y"]))}
    if stat == "mean":
        return mean["x"]

    def variance(c):
        return s.temp(clamped(mean_of(lambda v: (v[c] - mean[c]) * (v[c] - mean[c])), mean_of(lambda v: v[c] * v[c]), mean[c]))

    vx = variance("x")
    if stat == "std":
        return F.sqrt(vx)
    vy = variance("y")
    shared = mean_of(lambda v: (v["x"] - mean["x"]) * (v["y"] - mean["y"]))
    return F.when((n >= 2) & (vx > 0) & (vy > 0), fin(F.try_divide(shared, F.sqrt(vx) * F.sqrt(vy))))


def _rank_corr(s, agg, x, y, axis):
    pairs = _pairs(s, agg, x, y)
    middle = lambda v, c: F.size(F.filter(pairs, lambda u: u[c] < v[c])) + (F.size(F.filter(pairs, lambda u: u[c] == v[c])) + 1) / 2.0
    return _moments(s, s.temp(F.transform(pairs, lambda v: F.struct(middle(v, "x").alias("x"), middle(v, "y").alias("y")))), "corr")


def _split(stat):
    def f(s, agg, x, y, axis, top):
        pairs = _pairs(s, agg, x, y)
        edge = s.temp(F.get(F.sort_array(F.transform(pairs, lambda v: v["y"]), asc=False), F.least(F.lit(top), F.size(pairs)) - 1))
        return _moments(s, s.temp(F.filter(pairs, lambda v: v["y"] >= edge)), stat)

    return f


def _shared(pairs):
    """Updated in the order of the pairs, each product added without rounding in between: n, means, sums of products."""

    def add(a, v):
        n = a["n"] + 1
        x, y = a["x"] + (v["x"] - a["x"]) / n, a["y"] + (v["y"] - a["y"]) / n
        square = {c + c: a[c + c] + (v[c] - m) * (v[c] - a[c]) for c, m in (("x", x), ("y", y))}
        got = {"n": n, "x": x, "y": y, "xy": fused(v["y"] - a["y"], v["x"] - x, a["xy"]), **square}
        return F.struct(*[c.alias(k) for k, c in got.items()])

    return F.aggregate(pairs, F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xy", "xx", "yy")]), add)


def _cov(s, agg, x, y, axis):
    m = s.temp(_shared(_pairs(s, agg, x, y)))
    return F.when(m["n"] >= 2, fin(m["xy"] / (m["n"] - 1)))


def _beta(s, agg, x, y, axis):
    """Slope of y on x."""
    m, on = s.temp(_shared(_pairs(s, agg, y, x))), F.when(y.isNotNull(), x)
    v = clamped(F.try_divide(m["yy"], m["n"]), agg(F.avg(on * on)), agg(F.avg(on)))
    return F.when((m["n"] >= 2) & (v > 0), ratio(m["xy"] / m["n"], v))


def _slope_on_time(s, agg, x, axis):
    t = F.when(x.isNotNull(), s.position(axis).cast("double"))
    return ratio(agg(F.covar_pop(t, x)), agg(F.var_pop(t)))


_rolling("ts_mean", lambda s, agg, x, axis: agg(F.avg(x)))
_rolling("ts_sum", lambda s, agg, x, axis: agg(F.sum(x)))
_rolling("ts_std", lambda s, agg, x, axis: F.sqrt(var_pop(x, agg)))
_rolling("ts_var", lambda s, agg, x, axis: var_pop(x, agg))
_rolling("ts_min", lambda s, agg, x, axis: agg(F.min(x)))
_rolling("ts_max", lambda s, agg, x, axis: agg(F.max(x)))
_rolling("ts_max_to_min", lambda s, agg, x, axis: agg(F.max(x)) - agg(F.min(x)))
_rolling("ts_median", lambda s, agg, x, axis: agg(F.percentile(x, 0.5)))
_rolling("ts_quantile", lambda s, agg, x, axis, quantile: agg(F.percentile(x, float(quantile))), window=10, after={"quantile": 0.5})
_rolling("ts_argmin", lambda s, agg, x, axis: _argument(s, agg, x, axis, False))
_rolling("ts_argmax", lambda s, agg, x, axis: _argument(s, agg, x, axis, True))
_rolling("ts_rank", _rank)
_rolling("ts_cumprod", lambda s, agg, x, axis: fin(agg(F.product(1 + x))))
_rolling("ts_tbeta", _slope_on_time, least=2)
_rolling("ts_ewm_mean", lambda s, agg, x, axis, halflife: _ewm(s, agg, x, axis, halflife, False), window=10, before={"halflife": 5})
_rolling("ts_ewm_std", lambda s, agg, x, axis, halflife: _ewm(s, agg, x, axis, halflife, True), window=10, before={"halflife": 5})
_rolling("ts_corr", lambda s, agg, x, y, axis: corr(x, y, agg), inputs=2, least=2)
_rolling("ts_cov", _cov, inputs=2, least=2)
_rolling("ts_beta", _beta, inputs=2, least=2)
_rolling("ts_rankcorr", _rank_corr, inputs=2, least=2)
for _name in ("mean", "std", "corr"):
    _rolling(f"ts_split_{_name}", _split(_name), inputs=2, after={"top": 1})

# --- the step axis ---------------------------------------------------------------------------


def _plain(c: Column) -> Column:
    return c


def _kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    v = F.var_pop(x)
    return F.when((n >= 4) & (v > 0), fin((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)))


def _steps(name, f, inputs=1):
    register(Operator(name, (NUMERIC,) * inputs, lambda s, *c: {"v": f(*c)}, shape="step", finish=lambda s, got: got["v"]))


_steps("step_mean", F.avg)
_steps("step_sum", lambda x: F.coalesce(F.sum(x), F.lit(0.0)))  # nothing sums to 0 on this axis
_steps("step_std", lambda x: F.sqrt(var_pop(x, _plain)))
_steps("step_max", F.max)
_steps("step_min", F.min)
_steps("step_first", lambda x: F.min_by(x, F.col(STEP)))
_steps("step_last", lambda x: F.max_by(x, F.col(STEP)))
_steps("step_kurtosis", _kurtosis)


def _step_pairs(s, x, y):
    return {"v": F.array_sort(F.collect_list(F.when(x.isNotNull() & y.isNotNull(), F.struct(F.col(STEP).alias("at"), x.alias("x"), y.alias("y")))))}


def _step_corr(s, got):
    m = s.temp(_shared(got["v"]))
    vx, vy = F.try_divide(m["xx"], m["n"]), F.try_divide(m["yy"], m["n"])
    return F.when((vx > 0) & (vy > 0), fin(m["xy"] / m["n"] / F.sqrt(vx) / F.sqrt(vy)))


register(Operator("step_corr", _NN, _step_pairs, shape="step", finish=_step_corr))


def _flat(deviation):
    def aggregates(s, x, window_days):
        return {"n": F.count(x).cast("double"), "sum": F.sum(x), "square": F.sum(x * x)}

    def finish(s, got, window_days):
        over = s.last(0, window_days)
        n, total = F.sum(got["n"]).over(over), F.sum(got["sum"]).over(over)
        mean = F.try_divide(total, n)
        value = mean
        if deviation:
            square = F.try_divide(F.sum(got["square"]).over(over), n)
            value = F.sqrt(F.greatest(clamped(square - mean * mean, square, mean), F.lit(0.0)))
        return F.when((s.position(0) >= window_days - 1) & (n > 0), value)

    return aggregates, finish


def _days(p):
    return p["window_days"] - 1


for _name, _dev in (("mean", False), ("std", True)):
    _aggregates, _finish = _flat(_dev)
    register(
        Operator(f"intraday_flat_{_name}", _N, _aggregates, params={"window_days": REQUIRED}, shape="step", finish=_finish, lookback=_days, check=check_axis),
        Operator(
            f"intraday_by_step_{_name}",
            _N,
            lambda s, x, window_days, dev=_dev: F.when(
                s.position(0) >= window_days - 1, F.sqrt(var_pop(x, lambda c: c.over(s.last(0, window_days)))) if dev else F.avg(x).over(s.last(0, window_days))
            ),
            params={"window_days": REQUIRED},
            lookback=_days,
            check=check_axis,
        ),
    )
register(
    Operator("get_step", _N, None, params={"step": 0}, shape="get_step"),
    Operator("slice_step", _N, None, params={"start": None, "end": None}, shape="slice_step"),
    Operator("resample", _N, None, params={"target_freq": None, "method": None}, shape="resample"),
    Operator("align_frequency", _N, None, params={"target_freq": None, "method": None}, shape="align"),
)
