"""Column helpers: finite values, population moments, correlations. Missing is NULL and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: Relative size under which a variance counts as zero (fixed value).
TINY = 1e-12


def fin(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(F.abs(c) < F.lit(INF), c)


def tristate(c: Column) -> Column:
    """A mask of 0, 1 or nothing as a boolean; any other number fails the query."""
    c = fin(c.cast("double"))
    return F.when(c == 0, F.lit(False)).when(c == 1, F.lit(True)).when(c.isNotNull(), F.raise_error(F.lit("a mask is 0 or 1")))


def ratio(a: Column, b: Column) -> Column:
    return fin(F.try_divide(a, b))


def clamped(v: Column, mean_square: Column, mean: Column) -> Column:
    """A population variance, zero where it is tiny against the size of the values."""
    return F.when(F.abs(v) <= TINY * F.greatest(F.lit(1.0), mean_square, mean * mean), F.lit(0.0)).otherwise(v)


Agg = Callable[[Column], Column]


def _whole(x: Column) -> Column:
    """2^-20ths, which add up without error below 2^33."""
    return F.when(F.abs(x) < 2.0**32, F.rint(x * 2.0**20) / 2.0**20).otherwise(x)


def stable_sum(x: Column, agg: Agg) -> Column:
    """A sum that keeps six places whatever the order: whole 2^-20ths add up without error below 2^33, the rests apart from them."""
    return agg(F.sum(_whole(x))) + agg(F.sum(x - _whole(x)))


def stable_mean(x: Column, agg: Agg) -> Column:
    """The mean to its last bit whatever the order: what the division leaves is divided once more."""
    whole, rest, n = agg(F.sum(_whole(x))), agg(F.sum(x - _whole(x))), agg(F.count(x)).cast("double")
    mean = F.try_divide(whole + rest, n)
    return mean + F.try_divide(fused(-mean, n, whole) + rest, n)


def let(f: Callable[[Column], Column], **values: Column) -> Column:
    """``f`` of a struct of the values, each of which is worked out once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f)[0]


def fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` rounded once: what the product and the sum round off is added back."""

    def high(v):
        return v * 134217729.0 - (v * 134217729.0 - v)

    def total(u):
        low, below, z = u["a"] - u["h"], u["b"] - u["k"], u["s"] - u["c"]
        product = ((u["h"] * u["k"] - u["p"]) + u["h"] * below + low * u["k"]) + low * below
        return F.nanvl(u["s"] + (((u["c"] - (u["s"] - z)) + (u["p"] - z)) + product), u["s"])

    return let(lambda u: let(total, a=u["a"], b=u["b"], c=u["c"], h=high(u["a"]), k=high(u["b"]), p=u["a"] * u["b"], s=u["c"] + u["a"] * u["b"]), a=a, b=b, c=c)


def var_pop(x: Column, agg: Agg) -> Column:
    """``agg`` places an aggregate: over a window, or as it is for a group."""
    return clamped(agg(F.var_pop(x)), agg(F.avg(x * x)), agg(F.avg(x)))


def both(x: Column, y: Column) -> tuple[Column, Column]:
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def corr(x: Column, y: Column, agg: Agg, least: int = 2) -> Column:
    x, y = both(x, y)
    vx, vy = var_pop(x, agg), var_pop(y, agg)
    return F.when((agg(F.count(x)) >= least) & (vx > 0) & (vy > 0), fin(F.try_divide(agg(F.covar_pop(x, y)), F.sqrt(vx) * F.sqrt(vy))))


def cov(x: Column, y: Column, agg: Agg, least: int = 2) -> Column:
    x, y = both(x, y)
    return F.when(agg(F.count(x)) >= max(2, least), fin(agg(F.covar_samp(x, y))))


def beta(x: Column, y: Column, agg: Agg, least: int = 2) -> Column:
    """Slope of y on x."""
    x, y = both(x, y)
    v = var_pop(x, agg)
    return F.when((agg(F.count(x)) >= least) & (v > 0), ratio(agg(F.covar_pop(x, y)), v))
