"""Statistics across the assets of a date and step: reductions, transforms, groups and members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.numeric import beta, clamped, corr, cov, fin, ratio, stable_mean, stable_sum, var_pop
from gridloom.operators.spec import ASSET, CODE, KEYS, MASK, NUMERIC, CompileError, Operator, check_axis, register

_N, _NN = (NUMERIC,), (NUMERIC, NUMERIC)
_SAMPLE = {"sample_mask": MASK}
_WEIGHTED = {"sample_mask": MASK, "weight": NUMERIC}


def _in(mask, *columns):
    return columns if mask is None else tuple(F.when(mask, c) for c in columns)


def _plain(c: Column) -> Column:
    return c


def _reduce(name, f, inputs=1, check=check_axis, **params):
    """f(columns of the sample, parameters) -> aggregate."""

    def build(s, *columns, **p):
        return {"v": f(*_in(columns[inputs], *columns[:inputs]), **p)}

    register(Operator(name, (NUMERIC,) * inputs, build, params=params, optional=_SAMPLE, shape="asset", finish=lambda s, got, **p: got["v"], check=check))


def _skew(x):
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.var_pop(x) > 0), fin(F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x)))


def _kurt(x):
    n = F.count(x).cast("double")
    return F.when((n >= 4) & (F.var_pop(x) > 0), fin(((n * n - 1) * (F.kurtosis(x) + 3) - 3 * (n - 1) * (n - 1)) / ((n - 2) * (n - 3)) + 3))


def _entropy(x):
    total = F.sum(x)
    part = F.sum(F.when(x > 0, x * F.ln(x)).when(x == 0, F.lit(0.0)))
    return F.when((F.min(x) >= 0) & (total > 0), F.ln(total) - ratio(part, total))


_reduce("cs_mean", lambda x: stable_mean(x, _plain))
_reduce("cs_sum", lambda x: stable_sum(x, _plain))
_reduce("cs_std", lambda x: F.sqrt(var_pop(x, _plain)))
_reduce("cs_var", F.var_pop)
_reduce("cs_median", lambda x: F.percentile(x, 0.5))
_reduce("cs_quantile", lambda x, q: F.percentile(x, float(q)), q=0.5)
_reduce("cs_max", F.max)
_reduce("cs_min", F.min)
_reduce("cs_skew", _skew)
_reduce("cs_kurt", _kurt)
_reduce("cs_cv", lambda x: ratio(F.stddev_pop(x), F.avg(x)))
_reduce("cs_entropy", _entropy)
_reduce("cs_count", lambda x: F.count(x).cast("double"))
_reduce("cs_cumprod", lambda x: fin(F.product(1 + x)))
_reduce("cs_cov", lambda x, y: cov(x, y, _plain), inputs=2)
_reduce("cs_beta", lambda x, y: beta(x, y, _plain), inputs=2)


def _mad(s, x, mask):
    (x,) = _in(mask, x)
    middle = s.temp(F.percentile(x, 0.5).over(s.section()))
    return {"v": F.percentile(F.abs(x - middle), 0.5)}


def _cs_corr(s, x, y, mask, method):
    x, y = _in(mask, x, y)
    if method == "spearman":
        ok = x.isNotNull() & y.isNotNull()
        x, y = s.temp(F.when(ok, x)), s.temp(F.when(ok, y))

        def middle(c):
            return s.temp(F.when(c.isNotNull(), F.rank().over(s.section().orderBy(c.asc_nulls_last())) + (F.count("*").over(s.section(c)) - 1) / 2.0))

        x, y = middle(x), middle(y)
    return {"v": corr(x, y, _plain)}


def _corr_check(p):
    if p["method"] not in ("pearson", "spearman"):
        raise CompileError("method must be pearson or spearman")


def _relative_entropy(s, x, y, mask):
    x, y = _in(mask, x, y)
    ok = x.isNotNull() & y.isNotNull()
    x, y = s.temp(F.when(ok, x)), s.temp(F.when(ok, y))
    over = s.section()
    sx, sy = s.temp(F.sum(x).over(over)), s.temp(F.sum(y).over(over))
    part = F.when(x > 0, ratio(x, sx) * F.ln(ratio(ratio(x, sx), ratio(y, sy))))
    bad = F.coalesce(F.max((x > 0) & (y == 0)), F.lit(False))
    return {"v": F.when((F.min(x) >= 0) & (F.min(y) >= 0) & (F.max(sx) > 0) & (F.max(sy) > 0) & ~bad, fin(F.coalesce(F.sum(part), F.lit(0.0))))}


_value = lambda s, got, **p: got["v"]
register(
    Operator("cs_mad", _N, _mad, optional=_SAMPLE, shape="asset", finish=_value),
    Operator("cs_corr", _NN, _cs_corr, params={"method": "pearson"}, optional=_SAMPLE, shape="asset", finish=_value, check=_corr_check),
    Operator("cs_rel_entropy", _NN, _relative_entropy, optional=_SAMPLE, shape="asset", finish=_value),
)

# --- transforms ------------------------------------------------------------------------------


def _zscore(s, x, mask):
    (m,) = _in(mask, x)
    agg = s.stat
    return ratio(x - agg(F.avg(m)), F.sqrt(var_pop(m, agg)))


def ranked(s, x, mask=None):
    """Ordinal rank over the count, ties in order of assets."""
    (m,) = _in(mask, x)
    m = s.temp(m)
    return F.when(m.isNotNull(), F.row_number().over(s.section().orderBy(m.asc_nulls_last(), F.col(ASSET))) / F.count(m).over(s.section()).cast("double"))


def _winsorize(s, x, mask, lower, upper):
    (m,) = _in(mask, x)
    lo, hi = (s.stat(F.percentile(m, float(q))) for q in (lower, upper))
    return F.when(x.isNotNull(), F.when(lo.isNull(), x).otherwise(F.least(F.greatest(x, lo), hi)))


def _residual(s, y, e, mask):
    ok = e.isNotNull() & y.isNotNull() & (F.lit(True) if mask is None else F.coalesce(mask, F.lit(False)))
    a, b, agg = F.when(ok, e), F.when(ok, y), s.stat
    slope = F.when(var_pop(a, agg) > 0, ratio(agg(F.covar_pop(a, b)), agg(F.var_pop(a)))).otherwise(F.lit(0.0))
    return F.when(agg(F.count(a)) >= 2, fin(y - agg(F.avg(b)) - slope * (e - agg(F.avg(a)))))


def _min_max(s, x, mask):
    (m,) = _in(mask, x)
    lo, hi = (s.stat(f(m)) for f in (F.min, F.max))
    return F.when(hi - lo > 0, ratio(x - lo, hi - lo))


#: Coefficients of algorithm AS 241 for the normal percentage points, highest power first (fixed values): numerator and
#: denominator of the centre and of the tails.
CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
TAILS = (
    (7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)


def _polynomial(r: Column, powers) -> Column:
    out = F.lit(powers[0])
    for c in powers[1:]:
        out = out * r + c
    return out


def _inverse_erf(y: Column) -> Column:
    """For -0.9999995 to 0.9999995: the normal percentage point of (y + 1) / 2 over the root of two."""
    q = y / 2
    near = F.lit(0.180625) - q * q
    far = F.sqrt(-F.ln(0.5 - F.abs(q))) - 1.6
    point = F.when(F.abs(q) <= 0.425, q * _polynomial(near, CENTRE[0]) / _polynomial(near, CENTRE[1])).otherwise(F.signum(q) * _polynomial(far, TAILS[0]) / _polynomial(far, TAILS[1]))
    return point / 2**0.5


def _gauss_rank(s, x, mask):
    y = s.temp((ranked(s, x, mask) - 0.5) * 2)
    return F.when(y.isNotNull(), _inverse_erf(F.greatest(F.least(y, F.lit(0.999999)), F.lit(-0.999999))))


def _location_check(p):
    if p["axis"] not in (1, 2):
        raise CompileError("location needs axis 1 or 2")


register(
    Operator("cs_zscore", _N, _zscore, optional=_SAMPLE, section=True),
    Operator("rank", _N, ranked, optional=_SAMPLE),
    Operator("winsorize", _N, _winsorize, params={"lower": 0.01, "upper": 0.99}, optional=_SAMPLE, section=True, check=check_axis),
    Operator("neutralize", _NN, lambda s, x, e, m: _residual(s, x, e, m), optional=_SAMPLE, section=True),
    Operator("ols", _NN, lambda s, x, y, m: _residual(s, y, x, m), optional=_SAMPLE, section=True),
    Operator("cs_min_max_scale", _N, _min_max, optional=_SAMPLE, section=True),
    Operator("cs_gauss_rank", _N, _gauss_rank, optional=_SAMPLE),
    Operator("location", _N, lambda s, x, axis: F.when(x.isNotNull(), (F.col(KEYS[axis]) + 1).cast("double")), params={"axis": 1}, check=_location_check),
    Operator("umr", _NN, lambda s, x, y: fin((x - s.stat(F.avg(x))) * y), section=True),
    Operator("rank_add", _NN, lambda s, x, y: ranked(s, x) + ranked(s, y)),
    Operator("rank_sub", _NN, lambda s, x, y: ranked(s, x) - ranked(s, y)),
    Operator("rank_mul", _NN, lambda s, x, y: ranked(s, x) * ranked(s, y)),
    Operator("rank_div", _NN, lambda s, x, y: ratio(ranked(s, x), ranked(s, y))),
)

# --- groups and members ----------------------------------------------------------------------


def _weighted(x: Column, weight, sel: Column, agg):
    """(sum, mean, population variance) of the selected values by weight, and the selected values."""
    w = F.lit(1.0) if weight is None else fin(weight)
    ok = sel & x.isNotNull() & w.isNotNull() & (w > 0)
    v, w = F.when(ok, x), F.when(ok, w)
    total = agg(F.sum(w))
    mean = ratio(agg(F.sum(v * w)), total)
    if weight is None:
        return agg(F.sum(v)), mean, var_pop(v, agg)
    square = ratio(agg(F.sum(w * v * v)), total)
    return agg(F.sum(v * w)), mean, F.greatest(clamped(square - mean * mean, square, mean), F.lit(0.0))


def _group(stat):
    def build(s, x, group, mask, weight):
        inside = group.isNotNull() & (group >= 0) & (F.lit(True) if mask is None else F.coalesce(mask, F.lit(False)))
        total, mean, variance = _weighted(x, weight, inside, lambda c: s.stat(c, group))
        out = {"mean": mean, "sum": total, "std": F.sqrt(variance), "demean": fin(x - mean), "zscore": ratio(x - mean, F.sqrt(variance))}[stat]
        return F.when(inside, out)

    return build


def _member_selection(member, mask):
    sel = F.coalesce(member, F.lit(False))
    return sel if mask is None else sel & F.coalesce(mask, F.lit(False))


def _member_reduce(stat):
    def build(s, x, member, mask, weight):
        total, mean, variance = _weighted(x, weight, _member_selection(member, mask), _plain)
        return {"v": {"mean": mean, "sum": total, "std": F.sqrt(variance)}[stat]}

    return build


def _member_transform(stat):
    def build(s, x, member, mask, weight):
        sel = _member_selection(member, mask)
        _, mean, variance = _weighted(x, weight, sel, s.stat)
        return F.when(sel, fin(x - mean) if stat == "demean" else ratio(x - mean, F.sqrt(variance)))

    return build


for _stat in ("mean", "sum", "std", "demean", "zscore"):
    register(Operator(f"group_{_stat}", (NUMERIC, CODE), _group(_stat), optional=_WEIGHTED, section=True))
for _stat in ("mean", "sum", "std"):
    register(Operator(f"member_{_stat}", (NUMERIC, MASK), _member_reduce(_stat), optional=_WEIGHTED, shape="asset", finish=_value))
for _stat in ("demean", "zscore"):
    register(Operator(f"member_{_stat}", (NUMERIC, MASK), _member_transform(_stat), optional=_WEIGHTED, section=True))
