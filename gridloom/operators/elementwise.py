"""Arithmetic, mathematics, predicates and three-valued logic: plain column expressions, no shuffle."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import functions as F

from gridloom.functions.numeric import fin, ratio
from gridloom.operators.spec import MASK, NUMERIC, Operator, register

_N, _NN = (NUMERIC,), (NUMERIC, NUMERIC)
_ROOT = math.sqrt(2 / math.pi)


def _one(name, f):
    register(Operator(name, _N, lambda s, x, **p: f(x, **p)))


def _two(name, f, output=NUMERIC):
    register(Operator(name, _NN, lambda s, x, y: f(x, y), output=output))


_two("add", lambda x, y: fin(x + y))
_two("subtract", lambda x, y: fin(x - y))
_two("multiply", lambda x, y: fin(x * y))
_two("divide", ratio)
_one("neg", lambda x: -x)
_one("abs", F.abs)
_one("abs_val", F.abs)
_one("ln", lambda x: fin(F.ln(x)))
_one("log", lambda x: fin(F.ln(x)))
_one("log10", lambda x: fin(F.log10(x)))
_one("sqrt", lambda x: fin(F.sqrt(x)))
_one("sign", F.signum)
_one("power2", lambda x: fin(x * x))
_one("power3", lambda x: fin(x * x * x))
_one("curt", F.cbrt)
_one("inv", lambda x: ratio(F.lit(1.0), x))
_one("exp", lambda x: fin(F.exp(x)))
_two("power", lambda x, y: F.when(y == 0, F.lit(1.0)).when(x == 1, F.lit(1.0)).otherwise(fin(F.pow(x, y))))
_one("protected_sqrt", lambda x: F.signum(x) * F.sqrt(F.abs(x)))
_one("protected_log", lambda x: F.signum(x) * F.ln(F.abs(x) + 1))
_one("sin", F.sin)
_one("cos", F.cos)
_one("tan", lambda x: fin(F.tan(x)))
_one("sigmoid", lambda x: F.try_divide(F.lit(1.0), 1 + F.exp(-x)))
_one("hardsigmoid", lambda x: F.when(x.isNotNull(), F.least(F.greatest((x + 1) / 2, F.lit(0.0)), F.lit(1.0))))
register(Operator("leakyrelu", _N, lambda s, x, alpha: F.when(x > 0, x).otherwise(alpha * x), params={"alpha": 0.1}))
_one("gelu", lambda x: fin(0.5 * x * (1 + F.tanh(_ROOT * (x + 0.044715 * x * x * x)))))
_two("series_min", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)))
_two("series_max", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)))
_one("one", lambda x: F.when(x.isNotNull(), F.lit(1.0)))

_two("greater_equal", operator.ge, MASK)
_two("greater", operator.gt, MASK)
_two("less_equal", operator.le, MASK)
_two("less", operator.lt, MASK)
_two("equal", operator.eq, MASK)
_two("not_equal", operator.ne, MASK)
register(
    Operator("where", (MASK, NUMERIC), lambda s, m, x, y: F.when(m, x) if y is None else F.when(m, x).when(~m, y), optional={"y": NUMERIC}),
    Operator("apply_mask", (NUMERIC, MASK), lambda s, x, m: F.when(m, x)),
    Operator("mask_and", (MASK,), lambda s, *m: reduce(operator.and_, m), output=MASK, variadic=True),
    Operator("mask_or", (MASK,), lambda s, *m: reduce(operator.or_, m), output=MASK, variadic=True),
    Operator("mask_not", (MASK,), lambda s, m: ~m, output=MASK),
    Operator("if_then_else", (NUMERIC,) * 4, lambda s, x, y, a, b: F.when(x >= y, a).when(x < y, b)),
)
