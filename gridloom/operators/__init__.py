"""The operator registry: importing this package fills it."""

from gridloom.operators import alignment, cross_section, elementwise, timeseries  # noqa: F401
from gridloom.operators.spec import REGISTRY, CompileError, Operator

__all__ = ["REGISTRY", "CompileError", "Operator"]
