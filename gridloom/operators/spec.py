"""What an operator declares, and what it builds columns with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

NUMERIC, MASK, CODE = "numeric", "mask", "code"
REQUIRED = object()
DATE, ASSET, STEP = "date_idx", "asset_idx", "step_idx"
KEYS = (DATE, ASSET, STEP)


class CompileError(ValueError):
    """A batch that cannot be planned."""


class DomainError(CompileError):
    """Dates, assets or steps that the sources do not have."""


@dataclass(frozen=True)
class Operator:
    """``build`` gets a Stage, the input columns (None for an optional one not given) and the parameters.

    kind of ``shape``: "same" stays on the merged layout; "asset" and "step" reduce that axis, where ``build`` returns
    aggregates and ``finish`` may go on from them on the reduced layout; the others are lowered by the planner.
    """

    name: str
    inputs: tuple[str, ...]
    build: Callable[..., Any]
    params: dict[str, Any] = field(default_factory=dict)
    optional: dict[str, str] = field(default_factory=dict)
    output: str = NUMERIC
    shape: str = "same"
    lookback: Callable[[dict], int] = lambda p: 0
    finish: Callable[..., Column] | None = None
    variadic: bool = False
    section: bool = False  # stands on moments across the assets of a date and step, placed by ``Stage.stat``
    check: Callable[[dict], None] = lambda p: None


class Stage:
    """The layout that columns are being built on: window specifications and places for intermediate columns."""

    def __init__(self, add: Callable[[Column], Column], stat: Callable[..., Column] | None = None):
        self.temp = add  # puts a column into the frame and returns a reference, so that a window can stand on a window
        # an aggregate over all assets of a date and step, or over those with one value of further keys
        self.stat = stat or (lambda c, *more: c.over(self.section(*more)))

    @staticmethod
    def along(axis: int):
        """Ordered by position on the axis, apart for all other coordinates."""
        keys = [k for i, k in enumerate(KEYS) if i != axis]
        return Window.partitionBy(*keys).orderBy(KEYS[axis])

    @classmethod
    def last(cls, axis: int, window: int):
        return cls.along(axis).rowsBetween(-(window - 1), 0)

    @staticmethod
    def position(axis: int) -> Column:
        return F.col(KEYS[axis])

    @staticmethod
    def section(*more):
        """All assets of a date and step."""
        return Window.partitionBy(DATE, STEP, *more)


REGISTRY: dict[str, Operator] = {}


def register(*ops: Operator) -> None:
    for op in ops:
        if op.name in REGISTRY:
            raise ValueError(f"{op.name} is registered twice")
        REGISTRY[op.name] = op


def check_axis(p: dict) -> None:
    if p.get("axis", 0) not in (0, 1, 2):
        raise CompileError("axis must be 0, 1 or 2")
    for name in ("window", "window_days", "min_periods", "top"):
        v = p.get(name)
        if name in p and v is not None and (not isinstance(v, int) or isinstance(v, bool) or v <= 0):
            raise CompileError(f"{name} must be a positive integer")
    for name in ("periods", "limit"):
        v = p.get(name)
        if name in p and v is not None and (not isinstance(v, int) or isinstance(v, bool) or v < 0):
            raise CompileError(f"{name} must not be negative")
    if p.get("min_periods") and "window" in p and p["min_periods"] > p["window"]:
        raise CompileError("min_periods must not exceed window")
    for name in ("q", "quantile", "lower", "upper"):
        if name in p and not 0 <= p[name] <= 1:
            raise CompileError(f"{name} must be within 0 and 1")
    if "lower" in p and p["lower"] > p["upper"]:
        raise CompileError("lower must not exceed upper")
    if p.get("halflife", 1) <= 0:
        raise CompileError("halflife must be positive")
