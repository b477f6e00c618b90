"""Operators that move along the asset axis; the planner lowers them to joins and filters."""

from __future__ import annotations

from gridloom.operators.spec import CODE, NUMERIC, REQUIRED, CompileError, Operator, register


def _select_check(p):
    if p["axis"] not in (1, 2):
        raise CompileError("select_by_pos needs axis 1 or 2")
    if p["keepdims"] is not True:
        raise CompileError("select_by_pos needs keepdims=True")


register(
    Operator("lookup_by_col", (NUMERIC, CODE), None, shape="lookup"),
    Operator("select_by_pos", (NUMERIC,), None, params={"pos": REQUIRED, "axis": 1, "keepdims": False}, shape="select", check=_select_check),
)
