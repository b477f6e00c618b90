"""Rewrites of bound expressions: masks over a whole formula, implicit frequency alignment, a library of definitions."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from gridloom.formula import Call, FormulaBatch, FormulaError, Literal, Name, _Reader
from gridloom.functions.calendar import DAILY, MINUTES
from gridloom.operators import REGISTRY

_LEAVES = ("source", "get_lf", "get_hf", "get_fund", "load_factor")


def transform(e, f: Callable[[Call], Any]):
    """Rebuild the tree bottom-up; ``f`` sees every call after its arguments."""
    if not isinstance(e, Call):
        return e
    return f(Call(e.name, tuple(transform(a, f) for a in e.args), tuple((k, transform(v, f)) for k, v in e.kwargs), e.where))


@dataclass(frozen=True)
class Bound:
    """Expressions that are bound already, in the place of a FormulaBatch."""

    outputs: tuple

    def bind(self, reserved: frozenset[str]) -> dict[str, Any]:
        return dict(self.outputs)


def with_masks(e, inputs=None, sample=None, output=None):
    """``inputs`` blanks every source, ``sample`` limits every operator that takes a sample mask and has none yet,
    ``output`` blanks the result. Each is an expression of a mask."""
    if inputs is not None:
        e = transform(e, lambda c: Call("apply_mask", (c, inputs), (), c.where) if c.name in _LEAVES else c)
    if sample is not None:

        def limited(c: Call):
            op = REGISTRY.get(c.name)
            if op is None or "sample_mask" not in op.optional or any(k == "sample_mask" for k, _ in c.kwargs):
                return c
            at = len(op.inputs)
            if len(c.args) > at:
                given = isinstance(c.args[at], Literal) and c.args[at].value is None
                return Call(c.name, (*c.args[:at], sample, *c.args[at + 1 :]), c.kwargs, c.where) if given else c
            return Call(c.name, c.args, (*c.kwargs, ("sample_mask", sample)), c.where)

        e = transform(e, limited)
    return e if output is None else Call("apply_mask", (e, output))


def to_frequency(e, freq: str, delay: int = 1, delays: dict[str, int] | None = None):
    """Fit sources of coarser frequencies to ``freq``: daily ones are delayed (they are known after the close) and
    broadcast by their single step, coarser intraday ones are filled forward. Finer ones are an error."""

    def fitted(c: Call):
        if c.name != "source":
            return c
        key = c.args[0].value
        own = key.split(".", 2)[1] if key.count(".") >= 2 else DAILY
        if own == freq:
            return c
        if own == DAILY:
            n = (delays or {}).get(key, delay)
            return Call("delay", (c, Literal(n)), (), c.where) if n else c
        if freq == DAILY or MINUTES[own] < MINUTES[freq]:
            raise FormulaError(f"{c.where}: {key} is finer than {freq}; resample it")
        return Call("align_frequency", (c, Literal(freq), Literal("ffill")), (), c.where)

    return transform(e, fitted)


#: A string, or a source by its dotted key.
_DOTTED = re.compile(r"""("[^"]*"|'[^']*')|(?<![\w.])([A-Za-z]\w*\.\w+\.[A-Za-z_][\w.]*)""")


@dataclass(frozen=True)
class Definition:
    key: str
    text: str
    alias: str | None = None
    note: str = ""


class FeatureLibrary:
    """Named definitions that use each other by ``feature("key or alias")``; formulas over them become one batch."""

    def __init__(self) -> None:
        self.definitions: dict[str, Definition] = {}
        self.aliases: dict[str, str] = {}

    def define(self, key: str, text: str, alias: str | None = None, note: str = "", replace: bool = False) -> None:
        if key in self.definitions and not replace:
            raise KeyError(f"{key} is defined already")
        taken = alias is not None and (alias in self.definitions or self.aliases.get(alias, key) != key)
        if taken or self.aliases.get(key, key) != key:
            raise KeyError(f"{alias or key} is taken")
        self._parse(key, text)
        self.remove(key, missing=True)
        self.definitions[key] = Definition(key, text, alias, note)
        if alias:
            self.aliases[alias] = key

    def remove(self, key: str, missing: bool = False) -> None:
        d = self.definitions.pop(key, None)
        if d is None and not missing:
            raise KeyError(f"{key} is not defined")
        if d and d.alias:
            del self.aliases[d.alias]

    def resolve(self, name: str) -> Definition:
        key = self.aliases.get(name, name)
        if key not in self.definitions:
            raise KeyError(f"{name} is not defined")
        return self.definitions[key]

    def search(self, text: str) -> list[str]:
        t = text.lower()
        return sorted(d.key for d in self.definitions.values() if t in f"{d.key} {d.alias or ''} {d.note} {d.text}".lower())

    @staticmethod
    def _parse(key: str, text: str):
        return FormulaBatch.from_text("", {key: text}).bind(frozenset())[key]

    def expression(self, name: str, path: tuple[str, ...] = ()):
        """The definition with all features it uses put in."""
        d = self.resolve(name)
        if d.key in path:
            raise FormulaError("features use each other in a circle: " + " > ".join((*path, d.key)))
        put_in = lambda c: self.expression(c.args[0].value, (*path, d.key)) if c.name == "feature" else c
        return transform(self._parse(d.key, d.text), put_in)

    def formula(self, text: str):
        """One expression without assignments, where ``asset.freq.name`` is a source and any other name a feature or alias."""
        spelled = _DOTTED.sub(lambda m: m[0] if m[1] else f'source("{m[2]}")', text.strip())
        try:
            tree = ast.parse(spelled, mode="eval")
        except SyntaxError as x:
            raise FormulaError(f"formula:{x.lineno}:{x.offset}: {x.msg}") from None

        def named(e):
            if isinstance(e, Name):
                return self.expression(e.name)
            return Call(e.name, tuple(map(named, e.args)), tuple((k, named(v)) for k, v in e.kwargs), e.where) if isinstance(e, Call) else e

        return named(_Reader("formula").expr(tree.body))

    def batch(self, names: list[str], inputs: str | None = None, sample: str | None = None, output: str | None = None) -> Bound:
        """A batch of the named features, with masks given as formula text."""
        masks = [None if m is None else self._parse("mask", f"mask = {m}") for m in (inputs, sample, output)]
        return Bound(tuple((n, with_masks(self.expression(n), *masks)) for n in names))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps([asdict(d) for _, d in sorted(self.definitions.items())], indent=1))

    @classmethod
    def load(cls, path: str) -> FeatureLibrary:
        out = cls()
        for d in json.loads(Path(path).read_text()):
            out.define(**d)
        return out
