"""Registered features run as a whole: what they use of each other is found, shared, saved and read back.

``FeatureManager`` puts a ``FeatureLibrary``, an engine and a ``FactorRepository`` together. A feature that is
saved takes part in later runs as its saved table, so what stands on it does not compute it again (unless it needs dates before
those that were saved); results of a session are kept by name and domain until they are dropped.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from gridloom.engine import Engine
from gridloom.formula import Call, Literal
from gridloom.plans.compiler import Domain
from gridloom.plans.rewrites import Bound, FeatureLibrary, transform
from gridloom.sources.repository import FactorRepository, RepositoryProvider


class FeatureManager:
    def __init__(self, engine: Engine, library: FeatureLibrary, repository: FactorRepository):
        self.library, self.repository = library, repository
        self.engine = Engine(engine.spark, RepositoryProvider(engine.provider, repository), engine.compiler.operators)
        self.kept: dict[tuple, DataFrame] = {}

    def needs(self, name: str) -> list[str]:
        """The keys of all features that ``name`` stands on, those that need nothing first, itself last."""
        key = self.library.resolve(name).key
        self.library.expression(key)  # finds circles
        out: list[str] = []

        def visit(c: Call) -> Call:
            if c.name == "feature":
                out.extend(k for k in self.needs(c.args[0].value) if k not in out)
            return c

        transform(self.library._parse(key, self.library.definitions[key].text), visit)
        return [*out, key]

    def expression(self, name: str, saved: frozenset[str] = frozenset()):
        """The feature's formula, with the saved ones among those it uses as their saved tables."""
        d = self.library.resolve(name)

        def put_in(c: Call):
            if c.name != "feature":
                return c
            key = self.library.resolve(c.args[0].value).key
            return Call("source", (Literal(f"factor:{key}"),)) if key in saved else self.expression(key, saved)

        return transform(self.library._parse(d.key, d.text), put_in)

    def execute(self, names: list[str], domain: Domain, materialise: bool = False, chunk_dates: int | None = None) -> DataFrame:
        """date, asset, step and a column for each feature (by its key) over the domain.

        ``materialise`` saves every feature that is not there yet, those the others stand on first, and gives the saved
        values; ``chunk_dates`` computes them in runs of so many dates, each with the history it needs.
        """
        keys = [self.library.resolve(n).key for n in names]
        for k in keys:
            self.needs(k)
        if not materialise:
            kept = self.kept.get(self._name(keys, domain))
            return self._run(keys, domain) if kept is None else kept
        saved: set[str] = set()
        for key in dict.fromkeys(k for name in keys for k in self.needs(name)):
            if not self.repository.exists(key):
                bound = Bound(((key, self.expression(key, frozenset(saved))),))
                if self.engine.compile(bound, domain).first:  # history is not in the saved tables
                    bound = Bound(((key, self.expression(key)),))
                made = self.engine.compute(bound, domain) if chunk_dates is None else reduce(DataFrame.unionByName, self.engine.stream(bound, domain, chunk_dates))
                self.repository.save(made, key, domain, domain.steps or 1)
            saved.add(key)
        return self.engine.compute(Bound(tuple((k, Call("source", (Literal(f"factor:{k}"),))) for k in keys)), domain)

    def _run(self, keys: list[str], domain: Domain) -> DataFrame:
        return self.engine.compute(Bound(tuple((k, self.expression(k)) for k in keys)), domain)

    @staticmethod
    def _name(keys: list[str], domain: Domain) -> tuple:
        assets = domain.assets if domain.assets == "all" else tuple(domain.assets)
        return (*keys, replace(domain, assets=assets))

    def keep(self, names: list[str], domain: Domain) -> DataFrame:
        """Compute once for the session: later runs of the same features over the same domain get these rows (memory, then disk)."""
        keys = [self.library.resolve(n).key for n in names]
        name = self._name(keys, domain)
        if self.kept.get(name) is None:
            self.kept[name] = self._run(keys, domain).persist(StorageLevel.MEMORY_AND_DISK)
        return self.kept[name]

    def drop(self) -> None:
        """Forget the kept results."""
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()
