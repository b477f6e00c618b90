"""Runs plans as DataFrames: one dense frame for each layout, a column for each term.

A frame has a row for every read date, asset and step of its layout, so windows of rows are windows of positions. Terms
on one layout are columns of one frame; only a change of layout makes a join: reductions group the
frame and meet the smaller one, broadcasting joins a smaller frame on the keys both have. Frames whose size,
known from the axes, is small are broadcast; the others take part in shuffle joins.

Moments across the assets of a date and step (``Stage.stat``) are a grouping with partial sums, whose few rows come back in a
join; the frame itself is not shuffled for them. Terms that can be made at one time share that grouping. Terms that stand on
such a join in turn take windows, which share one shuffle, so no frame is read more than twice for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.formula import FormulaBatch
from gridloom.functions.numeric import fin, tristate, var_pop
from gridloom.operators import REGISTRY
from gridloom.operators.spec import ASSET, CODE, DATE, KEYS, MASK, STEP, Operator, Stage
from gridloom.plans.compiler import Compiler, Domain, Plan, Term

#: Rows of a frame that may be broadcast.
SMALL = 200_000


@dataclass
class ExecutionStats:
    """What the last ``compute`` planned. ``loads`` has an event a scan: its keys, dates, assets and steps."""

    formulas: int = 0
    terms: int = 0  # after equal ones were merged
    lookback: int = 0
    groupings: int = 0  # reductions and moments that share one count once
    peak_values: int = 0  # cells of all columns of the largest frame
    loads: list[dict] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, provider, operators: dict[str, Operator] | None = None):
        self.spark, self.provider = spark, provider
        self.stats = ExecutionStats()
        self.compiler = Compiler(provider, operators)

    def compile(self, batch: FormulaBatch, domain: Domain) -> Plan:
        return self.compiler.compile(batch, domain)

    def compute(self, batch: FormulaBatch, domain: Domain) -> DataFrame:
        """date, asset, step and a column for each formula, over the whole output grid."""
        run = _Run(self, self.compile(batch, domain))
        out = run.result()
        plan = run.plan
        cells = max((len(plan.dates) * a * s * (len(names) - len(KEYS)) for (a, s), names in run.names.items()), default=0)
        self.stats = ExecutionStats(len(plan.outputs), len(plan.order), plan.lookback, run.groupings, cells, run.loads)
        return out

    def stream(self, batch: FormulaBatch, domain: Domain, chunk_dates: int) -> Iterator[DataFrame]:
        """The same result in runs of ``chunk_dates`` dates, each reading its own history."""
        plan = self.compile(batch, domain)
        dates = plan.dates[plan.first :]
        codes = plan.codes[domain.asset]
        for at in range(0, len(dates), chunk_dates):
            part = dates[at : at + chunk_dates]
            yield self.compute(batch, replace(domain, start=part[0], end=part[-1], assets=codes))


class _Run:
    def __init__(self, engine: Engine, plan: Plan):
        self.engine, self.plan, self.spark = engine, plan, engine.spark
        self.frames: dict[tuple[int, int], DataFrame] = {}
        self.names: dict[tuple[int, int], set[str]] = {}  # columns of each frame, pending ones included
        self.pending: dict[tuple[int, int], dict[str, Column]] = {}  # columns that stand on columns already there
        self.joined: set[tuple[int, int]] = set()  # frames that have met a grouping of themselves
        self.done: set[str] = set()
        self.temps = self.groupings = 0
        self.loads: list[dict] = []

    # --- frames -----------------------------------------------------------------------------

    def frame(self, size: tuple[int, int]) -> DataFrame:
        if size not in self.frames:
            n, s = size
            i = F.col("id")
            grid = self.spark.range(len(self.plan.dates) * n * s)
            self.frames[size] = grid.select((F.expr(f"id div {n * s}")).cast("int").alias(DATE), (F.expr(f"id div {s}") % n).cast("int").alias(ASSET), (i % s).cast("int").alias(STEP))
            self.names[size] = set(KEYS)
        if waiting := self.pending.pop(size, None):
            self.frames[size] = self.frames[size].select("*", *[c.alias(name) for name, c in waiting.items()])
        return self.frames[size]

    def _join(self, size: tuple[int, int], right: DataFrame, on: list[str], rows: int) -> None:
        names = set(right.columns)
        right = F.broadcast(right) if rows <= SMALL else right
        self.frames[size] = self.frame(size).join(right, on, "left")
        self.names[size] |= names

    def bring(self, terms, size: tuple[int, int]) -> None:
        """Join the terms of smaller frames onto the frame of ``size``, one join for each of those frames."""
        if size not in self.frames:
            self.frame(size)
        have = self.names[size]
        by: dict[tuple[int, int], list[str]] = {}
        for t in terms:
            if t is not None and t.layout is not None and (own := (t.layout.assets, t.layout.steps)) != size and t.id not in have:
                by.setdefault(own, []).append(t.id)
        for own, names in by.items():
            keys = [DATE] + [k for k, a, b in ((ASSET, own[0], size[0]), (STEP, own[1], size[1])) if a == b]
            self._join(size, self.frame(own).select(*keys, *dict.fromkeys(names)), keys, len(self.plan.dates) * own[0] * own[1])

    def column(self, term: Term | None, size: tuple[int, int]) -> Column | None:
        """The term as a column of the frame of ``size``, brought there if its own frame is smaller."""
        if term is None:
            return None
        if term.layout is None:
            v = dict(term.params)["value"]
            return F.lit(v) if isinstance(v, bool) else F.lit(float(v))
        self.bring([term], size)
        if term.id in self.pending.get(size, ()):
            self.frame(size)
        return F.col(term.id)

    def put(self, size: tuple[int, int], name: str, c: Column) -> Column:
        """A further column; ``c`` may stand on any column that is there and not pending."""
        self.pending.setdefault(size, {})[name] = c
        self.names[size].add(name)
        return F.col(name)

    def _fresh(self) -> str:
        self.temps += 1
        return f"__{self.temps}"

    def stage(self, size: tuple[int, int], stat=None) -> Stage:
        def temp(c: Column) -> Column:
            name = self._fresh()
            self.put(size, name, c)
            self.frame(size)
            return F.col(name)

        return Stage(temp, stat)

    # --- terms ------------------------------------------------------------------------------

    def _turn(self, t: Term) -> int:
        """What is made first: the later reductions and moments come, the more of them share a grouping."""
        if t.op == "source":
            return 0
        op = self.engine.compiler.operators[t.op]
        return 1 if op.shape == "same" and not op.section else 3 if op.section else 2

    def evaluate(self, t: Term) -> None:
        self.done.add(t.id)
        size, params = (t.layout.assets, t.layout.steps), dict(t.params)
        if t.op == "source":
            self.load(t)
            return
        op = self.engine.compiler.operators[t.op]
        if op.section and size not in self.joined:
            self.section(t, size)
        elif op.shape == "same":
            if size not in self.frames:
                self.frame(size)
            made = op.build(self.stage(size), *(self.column(a, size) for a in t.args), **params)
            if REGISTRY.get(t.op) is not op:  # a custom operator's result is held to its kind
                made = tristate(made) if op.output == MASK else made.cast("bigint") if op.output == CODE else fin(made.cast("double"))
            self.put(size, t.id, made)
        elif op.shape in ("asset", "step"):
            self.reduce(t, op)
        else:
            self.reshape(t, op.shape, params, size)

    def section(self, first: Term, size: tuple[int, int]) -> None:
        """All terms that can be made now from moments across the assets of a date and step share one grouping for each set of keys."""
        known = self.done - {first.id}

        def now(t: Term) -> bool:
            o = self.engine.compiler.operators.get(t.op)
            return bool(o and o.section and t.id not in known and t.layout) and (t.layout.assets, t.layout.steps) == size and all(a is None or a.layout is None or a.id in known for a in t.args)

        terms = [t for t in self.plan.order if now(t)]
        self.done |= {t.id for t in terms}
        self.frame(size)
        self.joined.add(size)
        self.bring([a for t in terms for a in t.args], size)
        wanted: dict[tuple[str, ...], list[Column]] = {}
        keys: dict[str, tuple[str, Column]] = {}

        def stat(c: Column, *more: Column) -> Column:
            for m in more:
                keys.setdefault(str(m), (self._fresh(), m))
            name = self._fresh()
            wanted.setdefault(tuple(keys[str(m)][0] for m in more), []).append(c.alias(name))
            return F.col(name)

        made = {t.id: self.engine.compiler.operators[t.op].build(self.stage(size, stat), *(self.column(a, size) for a in t.args), **dict(t.params)) for t in terms}
        base = self.frame(size).select("*", *[k.alias(n) for n, k in keys.values()])
        out = base
        for names, stats in wanted.items():
            right = base.groupBy(DATE, STEP, *names).agg(*stats)
            self.groupings += 1
            few = not names and len(self.plan.dates) * size[1] <= SMALL
            out = out.join(F.broadcast(right) if few else right, [DATE, STEP, *names], "left")
        self.frames[size] = out.select(*self.names[size], *[c.alias(name) for name, c in made.items()])
        self.names[size] |= set(made)

    def _wide(self, args) -> tuple[int, int]:
        given = [a.layout for a in args if a is not None and a.layout is not None]
        return max(x.assets for x in given), max(x.steps for x in given)

    def reduce(self, first: Term, op: Operator) -> None:
        """All reductions that can be made now from one frame to one layout share a grouping."""
        source, target = self._wide(first.args), (first.layout.assets, first.layout.steps)
        group = [first]
        for t in self.plan.order:
            o = self.engine.compiler.operators.get(t.op)
            if o and t.id not in self.done and o.shape == op.shape and all(a is None or a.layout is None or a.id in self.done for a in t.args):
                if self._wide(t.args) == source and (t.layout.assets, t.layout.steps) == target:
                    group.append(t)
                    self.done.add(t.id)
        self.bring([a for t in group for a in t.args], source)
        built = []
        for t in group:
            o = self.engine.compiler.operators[t.op]
            built.append((t, o, o.build(self.stage(source), *(self.column(a, source) for a in t.args), **dict(t.params))))
        keys = [DATE, STEP] if op.shape == "asset" else [DATE, ASSET]
        aggregates = [c.alias(f"{t.id}_{name}") for t, _, got in built for name, c in got.items()]
        made = self.frame(source).groupBy(*keys).agg(*aggregates)
        self.groupings += 1
        if target in self.frames:
            self._join(target, made, keys, len(self.plan.dates) * target[0] * target[1])
        else:  # every date is there already
            self.frames[target] = made.withColumn(ASSET if op.shape == "asset" else STEP, F.lit(0))
            self.names[target] = {*KEYS, *made.columns}
        for t, o, got in built:
            columns = {name: F.col(f"{t.id}_{name}") for name in got}
            self.put(target, t.id, o.finish(self.stage(target), columns, **dict(t.params)))

    def reshape(self, t: Term, shape: str, params: dict, size: tuple[int, int]) -> None:
        x = t.args[0]
        own = (x.layout.assets, x.layout.steps)
        rows = len(self.plan.dates) * size[0] * size[1]
        src = self.frame(own).select(*KEYS, F.col(x.id).alias(t.id))
        if shape == "select":
            axis = KEYS[params["axis"]]
            made = src.filter(F.col(axis) == params["pos"]).withColumn(axis, F.lit(0))
        elif shape == "get_step":
            made = src.filter(F.col(STEP) == params["step"]).withColumn(STEP, F.lit(0))
        elif shape == "slice_step":
            made = src.filter(F.col(STEP).between(params["start"], params["end"] - 1)).withColumn(STEP, F.col(STEP) - params["start"])
        elif shape == "align":
            finer = [[k for k, c in enumerate(params["map"]) if c == coarse] for coarse in range(own[1])]
            table = F.array(*[F.array(*map(F.lit, k)) if k else F.array().cast("array<int>") for k in finer])
            made = src.withColumn(STEP, F.explode(F.get(table, F.col(STEP))))
        elif shape == "resample":
            bucket = F.get(F.array(*map(F.lit, params["map"])), F.col(STEP))
            v = F.col(t.id)
            how = {"mean": F.avg(v), "sum": F.coalesce(F.sum(v), F.lit(0.0)), "std": F.sqrt(var_pop(v, lambda c: c)), "last": F.max_by(v, F.col(STEP))}[params["method"]]
            made = src.groupBy(DATE, ASSET, bucket.alias("__bucket")).agg(how.alias(t.id)).withColumnRenamed("__bucket", STEP)
        else:  # lookup: the code of the map is a position on the asset axis of the values
            codes = t.args[1]
            one = (codes.layout.assets, 1)
            m = self.frame(one).filter(F.col(codes.id) >= 0).select(DATE, F.col(ASSET).alias("__to"), F.col(codes.id).cast("int").alias(ASSET))
            small = len(self.plan.dates) * one[0] <= SMALL
            made = src.join(F.broadcast(m) if small else m, [DATE, ASSET]).drop(ASSET).withColumnRenamed("__to", ASSET)
        self._join(size, made.select(*KEYS, t.id), list(KEYS), rows)

    def load(self, t: Term) -> None:
        """All sources of one table and layout come from one scan."""
        key = dict(t.params)["key"]
        size = (t.layout.assets, t.layout.steps)
        group = [(t.id, key, t.kind)]
        for u in self.plan.order:
            if u.op == "source" and u.id not in self.done and (u.layout.assets, u.layout.steps, u.layout.asset) == (*size, t.layout.asset):
                other = dict(u.params)["key"]
                if self.engine.provider.same_scan(key, other):
                    group.append((u.id, other, u.kind))
                    self.done.add(u.id)
        if hasattr(self.engine.provider, "freeze"):
            self.engine.provider.freeze(self.plan.dates, self.plan.codes)
        codes = self.plan.codes[t.layout.asset]
        self.loads.append({"keys": [k for _, k, _ in group], "first": self.plan.dates[0], "last": self.plan.dates[-1], "assets": len(codes), "steps": t.layout.steps})
        rows = self.engine.provider.load([k for _, k, _ in group], self.plan.dates, codes, t.layout.steps)

        def cast(k: str, kind: str) -> Column:
            c = F.col(f"`{k}`")
            return tristate(c) if kind == MASK else c.cast("bigint") if kind == CODE else fin(c.cast("double"))

        keys = [k for k in KEYS if k != DATE or DATE in rows.columns]
        rows = rows.select(*keys, *[cast(k, kind).alias(name) for name, k, kind in group])
        self._join(size, rows, keys, (len(self.plan.dates) if DATE in keys else 1) * size[0] * size[1])

    # --- the result --------------------------------------------------------------------------

    def result(self) -> DataFrame:
        plan = self.plan
        while waiting := [t for t in plan.order if t.id not in self.done and t.layout is not None]:
            ready = [t for t in waiting if all(a is None or a.layout is None or a.id in self.done for a in t.args)]
            self.evaluate(min(ready, key=self._turn))  # the first of its kind
        size = (len(plan.codes[plan.domain.asset]), len(plan.steps))
        self.bring(plan.outputs.values(), size)
        out = self.frame(size).filter(F.col(DATE) >= plan.first)
        out = out.join(F.broadcast(self._axis([(d, i) for i, d in enumerate(plan.dates)], "date string", DATE)), DATE)
        codes = plan.codes[plan.domain.asset]
        kind = "string" if any(isinstance(c, str) for c in codes) else "bigint"
        out = out.join(self._axis([(c, i) for i, c in enumerate(codes)], f"asset {kind}", ASSET), ASSET)
        if len(plan.steps) > 1:
            out = out.join(F.broadcast(self._axis([(c, i) for i, c in enumerate(plan.steps)], "step int", STEP)), STEP)
        else:
            out = out.withColumn("step", F.lit(plan.steps[0]).cast("int"))
        return out.select("date", "asset", "step", *[F.col(t.id).alias(name) for name, t in plan.outputs.items()])

    def _axis(self, rows: list, label: str, position: str) -> DataFrame:
        """(label, position) of an axis as a table; Spark decides by its size how to join it."""
        return self.spark.createDataFrame(rows, f"{label}, {position} int")
