import pytest

from gridloom.engine import Engine
from gridloom.formula import Call, FormulaBatch, FormulaError, Literal
from gridloom.plans.compiler import Domain
from gridloom.plans.rewrites import Bound, FeatureLibrary, to_frequency
from gridloom.sources.panel import memory_provider

DAYS = ["20240102", "20240103"]


@pytest.fixture(scope="module")
def engine(spark):
    arrays = {
        "stk.1d.x": [[1, 2, 4], [3, 5, 9]], "stk.1d.live": [[1, 1, 0], [1, 1, 1]], "stk.1d.industry_code.SW2021.L1": [[0, 0, 1]] * 2,
        "stk.60min.p": [[[1, 2, 3, 4]] * 3, [[5, 6, 7, 8]] * 3], "idx.1d.level": [[100, 200], [110, 210]],
    }
    return Engine(spark, memory_provider(spark, DAYS, {"stk": [1, 2, 3], "idx": [300, 500]}, arrays, {"stk.1d.live": "mask", "stk.1d.industry_code.SW2021.L1": "code"}))


def values(df, name):
    return {(r.date, r.asset, r.step): r[name] for r in df.collect()}


def test_features_and_masks(engine, tmp_path):
    lib = FeatureLibrary()
    lib.define("close", 'out = get_lf("stk", "x")', alias="c", note="price")
    lib.define("z", 'out = cs_mean(feature("c")) + 0 * feature("close")')
    masked = engine.compute(lib.batch(["z"], sample='get_lf("stk", "live")'), Domain(*DAYS))
    assert values(masked, "z")[DAYS[0], 3, 0] == 1.5
    both = engine.compute(lib.batch(["z"], inputs='get_lf("stk", "live")', output='get_lf("stk", "x") > 1'), Domain(*DAYS))
    got = values(both, "z")
    assert got[DAYS[0], 1, 0] is None and got[DAYS[0], 2, 0] == 1.5 and got[DAYS[0], 3, 0] is None and got[DAYS[1], 1, 0] == pytest.approx(17 / 3)
    lib.save(f"{tmp_path}/lib.json")
    again = FeatureLibrary.load(f"{tmp_path}/lib.json")
    assert again.definitions == lib.definitions and again.search("price") == ["close"] and again.resolve("c").key == "close"
    lib.define("a", 'out = feature("b")')
    lib.define("b", 'out = feature("a")')
    with pytest.raises(FormulaError, match="circle"):
        lib.batch(["a"])
    for bad in (lambda: lib.define("close", "o = 1"), lambda: lib.define("d", "o = 1", alias="c"), lambda: lib.resolve("none"), lambda: lib.remove("none")):
        with pytest.raises(KeyError):
            bad()


def test_daily_values_reach_steps_a_day_late(engine):
    e = FormulaBatch.from_text("", {"f": 'o = source("stk.60min.p") + source("stk.1d.x")'}).bind(frozenset())["f"]
    got = values(engine.compute(Bound((("f", to_frequency(e, "60min")),)), Domain(*DAYS, freq="60min")), "f")
    assert got[DAYS[0], 1, 930] is None and got[DAYS[1], 1, 930] == 6 and got[DAYS[1], 3, 1400] == 12
    finer = values(engine.compute(Bound((("f", to_frequency(e, "30min", delay=0)),)), Domain(*DAYS, freq="30min")), "f")
    assert finer[DAYS[0], 1, 1000] == 2
    with pytest.raises(FormulaError):
        to_frequency(e, "1d")


def test_industry_and_index_helpers(engine):
    batch = FormulaBatch.from_text('x = get_lf("stk", "x")', {"m": "o = industry_mean(x)", "s": 'o = industry_stat(x, method="sum", level=1)', "i": 'o = x - broadcast_index_feature(500, "level")'})
    df = engine.compute(batch, Domain(*DAYS))
    assert values(df, "m")[DAYS[1], 1, 0] == 4 and values(df, "s")[DAYS[0], 3, 0] == 4 and values(df, "i")[DAYS[0], 2, 0] == -198


def test_features_run_saved_and_kept(spark, engine, tmp_path):
    from gridloom.plans.features import FeatureManager
    from gridloom.sources.repository import FactorRepository

    lib = FeatureLibrary()
    lib.define("close", 'out = get_lf("stk", "x")', alias="c")
    lib.define("spread", 'out = feature("c") - cs_mean(feature("c"))')
    lib.define("change", 'out = ts_diff(feature("spread"), 1)')
    m = FeatureManager(engine, lib, FactorRepository(spark, f"file://{tmp_path}/saved"))
    assert m.needs("change") == ["close", "spread", "change"] and m.needs("c") == ["close"]
    plain = sorted(map(tuple, m.execute(["spread", "change"], Domain(*DAYS)).collect()), key=str)
    assert len(plain) == 6 and not m.repository.exists("close")
    for chunk in (None, 1):
        own = FeatureManager(engine, lib, FactorRepository(spark, f"file://{tmp_path}/saved{chunk}"))
        last = Domain(DAYS[1], DAYS[1])
        got = own.execute(["spread", "change"], last, materialise=True, chunk_dates=chunk)
        assert sorted(map(tuple, got.collect()), key=str) == [r for r in plain if r[0] == DAYS[1]]
        assert all(own.repository.exists(k) for k in ("close", "spread", "change"))
        again = own.execute(["spread"], last, materialise=True)
        assert own.engine.stats.loads[0]["keys"] == ["factor:spread"] and again.count() == 3
    kept = m.keep(["c"], Domain(*DAYS))
    assert kept.is_cached and m.execute(["close"], Domain(*DAYS)) is kept
    m.drop()
    assert not kept.is_cached and m.execute(["close"], Domain(*DAYS)) is not kept
    lib.define("a", 'out = feature("b")')
    lib.define("b", 'out = feature("a")')
    with pytest.raises(FormulaError, match="circle"):
        m.execute(["a"], Domain(*DAYS))


def test_single_expressions_with_dotted_sources(engine):
    lib = FeatureLibrary()
    lib.define("close", 'out = get_lf("stk", "x")', alias="c")
    e = lib.formula('cs_corr(c, stk.1d.x, method="pearson") + c * 1.5 - stk.1d.x')
    got = values(engine.compute(Bound((("f", e),)), Domain(*DAYS)), "f")
    assert got[DAYS[0], 3, 0] == pytest.approx(1 + 0.5 * 4)
    assert lib.formula("-stk.60min.p") == Call("neg", (Call("source", (Literal("stk.60min.p"),)),))
    assert lib.formula('source("stk.1d.x")') == Call("source", (Literal("stk.1d.x"),))
    for bad, error in (("c +", FormulaError), ("a = c", FormulaError), ("1 < c < 2", FormulaError), ("unknown + 1", KeyError), ("c.real", FormulaError)):
        with pytest.raises(error):
            lib.formula(bad)
