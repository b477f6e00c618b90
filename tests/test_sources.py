import pytest
from pyspark.sql import functions as F

from gridloom.engine import Engine
from gridloom.formula import FormulaBatch
from gridloom.plans.compiler import Domain
from gridloom.operators.spec import CompileError
from gridloom.sources import builders as B
from gridloom.sources.catalog import Catalog, CatalogError

DAYS = ["20240102", "20240103", "20240104"]


def values(df, name):
    return {(r.date, r.asset): r[name] for r in df.collect()}


def compute(spark, provider, text, asset="stk", first=DAYS[0], last=DAYS[-1], **domain):
    return values(Engine(spark, provider).compute(FormulaBatch.from_lines(f"o = {text}"), Domain(first, last, asset=asset, **domain)), "o")


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(f"2024-01-0{d}", f"S{a}", float(10 * d + a), 1 if (d, a) != (3, 2) else 0) for d in (2, 3, 4) for a in (1, 2)]
    return spark.createDataFrame(rows, "day string, name string, px double, flag int")


def test_dates_of_every_type_are_compared_raw(spark, bars):
    """Strings with a spelling, numbers, dates and timestamps: the same rows, and the scan is given the range."""
    from gridloom.functions.calendar import in_days

    forms = {"string": bars, "int": bars.withColumn("day", F.regexp_replace("day", "-", "").cast("int")), "date": bars.withColumn("day", F.to_date("day")), "timestamp": bars.withColumn("day", F.to_timestamp("day") + F.expr("interval 9 hours"))}
    for kind, df in forms.items():
        c = {"frame": df, "asset": "stk", "date": "day", "code": "name", "fields": ["px"]} | ({"spelling": "%Y-%m-%d"} if kind == "string" else {})
        got = compute(spark, Catalog(spark, {"bars": c}).provider(), 'get_lf("stk", "px")', first=DAYS[1], last=DAYS[1])
        assert got == {(DAYS[1], "S1"): 31.0, (DAYS[1], "S2"): 32.0}
    assert in_days(F.col("x"), "string", "20240101", "20240102") is None
    plain = Catalog(spark, {"bars": {"frame": bars, "asset": "stk", "date": "day", "code": "name", "fields": ["px"]}}).provider()
    assert compute(spark, plain, 'get_lf("stk", "px")', last=DAYS[0])[DAYS[0], "S2"] == 22.0


def test_flags_names_and_whitelists(spark, bars):
    c = {"frame": bars, "asset": "stk", "date": "day", "code": "name", "fields": ["price"], "rename": {"price": "px"}, "flag": "flag"}
    catalog = Catalog(spark, {"bars": c})
    assert catalog.keys() == ["stk.1d.price"] and catalog.search("PRICE") == ["stk.1d.price"]
    got = compute(spark, catalog.provider(), 'get_lf("stk", "price")')
    assert got[DAYS[1], "S2"] is None and got[DAYS[2], "S2"] == 42.0
    with pytest.raises(CompileError):
        compute(spark, catalog.provider(), 'get_lf("stk", "px")')  # not on the list
    for bad in (c | {"fields": ["none"]}, c | {"strange": 1}, {k: v for k, v in c.items() if k != "date"}, c | {"identity": "outer"}, c | {"identity": "odd"}):
        with pytest.raises(CatalogError):
            Catalog(spark, {"bars": bad})


def test_code_maps(spark, bars):
    static = spark.createDataFrame([(1, "S1"), (2, "S2")], "inner bigint, outer string")
    axes = {"stk": {"frame": static, "code": "inner"}}
    c = {"frame": bars, "asset": "stk", "date": "day", "code": "name", "fields": ["px"], "identity": "outer"}
    place = {"outer": "outer", "inner": "inner"}
    got = compute(spark, Catalog(spark, {"b": c}, axes=axes, codes={"stk": place | {"frame": static}}).provider(), 'get_lf("stk", "px")')
    assert got[DAYS[0], 1] == 21.0 and got[DAYS[2], 2] == 42.0
    # a map that changes over time: the names change hands on the last day, and one day has no row for S2
    rows = [("2024-01-02", 1, "S1"), ("2024-01-02", 2, "S2"), ("2024-01-03", 1, "S1"), ("2024-01-04", 2, "S1"), ("2024-01-04", 1, "S2")]
    dated = place | {"frame": spark.createDataFrame(rows, "d string, inner bigint, outer string"), "date": "d"}
    got = compute(spark, Catalog(spark, {"b": c}, axes=axes, codes={"stk": dated}).provider(), 'get_lf("stk", "px")')
    assert got == {(DAYS[0], 1): 21.0, (DAYS[0], 2): 22.0, (DAYS[1], 1): 31.0, (DAYS[1], 2): None, (DAYS[2], 1): 42.0, (DAYS[2], 2): 41.0}
    with pytest.raises(Exception, match="no inner code for S2"):
        compute(spark, Catalog(spark, {"b": c | {"unmatched": "fail"}}, axes=axes, codes={"stk": dated}).provider(), 'get_lf("stk", "px")')
    # outer codes compare as text, whatever their type
    numbers = bars.withColumn("name", F.substring("name", 2, 9).cast("int"))
    text = place | {"frame": spark.createDataFrame([(7, "1"), (8, "2")], "inner bigint, outer string")}
    got = compute(spark, Catalog(spark, {"b": c | {"frame": numbers}}, axes={"stk": {"frame": text["frame"], "code": "inner"}}, codes={"stk": text}).provider(), 'get_lf("stk", "px")')
    assert got[DAYS[0], 7] == 21.0 and got[DAYS[0], 8] == 22.0


def test_stored_calendar_and_axes(spark, bars):
    calendar = {"frame": spark.createDataFrame([("2024-01-02", 1), ("2024-01-03", 1), ("2024-01-04", 1), ("2024-01-06", 0)], "d string, open int"), "date": "d", "flag": "open"}
    axis = spark.createDataFrame([("2024-01-02", "S1", 1), ("2024-01-03", "S3", 1), ("2024-01-04", "S2", 0)], "d string, code string, trading int")
    catalog = Catalog(spark, {"b": {"frame": bars, "asset": "stk", "date": "day", "code": "name", "fields": ["px"]}}, calendar, {"stk": {"frame": axis, "code": "code", "date": "d", "flag": "trading"}})
    p = catalog.provider()
    assert p.calendar() == DAYS and p.assets("stk", DAYS) == ["S1", "S3"] and p.assets("stk", DAYS[1:]) == ["S3"]
    assert compute(spark, p, 'get_lf("stk", "px")')[DAYS[0], "S1"] == 21.0


def test_files_of_one_date(spark, tmp_path):
    for k, d in enumerate(DAYS):
        rows = [(a, hhmm, float(100 * k + 10 * a + s)) for a in (1, 2) for s, hhmm in enumerate((930, 1030, 1300, 1400))]
        rows += [(1, 1501, 5.0), (99, 930, 7.0)]  # after the session; not on the axis
        spark.createDataFrame(rows, "code bigint, hhmm int, px double").withColumn("unread", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/{d}")
        next((tmp_path / d).glob("*.parquet")).rename(tmp_path / f"bars_{d}.parquet")
    days = {"frame": spark.createDataFrame([(d,) for d in DAYS], "d string"), "date": "d"}
    axes = {"stk": {"frame": spark.createDataFrame([(1,), (2,)], "code bigint"), "code": "code"}}
    c = {"files": f"{tmp_path}/bars_{{date}}.parquet", "asset": "stk", "freq": "60min", "steps": 4, "code": "code", "step": "hhmm", "labels": [930, 1030, 1300, 1400], "fields": ["px"]}
    provider = Catalog(spark, {"m": c}, days, axes).provider()
    df = Engine(spark, provider).compute(FormulaBatch.from_lines('o = get_hf("stk", "60min", "px")'), Domain(DAYS[1], DAYS[2], freq="60min"))
    got = {(r.date, r.asset, r.step): r.o for r in df.collect()}
    assert len(got) == 16 and got[DAYS[1], 2, 1300] == 122.0 and got[DAYS[2], 1, 930] == 210.0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "unread" not in plan and f"bars_{DAYS[0]}" not in plan
    assert compute(spark, provider, 'step_last(get_hf("stk", "60min", "px"))')[DAYS[0], 2] == 23.0
    with pytest.raises(CatalogError, match="stored calendar"):
        Catalog(spark, {"m": c}).provider().calendar()
    (tmp_path / f"bars_{DAYS[1]}.parquet").unlink()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        compute(spark, provider, 'step_last(get_hf("stk", "60min", "px"))')


def test_untradable_states(spark):
    cols = B.UNTRADABLE
    rows = [("20240102", k, *[1 if j == k else (None if (j + k) % 3 else 0) for j in range(16)]) for k in range(17)]
    df = spark.createDataFrame(rows, "d string, code int, " + ", ".join(f"{c} int" for c in cols))
    got = {r.code: r.untradable for r in B.any_flag(df, "d", "code").collect()}
    assert got == {k: 1.0 for k in range(16)} | {16: 0.0}
    c = {"frame": df, "asset": "stk", "date": "d", "code": "code", "any_flag": {"untradable": list(cols), "limit": ["IfLimitup", "IfLimitdown"]}, "kinds": {"untradable": "mask", "limit": "mask"}}
    p = Catalog(spark, {"states": c}).provider()
    limit = compute(spark, p, 'get_lf("stk", "limit")', last=DAYS[0])
    assert {a for (_, a), v in limit.items() if v} == {cols.index("IfLimitup"), cols.index("IfLimitdown")}


def reports(spark):
    rows = [
        ("20240102", 1, "2024-01-01", "2023-12-31", 1, 5.0, 50.0), ("20240102", 1, "2023-10-20", "2023-09-30", 2, 4.0, 40.0), ("20240102", 1, "2023-07-01", "2023-06-30", 3, 3.0, 30.0),
        ("20240103", 1, "2024-01-01", "2023-12-31", 1, 6.0, 60.0), ("20240102", 2, "2023-01-01", "2023-12-31", 1, 9.0, 90.0), ("20240102", 2, "2023-11-01", "2023-12-31", 2, 8.0, 80.0),
    ]
    df = spark.createDataFrame(rows, "d string, code int, pub string, ended string, r int, profit double, sales double")
    return df.withColumn("pub", F.to_date("pub")).withColumn("ended", F.to_date("ended"))


def test_reports_take_their_parameters_from_the_formula(spark):
    c = {"frame": reports(spark), "asset": "stk", "date": "d", "code": "code", "fields": ["profit", "sales"], "reports": ["pub", "ended", "r"]}
    p = Catalog(spark, {"fund": c}).provider()
    one = compute(spark, p, 'get_fund("stk", "profit")', last=DAYS[1])
    assert one == {(DAYS[0], 1): 5.0, (DAYS[1], 1): 6.0, (DAYS[0], 2): None, (DAYS[1], 2): None}  # published a year before the end: more than 180 days early
    late = compute(spark, p, 'get_fund("stk", "profit", publ_date_limit=-400)', last=DAYS[1])
    assert late[DAYS[0], 2] == 9.0
    steps = {k: compute(spark, p, f'get_step(get_fund("stk", "sales", quarters=3), {k})', last=DAYS[0]) for k in (0, 1, 2)}
    assert [steps[k][DAYS[0], 1] for k in (0, 1, 2)] == [30.0, 40.0, 50.0] and steps[1][DAYS[0], 2] == 80.0
    total = compute(spark, p, 'step_sum(get_fund("stk", "sales", quarters=3)) + get_fund("stk", "profit")', last=DAYS[0])
    assert total[DAYS[0], 1] == 125.0  # two horizons of one table in one formula
    for bad in ('get_fund("stk", "profit", quarters=0)', 'get_fund("stk", "profit", quarters=1.5)', 'get_fund("stk", "profit", halves=2)'):
        with pytest.raises(CompileError):
            compute(spark, p, bad)


def test_report_tables_register_themselves(spark):
    reports(spark).createOrReplaceTempView("own_reports")
    items = spark.createDataFrame([("profit", "own_reports", "profit"), ("turnover", "own_reports", "sales"), ("gone", "own_reports", "no_column"), ("none", "no_table", "x")], "item string, tab string, col string")
    config = B.report_tables(spark, items, "item", "tab", "col", {"asset": "stk", "date": "d", "code": "code", "reports": ["pub", "ended", "r"]})
    catalog = Catalog(spark, config)
    assert catalog.keys() == ["stk.1d.profit", "stk.1d.turnover"]
    assert compute(spark, catalog.provider(), 'get_fund("stk", "turnover")', last=DAYS[0])[DAYS[0], 1] == 50.0


def test_bonds_point_to_stocks(spark, bars):
    codes = spark.createDataFrame([(101, 10), (102, 29), (103, 5), (104, 10)], "bond bigint, nature int")
    terms = spark.createDataFrame([(101, 2), (102, 1), (103, 1), (105, 1)], "bond bigint, stock bigint")
    rows = B.bond_stocks(codes, terms, "bond", "nature", "stock")
    assert sorted(map(tuple, rows.collect())) == [(101, 2), (102, 1)]
    stocks = bars.withColumn("name", F.substring("name", 2, 9).cast("bigint"))
    bond = {"frame": rows, "asset": "cb", "code": "code", "static": True, "fields": ["underlying_stk", "stock"], "rename": {"underlying_stk": "stock"}, "kinds": {"underlying_stk": "code"}}
    config = {"s": {"frame": stocks, "asset": "stk", "date": "day", "code": "name", "fields": ["px"]}, "b": bond | {"positions": {"underlying_stk": "stk"}}}
    p = Catalog(spark, config).provider()
    assert compute(spark, p, 'project_stk_to_cb(get_lf("stk", "px"))', asset="cb")[DAYS[0], 101] == 22.0
    assert compute(spark, p, 'get_lf("cb", "stock")', asset="cb")[DAYS[2], 102] == 1.0  # the inner code itself


def test_as_of_takes_the_latest_known(spark):
    rows = spark.createDataFrame([(1, 5), (1, 10), (2, 5)], "k int, t int")
    news = spark.createDataFrame([(1, 5, 2.0), (1, 5, 3.0), (1, 9, None), (1, 11, 9.0), (3, 1, 1.0)], "k int, at int, v double")
    got = {(r.k, r.t): r.f for r in B.as_of(rows, news, "k", "t", "at", "v", "f", 1.0).collect()}
    assert got == {(1, 5): 3.0, (1, 10): 3.0, (2, 5): 1.0}


def test_stream_closes_windows_and_adds_the_open_ones(spark, tmp_path):
    from gridloom.streaming.bars import step_bars, stream_to_bars

    rows = [(f"2024-01-0{1 + k // 24} {k % 24:02d}:15:00", "a" if k % 3 else "b", float(k)) for k in range(60)]
    spark.createDataFrame(rows, "ts string, c string, v double").withColumn("ts", F.to_timestamp("ts")).repartition(3).write.parquet(f"{tmp_path}/events")
    table = spark.read.parquet(f"{tmp_path}/events")
    out = stream_to_bars(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/events"), table, "ts", "c", "v", folder=f"{tmp_path}/out")
    closed = spark.read.parquet(f"{tmp_path}/out/closed").count()
    want = step_bars(table, "ts", "c", "v")
    assert 0 < closed < want.count() and sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
