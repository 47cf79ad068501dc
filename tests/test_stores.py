"""Stores, reference data as text, web tables, records and small functions on cases that can be worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom.functions import days as Y
from barloom.functions import maths, text
from barloom.operators import bars as B
from barloom.operators import inference as N
from barloom.operators import reference as R
from barloom.plans import search as S
from barloom.sources import files, ledger, web

D = dt.date


def lines(spark, *rows):
    return spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "file string, at long, line string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hashes_and_names(spark):
    assert [one(spark, text.fnv32(F.lit(x))) for x in ("", "a", "foobar")] == [2166136261, 0xE40C292C, 0xBF9CF968] and one(spark, text.fnv32(F.lit(None).cast("string"))) is None
    assert one(spark, text.cache_key([F.lit("ab"), F.lit("c")])) != one(spark, text.cache_key([F.lit("a"), F.lit("bc")]))
    assert [one(spark, text.vendor_symbol(F.lit(x))) for x in ("^GSPC", "^DJI", "btc-usd", "BRK.B", " a ")] == ["^spx", "^dji", "btcusd", "brk.b", "a.us"]
    m = lambda **kw: F.create_map(*(F.lit(x) for k, v in kw.items() for x in (k, float(v))))
    assert one(spark, text.same_params(m(a=1, b=2), m(b=2 + 1e-12, a=1))) and not one(spark, text.same_params(m(a=1), m(a=1.1))) and not one(spark, text.same_params(m(a=1), m(b=1)))
    low, high = maths.coin_flips(F.lit(100))
    assert one(spark, low) == pytest.approx(0.402) and one(spark, high) == pytest.approx(0.598) and one(spark, maths.significant(F.lit(-2.0)))
    rates = spark.createDataFrame([("A", 1.0, True), ("B", None, False)], "symbol string, annual_pct double, available boolean")
    assert rates.agg(text.rates_fingerprint().alias("x")).first() == rates.orderBy(F.desc("symbol")).agg(text.rates_fingerprint().alias("x")).first()


def test_sizes_and_days(spark):
    assert Y.bar_size(" Daily ") == "1d" and Y.bar_size("") == "1d" and Y.bar_size("60m") == "1h" and Y.coarser("week", "1d") and not Y.coarser("1m", "5m")
    with pytest.raises(ValueError):
        Y.bar_size("2 fortnights")
    assert Y.within_reach("5m", D(2020, 1, 1), D(2024, 1, 1)) == D(2023, 11, 2) and Y.within_reach("1d", D(2020, 1, 1), D(2024, 1, 1)) == D(2020, 1, 1)
    assert one(spark, Y.end_of_day(F.lit("2020-01-01"))) == "2020-01-01T23:59" and one(spark, Y.moved(F.lit("2020-02-28T10:00"), 2)) == "2020-03-01T10:00"
    assert one(spark, Y.days_between(F.lit(D(2020, 1, 5)), F.lit(D(2020, 1, 1)))) == 0
    assert S.merge_grids({"n": {"grid": [1, 2], "default": 1}, "m": {"grid": [], "default": 7}}, {"z": [3], "n": [9], "b": [4]}) == {"n": [9], "m": [7], "b": [4], "z": [3]}
    assert S.universe_of("Tech", {"tech": ["a", " B "]}) == ["A", "B"] and S.universe_of("a, b,A", {}) == ["A", "B"]


def test_reference_data_as_text(spark):
    got = files.share_lines(lines(spark, "symbol,from_day,shares", "# note", "a,2020-01-01,5", "A,2020-01-01,7", "B,2020-01-01,0", "C,never,5", "D"))
    assert [tuple(r) for r in got.collect()] == [("A", D(2020, 1, 1), 7.0)]
    got = files.tenure_lines(lines(spark, "index,symbol,from,to", "SP,a,2020-01-01,", "sp,A,2020-01-01,", "sp,b,,2020-05-01", "sp,c,2020-05-01,2020-01-01", "sp,d,soon,", "# x"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("sp", "A", D(2020, 1, 1), None), ("sp", "B", None, D(2020, 5, 1))]))
    m = files.with_lags(spark.createDataFrame([("cpi", D(2020, 1, 1), 1.0), ("x", D(2020, 1, 1), 2.0)], "series string, day date, value double"), spark.createDataFrame([("CPI", 12, False)], "series string, lag_days int, revised boolean"))
    assert {(r.series, r.lag_days, r.revised) for r in m.collect()} == {("CPI", 12, False), ("X", 30, True)}
    df = spark.createDataFrame([("a,b", 1.5, None), ('say "hi"', None, "z")], "t string, v double, u string")
    assert [r.line for r in files.table_lines(df, ["t", "v", "u"]).collect()] == ['"a,b",1.5,', '"say ""hi""",,z']


def test_strict_bars(spark):
    good = files.strict_bars(lines(spark, files.STRICT, "2020-01-01,1,2,0.5,1.5,1.5,100")).first()
    assert (good.bar_date, good.close, good.volume) == (D(2020, 1, 1), 1.5, 100.0)
    for rows in (["date,close", "2020-01-01,1"], [files.STRICT, "2020-01-01,1,2,0.5,NaN,1.5,100"], [files.STRICT, "someday,1,2,0.5,1,1.5,100"]):
        with pytest.raises(Exception, match=" in f"):
            files.strict_bars(lines(spark, *rows)).collect()


def test_stores(spark):
    bars = spark.createDataFrame([("A", D(2020, 1, i), float(i)) for i in range(1, 11)] + [("B", D(2020, 1, 5), 5.0)], "symbol string, bar_date date, close double")
    asked = spark.createDataFrame([("A", D(2020, 1, 3), D(2020, 1, 8)), ("B", D(2019, 1, 1), D(2020, 1, 8)), ("C", D(2020, 1, 1), D(2020, 1, 2)), ("B", D(2021, 1, 1), D(2021, 1, 2))], "symbol string, from_day date, to_day date")
    held = spark.createDataFrame([("A", D(2020, 1, 1), D(2020, 1, 10)), ("B", D(2019, 1, 1), D(2020, 1, 5))], "symbol string, requested_from date, last_day date")
    assert sorted((r.symbol, r.hit) for r in files.covered(asked, held).collect()) == [("A", True), ("B", False), ("B", False), ("C", False)]
    got = files.through_store(asked.where("symbol != 'C'"), bars, held, bars.withColumn("close", -F.col("close"))).collect()
    assert sorted((r.symbol, r.close, r.stored) for r in got) == [*[("A", float(i), True) for i in range(3, 9)], ("B", -5.0, False)]
    assert {(r.symbol, r.bars, r.error) for r in files.scanned(asked.limit(3), bars.where("symbol != 'B' or close < 0")).collect()} == {("A", 6, None), ("B", 0, "no data"), ("C", 0, "no data")}
    c = files.Chain({"x": {"1d": bars.where("symbol = 'A'")}, "y": {"1d": bars.withColumn("close", F.lit(0.0)), "1wk": bars}})
    assert c.sizes() == ["1d", "1wk"] and not c.supports("x", "1wk") and {(r.symbol, r.close > 0) for r in c.bars().collect()} == {("A", True), ("B", False)} and c.bars("1wk").count() == 11
    with pytest.raises(ValueError):
        c.bars("1m")
    names = spark.createDataFrame([("CO", "x"), ("COP", None), ("A", "Arco"), ("Z", "z")], "symbol string, name string")
    assert [r.symbol for r in files.found_symbols(names, " co ").collect()] == ["CO", "COP", "A"] and files.first_found([names.limit(0), names]).count() == 4
    o = files.overlay(bars, ["b", "A"]).where("bar_date = '2020-01-07'").collect()
    assert {(r.symbol, r.close, r.indexed) for r in o} == {("A", 7.0, 700.0), ("B", 5.0, 100.0)}
    with pytest.raises(ValueError):
        files.overlay(bars, [f"S{i}" for i in range(21)])
    later = B.bars_later(bars.where("bar_date = '2020-01-05'").select("symbol", "bar_date"), bars, 2).collect()
    assert {(r.symbol, r.later) for r in later} == {("A", D(2020, 1, 7)), ("B", None)}


def test_chart_documents(spark):
    body = {"chart": {"result": [{"meta": {"symbol": "a"}, "timestamp": [1577880000, 1577966400, 1578052800], "indicators": {"quote": [{"open": [1, None, 3], "high": [2, 2, 3], "low": [0.5, 1, 3], "close": [1.5, None, 3], "volume": [10, 10, None]}], "adjclose": [{"adjclose": [1.4, None, 2.9]}]}}]}}
    got = web.chart_bars(spark.createDataFrame([(json.dumps(body),), ("{broken",), ('{"chart": {"result": null}}',)], "body string")).orderBy("bar_date").collect()
    assert [(r.symbol, r.bar_date, r.close, r.adj_close, r.volume) for r in got] == [("A", D(2020, 1, 1), 1.5, 1.4, 10.0), ("A", D(2020, 1, 3), 3.0, 2.9, 0.0)]


def test_wiki_tables(spark):
    page = '{| class="wikitable"\n! Date !! Added !! Name !! Removed\n|-\n| June 1, 2020<ref>x</ref> || [[Exchange|NYSE: AB.C]] || Some name || XYZ\n|-\n| 2021-02-03\n| QQ\n| Other<!-- c -->\n|\n|}'
    rows = web.wiki_rows(spark.createDataFrame([("p", page)], "page string, body string"))
    got = {(r.day, r.added, r.removed) for r in web.wiki_changes(rows).collect()}
    assert got == {(D(2020, 6, 1), "AB-C", "XYZ"), (D(2021, 2, 3), "QQ", None)}
    assert [one(spark, web.wiki_day(F.lit(x))) for x in ("3 March 2019", "Mar 3, 2019", "soon")] == [D(2019, 3, 3), D(2019, 3, 3), None]


def test_ledger_of_searches(spark):
    e = spark.createDataFrame([("d", f"2020-01-0{i}", "s", 10 * i, "o", float(i)) for i in range(1, 6)] + [("e", "2020-01-01", "s", 1, "o", 1.0)], ledger.ENTRY)
    assert [r.dataset for r in ledger.datasets(e).collect()] == ["d", "e"] and ledger.reset(e, "d").count() == 1
    now = spark.createDataFrame([("d", 75), ("d", 76), ("e", 0), ("new", 5)], "dataset string, trials long")
    assert sorted((r.dataset, r.trials, r.warned) for r in ledger.warned(e, now).collect()) == [("d", 75, True), ("d", 76, False), ("e", 0, False), ("new", 5, False)]
    xs = [float(i) for i in range(1, 6) for _ in range(10 * i)]
    mean = sum(xs) / len(xs)
    s = {r.dataset: r.spread for r in ledger.spread(e).collect()}
    assert s["e"] is None and s["d"] == pytest.approx((sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) ** 0.5)
    a = spark.createDataFrame([("r", i, float(i)) for i in range(5)] + [("same", 1, None)], "run_id string, t int, v double")
    b = spark.createDataFrame([("r", i, float(i if i != 3 else 9)) for i in range(4)] + [("same", 1, None), ("more", 1, 1.0)], "run_id string, t int, v double")
    assert {(r.run_id, r.first, r.rows, r.what) for r in ledger.first_divergence(a, b, ["run_id"], "t", ["v"]).collect()} == {("r", 3, 2, "v"), ("same", None, 0, None), ("more", 1, 1, "new")}
    assert [r.run_id for r in ledger.kept_runs(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "run_id string, at int"), 2).collect()] == ["c", "b"]


def test_membership_and_borrowing(spark):
    spells = spark.createDataFrame([("i", "A", D(2020, 1, 10), D(2020, 2, 5)), ("i", "A", D(2020, 3, 1), None), ("i", "B", None, D(2020, 1, 31))], "index_name string, symbol string, from_day date, to_day date")
    bars = spark.createDataFrame([(s, D(2020, m, d)) for s in "ABC" for m in (1, 2, 3) for d in (1, 15)], "symbol string, bar_date date")
    got = {(r.symbol, r.bar_date.isoformat()) for r in R.with_membership(bars, spells).where("member = 1").collect()}
    assert got == {("A", "2020-01-15"), ("A", "2020-02-01"), ("A", "2020-03-01"), ("A", "2020-03-15"), ("B", "2020-01-01"), ("B", "2020-01-15")}
    assert {r.symbol for r in R.members_ever(spells, F.lit(D(2020, 2, 10)), F.lit(D(2020, 2, 20))).collect()} == set() and R.members_ever(spells, F.lit(D(1990, 1, 1)), F.lit(D(1990, 1, 2))).count() == 1
    c = R.covers(spells, F.lit(D(2020, 1, 10))).first()
    assert (c.earliest, c.tenures, c.covered) == (D(2020, 1, 10), 3, True)
    t = R.tenures_of(spark.createDataFrame([("N",)], "symbol string"), spark.createDataFrame([(D(2020, 1, 1), "A", None), (D(2020, 2, 1), None, "A"), (D(2020, 3, 1), "A", ""), (D(2020, 4, 1), "A", None), (D(2020, 5, 1), "", "B")], "day date, added string, removed string"))
    assert sorted(map(str, (tuple(r) for r in t.collect()))) == sorted(map(str, [("A", D(2020, 1, 1), D(2020, 1, 31)), ("A", D(2020, 3, 1), None), ("B", None, D(2020, 4, 30)), ("N", None, None)]))
    runs = spark.createDataFrame([("r", [("A", 12.0, 3.0)], [("B", 5.0), ("B", 2.0)], [("short", "A", 4.0), ("buy", "C", 1.0)]), ("long", [], [], [])], "run_id string, borrowed array<struct<symbol:string,fee:double,days:double>>, refusals array<struct<symbol:string,shares:double>>, fills array<struct<side:string,symbol:string,price:double>>")
    rates = spark.createDataFrame([("*", 2.0, True), ("B", None, False)], "symbol string, annual_pct double, available boolean")
    assert {(r.symbol, r.fee, r.annual_pct, r.hard, r.refused, r.refused_shares, r.low_priced) for r in R.borrow_report(runs, rates).collect()} == {("A", 12.0, 2.0, False, 0, 0.0, True), ("B", 0.0, 2.0, True, 2, 7.0, False)}


def test_pairs_of_runs(spark):
    rows = [("a", D(2020, 1, 1) + dt.timedelta(i), 0.01 * (1 if i % 2 else -0.5)) for i in range(100)] + [("b", D(2020, 1, 1) + dt.timedelta(i), 0.01 * (1 if i % 2 else -0.9)) for i in range(100)] + [("c", D(2020, 1, 1), 0.1)]
    curves = spark.createDataFrame(rows, "run_id string, bar_date date, r double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    got = {r.b: r for r in N.sharpe_gap(pairs, curves, 200).collect()}
    assert got["b"].gap > 0 and got["b"].p05 <= got["b"].gap <= got["b"].p95 and got["c"].gap is None and got["c"].days == 1
    setups = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "x")], "run_id string, cash int, kind string")
    assert {(r.b, tuple(r.differ), r.comparable) for r in N.mismatches(pairs, setups, ["cash", "kind"]).collect()} == {("b", ("kind",), False), ("c", (), True)}
