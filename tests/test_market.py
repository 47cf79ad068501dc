"""Indicators against plain loops, calendars, sources, records, streams."""

import datetime as dt
import json
import math
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import days, maths, text
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import recursive as R
from barloom.sources import files, ledger
from barloom.streaming import bars as stream

D = dt.date


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    c = 50 * np.exp(np.cumsum(0.02 * rng.standard_normal(170)))
    return pd.DataFrame({"symbol": "A", "bar_date": pd.bdate_range("2020-01-01", periods=170).date, "o": c, "h": c * 1.02, "l": c * 0.97, "c": c, "v": 1e6})


def ema_loop(x, n, a=None):
    a = a or 2 / (n + 1)
    out = [None] * len(x)
    if len(x) >= n:
        out[n - 1] = sum(x[:n]) / n
        for i in range(n, len(x)):
            out[i] = x[i] * a + out[i - 1] * (1 - a)
    return out


def macd_loop(c, t):
    x = c[max(0, t + 1 - 141) : t + 1]
    if len(x) < 35:
        return None
    line = [a - b for a, b in zip(ema_loop(x, 12), ema_loop(x, 26)) if a is not None and b is not None]
    return line[-1], ema_loop(line, 9)[-1]


def adx_loop(p, t, n=14):
    q = p.iloc[max(0, t + 1 - (4 * n + 10)) : t + 1]
    h, l, c = (q[k].tolist() for k in "hlc")
    if len(q) < 2 * n + 1:
        return None
    tr = [max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, len(q))]
    up = [max(h[i] - h[i - 1], 0) if h[i] - h[i - 1] > l[i - 1] - l[i] else 0 for i in range(1, len(q))]
    down = [max(l[i - 1] - l[i], 0) if l[i - 1] - l[i] > h[i] - h[i - 1] else 0 for i in range(1, len(q))]
    s = [sum(x[:n]) for x in (tr, up, down)]
    dx = []
    for i in range(n - 1, len(tr)):
        if i >= n:
            s = [a - a / n + x[i] for a, x in zip(s, (tr, up, down))]
        p_, m_ = 100 * s[1] / s[0], 100 * s[2] / s[0]
        dx.append(100 * abs(p_ - m_) / (p_ + m_) if p_ + m_ else 0)
    return ema_loop(dx, n, 1 / n)[-1]


def test_recursive_against_loops(spark, series):
    df = spark.createDataFrame(series)
    macd = R.recursive(df, "macd").toPandas().sort_values("bar_date").reset_index()
    adx = R.recursive(df, "adx").toPandas().sort_values("bar_date").reset_index()
    c = series["c"].tolist()
    for t in range(len(c)):
        want = macd_loop(c, t)
        got = macd.loc[t, ["line", "signal"]].tolist()
        assert (want is None and math.isnan(got[0])) or got == pytest.approx(list(want)), t
        x = adx_loop(series, t)
        assert (x is None and math.isnan(adx.loc[t, "adx"])) or adx.loc[t, "adx"] == pytest.approx(x), t


def test_bands_and_stops(spark, series):
    df = spark.createDataFrame(series)
    st = R.recursive(df, "supertrend").toPandas().sort_values("bar_date").reset_index()
    ps = R.recursive(df, "psar").toPandas().sort_values("bar_date").reset_index()
    known = st["value"].notna()
    assert known.tolist() == [t + 1 >= 30 for t in range(170)]
    side = np.sign(series["c"] - st["value"])[known]
    assert (side == np.where(st["rising"][known] > 0, 1, -1)).mean() > 0.95
    assert ps["value"].notna().sum() == 166
    k = df.withColumns({}).select("symbol", "bar_date", "o", "h", "l", "c", "v")
    kc = I.with_inputs(k).withColumns({f"k_{n}": x for n, x in I.keltner(20).items()}).toPandas().sort_values("bar_date").reset_index()
    x = series["c"].tolist()[100 - 64 : 101]
    assert kc.loc[100, "k_middle"] == pytest.approx(ema_loop(x, 20)[-1])
    assert (kc["k_upper"] - kc["k_middle"]).dropna().gt(0).all()


def test_no_indicator_sees_the_future(spark, series):
    """Later bars change no earlier value."""
    for cols in (lambda: {"a": I.ema(10), "b": I.atr(14), "c1": I.hma_input(10), "d": I.zscore(20), "e": I.choppiness(14)},):
        whole, part = (I.with_inputs(spark.createDataFrame(series.iloc[:n])).withColumns(cols()).where("bar_date < '2020-06-01'").drop("h").orderBy("bar_date").toPandas() for n in (170, 120))
        pd.testing.assert_frame_equal(whole, part)


def test_asof_ties_nulls_and_empty(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 5), 1), ("a", D(2020, 1, 1), 2), (None, D(2020, 1, 1), 3), ("b", D(2020, 1, 1), 4)], "k string, d date, n int")
    right = spark.createDataFrame([("a", D(2020, 1, 3), 1.0), ("a", D(2020, 1, 3), 2.0), ("a", D(2020, 1, 5), None), ("c", D(2020, 1, 1), 9.0)], "k string, d date, x double")
    got = lambda **kw: {r.n: r.x for r in B.asof(left, right, ["k"], "d", ["x"], **kw).collect()}
    assert got() == {1: None, 2: None, 3: None, 4: None}  # the row of the day itself holds a null
    assert got(lag_days=F.lit(1)) == {1: 2.0, 2: None, 3: None, 4: None}
    assert got(back_fill=True)[2] == 2.0 and got(forward=True)[2] == 2.0
    assert B.asof(left, right.limit(0), ["k"], "d", ["x"]).count() == 4 and B.asof(left.limit(0), right, ["k"], "d", ["x"]).count() == 0


def test_holidays(spark):
    assert sorted(days.holidays(2023)) == [D(2023, 1, 2), D(2023, 1, 16), D(2023, 2, 20), D(2023, 4, 7), D(2023, 5, 29), D(2023, 6, 19), D(2023, 7, 4), D(2023, 9, 4), D(2023, 11, 23), D(2023, 12, 25)]
    assert D(2022, 12, 26) in days.holidays(2022) and D(2021, 12, 24) in days.holidays(2021) and D(2022, 1, 1) not in days.holidays(2022) and D(2021, 12, 31) not in days.holidays(2021)
    assert days.easter(2024) == D(2024, 3, 31)
    assert days.trading_days(spark, "2023-01-01", "2023-12-31").count() == 250
    assert days.periods_per_year("15m") == 252 * 26 and days.periods_per_year("1d", "continuous") == 365


def test_text_functions(spark):
    df = spark.createDataFrame([("https://www.a.b:80/x", "<p>a &amp; b</p>", "so: {\"a\": [1, \"}\"]} ok", "Big  Name, Inc.", "03/04/2020")], "u string, h string, j string, n string, d string")
    r = df.select(text.host(F.col("u")), text.without_tags(F.col("h")), text.json_in(F.col("j")), text.slug(F.col("n")), text.flexible_day(F.col("d"))).first()
    assert tuple(r) == ("a.b:80", "a & b", '{"a": [1, "}"]}', "big-name-inc", D(2020, 3, 4))
    dates = spark.createDataFrame([("25/12/2020",), ("20201225",), ("1608854400",), ("2020/12/25",), ("2020-12-25T10:00",), ("x",)], "d string").select(text.flexible_day(F.col("d"))).collect()
    assert [x[0] for x in dates] == [D(2020, 12, 25)] * 5 + [None]
    x = spark.createDataFrame([(v,) for v in (-3.0, -0.5, 0.0, 1.0, 2.5)], "x double").select("x", maths.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-7) for r in x)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/BRK_B.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n01/02/2020,1,2,0.5,1.5,1.4,100\n01/03/2020,,,,2,,bad\nsoon,1,1,1,1,1,1\n01/04/2020,1,1,1,0,1,1\n01/02/2020,1,2,0.5,1.6,1.4,100\n\n")
    (tmp_path / "in/X.csv").write_text("close,date\n3,2020-01-02\n")
    b = files.read_bars(spark, str(tmp_path / "in"))
    got = {(r.symbol, str(r.bar_date)): (r.open, r.high, r.low, r.close, r.adj_close, r.volume) for r in b.collect()}
    assert got == {("BRK-B", "2020-01-02"): (1, 2, 0.5, 1.6, 1.4, 100), ("BRK-B", "2020-01-03"): (2, 2, 2, 2, 2, 0), ("X", "2020-01-02"): (3, 3, 3, 3, 3, 0)}
    files.write_bars(b, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_reference_lines(spark):
    lines = lambda *x: spark.createDataFrame([("f", i, s) for i, s in enumerate(x)], "file string, at int, line string")
    assert [(str(r.day), r.value) for r in files.economic(lines("observation_date,X", "2020-01-01,.", "2020-02-01,3.5", "")).collect()] == [("2020-02-01", 3.5)]
    rates = {r.symbol: (r.annual_pct, r.available) for r in files.borrow_rates(lines("symbol,annual_pct,available", "aapl,.3,", "GME,85%,yes", "SIRI,,no", "HTZ,n/a,", "*,2.5,")).collect()}
    assert rates == {"AAPL": (0.3, True), "GME": (85.0, True), "SIRI": (None, False), "HTZ": (None, False), "*": (2.5, True)}
    with pytest.raises(Exception, match="bad rate"):
        files.borrow_rates(lines("X,-1,")).collect()
    kept = files.compressed(spark.createDataFrame([("s", i, v) for i, v in enumerate([100.0, 100.2, 100.4, 101.0, 101.1])], "k string, a int, v double"), "k", "a", "v")
    assert sorted(r.a for r in kept.collect()) == [0, 3, 4]


def test_synthetic_is_the_same_whatever_else_is_asked(spark):
    one = files.synthetic(spark, ["A"], "2020-01-01", "2020-03-01").orderBy("bar_date").collect()
    two = files.synthetic(spark, ["A", "B"], "2020-01-01", "2020-03-01").where("symbol = 'A'").orderBy("bar_date").collect()
    assert one == two and all(r.low <= min(r.open, r.close) and r.high >= max(r.open, r.close) for r in one)


def test_ledger_chain_and_bundle(spark, tmp_path):
    e = spark.createDataFrame([("d", "2020", "s", 10, "sharpe", 1.0), ("d", "2021", "t", 30, "calmar", 2.0)], ledger.ENTRY)
    ledger.record(e, str(tmp_path / "l"))
    (tmp_path / "l/torn.json").write_text('{"dataset": "d", "at": ')
    s = ledger.summary(ledger.read(spark, str(tmp_path / "l"))).first()
    assert (s.entries, s.trials, s.objective, s.best, s.weighted_score) == (2, 40, "calmar", 2.0, 1.75)
    log = ledger.sealed(spark.createDataFrame([("a", i, i * 1.5) for i in range(5)], "c string, i int, x double"), "c", "i", ["c", "i", "x"])
    assert ledger.verified(log, "c", "i").first().broken_at is None
    bad = log.withColumn("body", F.when(F.col("i") == 3, F.lit(json.dumps({"c": "a", "i": 3, "x": 9}))).otherwise(F.col("body")))
    assert ledger.verified(bad, "c", "i").first().broken_at == 3
    path = str(tmp_path / "b")
    ledger.write_bundle(path, {"log": log}, {"made": "today"})
    assert ledger.open_bundle(spark, path)["log"].count() == 5
    spark.range(3).write.mode("overwrite").parquet(f"{path}/log")
    with pytest.raises(ValueError):
        ledger.open_bundle(spark, path)


def test_append_once(spark, tmp_path):
    source, out = tmp_path / "src", str(tmp_path / "out")
    schema = "k int, v string"

    def put(rows, n):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
        s = spark.readStream.schema(schema).parquet(str(source))
        stream.append_once(s, out, str(tmp_path / f"state{n}"), ["k"]).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    assert put([(1, "a"), (2, "b")], 1) == [(1, "a"), (2, "b")]
    assert put([(2, "b"), (3, "c")], 2) == [(1, "a"), (2, "b"), (3, "c")]  # a fresh state reads all again
    with pytest.raises(Exception, match="other content"):
        put([(1, "changed")], 3)
    shutil.rmtree(source)
