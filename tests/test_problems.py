"""Small cases of the data problems: nulls, empty tables, ties, repeats, clashing columns, hot keys, brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.common import day_of, epoch_of, symbol_of
from barloom.operators import snapshots as S
from barloom.operators.grid import increments, regular_grid
from barloom.operators.intervals import continuous_periods, latest_versions
from barloom.operators.known import known_at
from barloom.operators.snapshots import snapshot_changes
from barloom.operators.spikes import additive_outliers, implausible, stuck
from barloom.operators.trailing import calendar_days, extreme_days, trailing
from barloom.queries.problems import p2_grid

D = dt.date


# -- common ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [("2022-01-10T15:29Z", 1641828540), ("2022-01-10 15:29", 1641828540), ("2022-01-10T15:29:00Z", 1641828540), ("2022-02-11T04:01-05:00", 1644570060), ("2022-03-21T17:50+02:00", 1647877800), (" 2022-01-10\t", 1641772800), ("2022-01-10T25:00", None), ("soon", None), ("", None), (None, None)],
)
def test_epoch(spark, text, want):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark.createDataFrame([(text,)], "t string").select(epoch_of("t").alias("e")).first()["e"] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_day_and_symbol(spark):
    r = spark.createDataFrame([(" 2020-01-05", " ab1 "), ("2020-01-05T10:00+02:00", "AB1"), ("2020-13-05", " "), ("20200105", None), (None, "x")], "d string, s string")
    got = [tuple(x) for x in r.select(day_of("d"), symbol_of("s")).collect()]
    assert got == [(D(2020, 1, 5), "AB1"), (D(2020, 1, 5), "AB1"), (None, None), (None, None), (None, "X")]


# -- 1 -----------------------------------------------------------------------------------------------------------------------

SPELL = "k string, a date, b date, kind string, from_day string, _a int"


def periods(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SPELL)  # extra columns whose names clash with the result's
    return sorted(tuple(r) for r in continuous_periods(df, ["k"], "a", "b").fillna({"k": "-"}).withColumn("to_day", F.coalesce(F.col("to_day").cast("string"), F.lit(""))).withColumn("from_day", F.col("from_day").cast("string")).collect())


def test_periods_touch_nest_overlap_and_gap(spark):
    rows = [("u", D(2020, 1, 1), D(2020, 1, 5)), ("u", D(2020, 1, 6), D(2020, 1, 8)), ("u", D(2020, 1, 7), D(2020, 1, 7)), ("u", D(2020, 1, 10), None), ("u", D(2020, 2, 1), D(2020, 2, 2)), ("u", D(2020, 1, 1), D(2020, 1, 2))]
    assert periods(spark, rows) == [("u", "gap", "2020-01-09", "2020-01-09"), ("u", "period", "2020-01-01", "2020-01-08"), ("u", "period", "2020-01-10", "")]


def test_periods_void_null_and_empty(spark):
    assert periods(spark, []) == []
    assert periods(spark, [("u", None, D(2020, 1, 1)), ("u", D(2020, 1, 2), D(2020, 1, 1)), (None, D(2020, 1, 1), D(2020, 1, 1))]) == [("-", "period", "2020-01-01", "2020-01-01")]


def test_periods_against_days(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        a = D(2020, 1, 1) + dt.timedelta(rng.randrange(250))
        rows.append((rng.choice("xyz"), a, a + dt.timedelta(rng.randrange(6))))
    want = []
    for k in "xyz":
        days = sorted({a + dt.timedelta(i) for s, a, b in rows if s == k for i in range((b - a).days + 1)})
        spans = []
        for d in days:
            if spans and spans[-1][1] + dt.timedelta(1) == d:
                spans[-1][1] = d
            else:
                spans.append([d, d])
        want += [(k, "period", str(a), str(b)) for a, b in spans]
        want += [(k, "gap", str(x[1] + dt.timedelta(1)), str(y[0] - dt.timedelta(1))) for x, y in zip(spans, spans[1:])]
    assert periods(spark, rows) == sorted(want)


def test_latest_versions_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "c")], "k int, o int, v string")
    assert sorted(tuple(r) for r in latest_versions(df, ["k"], ["o"]).select("k", "v").collect()) == [(1, "b"), (2, "c")]


# -- 2 -----------------------------------------------------------------------------------------------------------------------

WINDOW = "entity string, step long, from_s long, to_s long, open_s int, close_s int, weekdays_only boolean, slot int, value int"


def window(spark, rows):
    return spark.createDataFrame([(*r, 7, 7) for r in rows], WINDOW)


def test_daily_volume_adds_up(spark, tmp_path):
    """A day whose first volume is larger than all of the day before, and a symbol's first reading, keep their volumes."""
    bars = [("A", "2022-01-10T15:00", 5.0), ("A", "2022-01-10T15:20", 10.0), ("A", "2022-01-11T15:00", 40.0), ("A", "2022-01-11T15:30", 1.0), ("A", "2022-01-12T15:00", 2.0), ("B", "2022-01-11T15:00", 7.0)]
    rows = [(s, t, 1.0, v, i) for i, (s, t, v) in enumerate(bars)]
    spark.createDataFrame(rows, "symbol string, bar_stamp string, close double, volume double, bar_seq long").write.parquet(f"{tmp_path}/intraday_bars.parquet")
    windows = [(s, "all", 10, "2022-01-10T00:00", "2022-01-13T00:00") for s in "AB"]
    spark.createDataFrame(windows, "symbol string, calendar string, step_min int, from_stamp string, to_stamp string").write.parquet(f"{tmp_path}/feed_windows.parquet")
    got = p2_grid(spark, str(tmp_path)).groupBy("symbol", F.substring("slot", 1, 10)).agg(F.sum("value")).collect()
    assert {(s, d): round(v, 2) for s, d, v in map(tuple, got) if v} == {("A", "2022-01-10"): 15.0, ("A", "2022-01-11"): 41.0, ("A", "2022-01-12"): 2.0, ("B", "2022-01-11"): 7.0}


def test_increments_and_reset(spark):
    r = spark.createDataFrame([("a", 100, 5.0), ("a", 200, 9.0), ("a", 90_000, 3.0), ("b", 5, None)], "entity string, ts long, counter double")
    got = {(x.entity, x.ts): (x.prev_ts, x.gain, x.reset) for x in increments(r).collect()}
    assert got == {("a", 100): (None, None, False), ("a", 200): (100, 4.0, False), ("a", 90_000): (200, 3.0, True), ("b", 5): (None, None, False)}


def test_gains_are_spread_by_overlap(spark):
    r = spark.createDataFrame([("a", 0, 0.0), ("a", 900, 90.0), ("a", 2400, 100.0), (None, 5, 1.0), ("a", None, 1.0)], "entity string, ts long, counter double")
    w = window(spark, [("a", 600, 0, 3600, 0, 86400, False), ("b", 600, 0, 1200, 0, 86400, False), ("a", 0, 0, 100, 0, 86400, False), ("a", 600, None, 100, 0, 86400, False)])
    got = {(x.entity, x.slot): (x.value, x.covered_s, x.n_readings, x.mark) for x in regular_grid(r, w, 1000).collect()}
    assert got[("a", 0)] == (pytest.approx(60.0), 600, 1, "reading")
    assert got[("a", 600)] == (pytest.approx(30.0), 300, 1, "reading")
    assert got[("a", 1200)] == (None, 0, 0, "missing")  # the gap is too long to be trusted
    assert got[("a", 2400)] == (pytest.approx(10.0), 0, 1, "reading")
    assert got[("b", 0)][3] == "missing" and len(got) == 8


def test_session_slots_and_step_that_does_not_divide_the_day(spark):
    friday = 18263 * 86400 + 0  # 2020-01-02 is a Thursday
    w = window(spark, [("a", 1800, friday, friday + 4 * 86400, 52200, 75600, True), ("b", 25_000, 0, 2 * 86400, 0, 86400, False)])
    r = spark.createDataFrame([("b", 86_399, 1.0), ("b", 86_401, 2.0)], "entity string, ts long, counter double")
    rows = regular_grid(r, w).collect()
    assert len([x for x in rows if x.entity == "a"]) == 2 * 13  # Thursday and Friday
    assert sorted(x.slot for x in rows if x.entity == "b") == [0, 25_000, 50_000, 75_000, 86_400, 111_400, 136_400, 161_400]
    assert {x.slot for x in rows if x.n_readings} == {75_000, 86_400}


# -- 3 -----------------------------------------------------------------------------------------------------------------------


def test_trailing(spark):
    daily = spark.createDataFrame([("r", D(2020, 1, 1), 1.0, 10.0), ("r", D(2020, 1, 3), 2.0, 20.0)], "k string, day date, x double, y double")
    spans = spark.createDataFrame([("r", D(2020, 1, 1), D(2020, 1, 5)), ("empty", D(2020, 1, 1), D(2020, 1, 1))], "k string, a date, b date")
    cal = calendar_days(spans, "k", "a", "b")
    got = {(x.k, x.day.day): (x.x_2, x.y_2) for x in trailing(daily, cal, "k", "day", ["x"], ["y"], [2]).collect()}
    assert got == {("r", 1): (1.0, 10.0), ("r", 2): (1.0, 10.0), ("r", 3): (2.0, 20.0), ("r", 4): (2.0, 20.0), ("r", 5): (0.0, None), ("empty", 1): (0.0, None)}
    rolled = trailing(daily, cal, "k", "day", ["x"], ["y"], [2])
    low = {(x.k, x.measure): x.end_day for x in extreme_days(rolled, "k", "day", [("x", "x_2", 2, 6, "min"), ("y", "y_2", 2, 4, "max")]).collect()}
    assert low == {("r", "x"): "2020-01-05", ("r", "y"): "2020-01-03", ("empty", "x"): "2020-01-01"}


# -- 5 -----------------------------------------------------------------------------------------------------------------------


def brute_known(events, facts):
    out = set()
    for rid, sym, day in events:
        if sym is None or day is None:
            continue
        known = [f for f in facts if f[1] == sym and f[5] is not None and f[5] <= day and f[3] is not None and (f[4] is None or f[4] >= f[3])]
        last = {}
        for f in known:
            key = (f[2], f[3])
            if key not in last or (f[5], f[0]) > (last[key][5], last[key][0]):
                last[key] = f
        best = {}
        for f in last.values():
            if f[3] <= day and (f[4] is None or day <= f[4]) and (f[2] not in best or (f[5], f[0]) > (best[f[2]][5], best[f[2]][0])):
                best[f[2]] = f
        out |= {(rid, sym, idx, f[0]) for idx, f in best.items()}
    return out


def test_known_at_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda: D(2020, 1, 1) + dt.timedelta(rng.randrange(60))
    facts = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice("xy"), rng.choice([day(), day(), None]), rng.choice([day(), None]), rng.choice([day(), day(), day(), None])) for i in range(400)]
    events = [(i, rng.choice(["a", "b", "c", None]), rng.choice([day(), day(), None])) for i in range(300)]
    f = spark.createDataFrame(facts + facts[:20], "id int, s string, idx string, from_day date, to_day date, known_day date")
    e = spark.createDataFrame([(*x, "clash") for x in events], "rid int, s string, day date, idx string")
    got = known_at(e, f, "s", ["idx"], ["id"], ["known_day", "id"])
    assert "event_idx" in got.columns
    assert {(r.rid, r.s, r.idx, r.id) for r in got.collect()} == brute_known(events, facts)
    assert known_at(e.limit(0), f, "s", ["idx"], ["id"], ["known_day", "id"]).count() == 0
    assert known_at(e, f.limit(0), "s", ["idx"], ["id"], ["known_day", "id"]).count() == 0


# -- 6 -----------------------------------------------------------------------------------------------------------------------


def test_hash_is_sparks(spark):
    v = [0, 1, -1, 2**62, -(2**63)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x long").select(F.xxhash64("x")).collect()]
    assert got == S.xxhash64_long(np.array(v), np.full(len(v), 42)).tolist()
    three = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long").select(F.xxhash64("a", "b", "c")).first()[0]
    assert three == S.check_of(np.array([1]), np.array([2]), np.array([3]))[0]


def brute_changes(rows):
    last = {}
    for no, k, v, at in rows:
        if no is not None and k is not None and ((no, k) not in last or at > last[no, k][1]):
            last[no, k] = (v, at)
    numbers = sorted({r[0] for r in rows if r[0] is not None})
    out = set()
    for a, b in zip(numbers, numbers[1:]):
        x, y = ({k: v for (n, k), (v, _) in last.items() if n == m} for m in (a, b))
        out |= {(b, k, "added") for k in y.keys() - x.keys()} | {(b, k, "removed") for k in x.keys() - y.keys()} | {(b, k, "changed") for k in x.keys() & y.keys() if x[k] != y[k]}
    return out


@pytest.mark.parametrize("width, rounds", [(64, 3), (2, 1), (2, 3)])
def test_snapshots_against_brute_force(spark, width, rounds):
    """Wide tables decode at once; narrow ones must be enlarged or compared record by record."""
    rng = random.Random(8)
    rows = [(no, rng.choice([f"k{i}", f"k{i}", None] if i < 3 else [f"k{i}"]), rng.choice([None, 1.0, 2.0]), at) for at, (no, i) in enumerate((n, i) for n in (1, 2, 4) for i in range(250) if rng.random() < 0.9)]
    rows += [(2, "k5", 9.0, 10_000), (2, "k5", 3.0, 9_000), (None, "k1", 1.0, 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "no int, k string, v double, at int, bucket int, k1 int")
    got = {(r.snapshot_no, r.k, r.change_kind) for r in snapshot_changes(df, "no", ["k"], F.col("v"), "at", per_bucket=64, width=width, rounds=rounds).collect()}
    assert got == brute_changes(rows)


def test_snapshots_in_many_pieces(spark):
    """Buckets that reach over batches and pieces, and keys of several columns with names the operator uses itself."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = random.Random(9)
        rows = [(no, f"k{i}", rng.choice([1.0, 2.0, None]), at) for at, (no, i) in enumerate((n, i) for n in (1, 2, 3, 5) for i in range(400) if rng.random() < 0.95)]
        df = spark.createDataFrame(rows, "no int, _bucket string, row double, at int").withColumn("delivery", F.substring("_bucket", 2, 1))
        got = [(r.snapshot_no, r._bucket, r.change_kind) for r in snapshot_changes(df, "no", ["_bucket", "delivery"], F.col("row"), "at", per_bucket=16, piece=200).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_changes(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_snapshots_empty_and_single(spark):
    df = spark.createDataFrame([], "no int, k string, v double, at int")
    assert snapshot_changes(df, "no", ["k"], F.col("v"), "at").count() == 0
    one = spark.createDataFrame([(1, "a", 1.0, 1)], "no int, k string, v double, at int")
    assert snapshot_changes(one, "no", ["k"], F.col("v"), "at").count() == 0


# -- 7 -----------------------------------------------------------------------------------------------------------------------


def walk(n, seed=1, sd=0.01):
    return np.cumsum(sd * np.random.default_rng(seed).standard_normal(n))


def test_outliers_of_one_and_two_bars_but_no_shift():
    y = walk(200)
    y[50] += 0.4
    y[100:102] -= 0.5
    y[150:] += 0.7
    assert np.flatnonzero(additive_outliers(y, 9, 0.002)).tolist() == [50, 100, 101]
    assert not additive_outliers(walk(200), 9, 0.002).any()
    assert not additive_outliers(np.zeros(50), 9, 0.002).any()
    assert not additive_outliers(walk(5), 9, 0.002).any()


def test_wild_readings_and_shifts_do_not_bend_the_fit():
    y = walk(120, 7, 0.005)
    y[40] += 2.3  # outweighs all other readings together
    y[80] += 0.17
    assert np.flatnonzero(additive_outliers(y, 8.5, 0.002)).tolist() == [40, 80]
    z = walk(120, 9, 0.004)
    z[60:] -= 1.4
    assert not additive_outliers(z, 8.5, 0.002).any()


def test_stuck_runs():
    v = np.array([1, 2, 2, 2, 2, 2, 2, np.nan, 2, 2, 3.0])
    assert np.flatnonzero(stuck(v, 6)).tolist() == [1, 2, 3, 4, 5, 6]
    assert stuck(np.array([]), 6).tolist() == []


def test_implausible(spark):
    n = 80
    c = (100 * np.exp(walk(n, 4))).tolist()
    day = [str(d.date()) for d in pd.date_range("2020-01-01", periods=n)]
    rows = [["A", day[i], c[i], c[i] * 1.02, c[i] * 0.98, c[i], c[i], 1e6 + i, i, "x"] for i in range(n)]
    rows[10][7] = -5.0
    rows[20][3] = rows[20][4] - 1
    rows[30][5] = rows[30][2] = None
    rows[40][6] *= 10
    rows += [["A", day[40], c[40], c[40] * 1.02, c[40] * 0.98, c[40], c[40], 1e6, 500, "x"]]  # replaces the spike
    rows += [["A", day[50], c[50], c[50] * 1.02, c[50] * 0.98, c[50], c[50] * 10, 1e6, 501, "x"], [None, day[1], 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 9, "x"], ["B", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 9, "x"], ["C", day[0], 0.0, 1.0, 1.0, 1.0, 1.0, None, 9, "x"]]
    schema = "symbol string, bar_date string, open double, high double, low double, close double, adj_close double, volume double, bar_seq long, spike string"
    df = spark.createDataFrame(rows, schema)
    got = {(r.symbol, r.bar_date): [k for k in ("limit", "order", "spike", "stuck") if r[k]] for r in implausible(df).collect()}
    assert got == {("A", day[10]): ["limit"], ("A", day[20]): ["order"], ("A", day[50]): ["spike"], ("C", day[0]): ["limit", "order"]}
    assert implausible(df.limit(0)).count() == 0
