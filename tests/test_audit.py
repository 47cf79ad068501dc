"""The audit on series with one known fault each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import days as Y
from barloom.operators import audit as A

SCHEMA = "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume double, arrival int"


def sessions(n, first=dt.date(2023, 1, 3)):
    out, day = [], first
    while len(out) < n:
        if Y.sessions_between(day, day):
            out.append(day)
        day += dt.timedelta(1)
    return out


def series(name, closes, days=None, spread=0.01, **over):
    days = days or sessions(len(closes))
    return [(name, d, c, c * (1 + spread), c * (1 - spread), c, c, 1000.0, i) for i, (d, c) in enumerate(zip(days, closes))]


def flat(n, level=100.0):
    return [level + 0.1 * (i % 3) for i in range(n)]


@pytest.fixture(scope="module")
def found(spark):
    rows = series("CLEAN", flat(40))
    rows += series("HALF", flat(20) + flat(20, 50.0)) + series("TENX", flat(20) + flat(20, 1000.0)) + series("SEVEN", flat(20, 700.0) + flat(20))
    rows += series("CRASH", flat(20) + flat(20, 50.0), spread=0.1)  # it traded the whole way
    rows += series("BLIP", flat(20) + [50.0] + flat(19))
    rows += series("STUCK", flat(10) + [100.5] * 6 + flat(10)) + series("FROZEN", flat(5) + [100.5] * 25)
    rows += [("GAPS", *r[1:]) for r in series("GAPS", flat(60)) if not dt.date(2023, 2, 6) <= r[1] <= dt.date(2023, 2, 9)]
    rows += series("SHUT", flat(30)) + [("SHUT", dt.date(2023, 1, 16), 100.0, 101.0, 99.0, 100.0, 100.0, 1000.0, 90), ("SHUT", dt.date(2023, 1, 21), 100.0, 101.0, 99.0, 100.0, 100.0, 1000.0, 91)]
    rows += series("ALWAYS", flat(30), [dt.date(2023, 1, 1) + dt.timedelta(i) for i in range(30)])
    rows += series("TWICE", flat(20)) + [("TWICE", sessions(5)[4], None, 100.0, 101.0, 77.0, 77.0, -1.0, 99)]
    rows += [("CLOSES", d, 0.0, 0.0, 0.0, c, c, 0.0, i) for i, (d, c) in enumerate(zip(sessions(20), flat(20)))]
    rows += [r if i != 7 else (*r[:7], 0.0, r[8]) for i, r in enumerate(series("QUIET", flat(30)))]
    rows += [(None, dt.date(2023, 1, 3), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1), ("NODAY", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1)]
    return A.flagged(spark.createDataFrame(rows, SCHEMA)).cache()


def test_findings(found):
    got = {}
    for r in A.report(found).collect():
        got.setdefault(r.symbol, {})[r.kind] = (r.severity, r["count"])
    assert "CLEAN" not in got and "CLOSES" not in got and "NODAY" not in got
    assert got["HALF"] == {"split": ("critical", 1)} and got["TENX"] == {"split": ("critical", 1)} and got["SEVEN"] == {"split": ("critical", 1)}
    assert got["CRASH"] == {"extreme": ("warning", 1)} and got["BLIP"]["extreme"] == ("warning", 2) and "split" not in got["BLIP"]
    assert got["STUCK"] == {"stale": ("warning", 1)} and got["FROZEN"] == {"stale": ("critical", 1)}
    assert got["GAPS"] == {"gap": ("critical", 4)} and got["SHUT"] == {"weekend": ("critical", 1), "holiday": ("warning", 1)}
    assert got["ALWAYS"] == {"continuous": ("note", 30)} and got["QUIET"] == {"silent": ("warning", 1)}
    assert got["TWICE"]["duplicate"] == ("critical", 1) and got["TWICE"]["impossible"] == ("critical", 1)
    bad = found.where("symbol = 'TWICE' and size(bad) > 0").first()
    assert set(bad.bad) == {"not_a_number", "negative_volume", "high_below_low", "close_outside"}


def test_splits_are_named(found):
    assert {r.symbol: r.split for r in A.splits(found).collect()} == {"HALF": "2:1", "TENX": "1:10 reverse", "SEVEN": "7:1"}
    assert {r.kind for r in A.critical(A.report(found)).collect()} <= {"duplicate", "impossible", "split", "stale"}


def test_empty_and_runs_of_gaps(spark, found):
    assert A.report(A.flagged(spark.createDataFrame([], SCHEMA))).count() == 0
    g = A.gaps(found).where("symbol = 'GAPS'").first()
    assert (g.missing, g.longest, g.severity) == (4, 4, "critical") and g.sessions == 60


def test_calendar_helpers(spark):
    assert Y.session_before(dt.date(2023, 1, 3)) == dt.date(2022, 12, 30) and Y.sessions_between(dt.date(2023, 1, 1), dt.date(2023, 1, 31)) == 20
    df = spark.createDataFrame([("btc-usd",), ("BRK-B",), ("EURUSD=X",)], "s string").select("s", Y.calendar_of_ticker(F.col("s")).alias("c"))
    assert [r.c for r in df.collect()] == ["continuous", "session", "fx"]
    w = spark.range(1).select(Y.widest(F.array(F.lit("session"), F.lit("fx"))).alias("a"), Y.widest(F.array().cast("array<string>")).alias("b")).first()
    assert (w.a, w.b) == ("fx", "session")
    t = Y.session_table(spark)
    assert t.where("day = '2023-07-04' and not session").count() == 1 and t.count() < 50_000


def test_findings_of_runs(spark, found):
    runs = spark.createDataFrame([("r", ["HALF", "TENX", "CLEAN", "HALF"]), ("s", ["CLEAN"])], "run_id string, symbols array<string>")
    got = A.of_runs(A.report(found), runs, 1).collect()
    assert [(r.run_id, r.symbol, r.kind, r.findings) for r in got] == [("r", "HALF", "split", 2)]
