"""Trading calendars: holidays by rule, sessions, intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sessions a year and minutes a session of each calendar; minutes of each bar size.
CALENDARS = {"session": (252, 390), "continuous": (365, 1440), "fx": (261, 1440)}
INTERVALS = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "1d": 1440, "1wk": 10080, "1mo": 43200}
#: Days on which the exchange was closed for one occasion.
CLOSURES = ["1985-09-27", "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th given weekday (Monday is 0) of a month; counted from the end for n below 0."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (dt.date(year + month // 12, month % 12 + 1, 1)) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7 + 7 * (-n - 1))


def easter(year: int) -> dt.date:
    """Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def observed(day: dt.date, saturday: bool = True) -> dt.date | None:
    """Sundays move to Monday, Saturdays to Friday (or nowhere)."""
    if day.weekday() == 6:
        return day + dt.timedelta(1)
    if day.weekday() == 5:
        return day - dt.timedelta(1) if saturday else None
    return day


def holidays(year: int) -> set[dt.date]:
    """US exchange holidays of a year."""
    days = {
        observed(dt.date(year, 1, 1), saturday=False), nth_weekday(year, 2, 0, 3), easter(year) - dt.timedelta(2), nth_weekday(year, 5, 0, -1),
        observed(dt.date(year, 7, 4)), nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4), observed(dt.date(year, 12, 25)),
    }
    if year >= 1998:
        days.add(nth_weekday(year, 1, 0, 3))
    if year >= 2022:
        days.add(observed(dt.date(year, 6, 19)))
    days |= {d for d in map(dt.date.fromisoformat, CLOSURES) if d.year == year}
    return {d for d in days if d is not None}


def holiday_table(spark: SparkSession, first: int, last: int) -> DataFrame:
    """A dozen rows a year."""
    return spark.createDataFrame([(d,) for y in range(first, last + 1) for d in sorted(holidays(y))], "day date")


#: Other spellings of bar sizes.
SIZE_NAMES = {
    "1m": "1min minute m1", "5m": "5min m5", "15m": "15min m15", "30m": "30min m30", "1h": "60m hour hourly h1", "1d": "d day daily 1day", "1wk": "w 1w week weekly", "1mo": "mo 1month month monthly",
}


def bar_size(text: str) -> str:
    """A bar size by any of its spellings; a day where there is none."""
    name = text.strip().lower() or "1d"
    for size, others in SIZE_NAMES.items():
        if name == size or name in others.split():
            return size
    raise ValueError(f"unknown bar size {text!r}; there are {', '.join(SIZE_NAMES)}")


def coarser(a: str, b: str) -> bool:
    """Whether bars of size ``a`` are longer than those of ``b``."""
    return INTERVALS[bar_size(a)] > INTERVALS[bar_size(b)]


#: How many days back a vendor gives bars of a size.
REACH = {"1m": 30, "5m": 60, "15m": 60, "30m": 60, "1h": 730}


def within_reach(size: str, first: dt.date, today: dt.date) -> dt.date:
    """The first day that can be asked for: not before what a vendor keeps of that size."""
    days = REACH.get(bar_size(size))
    return first if days is None else max(first, today - dt.timedelta(days))


def end_of_day(day: Column) -> Column:
    """The last minute of a day or stamp string: an upper bound that includes the day's own bars."""
    text = F.trim(day)
    return F.when(F.length(text) == 10, F.concat(text, F.lit("T23:59"))).otherwise(text)


def moved(stamp: Column, days: Column | int) -> Column:
    """A day or stamp string so many calendar days later; its time of day stays."""
    text = F.trim(stamp)
    n = F.lit(days) if isinstance(days, int) else days
    return F.concat(F.date_add(text.substr(1, 10).try_cast("date"), n).cast("string"), F.substring(text, 11, 100))


def days_between(a: Column, b: Column) -> Column:
    """Whole days from one day to another, never under 0; null where either is no day."""
    return F.greatest(F.lit(0), F.datediff(b, a))


CALENDAR_FROM = "1981-01-01"  # holidays are known from then on


def session_table(spark: SparkSession, last: int = 2100) -> DataFrame:
    """Every calendar day from 1981 to the end of ``last``: day, session (the exchange trades), upto (sessions so far). A fixed size, whatever the data."""
    import numpy as np
    import pyarrow as pa

    days = np.arange(np.datetime64(CALENDAR_FROM, "D"), np.datetime64(f"{last + 1}-01-01", "D"))
    closed = np.array([h for y in range(int(CALENDAR_FROM[:4]), last + 1) for h in sorted(holidays(y))], "datetime64[D]")
    session = np.is_busday(days, holidays=closed)
    return spark.createDataFrame(pa.table({"day": pa.array(days), "session": session, "upto": np.cumsum(session)}))


def sessions_between(first: dt.date, last: dt.date) -> int:
    """Number of the exchange's sessions from first to last, both included."""
    return sum(1 for i in range((last - first).days + 1) if (x := first + dt.timedelta(i)).weekday() < 5 and x not in holidays(x.year))


def session_before(day: dt.date) -> dt.date:
    """The exchange's last session before the day."""
    while True:
        day -= dt.timedelta(1)
        if day.weekday() < 5 and day not in holidays(day.year):
            return day


def calendar_of_ticker(symbol: Column) -> Column:
    """Calendar by a ticker's form: pairs with a currency trade always, those that end in =X when currencies do."""
    s = F.upper(F.trim(symbol))
    return F.when(s.rlike("-(USD|USDT|EUR|GBP)$"), "continuous").when(s.endswith("=X"), "fx").otherwise("session")


def widest(calendars: Column) -> Column:
    """Of an array of calendars the one with the most sessions a year; the exchange's for none."""
    size = F.transform(calendars, lambda c: F.struct(F.create_map(*(F.lit(x) for k, (n, _) in CALENDARS.items() for x in (k, n)))[c].alias("n"), c.alias("c")))
    return F.coalesce(F.array_max(size)["c"], F.lit("session"))


def trading_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Weekdays from first to last that are no holiday, numbered."""
    from pyspark.sql import Window as W

    span = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).where(~is_weekend(F.col("day")))
    out = span.join(F.broadcast(holiday_table(spark, int(first[:4]), int(last[:4]))), "day", "left_anti")
    return out.withColumn("no", F.row_number().over(W.orderBy("day")) - 1)


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def periods_per_year(interval: str, calendar: str = "session") -> float:
    sessions, minutes = CALENDARS[calendar]
    return {"1wk": 52.0, "1mo": 12.0, "1d": float(sessions)}.get(interval, sessions * minutes / INTERVALS[interval])
