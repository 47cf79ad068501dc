"""Problem 3: totals and averages over trailing periods, idle days included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calendar_days(spans: DataFrame, key: str, first: str, last: str, day: str = "day") -> DataFrame:
    """One row per entity and calendar day from ``first`` to ``last``."""
    return spans.select(key, F.col(first).alias("first_day"), F.col(last).alias("last_day"), F.explode(F.sequence(first, last)).alias(day))


def carried(daily: DataFrame, key: str, day: str, values: list[str]) -> DataFrame:
    """The last known value of each column as of each row's day."""
    w = W.partitionBy(key).orderBy(day)
    return daily.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def trailing(daily: DataFrame, calendar: DataFrame, key: str, day: str, totals: list[str], averages: list[str], windows: list[int]) -> DataFrame:
    """Totals and averages over the trailing ``windows`` days, for every calendar day of every entity.

    ``daily`` has at most one row per entity and day; ``calendar`` is as :func:`calendar_days` gives it. Every
    daily row is put on each later day it still influences (at most max(windows) rows, none past the entity's last
    day), these are summed per entity and day, and the calendar rows are joined so that idle days count as zero.
    Columns: key, day, then ``<column>_<n>`` for each column and window. A total without any row is 0, an average
    without any value is null. Windows that would begin before the entity's first day begin there.
    An entity is bounded by its calendar days, so no group grows with repeated rows.
    """
    longest = max(windows)
    spans = calendar.groupBy(key).agg(F.max("last_day").alias("_last"))
    rows = daily.select(key, F.col(day).alias("_d"), *totals, *averages).join(spans, key)
    upto = F.least(F.date_add("_d", longest - 1), F.col("_last"))
    spread = rows.where(F.col("_d") <= F.col("_last")).withColumn(day, F.explode(F.sequence("_d", upto))).withColumn("_age", F.datediff(day, "_d"))
    within = lambda c, n: F.when(F.col("_age") < n, F.col(c))
    sums = [F.sum(within(c, n)).alias(f"{c}_{n}") for c in totals for n in windows]
    means = [F.avg(within(c, n)).alias(f"{c}_{n}") for c in averages for n in windows]
    grouped = spread.groupBy(key, day).agg(*sums, *means)
    zeros = {f"{c}_{n}": F.coalesce(f"{c}_{n}", F.lit(0.0)) for c in totals for n in windows}
    return calendar.select(key, day).join(grouped, [key, day], "left").withColumns(zeros)


def extreme_days(rolled: DataFrame, key: str, day: str, picks: list[tuple[str, str, int, int, str]]) -> DataFrame:
    """Per entity, the day on which a rolled column is lowest or highest; the earliest of equals.

    ``picks``: (measure, column, window, decimals, ``min`` or ``max``). Entities whose column is null on all days
    give no row.
    """
    aggs, rows = [], []
    for i, (measure, column, window, decimals, which) in enumerate(picks):
        value = F.round(F.col(column), decimals) * (1 if which == "min" else -1)
        aggs.append(F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), F.col(day).alias("d")))).alias(f"_p{i}"))
        rows.append(F.struct(F.lit(measure).alias("measure"), F.lit(window).cast("bigint").alias("window_days"), F.col(f"_p{i}.d").cast("string").alias("end_day")))
    found = rolled.groupBy(key).agg(*aggs).select(key, F.inline(F.array(*rows)))
    return found.where("end_day is not null")
