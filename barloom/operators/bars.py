"""Bars: the rows that count, adjustment, lookups, resampling, calendar flags and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.common import day_of, symbol_of, table
from barloom.operators.intervals import latest_versions

FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def counting_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with normal symbols; of rows of one symbol and day the one that arrived last; incomplete ones are left out."""
    b = table(spark, sf, "bars").select(symbol_of("symbol").alias("symbol"), day_of("bar_date").alias("bar_date"), *FIELDS, "bar_seq")
    last = latest_versions(b.where("symbol is not null and bar_date is not null"), ["symbol", "bar_date"], ["bar_seq"]).drop("bar_seq")
    return last.where("open > 0 and high > 0 and low > 0 and close > 0 and adj_close > 0 and volume >= 0")


def split_factor() -> Column:
    """adj_close / close; 1 where either is 0."""
    return F.when((F.col("close") == 0) | (F.col("adj_close") == 0), 1.0).otherwise(F.col("adj_close") / F.col("close"))


def adjusted(bars: DataFrame) -> DataFrame:
    """symbol, bar_date and adjusted o, h, l, c, v."""
    sf = split_factor()
    return bars.select("symbol", "bar_date", (F.col("open") * sf).alias("o"), (F.col("high") * sf).alias("h"), (F.col("low") * sf).alias("l"), F.col("adj_close").alias("c"), (F.col("volume") / sf).alias("v"))


def on_day(bars: DataFrame, day: Column) -> DataFrame:
    """The bars of exactly that day."""
    return bars.where(F.col("bar_date") == day)


def between(bars: DataFrame, first: Column, last: Column) -> DataFrame:
    """The bars from first to last, both included: reaches the scan where bar_date is a column of it."""
    return bars.where((F.col("bar_date") >= first) & (F.col("bar_date") <= last))


def bars_later(wanted: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """For each wanted symbol and bar_date on which there is a bar: the day of the n-th bar after it (before it for n below 0), null beyond the ends."""
    w = W.partitionBy("symbol").orderBy("bar_date")
    return wanted.join(bars.select("symbol", "bar_date", F.lead("bar_date", n).over(w).alias("later")), ["symbol", "bar_date"])


def history(bars: DataFrame, n: int) -> DataFrame:
    """The latest n bars of each symbol."""
    w = W.partitionBy("symbol").orderBy(F.desc("bar_date"))
    return bars.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def first_last(bars: DataFrame, by: str = "symbol", at: str = "bar_date", value: str = "close") -> DataFrame:
    return bars.groupBy(by).agg(F.min(at).alias("first_day"), F.max(at).alias("last_day"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.count("*").alias("bars"))


def resample(bars: DataFrame, bucket: Column) -> DataFrame:
    """Coarser bars: open of the first, high and low (0 is unset), close of the last, volume summed; labelled by bucket start."""
    return bars.groupBy("symbol", bucket.alias("bucket")).agg(
        F.min_by("open", "bar_date").alias("open"), F.max("high").alias("high"), F.min(F.when(F.col("low") != 0, F.col("low"))).alias("low"),
        F.max_by("close", "bar_date").alias("close"), F.max_by("adj_close", "bar_date").alias("adj_close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"),
    )


def period_flags(days: DataFrame) -> DataFrame:
    """First and last session of month, ISO week and year, and the session's number; ``days`` has bar_date once each.

    The calendar is one row per day, so its windows are bounded by the days there are.
    """
    out = days.withColumn("day_index", F.row_number().over(W.orderBy("bar_date")) - 1)
    for name, part in (("month", F.date_trunc("month", "bar_date")), ("week", F.date_trunc("week", "bar_date")), ("year", F.date_trunc("year", "bar_date"))):
        w = W.partitionBy(part)
        out = out.withColumns({f"first_of_{name}": F.col("bar_date") == F.min("bar_date").over(w), f"last_of_{name}": F.col("bar_date") == F.max("bar_date").over(w)})
    return out


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], lag_days: Column | None = None, back_fill: bool = False, forward: bool = False) -> DataFrame:
    """Join each left row with the last right row at or before its day (Spark has no as-of join).

    Both sides are laid into one sequence per key and the last values carried along: one shuffle by the key, one sort, no
    pairs. ``lag_days`` shifts the right side (a value is known so many days after its day); ``back_fill`` gives rows before
    the first value the first value; ``forward`` looks for the first at or after instead. Null keys match nothing.
    Of right rows with one key and day the largest counts, so the result is defined.
    """
    r = right.select(*by, (F.date_add(at, lag_days) if lag_days is not None else F.col(at)).alias("_at"), F.struct(*values).alias("_v")).where(" and ".join(f"{k} is not null" for k in by))
    r = r.groupBy(*by, "_at").agg(F.max("_v").alias("_v"))
    keep = [c for c in left.columns if c not in by]
    a = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*keep).alias("_l"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"))
    b = r.select(*by, "_at", F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), "_v")
    order = [F.desc("_at"), F.asc("_side")] if forward else [F.asc("_at"), F.asc("_side")]
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = F.last("_v", ignorenulls=True).over(w)
    if back_fill:
        found = F.coalesce(found, F.first("_v", ignorenulls=True).over(W.partitionBy(*by).orderBy("_at", "_side").rowsBetween(W.currentRow, W.unboundedFollowing)))
    rows = a.unionByName(b).withColumn("_f", found).where("_side = 1")
    return rows.select(*by, *(F.col("_l").getField(c).alias(c) for c in keep), *(F.col("_f").getField(v).alias(v) for v in values))
