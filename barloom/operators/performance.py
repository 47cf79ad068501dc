"""Measures of equity curves: returns, headline and risk metrics, slices, rolling measures, benchmark measures, drawdown runs.

A curve has run_id, bar_date, value. Nothing but window functions by run and aggregations by run (with partial steps) is used.
An undefined measure is null. ``periods`` annualises (bars a year).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIODS = 252


def by_run():
    return W.partitionBy("run_id").orderBy("bar_date")


def nz(c: Column) -> Column:
    return F.when(c != 0, c)


def with_returns(curve: DataFrame) -> DataFrame:
    """Adds r (0 where the value before isn't positive, null on the first bar), peak, dd (0 or less), no (from 0)."""
    w = by_run()
    before = F.lag("value").over(w)
    return curve.withColumns(
        {
            "r": F.when(before.isNull(), None).when(before <= 0, 0.0).otherwise(F.col("value") / before - 1),
            "peak": F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0)),
            "no": F.row_number().over(w) - 1,
        }
    ).withColumn("dd", F.col("value") / nz(F.col("peak")) - 1)


def headline(curve: DataFrame, periods: float = PERIODS) -> DataFrame:
    """Per run: returns, growth, volatility, Sharpe, Sortino (squares of losing bars over their number), Calmar, drawdown, days."""
    c = with_returns(curve)
    lost = F.when(F.col("r") < 0, F.col("r") * F.col("r"))
    g = c.groupBy("run_id").agg(
        F.min("bar_date").alias("first_day"), F.max("bar_date").alias("last_day"), F.min_by("value", "bar_date").alias("first_value"), F.max_by("value", "bar_date").alias("last_value"),
        F.count("*").alias("bars"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), (F.sum(lost) / nz(F.count(lost))).alias("losses"), F.min("dd").alias("max_drawdown"),
        F.max("r").alias("best_day"), F.min("r").alias("worst_day"), (F.count(F.when(F.col("r") > 0, 1)) / nz(F.count("r"))).alias("win_rate"), F.min_by("bar_date", F.struct("dd", "bar_date")).alias("trough_day"),
    )
    years = nz(F.datediff("last_day", "first_day") / 365.25)
    g = g.withColumns({"total_return": F.col("last_value") / nz(F.col("first_value")) - 1, "years": years})
    g = g.withColumn("cagr", F.when((F.col("first_value") > 0) & (F.col("last_value") > 0), F.pow(F.col("last_value") / nz(F.col("first_value")), 1 / F.col("years")) - 1))
    return g.withColumns(
        {
            "volatility": F.col("sd") * math.sqrt(periods), "sharpe": F.col("mean") / nz(F.col("sd")) * math.sqrt(periods),
            "sortino": F.col("mean") / nz(F.sqrt("losses")) * math.sqrt(periods), "calmar": F.col("cagr") / nz(F.abs("max_drawdown")),
        }
    )


def longest_underwater(curve: DataFrame) -> DataFrame:
    """Longest run of bars that are no new high, by islands between new highs."""
    w = by_run()
    c = with_returns(curve).withColumn("high", (F.col("value") >= F.col("peak")).cast("int")).withColumn("island", F.sum("high").over(w))
    return c.where("high = 0").groupBy("run_id", "island").count().groupBy("run_id").agg(F.max("count").alias("longest_drawdown"))


def risk(curve: DataFrame) -> DataFrame:
    """Omega, ulcer, Value at Risk and the mean beyond it, skewness and excess kurtosis (by the sample deviation), gain to pain, Kelly, r squared of log value."""
    c = with_returns(curve)
    base = c.groupBy("run_id").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("r").alias("n"), F.min("no").alias("_z"))
    tails = c.where("r is not null").withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy("r", "bar_date")))
    d = tails.join(base, "run_id").withColumn("z", F.col("r") - F.col("m"))
    tail = lambda p: F.avg(F.when(F.col("rank") <= F.ceil(F.col("n") * p), F.col("r")))
    up, down = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("r") < 0, -F.col("r")).otherwise(0.0))
    pct = lambda p: F.percentile("r", F.lit(p))
    out = d.groupBy("run_id").agg(
        (up / nz(down)).alias("omega"), (F.sum("r") / nz(down)).alias("gain_to_pain"), pct(0.05).alias("var95"), pct(0.01).alias("var99"), tail(0.05).alias("cvar95"), tail(0.01).alias("cvar99"),
        (F.abs(pct(0.95)) / nz(F.abs(pct(0.05)))).alias("tail_ratio"), (F.avg(F.pow("z", 3.0)) / nz(F.pow(F.first("s"), 3.0))).alias("skew"), (F.avg(F.pow("z", 4.0)) / nz(F.pow(F.first("s"), 4.0)) - 3).alias("excess_kurtosis"),
        (F.first("m") / nz(F.pow(F.first("s"), 2.0))).alias("kelly"),
    )
    whole = c.groupBy("run_id").agg(F.sqrt(F.avg(F.pow("dd", 2.0))).alias("ulcer"), F.sum(F.when(F.col("value") > 0, F.ln("value"))).alias("_s"), F.regr_r2(F.when(F.col("value") > 0, F.ln("value")), F.col("no").cast("double")).alias("log_r2"))
    return out.join(whole.drop("_s"), "run_id")


def rolling(curve: DataFrame, window: int = 63, periods: float = PERIODS) -> DataFrame:
    """Sharpe and volatility over the trailing window of returns, at its last bar; bars without a whole window are left out."""
    w = by_run().rowsBetween(-(window - 1), 0)
    c = with_returns(curve).withColumns({"n": F.count("r").over(w), "m": F.avg("r").over(w), "s": F.stddev_samp("r").over(w)}).where(F.col("n") == window)
    return c.select("run_id", "bar_date", (F.col("m") / nz(F.col("s")) * math.sqrt(periods)).alias("sharpe"), (F.col("s") * math.sqrt(periods)).alias("volatility"))


def slices(curve: DataFrame, label: Column, periods: float = PERIODS) -> DataFrame:
    """Per run and period: return from the last value before the period (the first period: from its own first value), drawdown, bars, volatility and
    Sharpe ratio of its bars' returns (the run's first bar has 0), mean exposure (where the curve tells it).

    One shuffle by run: what a period begins with is known from the bar before it.
    """
    w = by_run()
    first = F.lag("value").over(w)
    c = curve.withColumns({"period": label, "_before": F.coalesce(first, F.col("value"))})
    inside = W.partitionBy("run_id", "period").orderBy("bar_date")
    c = c.withColumns({"_r": F.when(F.col("_before") > 0, F.col("value") / F.col("_before") - 1), "_base": F.first("_before").over(inside)})
    c = c.withColumn("_d", F.col("value") / nz(F.greatest(F.col("_base"), F.max("value").over(inside.rowsBetween(W.unboundedPreceding, 0)))) - 1)
    held = F.avg("exposure") if "exposure" in curve.columns else F.lit(None).cast("double")
    g = c.groupBy("run_id", "period").agg(F.count("*").alias("bars"), F.max_by("value", "bar_date").alias("_last"), F.first("_base").alias("_base"), F.least(F.min("_d"), F.lit(0.0)).alias("max_drawdown"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"), held.alias("exposure"))
    return g.select("run_id", "period", "bars", (F.col("_last") / nz(F.col("_base")) - 1).alias("total_return"), "max_drawdown", (F.col("_s") * math.sqrt(periods)).alias("volatility"), (F.col("_m") / nz(F.col("_s")) * math.sqrt(periods)).alias("sharpe"), "exposure")


def seasonal(curve: DataFrame) -> DataFrame:
    """All twelve months of each run, with the compounded return of all bars of that month; null where there are none."""
    c = with_returns(curve).where("r is not null and r > -1")
    found = c.groupBy("run_id", F.month("bar_date").alias("month")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("compounded"), F.count("*").alias("bars"))
    every = curve.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return every.join(found, ["run_id", "month"], "left")


def stress(curve: DataFrame, days: int = 5) -> DataFrame:
    """The compounded return as it is, without the best ``days`` bars and without the best month, and the share that is lost."""
    c = with_returns(curve).where("r is not null and r > -1").withColumn("g", F.log1p("r")).withColumn("month", F.trunc("bar_date", "month"))
    whole = c.groupBy("run_id").agg(F.sum("g").alias("g"))
    best = c.withColumn("k", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("r"), "bar_date"))).where(F.col("k") <= days).groupBy("run_id").agg(F.sum("g").alias("d"))
    month = c.groupBy("run_id", "month").agg(F.sum("g").alias("m")).groupBy("run_id").agg(F.max("m").alias("m"))
    j = whole.join(best, "run_id").join(month, "run_id")
    total, without_days, without_month = F.exp("g") - 1, F.exp(F.col("g") - F.col("d")) - 1, F.exp(F.col("g") - F.col("m")) - 1
    share = lambda x: (total - x) / nz(F.abs(total))
    return j.select("run_id", total.alias("total"), without_days.alias("without_days"), without_month.alias("without_month"), share(without_days).alias("share_days"), share(without_month).alias("share_month"))


def against(curve: DataFrame, benchmark: DataFrame, periods: float = PERIODS) -> DataFrame:
    """Beta, correlation, tracking error, information ratio, alpha and capture against a benchmark (bar_date, level); three pairs of returns or more.

    Both sides are first brought to their common days; returns lie between one common day and the next, so a gap on one side is a longer step on both.
    """
    w = by_run()
    step = lambda c: F.when(F.lag(c).over(w) > 0, F.col(c) / F.lag(c).over(w) - 1)
    common = curve.select("run_id", "bar_date", "value").join(benchmark.select("bar_date", "level").where("level > 0"), "bar_date").where("value > 0")
    j = common.withColumns({"r": step("value"), "rb": step("level")}).where("r is not null and rb is not null")
    mean_if = lambda c, x: F.avg(F.when(c, F.col(x)))
    g = j.groupBy("run_id").agg(
        F.count("*").alias("pairs"), F.covar_samp("r", "rb").alias("cov"), F.var_samp("rb").alias("vb"), F.stddev_samp("r").alias("sr"), F.stddev_samp(F.col("r") - F.col("rb")).alias("te"), F.avg("r").alias("m"), F.avg("rb").alias("mb"),
        mean_if(F.col("rb") > 0, "r").alias("ur"), mean_if(F.col("rb") > 0, "rb").alias("ub"), mean_if(F.col("rb") < 0, "r").alias("lr"), mean_if(F.col("rb") < 0, "rb").alias("lb"),
    ).where("pairs >= 3")
    beta = F.col("cov") / nz(F.col("vb"))
    return g.select(
        "run_id", "pairs", beta.alias("beta"), (F.col("cov") / nz(F.col("sr") * F.sqrt("vb"))).alias("correlation"), (F.col("te") * math.sqrt(periods)).alias("tracking_error"),
        ((F.col("m") - F.col("mb")) / nz(F.col("te")) * math.sqrt(periods)).alias("information_ratio"), ((F.col("m") - beta * F.col("mb")) * periods).alias("alpha"),
        (F.col("ur") / nz(F.col("ub"))).alias("up_capture"), (F.col("lr") / nz(F.col("lb"))).alias("down_capture"),
    )


def episodes(curve: DataFrame, exposure: str = "exposure") -> DataFrame:
    """Maximal runs of bars with exposure above 0: run_id, episode, first and last day, bars."""
    w = by_run()
    on = (F.coalesce(F.col(exposure), F.lit(0.0)) > 0).cast("int")
    c = curve.withColumn("on", on).withColumn("start", ((F.col("on") == 1) & (F.coalesce(F.lag("on").over(w), F.lit(0)) == 0)).cast("int")).withColumn("episode", F.sum("start").over(w))
    return c.where("on = 1").groupBy("run_id", "episode").agg(F.min("bar_date").alias("first_day"), F.max("bar_date").alias("last_day"), F.count("*").alias("bars"))


def regimes(curve: DataFrame, benchmark: DataFrame, window: int = 63) -> DataFrame:
    """Per run and regime of the benchmark (bar_date, value): compounded return and bars.

    A bar is ``bear`` where the benchmark is 10 % or more under its peak, else ``calm``, ``normal`` or ``high`` by the third in which its
    volatility of ``window`` bars lies; bars before the first volatility are left out. The benchmark is one series, a row per day.
    """
    w = W.orderBy("bar_date")
    b = benchmark.withColumn("_r", F.col("value") / F.lag("value").over(w) - 1)
    span = w.rowsBetween(-(window - 1), 0)
    b = b.withColumns({"_n": F.count("_r").over(span), "_v": F.stddev_samp("_r").over(span), "_d": F.col("value") / F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1}).where(F.col("_n") == window)
    third = b.agg(F.percentile("_v", F.lit(1 / 3)).alias("lo"), F.percentile("_v", F.lit(2 / 3)).alias("hi"))
    label = F.when(F.col("_d") <= -0.1, "bear").when(F.col("_v") <= F.col("lo"), "calm").when(F.col("_v") <= F.col("hi"), "normal").otherwise("high")
    kinds = b.join(F.broadcast(third)).select("bar_date", label.alias("regime"))  # one row of thirds
    c = with_returns(curve).where("r is not null and r > -1").join(kinds, "bar_date")
    return c.groupBy("run_id", "regime").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("compounded"), F.count("*").alias("bars"))
