"""Reference data as of a day: share counts and market values, index membership from a log of changes, forward scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.bars import asof


def market_value(wanted: DataFrame, bars: DataFrame, shares: DataFrame) -> DataFrame:
    """Shares known on the day (the first count also before it) times the last raw close: adds shares, close, market_value.

    ``wanted``: symbol, bar_date; ``shares``: symbol, from_day, shares.
    """
    priced = asof(wanted, bars.select("symbol", "bar_date", "close"), ["symbol"], "bar_date", ["close"])
    counted = asof(priced, shares.withColumnRenamed("from_day", "bar_date"), ["symbol"], "bar_date", ["shares"], back_fill=True)
    return counted.withColumn("market_value", F.col("shares") * F.col("close"))


def by_market_value(valued: DataFrame, n: int | None = None) -> DataFrame:
    """Rank of each day's symbols, the largest first; equal ones by name; those without a value have none."""
    r = valued.where("market_value is not null").withColumn("rank", F.row_number().over(W.partitionBy("bar_date").orderBy(F.desc("market_value"), "symbol")).cast("long"))
    return r if n is None else r.where(F.col("rank") <= n)


def tenures_of(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Membership spells from today's members and a log of changes: symbol, from_day, to_day.

    ``current``: symbol; ``changes``: day, added, removed (either may be null or blank). A member is in from the day it was
    added to the day before it was removed; what the log doesn't tell is null. Changes of one symbol and day count once, removals first.
    """
    side = lambda c, k: changes.select(F.upper(F.trim(c)).alias("symbol"), "day", F.lit(k).alias("kind")).where("symbol != '' and day is not null")
    e = side("added", 1).unionByName(side("removed", 0)).distinct()
    w = W.partitionBy("symbol").orderBy("day", "kind")
    end = F.first(F.when(F.col("kind") == 0, F.col("day")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    e = e.withColumns({"before": F.lag("kind").over(w), "end": end})
    opened = e.where("kind = 1 and (before is null or before = 0)")
    spells = opened.select("symbol", F.col("day").alias("from_day"), F.date_sub("end", 1).alias("to_day"))
    # removed before ever added: in from the unknown beginning
    unknown = e.where("kind = 0 and before is null").select("symbol", F.lit(None).cast("date").alias("from_day"), F.date_sub("day", 1).alias("to_day"))
    names = current.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    always = names.join(e.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit(None).cast("date").alias("from_day"), F.lit(None).cast("date").alias("to_day"))
    return spells.unionByName(unknown).unionByName(always)


def intended(books: DataFrame) -> DataFrame:
    """The book that each run means to hold next: the weights of its last record. ``books``: run_id, at (order of records), symbol, weight (null symbols: an empty book)."""
    last = books.groupBy("run_id").agg(F.max("at").alias("at"))
    return books.join(last, ["run_id", "at"]).where("symbol is not null").groupBy("run_id", "at", "symbol").agg(F.sum("weight").alias("weight"))


def forward_scores(decisions: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Score decisions (id, symbol, bar_date, weight): bought at the next session's open, sold at the close ``horizon`` sessions after the
    day of decision. state is ``scored``, ``pending`` (too few sessions yet) or ``unknown`` (no bar of the symbol at or before the day)."""
    w = W.partitionBy("symbol").orderBy("bar_date")
    b = bars.select("symbol", "bar_date", F.row_number().over(w).alias("no"), F.lead("o", 1).over(w).alias("entry"), F.lead("c", horizon).over(w).alias("exit"))
    d = asof(decisions, b.withColumn("at", F.col("bar_date")), ["symbol"], "bar_date", ["entry", "exit", "no"])
    state = F.when(F.col("no").isNull(), "unknown").when(F.col("entry").isNull() | F.col("exit").isNull(), "pending").otherwise("scored")
    return d.withColumns({"state": state, "result": F.when(state == "scored", F.col("weight") * (F.col("exit") / F.col("entry") - 1))}).drop("no")


def forward_summary(scored: DataFrame) -> DataFrame:
    """Hit rate, mean, deviation, t and the number of decisions that would make t two."""
    s = scored.where("state = 'scored'").agg(F.count("*").alias("n"), F.avg((F.col("result") > 0).cast("double")).alias("hits"), F.avg("result").alias("mean"), F.stddev_samp("result").alias("sd"))
    nz = lambda c: F.when(c != 0, c)
    return s.withColumns({"t": F.col("mean") / nz(F.col("sd")) * F.sqrt("n"), "needed": F.ceil(F.pow(2 * F.col("sd") / nz(F.col("mean")), F.lit(2.0)))})


MOST_ASSETS = 2_000  # of a group whose covariances are asked for: two million pairs


def covariances(returns: DataFrame, by: str, symbol: str, at: str, r: str, most: int = MOST_ASSETS) -> DataFrame:
    """Sample covariance of each two symbols of a group on their common days.

    The result has a row for each pair by its nature, so groups are to be bounded (a rebalance's universe): one of over ``most`` symbols is refused.
    """
    size = returns.groupBy(by).agg(F.count_distinct(symbol).alias("_n"))
    kept = returns.join(size, by).where(F.when(F.col("_n") > most, F.raise_error(F.concat(F.lit(f"over {most} symbols in group "), F.col(by).cast("string"))).cast("boolean")).otherwise(True))
    a = kept.select(by, F.col(symbol).alias("a"), at, F.col(r).alias("_x"))
    b = kept.select(by, F.col(symbol).alias("b"), at, F.col(r).alias("_y"))
    return a.join(b, [by, at]).where("a <= b").groupBy(by, "a", "b").agg(F.covar_samp("_x", "_y").alias("covariance"), F.count("*").alias("days"))


# -- membership -----------------------------------------------------------------------------------------------------------------


def members_ever(spells: DataFrame, first, last) -> DataFrame:
    """Symbols of each index that were members on any day from ``first`` to ``last``; a null from_day is always before, a null to_day never ends."""
    inside = (F.col("from_day").isNull() | (F.col("from_day") <= last)) & (F.col("to_day").isNull() | (F.col("to_day") >= first))
    return spells.where(inside).select("index_name", "symbol").distinct()


def covers(spells: DataFrame, first) -> DataFrame:
    """Per index the first day that is told, and whether it is told from ``first`` on."""
    return spells.groupBy("index_name").agg(F.min("from_day").alias("earliest"), F.count("*").alias("tenures")).withColumn("covered", F.coalesce(F.col("earliest") <= first, F.lit(False)))


def with_membership(bars: DataFrame, spells: DataFrame) -> DataFrame:
    """Adds member (1 or 0): whether the symbol was a member on the bar's day. ``spells``: symbol, from_day, to_day of one index.

    Spells are laid on the months they touch within the bars' months, so bars meet them by symbol and month, never by symbol alone.
    """
    lo, hi = F.trunc(F.coalesce("from_day", F.lit("1900-01-01").cast("date")), "month"), F.trunc(F.coalesce("to_day", F.lit("2200-01-01").cast("date")), "month")
    span = bars.groupBy("symbol").agg(F.trunc(F.min("bar_date"), "month").alias("_lo"), F.trunc(F.max("bar_date"), "month").alias("_hi"))
    touched = spells.join(span, "symbol").select("symbol", "from_day", "to_day", F.greatest(lo, "_lo").alias("_a"), F.least(hi, "_hi").alias("_z")).where("_a <= _z")
    monthly = touched.select("symbol", F.struct("from_day", "to_day").alias("x"), F.explode(F.sequence("_a", "_z", F.expr("interval 1 month"))).alias("_m")).groupBy("symbol", "_m").agg(F.collect_set("x").alias("_spells"))
    inside = F.exists("_spells", lambda x: (x["from_day"].isNull() | (x["from_day"] <= F.col("bar_date"))) & (x["to_day"].isNull() | (F.col("bar_date") <= x["to_day"])))
    j = bars.withColumn("_m", F.trunc("bar_date", "month")).join(monthly, ["symbol", "_m"], "left")
    return j.withColumn("member", F.coalesce(inside, F.lit(False)).cast("int")).drop("_m", "_spells")


# -- short positions ------------------------------------------------------------------------------------------------------------


def borrow_report(results: DataFrame, rates: DataFrame | None = None, general: float = 3.0, hard: float = 5.0, low_price: float = 5.0) -> DataFrame:
    """What the short side of each run cost: run_id, symbol, fee, days, annual_pct, hard (a rate of ``hard`` or more, or not to be had), refused (orders),
    refused_shares, low_priced (shorted under ``low_price``).

    ``results``: of :func:`barloom.plans.engine.backtests`; ``rates``: symbol, annual_pct, available (of :func:`barloom.sources.files.borrow_rates`; the rate of *
    is the general one, ``general`` where there is none). A run that never shorted has no row.
    """
    paid = results.select("run_id", F.inline("borrowed")).select("run_id", "symbol", "fee", "days")
    refused = results.select("run_id", F.inline("refusals")).groupBy("run_id", "symbol").agg(F.count("*").alias("refused"), F.sum("shares").alias("refused_shares"))
    shorted = results.select("run_id", F.inline("fills")).where("side = 'short'").groupBy("run_id", "symbol").agg((F.min("price") < low_price).alias("low_priced"))
    r = paid.join(refused, ["run_id", "symbol"], "full").join(shorted, ["run_id", "symbol"], "full")
    if rates is None:
        r = r.withColumns({"annual_pct": F.lit(general), "available": F.lit(True)})
    else:
        usual = rates.where("symbol = '*'").agg(F.coalesce(F.first("annual_pct"), F.lit(general)).alias("_usual"))  # one row
        r = r.join(rates.where("symbol != '*'").groupBy("symbol").agg(F.max("annual_pct").alias("annual_pct"), F.min("available").alias("available")), "symbol", "left").join(F.broadcast(usual))
        r = r.withColumns({"annual_pct": F.coalesce("annual_pct", "_usual"), "available": F.coalesce("available", F.lit(True))})
    zero = F.lit(0.0)
    return r.select("run_id", "symbol", F.coalesce("fee", zero).alias("fee"), F.coalesce("days", zero).cast("long").alias("days"), "annual_pct", ((F.col("annual_pct") >= hard) | ~F.col("available")).alias("hard"), F.coalesce("refused", F.lit(0)).alias("refused"), F.coalesce("refused_shares", zero).alias("refused_shares"), F.coalesce("low_priced", F.lit(False)).alias("low_priced"))
