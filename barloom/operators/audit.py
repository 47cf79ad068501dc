"""Audit of bars: what a series of prices shouldn't hold. All rows are looked at, also those that no other operator would use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.days import CALENDAR_FROM, is_weekend, session_table

#: The ratios that splits have, as what the price is multiplied by.
RATIOS = [
    ("2:1", 1 / 2), ("3:1", 1 / 3), ("3:2", 2 / 3), ("4:1", 1 / 4), ("5:1", 1 / 5), ("7:1", 1 / 7), ("10:1", 1 / 10), ("20:1", 1 / 20),
    ("1:2 reverse", 2.0), ("1:3 reverse", 3.0), ("2:3 reverse", 1.5), ("1:4 reverse", 4.0), ("1:5 reverse", 5.0), ("1:7 reverse", 7.0), ("1:10 reverse", 10.0), ("1:20 reverse", 20.0),
]
#: Limits of the checks.
STALE, FROZEN, NEAR_RATIO, MOST_RANGE, AROUND, EXTREME, LISTED = 5, 20, 0.02, 0.15, 5, 0.2, 5
LEVEL = 0.1  # a price within a tenth of another is back at it


def flagged(rows: DataFrame) -> DataFrame:
    """Each day's bar with what the checks found, in one shuffle by symbol.

    ``rows``: symbol, bar_date, open, high, low, close, adj_close, volume, arrival; of rows of one day the one that arrived last is looked
    at, ``copies`` counts them all. Added: a (adjusted close, the close where there is none), move, split (its ratio's name), run
    and length (first day and length of the run of equal closes), bad (array of what makes the bar impossible), silent, continuous (over a
    tenth of 20 or more bars lie on weekends), weekend, holiday, missing (sessions of the exchange between the bar before and this one).

    A split is a step of the adjusted close by a split's ratio on a day of small range whose level holds for five bars and wasn't there in
    the five before. Null prices are impossible bars and end runs. The calendar is known from 1981 on; before it nothing is
    missing or closed. Rows with a null symbol or day are left out.
    """
    fields = ["open", "high", "low", "close", "adj_close", "volume"]
    days = rows.where("symbol is not null and bar_date is not null").groupBy("symbol", "bar_date")
    b = days.agg(F.max_by(F.struct(*fields), "arrival").alias("x"), F.count("*").alias("copies")).select("symbol", "bar_date", "x.*", "copies")
    # a row a day from 1981 to 2100, whatever the data: some 44,000
    calendar = session_table(rows.sparkSession).select(F.col("day").alias("bar_date"), "session", "upto")
    b = b.join(F.broadcast(calendar), "bar_date", "left").withColumns({"a": F.when(F.col("adj_close") > 0, F.col("adj_close")).otherwise(F.col("close")), "_weekend": is_weekend(F.col("bar_date"))})
    w, whole = W.partitionBy("symbol").orderBy("bar_date"), W.partitionBy("symbol")
    known = F.col("session").isNotNull()
    ends = (F.row_number().over(w) == 1) | F.lead("bar_date").over(w).isNull() | (known & ~F.coalesce(F.lag(known).over(w), F.lit(False)))
    b = b.withColumns(
        {
            "_before": F.lag("a").over(w), "_next": F.collect_list("a").over(w.rowsBetween(1, AROUND)), "_prior": F.collect_list("a").over(w.rowsBetween(-AROUND - 1, -2)),
            "_new": F.coalesce(F.lag("close").over(w) != F.col("close"), F.lit(True)).cast("int"), "_end": ends, "bars": F.count("*").over(whole), "_weekends": F.sum(F.col("_weekend").cast("int")).over(whole),
        }
    )
    anchor = F.last(F.when(F.col("session") | F.col("_end"), F.col("upto")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    b = b.withColumns({"_run": F.sum("_new").over(w), "_anchor": anchor, "continuous": (F.col("bars") >= 20) & (F.col("_weekends") > 0.1 * F.col("bars"))})
    run = W.partitionBy("symbol", "_run")
    ratio = F.when((F.col("_before") > 0) & (F.col("a") > 0), F.col("a") / F.col("_before"))
    kind = F.coalesce(*(F.when(F.abs(ratio / x - 1) <= NEAR_RATIO, n) for n, x in RATIOS))
    wide = (F.col("low") > 0) & (F.col("high") > F.col("low")) & ((F.col("high") - F.col("low")) / F.col("low") > MOST_RANGE)
    near = lambda x, level: (x > 0) & (F.abs(x / F.when(level > 0, level) - 1) < LEVEL)
    turned = F.exists("_next", lambda x: near(x, F.col("_before"))) | F.exists("_prior", lambda x: near(x, F.col("a")))
    some_range = (F.coalesce("open", F.lit(0.0)) != 0) | (F.coalesce("high", F.lit(0.0)) != 0) | (F.coalesce("low", F.lit(0.0)) != 0)
    faults = {
        "not_a_number": F.greatest(*(F.col(c).isNull() | F.isnan(c) for c in ("open", "high", "low", "close", "volume"))), "close_not_positive": F.col("close") <= 0, "negative_volume": F.col("volume") < 0,
        "high_below_low": some_range & (F.col("high") < F.col("low")), "close_outside": some_range & ((F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))),
        "open_outside": some_range & ((F.col("open") > F.col("high")) | (F.col("open") < F.col("low"))), "price_not_positive": some_range & ((F.col("open") < 0) | (F.col("high") <= 0) | (F.col("low") <= 0)),
    }
    regular = known & ~F.col("continuous")
    gap = F.when(regular & (F.col("session") | F.col("_end")), F.greatest(F.col("upto") - F.col("session").cast("long") - F.col("_anchor"), F.lit(0)))
    return b.select(
        "symbol", "bar_date", *fields, "copies", "bars", "a", "continuous", (ratio - 1).alias("move"), F.when(~F.coalesce(wide, F.lit(False)) & ~F.coalesce(turned, F.lit(False)), kind).alias("split"),
        F.min("bar_date").over(run).alias("run"), F.count("close").over(run).alias("length"), F.array_compact(F.array(*(F.when(c, n) for n, c in faults.items()))).alias("bad"), F.coalesce(F.col("volume") == 0, F.lit(False)).alias("silent"),
        (regular & F.col("_weekend")).alias("weekend"), (regular & ~F.col("_weekend") & ~F.col("session")).alias("holiday"), F.coalesce(gap, F.lit(0)).alias("missing"), F.when(regular, F.col("upto")).alias("_upto"), F.col("session").alias("_session"),
    )


def splits(f: DataFrame) -> DataFrame:
    return f.where("split is not null").select("symbol", "bar_date", "split", (F.col("move") + 1).alias("ratio"))


def extremes(f: DataFrame, most: int | None = LISTED) -> DataFrame:
    """Moves of a fifth or more on days that no split explains, the largest of each symbol first; ``most`` of them (None: all)."""
    m = f.where((F.abs("move") >= EXTREME) & F.col("split").isNull())
    m = m.withColumn("no", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc(F.abs("move")), "bar_date")).cast("long"))
    return (m if most is None else m.where(F.col("no") <= most)).select("symbol", "bar_date", "move", "no")


def stale(f: DataFrame) -> DataFrame:
    """Runs of STALE or more equal closes; from FROZEN on they are critical."""
    g = f.where(F.col("length") >= STALE).groupBy("symbol", F.col("run").alias("from_day")).agg(F.max("bar_date").alias("to_day"), F.count("*").alias("length"), F.min("close").alias("close"))
    return g.withColumn("severity", F.when(F.col("length") >= FROZEN, "critical").otherwise("warning"))


def gaps(f: DataFrame) -> DataFrame:
    """Per symbol with sessions: how many the exchange held from its first to its last bar, how many have no bar, the longest stretch, severity."""
    g = f.where("_upto is not null").groupBy("symbol").agg(F.min("_upto").alias("_lo"), F.max("_upto").alias("_hi"), F.min_by("_session", "bar_date").alias("_s"), F.sum("missing").alias("missing"), F.max("missing").alias("longest"))
    g = g.select("symbol", (F.col("_hi") - F.col("_lo") + F.col("_s").cast("long")).alias("sessions"), "missing", "longest")
    share = F.col("missing") / F.when(F.col("sessions") > 0, F.col("sessions"))
    return g.withColumns({"share": share, "severity": F.when(F.col("missing") == 0, None).when((F.col("longest") >= 10) | (share > 0.02), "critical").when((F.col("longest") >= 3) | (F.col("missing") > 3), "warning").otherwise("note")})


def report(f: DataFrame) -> DataFrame:
    """Findings per symbol: kind, severity (critical, warning, note), count, first_day, rank (critical first). A symbol without any has no row."""
    flags = {
        "duplicate": (F.col("copies") > 1, F.col("copies") - 1), "impossible": (F.size("bad") > 0, F.lit(1)), "split": (F.col("split").isNotNull(), F.lit(1)), "stale": ((F.col("length") >= STALE) & (F.col("run") == F.col("bar_date")), F.lit(1)),
        "silent": (F.col("silent"), F.lit(1)), "extreme": ((F.abs("move") >= EXTREME) & F.col("split").isNull(), F.lit(1)), "weekend": (F.col("weekend"), F.lit(1)), "holiday": (F.col("holiday"), F.lit(1)), "gap": (F.col("missing") > 0, F.col("missing")),
    }
    aggs: list[Column] = [F.count("*").alias("bars"), F.max("length").alias("_frozen"), F.max("missing").alias("_longest"), F.count(F.when(F.col("volume") > 0, 1)).alias("_traded"), F.count(F.when(F.col("continuous"), 1)).alias("_continuous")]
    aggs += [F.min("_upto").alias("_lo"), F.max("_upto").alias("_hi"), F.min_by("_session", F.when(F.col("_upto").isNotNull(), F.col("bar_date"))).alias("_s"), F.min("bar_date").alias("_first")]
    for k, (flag, n) in flags.items():
        aggs += [F.sum(F.when(flag, n).otherwise(0)).alias(k), F.min(F.when(flag, F.col("bar_date"))).alias(f"_{k}_day")]
    g = f.groupBy("symbol").agg(*aggs)
    sessions = F.col("_hi") - F.col("_lo") + F.col("_s").cast("long")
    grade = {
        "duplicate": F.lit("critical"), "impossible": F.lit("critical"), "split": F.lit("critical"), "stale": F.when(F.col("_frozen") >= FROZEN, "critical").otherwise("warning"),
        "silent": F.when(F.col("silent") > 0.01 * F.col("bars"), "warning").otherwise("note"), "extreme": F.when(F.col("extreme") > 0.02 * F.col("bars"), "warning").otherwise("note"), "weekend": F.lit("critical"), "holiday": F.lit("warning"),
        "gap": F.when((F.col("_longest") >= 10) | (F.col("gap") > 0.02 * sessions), "critical").when((F.col("_longest") >= 3) | (F.col("gap") > 3), "warning").otherwise("note"),
    }
    there = {k: F.col(k) > 0 for k in flags}
    there["silent"] = there["silent"] & (F.col("_traded") >= F.floor(F.col("bars") * 9 / 10))
    each = [F.when(there[k], F.struct(F.lit(k).alias("kind"), grade[k].alias("severity"), F.col(k).cast("long").alias("count"), F.col(f"_{k}_day").alias("first_day"))) for k in flags]
    note = lambda when, kind: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit("note").alias("severity"), F.col("bars").cast("long").alias("count"), F.col("_first").alias("first_day")))
    each += [note(F.col("_continuous") > 0, "continuous"), note((F.col("_continuous") == 0) & (F.col("_first") < F.lit(CALENDAR_FROM).cast("date")), "before_calendar")]
    rows = g.select("symbol", "bars", F.inline(F.array_compact(F.array(*each))))
    return rows.withColumn("rank", F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2).cast("long"))


def critical(findings: DataFrame, most: int = 10) -> DataFrame:
    """What disqualifies a symbol's data before a run: the critical findings of bars alone, the ``most`` first by symbol and kind."""
    own = findings.where("severity = 'critical' and kind in ('duplicate', 'impossible', 'split', 'stale')")
    return own.orderBy("symbol", "kind").limit(most).drop("rank")


def of_runs(findings: DataFrame, runs: DataFrame, most: int = 10) -> DataFrame:
    """The critical findings of each run's symbols (run_id, symbols): for its record, so the first ``most`` by symbol and kind, with how many there are in all."""
    own = findings.where("severity = 'critical' and kind in ('duplicate', 'impossible', 'split', 'stale')")
    j = runs.select("run_id", F.explode(F.array_distinct("symbols")).alias("symbol")).join(own, "symbol")
    w = W.partitionBy("run_id")
    j = j.withColumns({"place": F.row_number().over(w.orderBy("symbol", "kind")).cast("long"), "findings": F.count("*").over(w)})
    return j.where(F.col("place") <= most).select("run_id", "place", "symbol", "kind", "count", "first_day", "findings")
