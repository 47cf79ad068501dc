"""Problem 2: irregular readings to a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.common import cut

DAY = 86400


def expected_slots(windows: DataFrame) -> DataFrame:
    """Slots that the windows expect: entity, step (seconds), slot (epoch seconds, start of the slot).

    ``windows``: entity, step, from_s, to_s (epoch seconds, to_s excluded) and open_s, close_s (seconds of the day
    between which slots are expected) and weekdays_only. Slots are the multiples of step since midnight UTC.
    Windows with a null bound, or a step of zero or less, expect nothing. Days are laid out first and spread over
    the cluster by entity and day, so a long window isn't expanded by one task.
    """
    w = windows.where("entity is not null and step > 0 and from_s is not null and to_s > from_s")
    day = F.explode(F.sequence(F.floor(F.col("from_s") / DAY).cast("bigint"), F.floor((F.col("to_s") - 1) / DAY).cast("bigint")))
    days = w.withColumn("_day", day)
    weekday = F.pmod(F.col("_day") + 3, F.lit(7))  # day 0 was a Thursday; Monday is 0
    days = days.where(~F.col("weekdays_only") | (weekday < 5)).repartition("entity", "_day")
    low = F.greatest(F.col("from_s") - F.col("_day") * DAY, F.col("open_s"), F.lit(0))
    high = F.least(F.col("to_s") - F.col("_day") * DAY, F.col("close_s"), F.lit(DAY))
    first, last = F.ceil(low / F.col("step")).cast("bigint"), (F.ceil(high / F.col("step")) - 1).cast("bigint")
    return (
        days.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
        .select("entity", "step", F.col("_day"), F.explode(F.sequence("_first", "_last")).alias("_n"))
        .select("entity", "step", (F.col("_day") * DAY + F.col("_n") * F.col("step")).alias("slot"))
        .distinct()
    )


def increments(readings: DataFrame, daily: bool = False) -> DataFrame:
    """What a cumulative counter gained since the reading before.

    ``readings``: entity, ts (epoch seconds), counter; one row per entity and ts. Result: entity, ts, prev_ts,
    gain, reset. A counter lower than before was reset: its gain is what it shows since. The first reading of an
    entity has a null prev_ts and gain. ``daily`` says that the counter begins anew at each midnight UTC: then a day's first
    reading is a reset even where it isn't lower, and an entity's first reading has gained what it shows. Readings are chained inside entity and day, and the days are chained by
    their last readings, so a hot entity is spread over its days.
    """
    day = F.floor(F.col("ts") / DAY)
    rows = cut(readings.select("entity", "ts", "counter", day.alias("_day")))  # read twice: inside days and at their ends
    w = W.partitionBy("entity", "_day").orderBy("ts")
    inside = rows.withColumns({"_pt": F.lag("ts").over(w), "_pc": F.lag("counter").over(w)})
    ends = rows.groupBy("entity", "_day").agg(F.max_by(F.struct(F.col("ts").alias("t"), F.col("counter").alias("c")), "ts").alias("_end"))
    before = ends.select("entity", "_day", F.lag("_end").over(W.partitionBy("entity").orderBy("_day")).alias("_before"))
    chained = inside.join(before, ["entity", "_day"])
    prev_ts, prev = F.coalesce("_pt", F.col("_before.t")), F.when(F.col("_pt").isNotNull(), F.col("_pc")).otherwise(F.col("_before.c"))
    reset = F.col("counter") < prev
    if daily:
        reset = reset | (F.col("_pt").isNull() & prev_ts.isNotNull())
    gain = F.when(prev_ts.isNull(), F.col("counter") if daily else None).when(reset, F.col("counter")).otherwise(F.col("counter") - prev)
    return chained.select("entity", "ts", prev_ts.alias("prev_ts"), gain.alias("gain"), F.coalesce(reset, F.lit(False)).alias("reset"))


def regular_grid(readings: DataFrame, windows: DataFrame, max_gap: int | Column = 7200, daily: bool = False) -> DataFrame:
    """Lay a cumulative counter on the regular grid of its windows and mark slots without a reading.

    ``readings``: entity, ts, counter (one row per entity and ts). ``windows``: as for :func:`expected_slots`. ``daily``: as
    for :func:`increments`.
    Result, a row per expected slot: entity, step, slot, value, covered_s, n_readings, mark.

    * Each gain is spread over the slots between its two readings in proportion to the overlap.
    * An interval between readings longer than ``max_gap`` seconds isn't trusted for spreading: it counts as
      uncovered, and its gain goes to the slot of the later reading.
    * mark: ``reading`` (a reading falls in the slot), ``covered`` (only spread gains), ``missing`` (neither).
      covered_s is how many seconds of the slot lie between readings; value is null where it is 0 and there is no reading.

    Readings outside the windows don't count. Rows with a null entity or ts are no readings. Readings meet windows by
    entity and day, never by entity alone, and are summed per slot with a partial aggregation before the shuffle.
    """
    grid = expected_slots(windows)
    spans = (
        windows.where("entity is not null and step > 0 and from_s is not null and to_s > from_s")
        .select("entity", "step", "from_s", "to_s", F.explode(F.sequence(F.floor(F.col("from_s") / DAY).cast("bigint"), F.floor((F.col("to_s") - 1) / DAY).cast("bigint"))).alias("_day"))
        .groupBy("entity", "step", "_day")
        .agg(F.collect_set(F.struct("from_s", "to_s")).alias("_spans"), F.min("from_s").alias("_from"))
    )
    gains = increments(readings.where("entity is not null and ts is not null"), daily).withColumn("_day", F.floor(F.col("ts") / DAY))
    inside = F.exists("_spans", lambda x: (x["from_s"] <= F.col("ts")) & (F.col("ts") < x["to_s"]))
    near = gains.join(spans.hint("merge"), ["entity", "_day"]).where(inside)
    slot_of = lambda t: F.floor(t / DAY) * DAY + F.floor(F.pmod(t, F.lit(DAY)) / F.col("step")) * F.col("step")
    gap = max_gap if isinstance(max_gap, Column) else F.lit(max_gap)
    close = F.col("prev_ts").isNotNull() & (F.col("ts") - F.col("prev_ts") <= gap)
    near = near.withColumn("_own", slot_of(F.col("ts"))).withColumn("_close", close)
    start = F.when(F.col("_close"), F.greatest(slot_of(F.col("prev_ts")), slot_of(F.col("_from")))).otherwise(F.col("_own"))
    # a step that doesn't divide the day starts again at midnight: each point is put on its own day's slots
    passed = F.transform(F.sequence(F.least(start, F.col("_own")), F.col("_own"), F.col("step")), slot_of)
    cells = near.withColumn("slot", F.explode(F.array_distinct(F.concat(passed, F.array("_own")))))
    end = F.least(F.col("slot") + F.col("step"), (F.floor(F.col("slot") / DAY) + 1) * DAY)
    overlap = F.when(F.col("_close"), F.greatest(F.lit(0), F.least(end, F.col("ts")) - F.greatest("slot", "prev_ts"))).otherwise(F.lit(0))
    share = F.when(F.col("_close"), overlap / F.greatest(F.col("ts") - F.col("prev_ts"), F.lit(1))).otherwise(F.lit(1.0))
    filled = (
        cells.withColumns({"_overlap": overlap, "_share": share})
        .groupBy("entity", "step", "slot")
        .agg(
            F.sum(F.col("gain") * F.col("_share")).alias("value"),
            F.sum("_overlap").alias("covered_s"),
            F.sum(F.when(F.col("slot") == F.col("_own"), 1).otherwise(0)).alias("n_readings"),
        )
    )
    laid = grid.join(filled.hint("merge"), ["entity", "step", "slot"], "left")
    laid = laid.withColumns({"covered_s": F.coalesce("covered_s", F.lit(0)), "n_readings": F.coalesce("n_readings", F.lit(0))})
    mark = F.when(F.col("n_readings") > 0, "reading").when(F.col("covered_s") > 0, "covered").otherwise("missing")
    return laid.select("entity", "step", "slot", "value", "covered_s", "n_readings", mark.alias("mark"))
