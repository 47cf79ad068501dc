"""Problem 1: overlapping and gapped intervals to continuous periods and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAR = "9999-12-30"


def latest_versions(spells: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows that share ``keys``, the one that is last in ``order`` (nulls come first).

    A hash aggregation with a partial step on the map side: copies of one key never meet in one task unreduced.
    """
    rest = [c for c in spells.columns if c not in keys]
    picked = spells.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return picked.select(*keys, *(F.col("_last").getField(c).alias(c) for c in rest))


def continuous_periods(spells: DataFrame, keys: list[str], start: str | Column, end: str | Column) -> DataFrame:
    """Continuous periods and the gaps between them, per entity.

    ``start`` and ``end`` are dates, both included; a null ``end`` is open. Rows without a start or ending before
    they begin are void. Result: ``keys``, kind (``period`` or ``gap``), from_day and to_day as dates, to_day null
    where a period is open. Spells that overlap, nest or follow on the next day are one period. An empty table
    gives an empty result; repeated rows change nothing; other columns, whatever their names, are ignored. Null
    keys form an entity of their own.

    Plan: spells are first reduced to one row per entity and start day (partial aggregation), which bounds an
    entity by the number of days. ``session_window`` with each row's own length merges what overlaps; the window
    functions after it see disjoint sessions only and join those that touch. All steps cluster by ``keys``.
    """
    a = F.col(start) if isinstance(start, str) else start
    b = F.col(end) if isinstance(end, str) else end
    far = F.lit(FAR).cast("date")
    rows = spells.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), a.alias("_a"), b.alias("_b"))
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = rows.where(F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_b") >= F.col("_a"))))
    rows = rows.groupBy(*ks, "_a").agg(F.max(F.coalesce("_b", far)).alias("_b"), F.max(F.col("_b").isNull()).alias("_open"))
    rows = rows.withColumn("_b", F.greatest("_a", F.least("_b", far)))
    length = F.concat((F.datediff("_b", "_a") + 1).cast("string"), F.lit(" days"))
    sessions = (
        rows.groupBy(*ks, F.session_window(F.col("_a").cast("timestamp_ntz"), length).alias("_s"))
        .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.max("_open").alias("_open"))
        .drop("_s")
    )
    w = W.partitionBy(*ks).orderBy("_a")
    touching = F.col("_a") <= F.date_add(F.lag("_b").over(w), 1)
    periods = (
        sessions.withColumn("_new", F.when(touching, 0).otherwise(1))
        .withColumn("_no", F.sum("_new").over(w))
        .groupBy(*ks, "_no")
        .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.max("_open").alias("_open"))
        .withColumn("_next", F.lead("_a").over(w))
    )
    period = F.struct(F.lit("period").alias("kind"), F.col("_a").alias("from_day"), F.when(~F.col("_open"), F.col("_b")).alias("to_day"))
    gap = F.struct(F.lit("gap").alias("kind"), F.date_add("_b", 1).alias("from_day"), F.date_sub("_next", 1).alias("to_day"))
    cases = F.when(F.col("_next").isNull() | F.col("_open"), F.array(period)).otherwise(F.array(period, gap))
    return periods.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.inline(cases))
