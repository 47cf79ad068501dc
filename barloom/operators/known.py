"""Problem 5: attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.common import cut

LEVELS = 22  # 2**22 versions of one entity: over 11,000 years of daily changes


def numbered(changes: DataFrame, events: DataFrame, entity: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Version numbers: of each change point, and in force at each event.

    ``changes`` and ``events`` are narrow: entity and the day ``at``. Each distinct change point of an entity begins
    a version; an event has the number of changes up to and with its own day, 0 before the first. Both are reduced
    to distinct entity and day first, so a hot entity is bounded by its days. Result: (entity, at, version) of the
    changes, (entity, at, version) of the events.
    """
    # one row per entity and day; kept apart by flags, so that a day may be both
    points = (
        changes.select(entity, at, F.lit(1).alias("_c"), F.lit(0).alias("_e"))
        .unionByName(events.select(entity, at, F.lit(0).alias("_c"), F.lit(1).alias("_e")))
        .where(F.col(entity).isNotNull() & F.col(at).isNotNull())
        .groupBy(entity, at)
        .agg(F.max("_c").alias("_c"), F.max("_e").alias("_e"))
    )
    w = W.partitionBy(entity).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = cut(points.withColumn("version", F.sum("_c").over(w).cast("bigint")))  # read four times: where spans begin and end, the last one, events
    return counted.where("_c = 1").select(entity, at, "version"), counted.where("_e = 1").select(entity, at, "version")


def winners_by_version(spans: DataFrame, versions: DataFrame, keys: list[str], entity: str, rank: str, attributes: list[str]) -> DataFrame:
    """Per version and ``keys``, the span that covers the version and ranks highest.

    ``spans``: keys (which include entity), first and last version (both included), rank, attributes. A span is laid
    on at most two aligned blocks of each power of two, of each block only the best span is kept, and a version looks
    at the blocks above it. So n spans over v versions cost n log v + v log v rows, never n times v.
    """
    low = lambda k: F.ceil(F.col("_first") / F.pow(F.lit(2.0), k)).cast("bigint")
    high = lambda k: F.floor((F.col("_last") + 1) / F.pow(F.lit(2.0), k)).cast("bigint")
    block = lambda k, n, use: F.when(use, F.struct(k.alias("_level"), n.alias("_block")))
    two = lambda k: F.array(block(k, low(k), (low(k) < high(k)) & (low(k) % 2 == 1)), block(k, high(k) - 1, (low(k) < high(k)) & (high(k) % 2 == 1)))
    # the widest block that fits bounds the levels
    top = F.floor(F.log2((F.col("_last") - F.col("_first") + 1).cast("double"))).cast("int")
    blocks = F.filter(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.least(top, F.lit(LEVELS))), two))), lambda x: x.isNotNull())
    best = (
        spans.where("_first <= _last")
        .select(*keys, rank, *attributes, F.inline(blocks))
        .groupBy(*keys, "_level", "_block")
        .agg(F.max(F.struct(rank, *attributes)).alias("_best"))
    )
    tops = best.groupBy(entity).agg(F.max("_level").alias("_top"))
    looks = versions.join(tops, entity).select(entity, "version", F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_level"))
    looks = looks.withColumn("_block", F.floor(F.col("version") / F.pow(F.lit(2.0), F.col("_level"))).cast("bigint"))
    found = looks.join(best, [entity, "_level", "_block"]).groupBy(*keys, "version").agg(F.max("_best").alias("_best"))
    return found.select(*keys, "version", *(F.col("_best").getField(c).alias(c) for c in attributes))


def known_at(events: DataFrame, facts: DataFrame, entity: str, per: list[str], attributes: list[str], order: list[str]) -> DataFrame:
    """Join each event with the facts in force on its day as far as they were known by then.

    ``events``: entity, day, any other columns. ``facts``: entity, ``per`` (one fact in force is wanted for each),
    from_day, to_day (null: open), known_day (when it was recorded), ``order`` (the later recorded ranks higher) and
    ``attributes``. A fact recorded later with the same entity, ``per`` and from_day replaces the earlier one from
    the day it was recorded. Of several that hold, the one that ranks highest counts. Events without a fact give no
    row; null entities or days match nothing; an equal pair of facts counts once.

    How: each fact is turned into the span of event days on which it is known, not yet replaced and valid. The
    spans' ends are an entity's change points; a cumulative count over narrow (entity, day) rows gives the version
    number of each event; wide attributes are then equi-joined on entity and version. Columns of events that clash with
    attributes keep the event's value under ``event_<name>``.

    Runs two jobs: the spans and the narrow version rows are each made once and cut off with a checkpoint.
    """
    keys = [entity, *per]
    rank = F.struct(*order).alias("_rank")
    rows = facts.where(F.col(entity).isNotNull() & F.col("from_day").isNotNull() & F.col("known_day").isNotNull() & (F.col("to_day").isNull() | (F.col("to_day") >= F.col("from_day"))))
    rows = rows.select(*keys, "from_day", "to_day", "known_day", rank, *(F.col(a).alias(f"_a_{a}") for a in attributes))
    # of the facts recorded on one day for one spell only the last can ever count; this also bounds the window below
    fields = ["_rank", "to_day", *(f"_a_{a}" for a in attributes)]
    rows = rows.groupBy(*keys, "from_day", "known_day").agg(F.max_by(F.struct(*fields), "_rank").alias("_x")).select(*keys, "from_day", "known_day", *(F.col("_x").getField(f).alias(f) for f in fields))
    replaced = F.lead("known_day").over(W.partitionBy(*keys, "from_day").orderBy("_rank"))
    rows = rows.withColumn("_until", F.date_sub(replaced, 1))
    begin = F.greatest("from_day", "known_day")
    end = F.least("to_day", "_until")  # null only if both are
    spans = cut(rows.withColumns({"_b": begin, "_e": end}).where("_e is null or _e >= _b"))  # read twice: for the change points and to be placed on versions
    changes = spans.select(entity, F.explode(F.array_compact(F.array("_b", F.date_add("_e", 1)))).alias("day"))
    narrow = events.select(entity, "day").where(F.col(entity).isNotNull() & F.col("day").isNotNull()).distinct()
    points, at_events = numbered(changes, narrow, entity, "day")
    firsts = points.select(entity, F.col("day").alias("_b"), F.col("version").alias("_first"))
    lasts = points.select(entity, F.date_sub("day", 1).alias("_e"), (F.col("version") - 1).alias("_last"))
    most = points.groupBy(entity).agg(F.max("version").alias("_most"))
    placed = spans.join(firsts, [entity, "_b"]).join(lasts, [entity, "_e"], "left").join(most, entity)
    placed = placed.withColumn("_last", F.coalesce("_last", "_most"))
    named = [f"_a_{a}" for a in attributes]
    wide = winners_by_version(placed, at_events.select(entity, "version").distinct(), keys, entity, "_rank", named)
    state = at_events.join(wide, [entity, "version"]).select(*keys, "day", *(F.col(n).alias(n[3:]) for n in named))
    clash = {c: f"event_{c}" for c in events.columns if c in {*per, *attributes}}
    return events.withColumnsRenamed(clash).join(state, [entity, "day"])
