"""Queries of the general data problems (p1, p2, p3, p5, p6, p7) with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.common import day_of, epoch_of, symbol_of, table, trimmed
from barloom.operators.grid import regular_grid
from barloom.operators.intervals import continuous_periods, latest_versions
from barloom.operators.known import known_at
from barloom.operators.snapshots import snapshot_changes
from barloom.operators.spikes import implausible
from barloom.operators.trailing import calendar_days, carried, extreme_days, trailing


def valid_tenures(spark: SparkSession, sf: str) -> DataFrame:
    """Tenures with dates and normal symbols; void ones are left out."""
    t = table(spark, sf, "tenures")
    end = F.nullif(trimmed(F.col("to_day")), F.lit(""))
    rows = t.select("tenure_id", "index_name", symbol_of("symbol").alias("symbol"), day_of("from_day").alias("from_day"), day_of(end).alias("to_day"), (end.isNotNull() & day_of(end).isNull()).alias("_unreadable"), "sector", "recorded_at")
    return rows.where("index_name is not null and symbol is not null and from_day is not null and not _unreadable and (to_day is null or to_day >= from_day)").drop("_unreadable")


def counting_tenures(spark: SparkSession, sf: str) -> DataFrame:
    """Of the tenures of one index, symbol and from_day the one recorded last."""
    return latest_versions(valid_tenures(spark, sf).select("index_name", "symbol", "from_day", "to_day", "recorded_at", "tenure_id"), ["index_name", "symbol", "from_day"], ["recorded_at", "tenure_id"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    cases = continuous_periods(counting_tenures(spark, sf), ["index_name", "symbol"], "from_day", "to_day")
    return cases.select("index_name", "symbol", "kind", F.col("from_day").cast("string").alias("from_day"), F.coalesce(F.col("to_day").cast("string"), F.lit("")).alias("to_day"))


P1 = """
with t as (
  select index_name, upper(trim(symbol)) as symbol, try_cast(left(trim(from_day), 10) as date) as a,
         coalesce(try_cast(left(nullif(trim(to_day), ''), 10) as date), date '9999-12-30') as b, recorded_at, tenure_id
  from tenures),
v as (select * from t where a is not null and b >= a and index_name is not null and symbol is not null),
l as (select * from (select *, row_number() over (partition by index_name, symbol, a order by recorded_at desc nulls last, tenure_id desc) as rn from v) where rn = 1),
m as (select *, max(b) over (partition by index_name, symbol order by a rows between unbounded preceding and 1 preceding) as upto from l),
g as (select *, sum(case when upto is null or a > upto + 1 then 1 else 0 end) over (partition by index_name, symbol order by a) as no from m),
p as (select index_name, symbol, no, min(a) as a, max(b) as b from g group by index_name, symbol, no),
q as (select *, lead(a) over (partition by index_name, symbol order by a) as nxt from p)
select index_name, symbol, 'period' as kind, cast(a as varchar) as from_day, case when b = date '9999-12-30' then '' else cast(b as varchar) end as to_day from q
union all
select index_name, symbol, 'gap', cast(b + 1 as varchar), cast(nxt - 1 as varchar) from q where nxt is not null
"""

OPEN_S, CLOSE_S = 14 * 3600 + 30 * 60, 21 * 3600


def intraday_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Volume traded so far each day, as a counter, on the grid of the feed windows."""
    bars = table(spark, sf, "intraday_bars")
    stamped = bars.where("close is not null").select(symbol_of("symbol").alias("entity"), epoch_of("bar_stamp").alias("ts"), F.coalesce("volume", F.lit(0.0)).alias("volume"), "bar_seq")
    stamped = stamped.where("entity is not null and ts is not null")
    readings = stamped.groupBy("entity", "ts").agg(F.max_by("volume", "bar_seq").alias("volume"))
    from pyspark.sql import Window as W

    so_far = W.partitionBy("entity", F.floor(F.col("ts") / 86400)).orderBy("ts")
    counters = readings.select("entity", "ts", F.sum("volume").over(so_far).alias("counter"))
    session = F.col("calendar") == "session"
    windows = table(spark, sf, "feed_windows").select(
        symbol_of("symbol").alias("entity"), (F.col("step_min").cast("bigint") * 60).alias("step"), epoch_of("from_stamp").alias("from_s"), epoch_of("to_stamp").alias("to_s"),
        F.when(session, OPEN_S).otherwise(0).alias("open_s"), F.when(session, CLOSE_S).otherwise(86400).alias("close_s"), F.coalesce(session, F.lit(False)).alias("weekdays_only"),
    )
    return regular_grid(counters, windows, daily=True)


def stamp(seconds: str):
    """``YYYY-MM-DDTHH:MM`` of epoch seconds, whatever the session's time zone."""
    c = F.col(seconds)
    minute = F.floor(F.pmod(c, F.lit(86400)) / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(F.floor(c / 86400).cast("int")).cast("string"), F.lit("T"), two(F.floor(minute / 60)), F.lit(":"), two(minute % 60))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return intraday_grid(spark, sf).where("mark != 'reading'").select(F.col("entity").alias("symbol"), stamp("slot").alias("slot")).distinct()


def p2_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid: volume per slot (halves are rounded up, whatever the order of sums), spread where readings are close together, and the marks."""
    g = intraday_grid(spark, sf)
    return g.select(F.col("entity").alias("symbol"), (F.col("step") / 60).cast("int").alias("step_min"), stamp("slot").alias("slot"), F.round(F.col("value") + 1e-7, 3).alias("value"), F.col("covered_s").cast("long").alias("covered_s"), F.col("n_readings").cast("long").alias("n_readings"), "mark")


P2 = r"""
with e as (
  select upper(trim(symbol)) as symbol, regexp_extract(bar_stamp, '^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2})(?::(\d{2}))?(Z|[+-]\d{2}:\d{2})?$', ['d', 'h', 'm', 's', 'z']) as x
  from intraday_bars where close is not null),
r as (
  select symbol, cast(x.d as timestamp) + to_minutes(cast(cast(x.h as int) * 60 + cast(x.m as int)
         - case when left(x.z, 1) in ('+', '-') then (case when left(x.z, 1) = '-' then -1 else 1 end) * (cast(substr(x.z, 2, 2) as int) * 60 + cast(substr(x.z, 5, 2) as int)) else 0 end as int)) as ts
  from e where x.d <> ''),
w as (select upper(trim(symbol)) as symbol, calendar, step_min, cast(replace(from_stamp, 'T', ' ') || ':00' as timestamp) as a, cast(replace(to_stamp, 'T', ' ') || ':00' as timestamp) as b from feed_windows),
d as (select w.*, unnest(generate_series(date_trunc('day', a), date_trunc('day', b), interval 1 day)) as day from w),
n as (select d.*, unnest(range(0, 1440, step_min)) as mi from d),
s as (
  select symbol, step_min, a, b, day + to_minutes(cast(mi as int)) as slot from n
  where day + to_minutes(cast(mi as int)) >= a and day + to_minutes(cast(mi as int)) < b
    and (calendar <> 'session' or (isodow(day) <= 5 and mi >= 870 and mi < 1260))),
f as (
  select distinct w.symbol, w.step_min, date_trunc('day', r.ts) + to_minutes(cast(floor((extract('hour' from r.ts) * 60 + extract('minute' from r.ts)) / w.step_min) * w.step_min as int)) as slot
  from r join w on r.symbol = w.symbol and r.ts >= w.a and r.ts < w.b)
select distinct s.symbol, strftime(s.slot, '%Y-%m-%dT%H:%M') as slot
from s left join f on s.symbol = f.symbol and s.step_min = f.step_min and s.slot = f.slot where f.slot is null
"""


def counting_records(spark: SparkSession, sf: str) -> DataFrame:
    """day_records that count: of one run and stamp the one that arrived last."""
    r = table(spark, sf, "day_records").select("run_id", trimmed(F.col("day_stamp")).alias("stamp"), day_of("day_stamp").alias("day"), "ret", "equity", "record_id")
    return latest_versions(r.where("run_id is not null and day is not null"), ["run_id", "stamp", "day"], ["record_id"])


def daily_totals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Per run and calendar day: total ret (null on idle days) and the equity carried forward; and the calendar."""
    days = counting_records(spark, sf).groupBy("run_id", "day").agg(
        F.sum(F.coalesce("ret", F.lit(0.0))).alias("ret"), F.max_by("equity", F.when(F.col("equity").isNotNull(), F.col("stamp"))).alias("equity")
    )
    spans = days.groupBy("run_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = calendar_days(spans, "run_id", "a", "b")
    filled = carried(calendar.select("run_id", "day").join(days, ["run_id", "day"], "left"), "run_id", "day", ["equity"])
    return filled, calendar


def rolled(spark: SparkSession, sf: str) -> DataFrame:
    filled, calendar = daily_totals(spark, sf)
    return trailing(filled, calendar, "run_id", "day", ["ret"], ["equity"], [7, 30])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    picks = [("ret", f"ret_{n}", n, 6, "min") for n in (7, 30)] + [("equity", f"equity_{n}", n, 4, "max") for n in (7, 30)]
    return extreme_days(rolled(spark, sf), "run_id", "day", picks)


def p3_trailing(spark: SparkSession, sf: str) -> DataFrame:
    """All runs and days with their trailing totals and averages."""
    return rolled(spark, sf).select("run_id", F.col("day").cast("string").alias("day"), *(F.round(c, 6).alias(c) for c in ("ret_7", "ret_30", "equity_7", "equity_30")))


P3_ROLLED = """
with r as (select run_id, trim(day_stamp) as stamp, try_cast(left(trim(day_stamp), 10) as date) as day, ret, equity, record_id from day_records),
c as (select * from (select *, row_number() over (partition by run_id, stamp order by record_id desc) as rn from r where run_id is not null and day is not null) where rn = 1),
d as (select run_id, day, sum(coalesce(ret, 0)) as ret, arg_max(equity, stamp) filter (where equity is not null) as equity from c group by run_id, day),
s as (select run_id, min(day) as a, max(day) as b from d group by run_id),
k as (select run_id, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as date) as day from s),
f as (select k.run_id, k.day, coalesce(d.ret, 0) as ret, last_value(d.equity ignore nulls) over (partition by k.run_id order by k.day rows between unbounded preceding and current row) as equity
      from k left join d on k.run_id = d.run_id and k.day = d.day),
w as (select run_id, day,
  sum(ret) over (partition by run_id order by day rows between 6 preceding and current row) as ret_7,
  sum(ret) over (partition by run_id order by day rows between 29 preceding and current row) as ret_30,
  avg(equity) over (partition by run_id order by day rows between 6 preceding and current row) as equity_7,
  avg(equity) over (partition by run_id order by day rows between 29 preceding and current row) as equity_30 from f)
"""
P3 = P3_ROLLED + ", l as (" + " union all ".join(
    f"select run_id, '{m}' as measure, cast({n} as bigint) as window_days, day, row_number() over (partition by run_id order by round({m}_{n}, {x}) {o} nulls last, day) as rn, {m}_{n} as v from w"
    for m, x, o in (("ret", 6, "asc"), ("equity", 4, "desc")) for n in (7, 30)
) + ") select run_id, measure, window_days, cast(day as varchar) as end_day from l where rn = 1 and v is not null"
P3_ALL = P3_ROLLED + "select run_id, cast(day as varchar) as day, round(ret_7, 6) + 0 as ret_7, round(ret_30, 6) + 0 as ret_30, round(equity_7, 6) as equity_7, round(equity_30, 6) as equity_30 from w"


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "day_records").select("record_id", day_of("day_stamp").alias("day"), F.explode("positions.symbol").alias("symbol"))
    events = records.select("record_id", "day", symbol_of("symbol").alias("symbol")).where("symbol is not null and day is not null").distinct()
    facts = valid_tenures(spark, sf).withColumn("known_day", F.to_date("recorded_at"))
    known = known_at(events, facts, "symbol", ["index_name"], ["tenure_id", "sector"], ["recorded_at", "tenure_id"])
    return known.select("record_id", "symbol", "tenure_id")


P5 = """
with t as (
  select tenure_id, index_name, upper(trim(symbol)) as symbol, try_cast(left(trim(from_day), 10) as date) as a,
         coalesce(try_cast(left(nullif(trim(to_day), ''), 10) as date), date '9999-12-30') as b, recorded_at, cast(recorded_at as date) as known from tenures),
v as (select * from t where a is not null and b >= a and index_name is not null),
e as (select distinct record_id, day, upper(trim(p.symbol)) as symbol from (select record_id, try_cast(left(trim(day_stamp), 10) as date) as day, unnest(positions) as p from day_records)),
k as (select distinct symbol, day from e),
c as (select k.symbol, k.day, v.*exclude(symbol), row_number() over (partition by k.symbol, k.day, index_name, a order by recorded_at desc, tenure_id desc) as rn from k join v on k.symbol = v.symbol and v.known <= k.day),
i as (select *, row_number() over (partition by symbol, day, index_name order by recorded_at desc, tenure_id desc) as rk from c where rn = 1 and a <= day and day <= b)
select e.record_id, e.symbol, i.tenure_id from e join i on e.symbol = i.symbol and e.day = i.day and i.rk = 1
"""


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "bar_snapshots").select("snapshot_no", symbol_of("symbol").alias("symbol"), trimmed(F.col("bar_date")).alias("bar_date"), (F.round("adj_close", 4) + F.lit(0.0)).alias("adj"), "row_seq")
    return snapshot_changes(rows, "snapshot_no", ["symbol", "bar_date"], F.col("adj"), "row_seq")


P6 = """
with r as (select *, row_number() over (partition by snapshot_no, upper(trim(symbol)), trim(bar_date) order by row_seq desc) as rn from bar_snapshots),
s as (select cast(snapshot_no as bigint) as no, upper(trim(symbol)) as symbol, trim(bar_date) as bar_date, round(adj_close, 4) as adj from r where rn = 1),
n as (select distinct no from s),
p as (select no, lag(no) over (order by no) as before from n),
l as (select p.no, s.symbol, s.bar_date, s.adj from s join p on s.no = p.no where p.before is not null),
e as (select p.no, s.symbol, s.bar_date, s.adj from s join p on s.no = p.before)
select coalesce(l.no, e.no) as snapshot_no, coalesce(l.symbol, e.symbol) as symbol, coalesce(l.bar_date, e.bar_date) as bar_date,
       case when e.no is null then 'added' when l.no is null then 'removed' else 'changed' end as change_kind
from l full join e on l.no = e.no and l.symbol = e.symbol and l.bar_date = e.bar_date
where e.no is null or l.no is null or l.adj is distinct from e.adj
"""


def flagged_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "bars")
    return implausible(b.withColumns({"symbol": symbol_of("symbol"), "bar_date": day_of("bar_date").cast("string")}))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return flagged_bars(spark, sf).select("symbol", "bar_date")


def p7_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Implausible bars with the reasons."""
    return flagged_bars(spark, sf)


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_grid, p3_found, p3_trailing, p5_found, p6_found, p7_found, p7_reasons)}
SQL = {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p3_trailing": P3_ALL, "p5_found": P5, "p6_found": P6}
