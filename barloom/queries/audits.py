"""Queries of the audit of bars: every row of the table is looked at."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.common import day_of, symbol_of, table
from barloom.functions import days
from barloom.operators import audit as A
from barloom.operators import bars as B
from barloom.queries.market import dated
from barloom.queries.runs import shown

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bars").select(symbol_of("symbol").alias("symbol"), day_of("bar_date").alias("bar_date"), *B.FIELDS, F.col("bar_seq").alias("arrival"))


def flagged(s: SparkSession, d: str) -> DataFrame:
    return A.flagged(rows(s, d))


CLOSED = ", ".join(f"(date '{h}')" for y in range(1981, 2036) for h in sorted(days.holidays(y)))
KIND = "case " + " ".join(f"when abs(ratio / {x!r} - 1) <= 0.02 then '{n}'" for n, x in A.RATIOS) + " end"
FLAGGED = f"""
with raw as (select upper(trim(symbol)) as symbol, try_cast(trim(bar_date) as date) as bar_date, open, high, low, close, adj_close, volume, bar_seq from bars),
ct as (select *, row_number() over (partition by symbol, bar_date order by bar_seq desc) as rn, count(*) over (partition by symbol, bar_date) as copies from raw where symbol <> '' and bar_date is not null),
hol as (select * from (values {CLOSED}) v(day)),
cal as (select day, session, sum(case when session then 1 else 0 end) over (order by day) as upto from (select cast(g as date) as day, isodow(g) < 6 and cast(g as date) not in (select day from hol) as session from generate_series(timestamp '1981-01-01', timestamp '2035-12-31', interval 1 day) t(g))),
b as (select symbol, bar_date, open, high, low, close, adj_close, volume, copies, session, upto, case when adj_close > 0 then adj_close else close end as a from ct join cal on cal.day = bar_date where rn = 1),
w as (select *, lag(a) over v as before, list(a) filter (where a is not null) over (partition by symbol order by bar_date rows between 1 following and 5 following) as nx, list(a) filter (where a is not null) over (partition by symbol order by bar_date rows between 6 preceding and 2 preceding) as pv,
  case when lag(close) over v = close then 0 else 1 end as new, row_number() over v = 1 or lead(bar_date) over v is null as edge, count(*) over p as bars, count(case when isodow(bar_date) >= 6 then 1 end) over p as weekends from b window v as (partition by symbol order by bar_date), p as (partition by symbol)),
y as (select *, sum(new) over (partition by symbol order by bar_date) as rno, last_value(case when session or edge then upto end ignore nulls) over (partition by symbol order by bar_date rows between unbounded preceding and 1 preceding) as anchor, bars >= 20 and weekends > 0.1 * bars as continuous, case when before > 0 and a > 0 then a / before end as ratio,
  coalesce(open, 0) <> 0 or coalesce(high, 0) <> 0 or coalesce(low, 0) <> 0 as rg from w),
fl as (select symbol, bar_date, close, volume, copies, bars, continuous, session, ratio - 1 as move, case when not coalesce(low > 0 and high > low and (high - low) / low > 0.15, false) and len(list_filter(coalesce(nx, []), lambda e: e > 0 and abs(e / before - 1) < 0.1)) = 0 and len(list_filter(coalesce(pv, []), lambda e: e > 0 and abs(e / a - 1) < 0.1)) = 0 then {KIND} end as split,
  min(bar_date) over (partition by symbol, rno) as run, count(close) over (partition by symbol, rno) as length, volume = 0 as silent, not continuous and isodow(bar_date) >= 6 as weekend, not continuous and isodow(bar_date) < 6 and not session as holiday,
  case when not continuous and (session or edge) then greatest(0, coalesce(upto - case when session then 1 else 0 end - anchor, 0)) else 0 end as missing, case when not continuous then upto end as up,
  open is null or high is null or low is null or close is null or volume is null as f1, coalesce(close <= 0, false) as f2, coalesce(volume < 0, false) as f3, coalesce(rg and high < low, false) as f4, coalesce(rg and (close > high or close < low), false) as f5, coalesce(rg and (open > high or open < low), false) as f6, coalesce(rg and (open < 0 or high <= 0 or low <= 0), false) as f7 from y)
"""
FAULTS = ["not_a_number", "close_not_positive", "negative_volume", "high_below_low", "close_outside", "open_outside", "price_not_positive"]
add("audit_duplicates", lambda s, d: dated(flagged(s, d).where("copies > 1").select("symbol", "bar_date", "copies"), "bar_date"), f"{FLAGGED} select symbol, cast(bar_date as varchar) as bar_date, copies from fl where copies > 1")


def impossible(s: SparkSession, d: str) -> DataFrame:
    f = flagged(s, d).where(F.size("bad") > 0)
    return f.groupBy("symbol").agg(F.count("*").alias("days"), *(F.sum(F.array_contains("bad", k).cast("long")).alias(k) for k in FAULTS))


add("audit_ohlc", impossible, f"{FLAGGED} select symbol, count(*) as days, {', '.join(f'count(case when f{i} then 1 end) as {k}' for i, k in enumerate(FAULTS, 1))} from fl where f1 or f2 or f3 or f4 or f5 or f6 or f7 group by symbol")
add("audit_stale", lambda s, d: dated(A.stale(flagged(s, d)), "from_day", "to_day"), f"{FLAGGED} select symbol, cast(run as varchar) as from_day, cast(max(bar_date) as varchar) as to_day, count(*) as length, min(close) as close, case when count(*) >= 20 then 'critical' else 'warning' end as severity from fl where length >= 5 group by symbol, run")
add("audit_splits", lambda s, d: dated(shown(A.splits(flagged(s, d))), "bar_date"), f"{FLAGGED} select symbol, cast(bar_date as varchar) as bar_date, split, round(move + 1, 6) as ratio from fl where split is not null")
add("audit_extremes", lambda s, d: dated(shown(A.extremes(flagged(s, d))), "bar_date"), f"{FLAGGED}, q as (select symbol, bar_date, move, row_number() over (partition by symbol order by abs(move) desc, bar_date) as no from fl where abs(move) >= 0.2 and split is null) select symbol, cast(bar_date as varchar) as bar_date, round(move, 6) as move, no from q where no <= 5")
SILENT = "count(*) as bars, count(case when volume > 0 then 1 end) as traded, count(case when silent then 1 end) as silent"


def silent(s: SparkSession, d: str) -> DataFrame:
    g = flagged(s, d).groupBy("symbol").agg(F.count("*").alias("bars"), F.count(F.when(F.col("volume") > 0, 1)).alias("traded"), F.count(F.when(F.col("silent"), 1)).alias("silent"))
    return g.withColumn("finding", (F.col("traded") >= F.floor(0.9 * F.col("bars"))) & (F.col("silent") > 0))


add("audit_zero_volume", silent, f"{FLAGGED}, g as (select symbol, {SILENT} from fl group by symbol) select *, traded >= floor(0.9 * bars) and silent > 0 as finding from g")
add("audit_closed_days", lambda s, d: flagged(s, d).where("weekend or holiday").groupBy("symbol", "weekend").agg(F.count("*").alias("bars"), F.min("bar_date").cast("string").alias("first_day")), f"{FLAGGED} select symbol, weekend, count(*) as bars, cast(min(bar_date) as varchar) as first_day from fl where weekend or holiday group by symbol, weekend")
add("audit_missing_sessions", lambda s, d: dated(flagged(s, d).where("missing > 0").select("symbol", F.col("bar_date").alias("before_day"), "missing"), "before_day"), f"{FLAGGED} select symbol, cast(bar_date as varchar) as before_day, cast(missing as bigint) as missing from fl where missing > 0")
GAPS = "select symbol, cast(max(up) - min(up) + max(case when fi and session then 1 else 0 end) as bigint) as sessions, cast(sum(missing) as bigint) as missing, cast(max(missing) as bigint) as longest from (select *, bar_date = min(bar_date) over (partition by symbol) as fi from fl where up is not null) group by symbol"
add("audit_gaps", lambda s, d: shown(A.gaps(flagged(s, d))), f"{FLAGGED}, g as ({GAPS}) select *, round(missing * 1e0 / nullif(sessions, 0), 6) as share, case when missing = 0 then null when longest >= 10 or missing * 1e0 / sessions > 0.02 then 'critical' when longest >= 3 or missing > 3 then 'warning' else 'note' end as severity from g")
REPORT = f"""{FLAGGED}, g as ({GAPS}), s as (select symbol, count(*) as bars, sum(copies - 1) as duplicate, count(case when f1 or f2 or f3 or f4 or f5 or f6 or f7 then 1 end) as impossible, count(split) as split, count(case when length >= 5 and run = bar_date then 1 end) as stale, max(length) as frozen, count(case when silent then 1 end) as silent, count(case when volume > 0 then 1 end) as traded,
  count(case when abs(move) >= 0.2 and split is null then 1 end) as extreme, count(case when weekend then 1 end) as weekend, count(case when holiday then 1 end) as holiday, sum(missing) as gap, bool_or(continuous) as continuous,
  min(case when copies > 1 then bar_date end) as d1, min(case when f1 or f2 or f3 or f4 or f5 or f6 or f7 then bar_date end) as d2, min(case when split is not null then bar_date end) as d3, min(case when length >= 5 then bar_date end) as d4, min(case when silent then bar_date end) as d5, min(case when abs(move) >= 0.2 and split is null then bar_date end) as d6, min(case when weekend then bar_date end) as d7, min(case when holiday then bar_date end) as d8, min(case when missing > 0 then bar_date end) as d9, min(bar_date) as d0 from fl group by symbol),
r as (select s.symbol, bars, 'duplicate' as kind, 'critical' as severity, duplicate as count, d1 as first_day from s where duplicate > 0 union all select s.symbol, bars, 'impossible', 'critical', impossible, d2 from s where impossible > 0 union all select s.symbol, bars, 'split', 'critical', split, d3 from s where split > 0
  union all select s.symbol, bars, 'stale', case when frozen >= 20 then 'critical' else 'warning' end, stale, d4 from s where stale > 0 union all select s.symbol, bars, 'silent', case when silent > 0.01 * bars then 'warning' else 'note' end, silent, d5 from s where silent > 0 and traded >= floor(bars * 9 / 10.0)
  union all select s.symbol, bars, 'extreme', case when extreme > 0.02 * bars then 'warning' else 'note' end, extreme, d6 from s where extreme > 0 union all select s.symbol, bars, 'weekend', 'critical', weekend, d7 from s where weekend > 0 union all select s.symbol, bars, 'holiday', 'warning', holiday, d8 from s where holiday > 0
  union all select s.symbol, bars, 'gap', case when longest >= 10 or missing > 0.02 * sessions then 'critical' when longest >= 3 or missing > 3 then 'warning' else 'note' end, gap, d9 from s join g on g.symbol = s.symbol where gap > 0 union all select s.symbol, bars, 'continuous', 'note', bars, d0 from s where continuous)
"""
add("audit_report", lambda s, d: dated(A.report(flagged(s, d)), "first_day"), f"{REPORT} select symbol, bars, kind, severity, cast(count as bigint) as count, cast(first_day as varchar) as first_day, cast(case severity when 'critical' then 0 when 'warning' then 1 else 2 end as bigint) as rank from r")
add("audit_critical", lambda s, d: dated(A.critical(A.report(flagged(s, d))), "first_day"), f"{REPORT} select symbol, bars, kind, severity, cast(count as bigint) as count, cast(first_day as varchar) as first_day from r where severity = 'critical' and kind in ('duplicate', 'impossible', 'split', 'stale') order by symbol, kind limit 10")


def of_groups(s: SparkSession, d: str) -> DataFrame:
    """The critical findings that each of sixteen groups of symbols would carry in the record of its run."""
    from barloom.queries.search import universes

    return dated(A.of_runs(A.report(flagged(s, d)), universes(s, d, "groups").withColumnRenamed("study", "run_id")), "first_day")


add("audit_of_runs", of_groups)
