"""Queries of stores and reference data as sources: chains, coverage, scans, share counts, membership, economic series, and the runs that use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.common import table
from barloom.operators import bars as B
from barloom.operators import reference as R
from barloom.operators.intervals import continuous_periods
from barloom.plans import engine as E
from barloom.queries.market import BARS, ENDS, dated, month_ends
from barloom.queries.problems import P1, counting_tenures
from barloom.queries.reference import share_counts
from barloom.queries.runs import shown
from barloom.queries.search import measured, run_bars, simulated
from barloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


# -- share counts, membership, economic series as text ----------------------------------------------------------------------------

add("source_share_lines", lambda s, d: shown(files.share_lines(files.table_lines(share_counts(s, d), ["symbol", "from_day", "shares"])), 4), f"{BARS} select symbol, cast(min(bar_date) as varchar) as from_day, round(arg_min(volume, bar_date), 4) as shares from b group by symbol, date_trunc('quarter', bar_date) having arg_min(volume, bar_date) > 0")


def periods(s: SparkSession, d: str) -> DataFrame:
    return continuous_periods(counting_tenures(s, d), ["index_name", "symbol"], "from_day", "to_day").where("kind = 'period'")


def tenures_back(s: SparkSession, d: str) -> DataFrame:
    """The periods of membership written as lines and read again."""
    t = files.tenure_lines(files.table_lines(periods(s, d), ["index_name", "symbol", "from_day", "to_day"]))
    return t.select("index_name", "symbol", F.col("from_day").cast("string").alias("from_day"), F.coalesce(F.col("to_day").cast("string"), F.lit("")).alias("to_day"))


PERIODS = f"select lower(index_name) as index_name, symbol, from_day, to_day from ({P1}) where kind = 'period'"
add("source_tenure_lines", tenures_back, PERIODS)
FIRST, LAST = "2019-01-01", "2020-12-31"
day = lambda x: F.lit(x).cast("date")
add("members_ever", lambda s, d: R.members_ever(periods(s, d), day(FIRST), day(LAST)), f"select distinct index_name, symbol from ({P1}) where kind = 'period' and from_day <= '{LAST}' and (to_day = '' or to_day >= '{FIRST}')")
add("members_covered", lambda s, d: dated(R.covers(periods(s, d), day(FIRST)), "earliest"), f"select index_name, min(from_day) as earliest, count(*) as tenures, min(from_day) <= '{FIRST}' as covered from ({P1}) where kind = 'period' group by index_name")


def one_index(s: SparkSession, d: str) -> DataFrame:
    """Periods of the index that sorts first."""
    p = periods(s, d)
    return p.join(F.broadcast(p.agg(F.min("index_name").alias("index_name"))), "index_name").select("symbol", "from_day", "to_day")  # one row


add("join_membership", lambda s, d: dated(R.with_membership(B.counting_bars(s, d).select("symbol", "bar_date"), one_index(s, d)).withColumn("member", F.col("member").cast("long")), "bar_date"), f"with p as ({P1}), o as (select symbol, cast(from_day as date) as a, try_cast(nullif(to_day, '') as date) as z from p where kind = 'period' and index_name = (select min(index_name) from p)), k as ({BARS} select symbol, bar_date from b) select k.symbol, cast(bar_date as varchar) as bar_date, cast(max(case when o.symbol is not null then 1 else 0 end) as bigint) as member from k left join o on o.symbol = k.symbol and a <= bar_date and (z is null or bar_date <= z) group by k.symbol, bar_date")


def macro_lines(s: SparkSession, d: str) -> DataFrame:
    """Two monthly series as a publisher's lines: the mean close of all symbols (LEVEL) and the bars of the month (COUNT), with a header and gaps."""
    b = B.counting_bars(s, d).groupBy(F.trunc("bar_date", "month").alias("day")).agg(F.avg("close").alias("level"), F.count("*").cast("double").alias("count"))
    each = b.select(F.inline(F.array(F.struct(F.lit("LEVEL").alias("file"), F.col("day"), F.col("level").alias("v")), F.struct(F.lit("COUNT").alias("file"), F.col("day"), F.when(F.month("day") != 2, F.col("count")).alias("v")))))
    lines = each.select("file", F.concat_ws(",", F.col("day").cast("string"), F.coalesce(F.col("v").cast("string"), F.lit("."))).alias("line"))
    head = each.select("file").distinct().withColumn("line", F.lit("DATE,VALUE"))
    return head.unionByName(lines)


def macro(s: SparkSession, d: str) -> DataFrame:
    """LEVEL comes 10 days late; COUNT isn't listed, so it counts as revised and 30 days late."""
    lags = s.createDataFrame([("level", 10, False)], "series string, lag_days int, revised boolean")
    return files.with_lags(files.economic(macro_lines(s, d)).withColumnRenamed("file", "series"), lags)


def macro_at_ends(s: SparkSession, d: str) -> DataFrame:
    """Both series as known on each month end of a symbol."""
    m = macro(s, d).withColumn("bar_date", F.date_add("day", F.col("lag_days")))
    wanted = month_ends(s, d).select("bar_date").distinct().select("bar_date", F.explode(F.array(F.lit("LEVEL"), F.lit("COUNT"))).alias("series"))
    return dated(B.asof(wanted, m, ["series"], "bar_date", ["value", "revised"]).withColumn("value", F.round("value", 6)), "bar_date")


add("source_economic", lambda s, d: dated(macro(s, d).select("series", "day", F.round("value", 6).alias("value"), F.col("lag_days").cast("long").alias("lag_days"), "revised"), "day"), f"{BARS}, m as (select cast(date_trunc('month', bar_date) as date) as day, avg(close) as level, count(*) as n from b group by 1) select 'LEVEL' as series, cast(day as varchar) as day, round(level, 6) as value, cast(10 as bigint) as lag_days, false as revised from m union all select 'COUNT', cast(day as varchar), n, 30, true from m where month(day) <> 2")
add("join_economic", macro_at_ends, f"{ENDS}, m as (select cast(date_trunc('month', bar_date) as date) as day, avg(close) as level, count(*) as n from b group by 1), se as (select 'LEVEL' as series, day + 10 as known, level as value, false as revised from m union all select 'COUNT', day + 30, n, true from m where month(day) <> 2), w as (select distinct bar_date, series from l cross join (values ('LEVEL'), ('COUNT')) v(series)) select cast(w.bar_date as varchar) as bar_date, w.series, round(se.value, 6) as value, se.revised from w asof left join se on w.series = se.series and w.bar_date >= se.known")

# -- stores ------------------------------------------------------------------------------------------------------------------------


def asked(s: SparkSession, d: str) -> DataFrame:
    """Every symbol of the list, from mid 2019 to mid 2020."""
    from barloom.common import symbol_of

    return table(s, d, "series").select(symbol_of("symbol").alias("symbol"), day("2019-07-01").alias("from_day"), day("2020-06-30").alias("to_day")).where("symbol is not null")


def held(s: SparkSession, d: str) -> DataFrame:
    """What a store has: each symbol up to its last bar, asked for from two months before its first."""
    return B.counting_bars(s, d).groupBy("symbol").agg(F.add_months(F.min("bar_date"), -2).alias("requested_from"), F.max("bar_date").alias("last_day"))


ASKED = f"{BARS}, sy as (select upper(trim(symbol)) as symbol from series where trim(symbol) <> ''), hd as (select symbol, min(bar_date) - interval 2 month as requested_from, max(bar_date) as last_day from b group by symbol)"
HIT = "coalesce(requested_from <= date '2019-07-01' and last_day >= date '2020-06-30', false)"
add("store_covered", lambda s, d: files.covered(asked(s, d), held(s, d)).select("symbol", "hit"), f"{ASKED} select sy.symbol, {HIT} as hit from sy left join hd on hd.symbol = sy.symbol")


def from_store(s: SparkSession, d: str) -> DataFrame:
    b = B.counting_bars(s, d).select("symbol", "bar_date", "close")
    return dated(files.through_store(asked(s, d), b, held(s, d), b.withColumn("close", F.col("close") * 2)), "bar_date")


add("store_through", from_store, f"{ASKED} select b.symbol, cast(bar_date as varchar) as bar_date, case when {HIT} then close else close * 2 end as close, {HIT} as stored from b join sy on sy.symbol = b.symbol join hd on hd.symbol = b.symbol where bar_date between date '2019-07-01' and date '2020-06-30'")
add("store_scan", lambda s, d: dated(files.scanned(asked(s, d), B.counting_bars(s, d)), "first_day", "last_day"), f"{ASKED}, g as (select symbol, count(*) as n, min(bar_date) as a, max(bar_date) as z from b where bar_date between date '2019-07-01' and date '2020-06-30' group by symbol) select sy.symbol, coalesce(n, 0) as bars, cast(a as varchar) as first_day, cast(z as varchar) as last_day, case when hd.symbol is null then 'no data' when n is null then 'no bars in range' end as error from sy left join hd on hd.symbol = sy.symbol left join g on g.symbol = sy.symbol")


def weekly_chain(s: SparkSession, d: str) -> DataFrame:
    """A chain of which only the second source has weekly bars."""
    b = B.counting_bars(s, d).select("symbol", "bar_date", "open", "high", "low", "close", "adj_close", "volume")
    c = files.Chain({"daily only": {"1d": b}, "both": {"1d": b, "1wk": B.resample(b, F.date_trunc("week", "bar_date").cast("date"))}})
    return dated(c.bars("1wk").select("symbol", "bucket", "close", F.col("bars").alias("days")), "bucket")


add("source_chain_weekly", weekly_chain, f"{BARS} select symbol, cast(cast(date_trunc('week', bar_date) as date) as varchar) as bucket, arg_max(close, bar_date) as close, count(*) as days from b group by symbol, date_trunc('week', bar_date)")
add("source_symbol_search", lambda s, d: files.found_symbols(table(s, d, "series").select("symbol", "name"), "co"), "select symbol, name from series where contains(upper(symbol), 'CO') or contains(upper(coalesce(name, '')), 'CO') order by upper(symbol) <> 'CO', not starts_with(upper(symbol), 'CO'), symbol limit 20")


def charted(s: SparkSession, d: str) -> DataFrame:
    """The three symbols that sort first, on one chart."""
    b = B.counting_bars(s, d)
    names = [r["symbol"] for r in b.select("symbol").distinct().orderBy("symbol").limit(3).collect()]
    return dated(shown(files.overlay(b, names)), "bar_date")


add("chart_overlay", charted, f"{BARS}, nm as (select distinct symbol from b order by symbol limit 3), q as (select b.symbol, bar_date, close from b join nm on nm.symbol = b.symbol), g as (select d.bar_date, nm.symbol from (select distinct bar_date from q) d cross join nm), h as (select g.symbol, g.bar_date, last_value(close ignore nulls) over (partition by g.symbol order by g.bar_date) as close from g left join q on q.symbol = g.symbol and q.bar_date = g.bar_date) select symbol, cast(bar_date as varchar) as bar_date, round(close, 6) as close, round(100 * close / first_value(close) over (partition by symbol order by bar_date), 6) as indexed from h where close is not null")
add("sink_lines", lambda s, d: files.table_lines(table(s, d, "series"), ["symbol", "name", "calendar", "listed_on"]), """select symbol || ',' || case when regexp_matches(coalesce(name, ''), '[,"\\n\\r]') then '"' || replace(name, '"', '""') || '"' else coalesce(name, '') end || ',' || coalesce(calendar, '') || ',' || coalesce(listed_on, '') as line from series""")

# -- runs on reference data ------------------------------------------------------------------------------------------------------


def with_shares(s: SparkSession, d: str) -> DataFrame:
    """Bars with the share count known on the day (the first one also before it)."""
    return B.asof(run_bars(s, d), share_counts(s, d).withColumnRenamed("from_day", "bar_date"), ["symbol"], "bar_date", ["shares"], back_fill=True)


add("run_biggest_company", lambda s, d: measured(simulated(s, d, "biggest-company", "groups", bars=with_shares(s, d))))
add("run_index_members", lambda s, d: measured(simulated(s, d, "momentum-rotation", "groups", bars=R.with_membership(run_bars(s, d), one_index(s, d)))))
add("run_rate_timing", lambda s, d: measured(simulated(s, d, "rate-timing", "groups", {"": {"slippage_bps": 2.0}}, macro=macro(s, d).withColumn("series", F.when(F.col("series") == "LEVEL", "RATE").otherwise(F.col("series"))))))


def borrow(s: SparkSession, d: str) -> DataFrame:
    """What the pairs' short sides cost, with a schedule of rates in which one symbol in five is dear and one in five can't be borrowed."""
    symbols = B.counting_bars(s, d).select("symbol").distinct()
    kind = F.pmod(F.crc32("symbol"), F.lit(5))
    lines = symbols.select(F.concat_ws(",", "symbol", F.when(kind == 0, "12.5%").when(kind == 1, "n/a").otherwise("1")).alias("line")).unionByName(s.createDataFrame([("*,2.5",)], "line string"))
    rates = files.borrow_rates(lines)
    runs = simulated(s, d, "pairs-trade", "pair", allow_short=True, leverage=2.0)
    return R.borrow_report(runs, rates)


add("run_borrow_report", lambda s, d: shown(borrow(s, d), 4))
