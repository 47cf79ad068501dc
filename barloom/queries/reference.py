"""Queries of reference data, regimes, reasons, covariance, ladders and windows of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import performance as P
from barloom.operators import reference as R
from barloom.operators import trades as T
from barloom.plans import engine as E
from barloom.common import day_of, table
from barloom.queries.market import BARS, CALENDAR, ENDS, calendar_of, month_ends
from barloom.queries.runs import CURVE, curve, shown
from barloom.plans import search as S
from barloom.queries.search import TRIALS, measured, prices, run_bars, simulated, trials, universes
from barloom.sources import web

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def share_counts(s: SparkSession, d: str) -> DataFrame:
    """A step function of share counts: the volume of each quarter's first bar."""
    b = B.counting_bars(s, d)
    g = b.groupBy("symbol", F.date_trunc("quarter", "bar_date")).agg(F.min("bar_date").alias("from_day"), F.min_by("volume", "bar_date").alias("shares"))
    return g.select("symbol", "from_day", "shares")


SHARES = f"{ENDS}, sh as (select symbol, min(bar_date) as from_day, arg_min(volume, bar_date) as shares from b group by symbol, date_trunc('quarter', bar_date)), f0 as (select symbol, arg_min(shares, from_day) as first_shares from sh group by symbol), pr as (select l.symbol, l.bar_date, b.close from l asof left join b on l.symbol = b.symbol and l.bar_date >= b.bar_date), va as (select pr.symbol, pr.bar_date, pr.close, sh.shares from pr asof left join sh on pr.symbol = sh.symbol and pr.bar_date >= sh.from_day), mv as (select va.symbol, bar_date, close, coalesce(shares, first_shares) as shares, coalesce(shares, first_shares) * close as market_value from va join f0 on f0.symbol = va.symbol)"
add("join_market_value", lambda s, d: shown(R.market_value(month_ends(s, d), B.counting_bars(s, d), share_counts(s, d)).select("symbol", "bar_date", "close", "shares", "market_value"), 4), f"{SHARES} select symbol, cast(bar_date as varchar) as bar_date, round(close, 4) as close, round(shares, 4) as shares, round(market_value, 4) as market_value from mv")
add("rank_market_value", lambda s, d: shown(R.by_market_value(R.market_value(month_ends(s, d), B.counting_bars(s, d), share_counts(s, d)), 5).select("bar_date", "symbol", "rank"), 4), f"{SHARES} select cast(bar_date as varchar) as bar_date, symbol, rank from (select *, row_number() over (partition by bar_date order by market_value desc, symbol) as rank from mv where market_value is not null) where rank <= 5")


def change_log(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The tenures of each index as a log of changes (symbols marked by index), and today's members."""
    from barloom.operators.intervals import continuous_periods
    from barloom.queries.problems import counting_tenures

    p = continuous_periods(counting_tenures(s, d), ["index_name", "symbol"], "from_day", "to_day").where("kind = 'period'").withColumn("name", F.concat_ws("@", "symbol", "index_name"))
    log = p.select(F.col("from_day").alias("day"), F.col("name").alias("added"), F.lit(None).cast("string").alias("removed")).unionByName(p.where("to_day is not null").select(F.date_add("to_day", 1).alias("day"), F.lit("").alias("added"), F.col("name").alias("removed")))
    return p.where("to_day is null").select(F.col("name").alias("symbol")), log


def rebuilt(s: SparkSession, d: str) -> DataFrame:
    now, log = change_log(s, d)
    return R.tenures_of(now, log).select("symbol", F.coalesce(F.col("from_day").cast("string"), F.lit("")).alias("from_day"), F.coalesce(F.col("to_day").cast("string"), F.lit("")).alias("to_day"))


add("source_membership", rebuilt, """with t as (select index_name, upper(trim(symbol)) as symbol, try_cast(left(trim(from_day), 10) as date) as a, coalesce(try_cast(left(nullif(trim(to_day), ''), 10) as date), date '9999-12-30') as b, recorded_at, tenure_id from tenures),
v as (select * from (select *, row_number() over (partition by index_name, symbol, a order by recorded_at desc nulls last, tenure_id desc) as rn from t where a is not null and b >= a and index_name is not null and symbol is not null) where rn = 1),
m as (select *, max(b) over (partition by index_name, symbol order by a, b rows between unbounded preceding and 1 preceding) as upto from v),
g as (select *, sum(case when upto is null or a > upto + 1 then 1 else 0 end) over (partition by index_name, symbol order by a, b rows between unbounded preceding and current row) as no from m),
p as (select index_name, symbol, min(a) as a, max(b) as b from g group by index_name, symbol, no)
select upper(symbol || '@' || index_name) as symbol, cast(a as varchar) as from_day, case when b = date '9999-12-30' then '' else cast(b as varchar) end as to_day from p""")


def decisions(s: SparkSession, d: str) -> DataFrame:
    return month_ends(s, d).select("symbol", "bar_date", F.lit(1.0).alias("weight"))


add("forward_scores", lambda s, d: shown(R.forward_scores(decisions(s, d), prices(s, d), 5).select("symbol", "bar_date", "state", "result")), f"{ENDS}, q as (select symbol, bar_date, lead(o) over (partition by symbol order by bar_date) as entry, lead(c, 5) over (partition by symbol order by bar_date) as exit from x), j as (select l.symbol, l.bar_date, q.bar_date as seen, q.entry, q.exit from l asof left join q on l.symbol = q.symbol and l.bar_date >= q.bar_date) select symbol, cast(bar_date as varchar) as bar_date, case when seen is null then 'unknown' when entry is null or exit is null then 'pending' else 'scored' end as state, case when seen is not null and entry is not null and exit is not null then round(exit / entry - 1, 6) + 0 end as result from j")
add("forward_summary", lambda s, d: shown(R.forward_summary(R.forward_scores(decisions(s, d), prices(s, d), 5))))


def benchmark(s: SparkSession, d: str) -> DataFrame:
    """The runs' mean return, compounded: one value a day."""
    from pyspark.sql import Window as W

    m = P.with_returns(curve(s, d)).groupBy("bar_date").agg(F.avg("r").alias("m")).where("m is not null")
    return m.select("bar_date", F.round(F.exp(F.sum(F.log1p("m")).over(W.orderBy("bar_date"))), 9).alias("value"))


add("perf_regimes", lambda s, d: shown(P.regimes(curve(s, d), benchmark(s, d)), 5), f"""{CURVE}, b0 as (select bar_date, avg(r) as m from w group by bar_date having avg(r) is not null), b1 as (select bar_date, round(exp(sum(ln(1 + m)) over (order by bar_date)), 9) as value from b0),
b2 as (select *, value / lag(value) over (order by bar_date) - 1 as br from b1), b3 as (select *, count(br) over z as n, stddev_samp(br) over z as v, value / max(value) over (order by bar_date rows between unbounded preceding and current row) - 1 as dd from b2 window z as (order by bar_date rows between 62 preceding and current row)),
b4 as (select * from b3 where n = 63), th as (select quantile_cont(v, 1.0 / 3) as lo, quantile_cont(v, 2.0 / 3) as hi from b4),
k2 as (select bar_date, case when dd <= -0.1 then 'bear' when v <= lo then 'calm' when v <= hi then 'normal' else 'high' end as regime from b4, th)
select run_id, regime, round(exp(sum(ln(1 + r))) - 1, 5) + 0 as compounded, count(*) as bars from w join k2 on w.bar_date = k2.bar_date where r is not null group by run_id, regime""")


def reasons(s: SparkSession, d: str) -> DataFrame:
    """Results of the mean-reversion runs by the reasons of entry and exit, costs of both legs taken off."""
    f = E.fills(simulated(s, d, "mean-reversion", "each")).withColumn("cost", F.col("commission") + F.col("slippage"))
    t = T.enriched(T.round_trips(f, ("reason",)), prices(s, d))
    return shown(T.both_reasons(t), 4)


add("trades_by_reason", reasons)


def month_returns(s: SparkSession, d: str) -> DataFrame:
    """Returns of each month's five symbols of steadiest price."""
    from pyspark.sql import Window as W

    p = I.with_inputs(prices(s, d)).where("r is not null").select("symbol", "bar_date", "r", F.date_format("bar_date", "yyyy-MM").alias("month"))
    sd = p.groupBy("month", "symbol").agg(F.round(F.stddev_samp("r"), 9).alias("sd"), F.count("*").alias("n")).where("n >= 15")
    top = sd.withColumn("place", F.row_number().over(W.partitionBy("month").orderBy("sd", "symbol"))).where("place <= 5").select("month", "symbol")
    return p.join(top, ["month", "symbol"])


add("construct_covariance", lambda s, d: shown(R.covariances(month_returns(s, d), "month", "symbol", "bar_date", "r"), 8), f"{BARS}, p as (select symbol, bar_date, r, strftime(bar_date, '%Y-%m') as month from y where pc is not null), sd as (select month, symbol, round(stddev_samp(r), 9) as sd from p group by month, symbol having count(*) >= 15), t as (select month, symbol from (select *, row_number() over (partition by month order by sd, symbol) as k from sd) where k <= 5), q as (select p.* from p join t on p.month = t.month and p.symbol = t.symbol) select i.month, i.symbol as a, j.symbol as b, round(covar_samp(i.r, j.r), 8) + 0 as covariance, count(*) as days from q i join q j on i.month = j.month and i.bar_date = j.bar_date and i.symbol <= j.symbol group by i.month, i.symbol, j.symbol")


def capacity(s: SparkSession, d: str) -> DataFrame:
    """The rotation at five sizes of capital with impact on prices: where size eats the result, and how much of it was put to work."""
    rungs = {f"1e{k}": {"cash": 10.0**k, "impact": 1.0} for k in (5, 6, 7, 8, 9)}
    return shown(S.capacity_rungs(simulated(s, d, "momentum-rotation", "groups", rungs)))


add("run_capacity", capacity)
add("run_capacity_ends", lambda s, d: shown(S.capacity_ends(capacity(s, d))))


def windows(s: SparkSession, d: str) -> DataFrame:
    """The rotation replayed in each calendar year alone, with the bars before it as its look-back; years before a universe's bars are left out."""
    b = run_bars(s, d)
    spans = b.groupBy(F.year("bar_date").alias("year")).agg(F.min("bar_date").alias("from_day")).select(F.col("year").cast("string").alias("window"), F.make_date("year", F.lit(1), F.lit(1)).alias("start"), F.make_date("year", F.lit(12), F.lit(31)).alias("end"))
    return measured(E.backtests(b, S.replayed(universes(s, d, "groups"), spans, "momentum-rotation")))


add("run_windows", windows)

add("search_paths", lambda s, d: shown(S.paths(trials(s, d), S.combinatorial(trials(s, d), 6, 2, 5)), 5))
SIDE = "case when stddev_samp(case when {c} then r end) > 1e-12 then round(avg(case when {c} then r end) / stddev_samp(case when {c} then r end) * sqrt(252), 9) end"
add("search_holdout", lambda s, d: shown(S.holdout(trials(s, d)), 5), f"{TRIALS}, l as (select symbol, max(no) + 1 as t from tr group by symbol), h as (select tr.*, no < floor(t * 7e-1 + 1e-9) as seen from tr join l on tr.symbol = l.symbol), g as (select symbol, fast, slow, {SIDE.format(c='seen')} as a, {SIDE.format(c='not seen')} as b, exp(sum(case when not seen then ln(1 + r) end)) - 1 as tr from h group by symbol, fast, slow), k as (select *, row_number() over (partition by symbol order by a desc nulls last, fast, slow) as k from g) select symbol, fast, slow, round(a, 5) + 0 as train_sharpe, round(b, 5) + 0 as test_sharpe, round(tr, 5) + 0 as test_return from k where k = 1")


def coverage(s: SparkSession, d: str) -> DataFrame:
    """Share of the calendar's days, from a symbol's first to its last bar, on which it has one; enough from 90 %."""
    b = B.counting_bars(s, d).select("symbol", "bar_date").join(calendar_of(s, d).select("symbol", "calendar"), "symbol")
    from pyspark.sql import Window as W

    days = b.select("calendar", "bar_date").distinct().withColumn("no", F.row_number().over(W.partitionBy("calendar").orderBy("bar_date")))
    g = b.join(days, ["calendar", "bar_date"]).groupBy("symbol").agg(F.count("*").alias("bars"), (F.max("no") - F.min("no") + 1).alias("sessions"))
    return shown(g.withColumn("share", F.col("bars") / F.col("sessions")).withColumn("enough", F.col("bars") >= 0.9 * F.col("sessions")))


add("join_coverage", coverage, f"{BARS}, k as (select symbol, {CALENDAR} as calendar from b group by symbol), s as (select distinct calendar, bar_date from b join k on b.symbol = k.symbol), n as (select *, row_number() over (partition by calendar order by bar_date) as no from s), g as (select b.symbol, count(*) as bars, max(no) - min(no) + 1 as sessions from b join k on b.symbol = k.symbol join n on n.calendar = k.calendar and n.bar_date = b.bar_date group by b.symbol) select symbol, bars, sessions, round(bars * 1e0 / sessions, 6) as share, bars >= 0.9 * sessions as enough from g")


add("fn_ticker", lambda s, d: table(s, d, "ai_calls").select("call_id", web.ticker_in(F.col("prompt")).alias("ticker")))


def articles(s: SparkSession, d: str) -> DataFrame:
    """Speeches as articles: on each day that a party speaks, the titles of the week before."""
    a = table(s, d, "documents").select(F.col("party").alias("key"), day_of("sitting_day").alias("day"), F.col("agenda_item").alias("title"), F.col("doc_id").alias("id"))
    out = web.dated_articles(a.where("key is not null and day is not null"), a, "key")
    return shown(out)


add("source_articles", articles, "with a as (select party as key, try_cast(left(trim(sitting_day), 10) as date) as day, agenda_item as title, doc_id as id from documents), w as (select distinct key, day from a where key is not null and day is not null), h as (select w.key, w.day, a.day as published, title, id from w join a on a.key = w.key and a.day <= w.day and a.day >= w.day - 7 where title is not null), o as (select *, row_number() over (partition by key, day, lower(title) order by published desc, id desc) as c from h), r as (select *, row_number() over (partition by key, day order by published desc, id desc) as place from o where c = 1) select key, cast(day as varchar) as day, place, cast(published as varchar) as published, id, title from r where place <= 5")


def filings(s: SparkSession, d: str) -> DataFrame:
    """The share counts as filed facts and back."""
    c = share_counts(s, d).withColumn("cik", F.crc32("symbol").cast("string"))
    fact = F.struct(F.col("from_day").cast("string").alias("end"), F.col("shares").alias("val"), F.col("from_day").cast("string").alias("filed"), F.lit("10-Q").alias("form"))
    per = c.groupBy("symbol", "cik").agg(F.sort_array(F.collect_list(fact)).alias("xs"))
    tag = lambda t, xs: F.create_map(F.lit(t), F.struct(F.create_map(F.lit("shares"), xs).alias("units")))
    body = F.to_json(F.struct("cik", F.create_map(F.lit("dei"), tag("Outstanding", F.col("xs")), F.lit("gaap"), tag("Issued", F.slice("xs", 1, 1))).alias("facts")))
    out = web.share_facts(per.select(body.alias("body")), ["Outstanding", "Issued"])
    names = per.select("symbol", F.lpad("cik", 10, "0").alias("cik"))
    return shown(out.join(names, "cik").select("symbol", "from_day", "shares"), 4)


add("source_filings", filings, f"{BARS} select symbol, cast(min(bar_date) as varchar) as from_day, round(arg_min(volume, bar_date), 4) as shares from b group by symbol, date_trunc('quarter', bar_date) having arg_min(volume, bar_date) > 0")


def intents(s: SparkSession, d: str) -> DataFrame:
    """The book each run means to hold after its last record."""
    from barloom.common import symbol_of
    from barloom.queries.runs import records

    r = records(s, d).select("run_id", F.col("bar_date").alias("at"), F.explode_outer("positions").alias("p"))
    return shown(R.intended(r.select("run_id", "at", F.when(F.col("p.weight").isNotNull(), symbol_of(F.col("p.symbol"))).alias("symbol"), F.col("p.weight").alias("weight"))).withColumnRenamed("at", "as_of"), 5)


add("forward_intended", intents, f"{CURVE}, la as (select run_id, max(bar_date) as as_of from c group by run_id), p as (select c.run_id, as_of, unnest(positions) as p from c join la on la.run_id = c.run_id and la.as_of = c.bar_date) select run_id, cast(as_of as varchar) as as_of, upper(trim(p.symbol)) as symbol, round(sum(p.weight), 5) + 0 as weight from p where p.weight is not null and trim(p.symbol) <> '' group by run_id, as_of, upper(trim(p.symbol))")
add("search_fixed_spread", lambda s, d: shown(S.fixed_spread(trials(s, d), "symbol", ["fast", "slow"]), 5), f"{TRIALS}, ln as (select symbol, max(no) + 1 as t from tr group by symbol), pa as (select tr.symbol, fast || '-' || slow as config, floor(no * 6 / t) as g, exp(sum(ln(1 + r))) - 1 as x from tr join ln on ln.symbol = tr.symbol group by all) select symbol, config, count(*) as groups, round(avg(x), 5) + 0 as mean, round(quantile_cont(x, 0.5), 5) + 0 as median, round(stddev_samp(x), 5) + 0 as sd, round(min(x), 5) + 0 as worst, round(max(x), 5) + 0 as best, round(avg(case when x < 0 then 1.0 else 0.0 end), 5) as below_zero from pa group by symbol, config")


def placements(s: SparkSession, d: str) -> DataFrame:
    """Where each symbol's walk-forward result stands among the paths of its combinatorial validation."""
    own = S.walk_forward(trials(s, d), 40, 20).groupBy("symbol").agg(F.round(F.exp(F.sum(F.log1p("test_return"))) - 1, 9).alias("walked"))
    return shown(S.placed_in(S.paths(trials(s, d), S.combinatorial(trials(s, d), 6, 2, 5)).withColumn("total_return", F.round("total_return", 9)), own, "symbol", "walked"), 5)


add("search_placement", placements)
add("run_positions", lambda s, d: shown(E.positions(simulated(s, d, "momentum-rotation", "groups"), prices(s, d)), 4))
