"""Queries over runs (day_records): curves, measures, slices, trades, books, and the statistics that search over runs needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.common import day_of, symbol_of, table, trimmed
from barloom.operators import bars as B
from barloom.operators import performance as P
from barloom.operators import trades as T
from barloom.operators.intervals import latest_versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The last counting record of each run and day that has a positive equity."""
    r = table(spark, sf, "day_records").select("run_id", trimmed(F.col("day_stamp")).alias("stamp"), day_of("day_stamp").alias("bar_date"), "equity", "exposure", "positions", "record_id")
    counting = latest_versions(r.where("run_id is not null and bar_date is not null"), ["run_id", "stamp", "bar_date"], ["record_id"])
    return latest_versions(counting.where("equity > 0"), ["run_id", "bar_date"], ["stamp"])


def curve(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("run_id", "bar_date", F.col("equity").alias("value"), F.coalesce("exposure", F.lit(0.0)).alias("exposure"))


CURVE = """
with r as (select run_id, trim(day_stamp) as stamp, try_cast(left(trim(day_stamp), 10) as date) as bar_date, equity, exposure, positions, record_id from day_records),
k as (select * from (select *, row_number() over (partition by run_id, stamp order by record_id desc) as rn from r where run_id is not null and bar_date is not null) where rn = 1 and equity > 0),
d as (select * from (select *, row_number() over (partition by run_id, bar_date order by stamp desc) as dn from k) where dn = 1),
c as (select run_id, bar_date, equity as value, coalesce(exposure, 0) as exposure, positions from d),
w0 as (select *, lag(value) over (partition by run_id order by bar_date) as before, max(value) over (partition by run_id order by bar_date rows between unbounded preceding and current row) as peak, row_number() over (partition by run_id order by bar_date) - 1 as no from c),
w as (select *, case when before is null then null when before <= 0 then 0 else value / before - 1 end as r, value / peak - 1 as dd from w0)
"""


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as strings: what engines agree on."""
    out = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "double":
            out[f.name] = F.round(f.name, digits) + F.lit(0.0)
        elif kind == "date":
            out[f.name] = F.col(f.name).cast("string")
        elif kind == "int":
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out) if out else df


def rounds(*pairs: str) -> str:
    return ", ".join(f"round({e}, 6) + 0 as {n}" for n, e in (p.split("=", 1) for p in pairs))


add("curve", lambda s, d: shown(curve(s, d), 4), f"{CURVE} select run_id, cast(bar_date as varchar) as bar_date, round(value, 4) as value, round(exposure, 4) as exposure from c")
add("curve_returns", lambda s, d: shown(P.with_returns(curve(s, d)).select("run_id", "bar_date", "r", "dd", "no")), f"{CURVE} select run_id, cast(bar_date as varchar) as bar_date, round(r, 6) + 0 as r, round(dd, 6) + 0 as dd, no from w")
add("perf_headline", lambda s, d: shown(P.headline(curve(s, d)).select("run_id", "first_day", "last_day", "bars", "total_return", "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "trough_day", "best_day", "worst_day", "win_rate")), f"""{CURVE},
g as (select run_id, min(bar_date) as a, max(bar_date) as z, arg_min(value, bar_date) as v0, arg_max(value, bar_date) as v1, count(*) as bars, avg(r) as m, stddev_samp(r) as s, sum(case when r < 0 then r * r end) / nullif(count(case when r < 0 then 1 end), 0) as l, min(dd) as mdd, max(r) as best, min(r) as worst, count(case when r > 0 then 1 end) * 1.0 / nullif(count(r), 0) as wr, arg_min(bar_date, struct_pack(dd := dd, bar_date := bar_date)) as t from w group by run_id),
h as (select *, v1 / v0 - 1 as tr, case when z > a then pow(v1 / v0, 365.25 / (z - a)) - 1 end as cagr from g)
select run_id, cast(a as varchar) as first_day, cast(z as varchar) as last_day, bars, {rounds('total_return=tr', 'cagr=cagr', 'volatility=s * sqrt(252)', 'sharpe=m / nullif(s, 0) * sqrt(252)', 'sortino=m / nullif(sqrt(l), 0) * sqrt(252)', 'calmar=cagr / nullif(abs(mdd), 0)', 'max_drawdown=mdd', 'best_day=best', 'worst_day=worst', 'win_rate=wr')}, cast(t as varchar) as trough_day from h""")
add("perf_longest_drawdown", lambda s, d: shown(P.longest_underwater(curve(s, d))), f"{CURVE}, i as (select *, sum(case when value >= peak then 1 else 0 end) over (partition by run_id order by bar_date) as island from w) select run_id, max(n) as longest_drawdown from (select run_id, island, count(*) as n from i where value < peak group by run_id, island) group by run_id")
add("perf_risk", lambda s, d: shown(P.risk(curve(s, d)), 5), f"""{CURVE},
b as (select run_id, avg(r) as m, stddev_samp(r) as s, count(r) as n from w group by run_id),
t as (select w.run_id, w.r, m, s, n, row_number() over (partition by w.run_id order by r, bar_date) as rk from w join b on w.run_id = b.run_id where r is not null),
g as (select run_id, sum(case when r > 0 then r else 0 end) as up, sum(case when r < 0 then -r else 0 end) as dn, sum(r) as sr, quantile_cont(r, 0.05) as q05, quantile_cont(r, 0.01) as q01, quantile_cont(r, 0.95) as q95, avg(case when rk <= ceil(n * 0.05) then r end) as c95, avg(case when rk <= ceil(n * 0.01) then r end) as c99, avg(pow(r - m, 3)) as m3, avg(pow(r - m, 4)) as m4, any_value(m) as m, any_value(s) as s from t group by run_id),
u as (select run_id, sqrt(avg(dd * dd)) as ulcer, regr_r2(ln(value), no) as lr from w group by run_id)
select g.run_id, {', '.join(f"round({e}, 5) + 0 as {n}" for n, e in (('omega', 'up / nullif(dn, 0)'), ('gain_to_pain', 'sr / nullif(dn, 0)'), ('var95', 'q05'), ('var99', 'q01'), ('cvar95', 'c95'), ('cvar99', 'c99'), ('tail_ratio', 'abs(q95) / nullif(abs(q05), 0)'), ('skew', 'm3 / nullif(pow(s, 3), 0)'), ('excess_kurtosis', 'm4 / nullif(pow(s, 4), 0) - 3'), ('kelly', 'm / nullif(s * s, 0)'), ('ulcer', 'ulcer'), ('log_r2', 'lr')))} from g join u on g.run_id = u.run_id""")
add("perf_rolling", lambda s, d: shown(P.rolling(curve(s, d), 21)), f"{CURVE}, q as (select run_id, bar_date, count(r) over v as n, avg(r) over v as m, stddev_samp(r) over v as s from w window v as (partition by run_id order by bar_date rows between 20 preceding and current row)) select run_id, cast(bar_date as varchar) as bar_date, {rounds('sharpe=m / nullif(s, 0) * sqrt(252)', 'volatility=s * sqrt(252)')} from q where n = 21")
for unit, fmt, sql_fmt in (("year", "yyyy", "%Y"), ("month", "yyyy-MM", "%Y-%m")):
    add(f"perf_by_{unit}", lambda s, d, f=fmt: shown(P.slices(curve(s, d), F.date_format("bar_date", f)).withColumn("exposure", F.col("exposure") + 1e-9), 5), f"""{CURVE}, p as (select *, strftime(bar_date, '{sql_fmt}') as period, value / coalesce(before, value) - 1 as r0, coalesce(before, value) as b0 from w),
x as (select run_id, period, arg_min(b0, bar_date) as base from p group by run_id, period), y as (select p.*, base, value / greatest(base, max(value) over (partition by p.run_id, p.period order by bar_date)) - 1 as dd0 from p join x on p.run_id = x.run_id and p.period = x.period)
select run_id, period, count(*) as bars, {", ".join(f"round({e}, 5) + 0 as {n}" for n, e in (("total_return", "arg_max(value, bar_date) / any_value(base) - 1"), ("max_drawdown", "least(0, min(dd0))"), ("volatility", "stddev_samp(r0) * sqrt(252)"), ("sharpe", "avg(r0) / nullif(stddev_samp(r0), 0) * sqrt(252)"), ("exposure", "avg(exposure) + 1e-9")))} from y group by run_id, period""")
add("perf_seasonal", lambda s, d: shown(P.seasonal(curve(s, d)).withColumn("bars", F.coalesce("bars", F.lit(0)))), f"{CURVE}, f as (select run_id, month(bar_date) as month, exp(sum(ln(1 + r))) - 1 as x, count(*) as bars from w where r is not null group by run_id, month(bar_date)), e as (select run_id, unnest(range(1, 13)) as month from (select distinct run_id from c)) select e.run_id, e.month, round(x, 6) + 0 as compounded, coalesce(bars, 0) as bars from e left join f on e.run_id = f.run_id and e.month = f.month")
add("perf_stress", lambda s, d: shown(P.stress(curve(s, d)), 5), f"{CURVE}, g as (select run_id, bar_date, r, ln(1 + r) as g from w where r is not null), t as (select run_id, sum(g) as g from g group by run_id), b as (select run_id, sum(g) as d from (select *, row_number() over (partition by run_id order by r desc, bar_date) as k from g) where k <= 5 group by run_id), m as (select run_id, max(m) as m from (select run_id, date_trunc('month', bar_date) as mm, sum(g) as m from g group by run_id, date_trunc('month', bar_date)) group by run_id), j as (select t.run_id, exp(g) - 1 as total, exp(g - d) - 1 as wd, exp(g - m) - 1 as wm from t join b on t.run_id = b.run_id join m on t.run_id = m.run_id) select run_id, round(total, 5) + 0 as total, round(wd, 5) + 0 as without_days, round(wm, 5) + 0 as without_month, round((total - wd) / nullif(abs(total), 0), 5) + 0 as share_days, round((total - wm) / nullif(abs(total), 0), 5) + 0 as share_month from j")


def market(s: SparkSession, d: str) -> DataFrame:
    """The mean return of all runs on each day, compounded, as the benchmark: a row a day."""
    m = P.with_returns(curve(s, d)).groupBy("bar_date").agg(F.avg("r").alias("m")).where("m is not null")
    return m.select("bar_date", F.round(F.exp(F.sum(F.log1p("m")).over(W.orderBy("bar_date"))), 9).alias("level"))


add("perf_benchmark", lambda s, d: shown(P.against(curve(s, d), market(s, d)), 4), f"""{CURVE}, m as (select bar_date, round(exp(sum(ln(1 + avg(r))) over (order by bar_date)), 9) as level from w where r is not null group by bar_date), q as (select c.run_id, c.bar_date, value, level, lag(value) over v as pv, lag(level) over v as pl from c join m on c.bar_date = m.bar_date window v as (partition by c.run_id order by c.bar_date)),
j as (select run_id, value / pv - 1 as r, level / pl - 1 as rb from q where pv is not null),
g as (select run_id, count(*) as pairs, covar_samp(r, rb) as cov, var_samp(rb) as vb, stddev_samp(r) as sr, stddev_samp(r - rb) as te, avg(r) as m, avg(rb) as mb, avg(case when rb > 0 then r end) as ur, avg(case when rb > 0 then rb end) as ub, avg(case when rb < 0 then r end) as lr, avg(case when rb < 0 then rb end) as lb from j group by run_id having count(*) >= 3)
select run_id, pairs, {', '.join(f"round({e}, 4) + 0 as {n}" for n, e in (('beta', 'cov / nullif(vb, 0)'), ('correlation', 'cov / nullif(sr * sqrt(vb), 0)'), ('tracking_error', 'te * sqrt(252)'), ('information_ratio', '(m - mb) / nullif(te, 0) * sqrt(252)'), ('alpha', '(m - cov / nullif(vb, 0) * mb) * 252'), ('up_capture', 'ur / nullif(ub, 0)'), ('down_capture', 'lr / nullif(lb, 0)')))} from g""")
add("perf_episodes", lambda s, d: shown(P.episodes(curve(s, d))), f"{CURVE}, o as (select *, exposure > 0 as on1 from c), p as (select *, case when on1 and not coalesce(lag(on1) over (partition by run_id order by bar_date), false) then 1 else 0 end as st from o), q as (select *, sum(st) over (partition by run_id order by bar_date) as episode from p) select run_id, cast(episode as bigint) as episode, cast(min(bar_date) as varchar) as first_day, cast(max(bar_date) as varchar) as last_day, count(*) as bars from q where on1 group by run_id, episode")

# -- trades ------------------------------------------------------------------------------------------------------------------


def numbered_records(s: SparkSession, d: str) -> DataFrame:
    return records(s, d).withColumn("seq", F.row_number().over(W.partitionBy("run_id").orderBy("bar_date")))


def books(s: SparkSession, d: str) -> DataFrame:
    """Positions of each record, long and short, numbered by record."""
    p = numbered_records(s, d).select("run_id", "seq", "bar_date", F.explode("positions").alias("p")).select("run_id", "seq", "bar_date", symbol_of(F.col("p.symbol")).alias("symbol"), F.col("p.shares").alias("shares"), F.col("p.price").alias("price"))
    return p.where("symbol is not null and shares != 0 and price > 0")


FILLS = f"""{CURVE}, sq as (select *, row_number() over (partition by run_id order by bar_date) as seq from c), pe as (select run_id, seq, bar_date, unnest(positions) as p from sq),
b as (select run_id, seq, bar_date, upper(trim(p.symbol)) as symbol, sum(p.shares) as shares, max(p.price) as price from pe where p.shares <> 0 and p.price > 0 and trim(p.symbol) <> '' group by run_id, seq, bar_date, upper(trim(p.symbol))),
h as (select *, lag(shares) over v as bs, lag(seq) over v as bq, lead(seq) over v as nq from b window v as (partition by run_id, symbol order by seq)),
f as (select run_id, symbol, seq, bar_date, shares - case when bq = seq - 1 then bs else 0 end as shares, price from h
  union all select h.run_id, symbol, h.seq + 1, sq.bar_date, -shares, price from h join sq on sq.run_id = h.run_id and sq.seq = h.seq + 1 where nq is null or nq > h.seq + 1),
fl as (select * from f where shares <> 0)
"""


def fills(s: SparkSession, d: str) -> DataFrame:
    return T.fills_of(books(s, d), numbered_records(s, d))


add("trades_fills", lambda s, d: shown(fills(s, d), 4), f"{FILLS} select run_id, symbol, cast(seq as bigint) as seq, cast(bar_date as varchar) as bar_date, round(shares, 4) as shares, round(price, 4) as price from fl")
BARS_X = """, rawb as (select upper(trim(symbol)) as symbol, try_cast(trim(bar_date) as date) as bar_date, open, high, low, close, adj_close, volume, row_number() over (partition by upper(trim(symbol)), trim(bar_date) order by bar_seq desc) as rn from bars),
x as (select symbol, bar_date, high * (adj_close / close) as h, low * (adj_close / close) as l, adj_close as c from rawb where rn = 1 and open > 0 and high > 0 and low > 0 and close > 0 and adj_close > 0 and volume >= 0),
mk as (select symbol, max(bar_date) as last_day, arg_max(c, bar_date) as last from x group by symbol)
"""
# positions before and after each fill, split where they go through zero; then openings and closings by their shares so far
TRIPS = f"""{FILLS}{BARS_X}, ps as (select *, round(sum(shares) over (partition by run_id, symbol order by seq), 6) as aft from fl), pq as (select *, coalesce(lag(aft) over (partition by run_id, symbol order by seq), 0) as bef from ps),
lg as (select run_id, symbol, seq, bar_date, price, sign(bef) as dir, false as opens, case when bef * aft < 0 then abs(bef) else greatest(abs(bef) - abs(aft), 0) end as q from pq
  union all select run_id, symbol, seq, bar_date, price, sign(aft), true, case when bef * aft < 0 then abs(aft) else greatest(abs(aft) - abs(bef), 0) end from pq),
hi as (select *, round(sum(q) over (partition by run_id, symbol, dir, opens order by seq), 6) as hi from lg where q > 0),
cu as (select *, coalesce(lag(hi) over (partition by run_id, symbol, dir, opens order by seq), 0) as lo from hi),
m as (select y.run_id, y.symbol, y.dir, y.bar_date as entry_day, s.bar_date as exit_day, y.price as entry_price, s.price as exit_price, y.seq as entry_seq, s.seq as exit_seq, least(y.hi, s.hi) - greatest(y.lo, s.lo) as shares from cu y join cu s on y.opens and not s.opens and y.run_id = s.run_id and y.symbol = s.symbol and y.dir = s.dir and y.lo < s.hi - 1e-9 and s.lo < y.hi - 1e-9),
so as (select run_id, symbol, dir, max(hi) as sold from cu where not opens group by run_id, symbol, dir),
o as (select y.run_id, y.symbol, y.dir, y.bar_date as entry_day, cast(null as date) as exit_day, y.price as entry_price, mk.last as exit_price, y.seq as entry_seq, null as exit_seq, y.hi - greatest(y.lo, coalesce(sold, 0)) as shares from cu y left join so on so.run_id = y.run_id and so.symbol = y.symbol and so.dir = y.dir left join mk on mk.symbol = y.symbol where y.opens and y.hi > coalesce(sold, 0) + 1e-9),
t as (select u.*, case when dir > 0 then 'long' else 'short' end as direction, dir * (exit_price - entry_price) * shares as net_pnl, dir * (exit_price / entry_price - 1) as ret, exit_day is null as open, greatest(0, coalesce(exit_day, last_day) - entry_day) as days_held from (select * from m union all select * from o) u left join mk on mk.symbol = u.symbol),
e as (select t.*, count(x.c) as bars_held, least(0, coalesce(case when any_value(dir) > 0 then min(x.l) / any_value(entry_price) - 1 else 1 - max(x.h) / any_value(entry_price) end, 0)) as mae_pct, greatest(0, coalesce(case when any_value(dir) > 0 then max(x.h) / any_value(entry_price) - 1 else 1 - min(x.l) / any_value(entry_price) end, 0)) as mfe_pct
  from t left join x on x.symbol = t.symbol and x.bar_date >= entry_day and (open or x.bar_date <= exit_day) group by all)
"""


def day_bars(s: SparkSession, d: str) -> DataFrame:
    return B.adjusted(B.counting_bars(s, d))


def trips(s: SparkSession, d: str) -> DataFrame:
    marks = day_bars(s, d).groupBy("symbol").agg(F.max("bar_date").alias("last_day"), F.max_by("c", "bar_date").alias("last"))
    return T.round_trips(fills(s, d), marks=marks)


def enriched(s: SparkSession, d: str) -> DataFrame:
    return T.enriched(trips(s, d), day_bars(s, d))


def r4(digits: int = 4, **columns: str) -> str:
    return ", ".join(f"round({e}, {digits}) + 0 as {n}" for n, e in columns.items())


KEYS = ("run_id", "symbol", "direction", "entry_seq", "exit_seq")
KEYS_SQL = "run_id, symbol, direction, cast(entry_seq as bigint) as entry_seq, cast(coalesce(exit_seq, 0) as bigint) as exit_seq"
add("trades_round_trips", lambda s, d: shown(trips(s, d).drop("gross_pnl", "costs").fillna(0, ["exit_seq"]), 4), f"{TRIPS} select {KEYS_SQL}, cast(entry_day as varchar) as entry_day, cast(exit_day as varchar) as exit_day, {r4(entry_price='entry_price', exit_price='exit_price', shares='shares', net_pnl='net_pnl', ret='ret')}, cast(days_held as bigint) as days_held, open from t")
add("trades_excursions", lambda s, d: shown(enriched(s, d).select(*KEYS, "bars_held", "mae_pct", "mfe_pct", "mae", "mfe").fillna(0, ["exit_seq"]), 4), f"{TRIPS} select {KEYS_SQL}, bars_held, {r4(mae_pct='mae_pct', mfe_pct='mfe_pct', mae='mae_pct * entry_price * shares', mfe='mfe_pct * entry_price * shares')} from e")
STREAKS = """q as (select run_id, net_pnl > 0 as won, row_number() over (partition by run_id order by entry_day, symbol, exit_seq, entry_seq, direction) as no from t where not open), i as (select *, no - row_number() over (partition by run_id, won order by no) as island from q), g2 as (select run_id, won, island, count(*) as n from i group by run_id, won, island), sk as (select run_id, coalesce(max(case when won then n end), 0) as longest_wins, coalesce(max(case when not won then n end), 0) as longest_losses from g2 group by run_id)"""
WON, LOST, GAVE = "case when net_pnl > 0 then {} end", "case when net_pnl <= 0 then {} end", "case when net_pnl <= 0 and mfe_pct >= 0.01 then {} end"
STATS = r4(
    7, win_rate="count(case when net_pnl > 0 then 1 end) * 1.0 / count(*)", mean_win_pct=f"avg({WON.format('ret')})", mean_loss_pct=f"avg({LOST.format('ret')})", mean_win=f"avg({WON.format('net_pnl')})", mean_loss=f"avg({LOST.format('-net_pnl')})",
    expectancy="avg(net_pnl)", expectancy_pct="avg(ret)", profit_factor=f"case when sum({LOST.format('-net_pnl')}) > 0 then coalesce(sum({WON.format('net_pnl')}), 0) / sum({LOST.format('-net_pnl')}) when sum({WON.format('net_pnl')}) > 0 then cast('inf' as double) end",
    best="max(ret)", worst="min(ret)", largest_win=f"max({WON.format('net_pnl')})", largest_loss=f"min({LOST.format('net_pnl')})", mean_bars="avg(bars_held)", mean_days="avg(days_held)", mean_mae="avg(mae_pct)", mean_mfe="avg(mfe_pct)", edge_ratio="avg(mfe_pct) / nullif(abs(avg(mae_pct)), 0)",
    winner_mae=f"avg({WON.format('mae_pct')})", give_back=f"avg({GAVE.format('least(2, (mfe_pct - ret) / mfe_pct)')})", net_pnl="sum(net_pnl)", payoff=f"case when avg({LOST.format('-net_pnl')}) > 0 then coalesce(avg({WON.format('net_pnl')}), 0) / avg({LOST.format('-net_pnl')}) end",
)
add("trades_stats", lambda s, d: shown(T.trade_stats(enriched(s, d)).drop("costs").fillna(0, ["closed", "wins", "losses", "give_back_trades", "median_bars", "most_bars", "longest_wins", "longest_losses"]), 7), f"""{TRIPS}, {STREAKS}, n as (select *, row_number() over (partition by run_id order by bars_held, symbol, direction, entry_seq, exit_seq) as k, count(*) over (partition by run_id) as n from e where not open),
st as (select run_id, count(*) as closed, count(case when net_pnl > 0 then 1 end) as wins, count(case when net_pnl <= 0 then 1 end) as losses, {STATS}, max(case when k = n // 2 + 1 then bars_held end) as median_bars, max(bars_held) as most_bars, count({GAVE.format('1')}) as give_back_trades from n group by run_id),
al as (select run_id, count(case when open then 1 end) as open from t group by run_id)
select al.run_id, al.open, st.* exclude (run_id, closed, wins, losses, median_bars, most_bars, give_back_trades), {', '.join(f'coalesce({c}, 0) as {c}' for c in ('closed', 'wins', 'losses', 'median_bars', 'most_bars', 'give_back_trades', 'longest_wins', 'longest_losses'))} from al left join st on st.run_id = al.run_id left join sk on sk.run_id = al.run_id""")
add("trades_streaks", lambda s, d: shown(T.streaks(trips(s, d))), f"{TRIPS}, {STREAKS} select * from sk")
add("trades_by_symbol", lambda s, d: shown(T.by_symbol(trips(s, d)), 4), f"{TRIPS}, g as (select run_id, symbol, sum(net_pnl) as net, count(*) as trades, count(case when net_pnl > 0 then 1 end) as wins from t where not open group by run_id, symbol) select run_id, symbol, round(net, 4) + 0 as net, trades, wins, round(net / nullif(sum(abs(net)) over (partition by run_id), 0), 4) + 0 as contribution from g")


def by_half(s: SparkSession, d: str) -> DataFrame:
    """Trades that ended (open ones: began) in the first half of a year."""
    t = trips(s, d).withColumn("_year", F.year(F.coalesce("exit_day", "entry_day")))
    t = T.in_range(t, F.make_date("_year", F.lit(1), F.lit(1)), F.make_date("_year", F.lit(6), F.lit(30)))
    return shown(t.groupBy("run_id", F.col("_year").cast("long").alias("year")).agg(F.count("*").alias("trades"), F.sum("net_pnl").alias("net")), 4)


add("trades_in_range", by_half, f"{TRIPS} select run_id, year(coalesce(exit_day, entry_day)) as year, count(*) as trades, round(sum(net_pnl), 4) + 0 as net from t where month(coalesce(exit_day, entry_day)) <= 6 group by run_id, year(coalesce(exit_day, entry_day))")
DECAY = f"""{TRIPS}, n0 as (select symbol, bar_date, c, row_number() over (partition by symbol order by bar_date) as no from x),
w1 as (select t.run_id, t.symbol, t.direction, entry_seq, exit_seq, any_value(dir) as dir, any_value(entry_price) as ep, min(no) as a, max(no) as b from t join n0 on n0.symbol = t.symbol and n0.bar_date between entry_day and exit_day where not open group by all having max(no) > min(no)),
w2 as (select w1.*, unnest([1, 2, 3, 5, 10, 20, 40]) as horizon from w1), w3 as (select w2.*, dir * (p.c / ep - 1) as v, dir * (z.c / ep - 1) as fv from w2 join n0 p on p.symbol = w2.symbol and p.no = least(a + horizon, b) join n0 z on z.symbol = w2.symbol and z.no = b),
pt as (select run_id, horizon, avg(v) as mean_return, sum(case when a + horizon <= b then 1 else 0 end) as still_open, count(*) as trades, avg(fv) as exit_return, avg(b - a + 1) as mean_bars from w3 group by run_id, horizon)
"""
add("trades_decay", lambda s, d: shown(T.decay(trips(s, d), day_bars(s, d))), f"{DECAY} select run_id, cast(horizon as bigint) as horizon, {rounds('mean_return=mean_return', 'exit_return=exit_return', 'mean_bars=mean_bars')}, cast(still_open as bigint) as still_open, trades from pt")


def decay_points(s: SparkSession, d: str) -> DataFrame:
    """Rounded, so that engines agree on which of two equal means is the peak."""
    return T.decay(trips(s, d), day_bars(s, d)).withColumn("mean_return", F.round("mean_return", 9))


add("trades_decay_summary", lambda s, d: shown(T.decay_summary(decay_points(s, d)), 5), f"""{DECAY}, rp as (select * replace (round(mean_return, 9) as mean_return) from pt), l as (select *, lag(mean_return) over (partition by run_id order by horizon) as before from rp),
g as (select run_id, any_value(trades) as trades, any_value(exit_return) as exit_return, any_value(mean_bars) as mean_bars, max(mean_return) as peak_return, arg_max(struct_pack(m := mean_return, p := before), case when horizon <= mean_bars - 1 then horizon end) as la from l group by run_id),
kk as (select g.*, (select min(horizon) from rp where rp.run_id = g.run_id and rp.mean_return = g.peak_return) as peak_bars from g)
select run_id, trades, cast(peak_bars as bigint) as peak_bars, round(peak_return, 5) + 0 as peak_return, round(exit_return, 5) + 0 as exit_return, round(mean_bars, 5) as mean_bars, coalesce(la.m >= la.p, true) as still_rising, round(case when peak_return >= 0.01 and peak_bars < 40 then (peak_return - exit_return) / peak_return end, 5) + 0 as given_back from kk""")
add("book_overlap", lambda s, d: shown(_overlap(s, d)), f"{FILLS}, bk as (select bar_date, run_id, list_sort(list(distinct case when shares > 0 then '+' else '-' end || symbol)) as book from b where shares <> 0 group by bar_date, run_id), y as (select bar_date, book, count(*) as runs from bk group by bar_date, book) select cast(bar_date as varchar) as bar_date, array_to_string(book, ',') as book, runs from y where runs > 1")


def _overlap(s: SparkSession, d: str) -> DataFrame:
    """Days on which several runs hold the same symbols on the same sides: compared by a canonical key (+A,-B), not run by run."""
    net = books(s, d).groupBy("bar_date", "run_id", "symbol").agg(F.sum("shares").alias("shares")).where("shares != 0")
    side = F.concat(F.when(F.col("shares") > 0, "+").otherwise("-"), "symbol")
    k = net.groupBy("bar_date", "run_id").agg(F.array_join(F.sort_array(F.collect_set(side)), ",").alias("book"))
    return k.groupBy("bar_date", "book").agg(F.count("*").alias("runs")).where("runs > 1")
