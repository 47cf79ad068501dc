"""Queries over bars: indicators, lookups, calendar, resampling, ranking, as-of joins and the data audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import days
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import recursive as R

#: The counting bars and their adjusted columns, for the SQL side.
BARS = """
with raw as (select upper(trim(symbol)) as symbol, try_cast(trim(bar_date) as date) as bar_date, open, high, low, close, adj_close, volume,
  row_number() over (partition by upper(trim(symbol)), trim(bar_date) order by bar_seq desc) as rn from bars),
b as (select symbol, bar_date, open, high, low, close, adj_close, volume from raw
  where rn = 1 and open > 0 and high > 0 and low > 0 and close > 0 and adj_close > 0 and volume >= 0),
x as (select symbol, bar_date, open * (adj_close / close) as o, high * (adj_close / close) as h, low * (adj_close / close) as l, adj_close as c, volume / (adj_close / close) as v from b),
y0 as (select *, lag(c) over s as pc, lag(h) over s as ph, lag(l) over s as pl, (h + l + c) / 3 as tp from x window s as (partition by symbol order by bar_date)),
y as (select *, case when pc = 0 then 0 else c / pc - 1 end as r, lag(tp) over (partition by symbol order by bar_date) as ptp,
  case when pc is not null then greatest(h - l, abs(h - pc), abs(l - pc)) end as tr from y0)
"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def frame(n: int) -> str:
    return f"(partition by symbol order by bar_date rows between {n - 1} preceding and current row)"


ORDER = "(partition by symbol order by bar_date)"


def indicator(name: str, columns: Callable[[], dict], sql: str | None = None, pre: Callable[[], dict] | None = None, digits: int = 6) -> None:
    """``sql``: select list over y (column AS name), or a whole statement after the common part."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = I.with_inputs(B.adjusted(B.counting_bars(spark, sf)))
        if pre:
            df = df.withColumns(pre())
        cols = columns()
        out = df.withColumns({f"_{k}": c for k, c in cols.items()})
        return out.select("symbol", F.col("bar_date").cast("string").alias("bar_date"), *((F.round(f"_{k}", digits) + F.lit(0.0)).alias(k) for k in cols))

    add(f"ind_{name}", query, None if sql is None else sql if sql.startswith(BARS) else f"{BARS} select symbol, cast(bar_date as varchar) as bar_date, {sql} from y")


def rounded(**cols: str) -> str:
    return ", ".join(f"round({e}, 6) + 0 as {k}" for k, e in cols.items())


def when_full(n: int, e: str, x: str = "c") -> str:
    return f"case when count({x}) over {frame(n)} = {n} then {e} end"


def one(c) -> Callable[[], dict]:
    return lambda: {"value": c()}


avg, sd = lambda n: f"avg(c) over {frame(n)}", lambda n: f"stddev_samp(c) over {frame(n)}"
mx, mn = lambda x, n: f"max({x}) over {frame(n)}", lambda x, n: f"min({x}) over {frame(n)}"
hist = lambda x, n: f"list({x}) over {frame(n)}"

indicator("sma", one(lambda: I.sma(20)), rounded(value=when_full(20, avg(20))))
indicator("stdev", one(lambda: I.stdev(20)), rounded(value=when_full(20, sd(20))))
indicator("bollinger", lambda: I.bollinger(20, 2.0), rounded(middle=when_full(20, avg(20)), upper=when_full(20, f"{avg(20)} + 2 * {sd(20)}"), lower=when_full(20, f"{avg(20)} - 2 * {sd(20)}")))
indicator("highest", one(lambda: I.highest(20)), rounded(value=mx("c", 20)))
indicator("lowest", one(lambda: I.lowest(20)), rounded(value=mn("c", 20)))
indicator("momentum", one(lambda: I.momentum(20)), rounded(value=f"c / nullif(lag(c, 20) over {ORDER}, 0) - 1"))
indicator("roc", one(lambda: I.momentum(10)), rounded(value=f"c / nullif(lag(c, 10) over {ORDER}, 0) - 1"))
indicator("ret", one(lambda: I.ret(1)), rounded(value="r"))
indicator("zscore", one(lambda: I.zscore(20)), rounded(value=when_full(20, f"(c - {avg(20)}) / nullif({sd(20)}, 0)")))
indicator("volatility", one(lambda: I.volatility(20)), rounded(value=when_full(20, f"stddev_samp(r) over {frame(20)} * sqrt(252)", "r")))
indicator("drawdown", one(lambda: I.drawdown(252)), rounded(value=f"c / max(c) over {frame(252)} - 1"))
weighted_sql = lambda n, x="c": f"list_sum(list_transform({hist(x, n)}, lambda e, i: e * i)) / {n * (n + 1) / 2}"
indicator("wma", one(lambda: I.wma(20)), rounded(value=when_full(20, weighted_sql(20))))
indicator("hma", one(lambda: I.hma(20)), f"{BARS}, z as (select *, 2 * ({when_full(10, weighted_sql(10))}) - ({when_full(20, weighted_sql(20))}) as hi from y) select symbol, cast(bar_date as varchar) as bar_date, round({when_full(4, weighted_sql(4, 'hi'), 'hi')}, 6) + 0 as value from z", pre=lambda: {"hma_input": I.hma_input(20)})
kk = when_full(14, f"case when {mx('h', 14)} = {mn('l', 14)} then 50 else 100 * (c - {mn('l', 14)}) / ({mx('h', 14)} - {mn('l', 14)}) end")
indicator("stochastic", lambda: {"k": F.col("k"), "d": I.sma(3, "k")}, f"{BARS}, z as (select *, {kk} as k from y) select symbol, cast(bar_date as varchar) as bar_date, round(k, 6) + 0 as k, round({when_full(3, f'avg(k) over {frame(3)}', 'k')}, 6) + 0 as d from z", pre=lambda: {"k": I.stochastic_k(14)})
indicator("williams_r", one(lambda: I.williams_r(14)), rounded(value=when_full(14, f"case when {mx('h', 14)} <> {mn('l', 14)} then -100 * ({mx('h', 14)} - c) / ({mx('h', 14)} - {mn('l', 14)}) end")))
indicator("cci", one(lambda: I.cci(20)), f"{BARS}, z as (select *, list(tp) over {frame(20)} as xs, avg(tp) over {frame(20)} as m from y), q as (select *, list_avg(list_transform(xs, lambda e: abs(e - m))) as dev from z) select symbol, cast(bar_date as varchar) as bar_date, round(case when len(xs) = 20 then case when dev = 0 then 0 else (tp - m) / (0.015 * dev) end end, 6) + 0 as value from q")
indicator("obv", one(lambda: I.obv(60)), f"{BARS}, z as (select *, case when pc is not null then sign(c - pc) * v end as sv from y) select symbol, cast(bar_date as varchar) as bar_date, round({when_full(60, f'sum(sv) over {frame(59)}')}, 2) + 0 as value from z", digits=2)
up, down = (f"sum(case when tp {o} ptp then tp * v else 0 end) over {frame(14)}" for o in "><")
indicator("mfi", one(lambda: I.mfi(14)), rounded(value=f"case when count(ptp) over {frame(14)} = 14 then case when {down} = 0 and {up} = 0 then null when {down} = 0 then 100 else 100 - 100 / (1 + {up} / {down}) end end"))
indicator("vwap", one(lambda: I.vwap(20)), rounded(value=when_full(20, f"sum(tp * v) over {frame(20)} / nullif(sum(v) over {frame(20)}, 0)")))
indicator("cmf", one(lambda: I.cmf(20)), rounded(value=when_full(20, f"sum(case when h <> l then ((c - l) - (h - c)) / (h - l) * v end) over {frame(20)} / nullif(sum(case when h <> l then v end) over {frame(20)}, 0)")))
hh, ll = when_full(20, mx("h", 20), "h"), when_full(20, mn("l", 20), "l")
indicator("donchian", lambda: I.donchian(20), rounded(upper=hh, lower=ll, middle=f"(({hh}) + ({ll})) / 2"))
since = lambda x, g: when_full(26, f"100.0 * (25 - (list_position(list_reverse({hist(x, 26)}), list_{g}({hist(x, 26)})) - 1)) / 25", x)
indicator("aroon", lambda: {k.replace("up", "rise").replace("down", "fall"): c for k, c in I.aroon(25).items()}, rounded(rise=since("h", "max"), fall=since("l", "min"), oscillator=f"({since('h', 'max')}) - ({since('l', 'min')})"))
mid = lambda n: when_full(n, f"({mx('h', n)} + {mn('l', n)}) / 2", "h")
indicator("ichimoku", lambda: I.ichimoku(), rounded(conversion=mid(9), base=mid(26), span_a=f"(({mid(9)}) + ({mid(26)})) / 2", span_b=mid(52)))
rng, trs = f"({mx('h', 14)} - {mn('l', 14)})", f"sum(tr) over {frame(14)}"
indicator("choppiness", one(lambda: I.choppiness(14)), rounded(value=f"case when count(tr) over {frame(14)} = 14 and {rng} > 0 and {trs} > 0 then 100 * log10({trs} / {rng}) / log10(14) end"))
indicator("linreg", lambda: I.linreg(20), f"{BARS}, z as (select *, cast(row_number() over {ORDER} as double) as i from y), q as (select symbol, bar_date, i, count(c) over {frame(20)} as n, regr_slope(c, i) over {frame(20)} as s, avg(c) over {frame(20)} as m, avg(i) over {frame(20)} as mi, regr_r2(c, i) over {frame(20)} as r2 from z) select symbol, cast(bar_date as varchar) as bar_date, case when n = 20 then round(s, 6) + 0 end as slope, case when n = 20 then round(m - s * (mi - (i - 19)), 6) + 0 end as intercept, case when n = 20 then round(r2, 6) + 0 end as r2, case when n = 20 then round(m - s * (mi - (i - 19)) + s * 20, 6) + 0 end as forecast from q")
fold = lambda xs, n, step, alias: f"case when len({xs}) >= {n} then list_reduce(list_concat([list_avg({xs}[1:{n}])], {xs}[{n + 1}:]), lambda a, e: {step}) end as {alias}"
indicator("ema", one(lambda: I.ema(10)), f"{BARS}, z as (select symbol, bar_date, list(c) over {frame(35)} as xs from y), q as (select *, {fold('xs', 10, 'e * (2.0 / 11) + a * (1 - 2.0 / 11)', 'value')} from z) select symbol, cast(bar_date as varchar) as bar_date, round(value, 6) + 0 as value from q")
indicator("atr", one(lambda: I.atr(14)), f"{BARS}, z as (select symbol, bar_date, list(tr) filter (where tr is not null) over {frame(60)} as xs from y), q as (select *, {fold('xs', 14, '(a * 13 + e) / 14', 'value')} from z) select symbol, cast(bar_date as varchar) as bar_date, round(value, 6) + 0 as value from q")
RSI = f"{BARS}, z as (select symbol, bar_date, list(c) over {frame(61)} as xs from y), d as (select *, list_transform(xs[2:], lambda e, i: e - xs[i]) as ds from z), g as (select *, list_transform(ds, lambda e: greatest(e, 0.0)) as ups, list_transform(ds, lambda e: greatest(-e, 0.0)) as downs from d), q as (select symbol, bar_date, {fold('ups', 14, '(a * 13 + e) / 14', 'gain')}, {fold('downs', 14, '(a * 13 + e) / 14', 'loss')} from g) select symbol, cast(bar_date as varchar) as bar_date, round(case when loss = 0 and gain = 0 then 50 when loss = 0 then 100 else 100 - 100 / (1 + gain / loss) end, 6) + 0 as value from q"
indicator("keltner", lambda: I.keltner(20, 2.0))
for kind in R.KINDS:
    add(f"ind_{kind}", lambda s, d, k=kind: R.recursive(B.adjusted(B.counting_bars(s, d)), k).withColumn("bar_date", F.col("bar_date").cast("string")).withColumns({n: F.round(n, 6) + F.lit(0.0) for n in R.KINDS[k][3]}), RSI if kind == "rsi" else None)


def with_market(spark: SparkSession, sf: str) -> DataFrame:
    """Returns beside the day's mean return over all symbols (rb)."""
    df = I.with_inputs(B.adjusted(B.counting_bars(spark, sf))).select("symbol", "bar_date", "r")
    mean = df.groupBy("bar_date").agg(F.avg("r").alias("rb"))
    return df.join(mean, "bar_date")


PAIR = BARS + ", m as (select bar_date, avg(r) as rb from y group by bar_date), z as (select y.symbol, y.bar_date, r, rb from y join m on y.bar_date = m.bar_date) select symbol, cast(bar_date as varchar) as bar_date, round({e}, 6) + 0 as value from z"
both = f"count(case when r is not null and rb is not null then 1 end) over {frame(60)} = 60"
add("ind_correlation", lambda s, d: with_market(s, d).select("symbol", F.col("bar_date").cast("string").alias("bar_date"), (F.round(I.correlation(60), 6) + F.lit(0.0)).alias("value")), PAIR.format(e=f"case when {both} and min(r) over {frame(60)} <> max(r) over {frame(60)} then corr(r, rb) over {frame(60)} end"))
add("ind_beta", lambda s, d: with_market(s, d).select("symbol", F.col("bar_date").cast("string").alias("bar_date"), (F.round(I.beta(60), 6) + F.lit(0.0)).alias("value")), PAIR.format(e=f"case when {both} then covar_pop(r, rb) over {frame(60)} / var_pop(rb) over {frame(60)} end"))

# -- lookups, resampling, calendar -------------------------------------------------------------------------------------------


def dated(df: DataFrame, *days: str) -> DataFrame:
    return df.withColumns({d: F.col(d).cast("string") for d in days})


add("bars_counting", lambda s, d: dated(B.counting_bars(s, d), "bar_date"), f"{BARS} select symbol, cast(bar_date as varchar) as bar_date, open, high, low, close, adj_close, volume from b")
add("bars_adjusted", lambda s, d: dated(B.adjusted(B.counting_bars(s, d)).select("symbol", "bar_date", *(F.round(c, 6).alias(c) for c in "ohlc"), F.round("v", 2).alias("v")), "bar_date"), f"{BARS} select symbol, cast(bar_date as varchar) as bar_date, round(o, 6) as o, round(h, 6) as h, round(l, 6) as l, round(c, 6) as c, round(v, 2) as v from x")
add("bars_history", lambda s, d: dated(B.history(B.counting_bars(s, d), 5), "bar_date").select("symbol", "bar_date", "close", F.col("back").cast("long").alias("back")), f"{BARS} select symbol, cast(bar_date as varchar) as bar_date, close, back from (select *, row_number() over (partition by symbol order by bar_date desc) as back from b) where back <= 5")
add("bars_first_last", lambda s, d: dated(B.first_last(B.counting_bars(s, d)), "first_day", "last_day"), f"{BARS} select symbol, cast(min(bar_date) as varchar) as first_day, cast(max(bar_date) as varchar) as last_day, arg_min(close, bar_date) as first_value, arg_max(close, bar_date) as last_value, count(*) as bars from b group by symbol")
for unit in ("month", "week"):
    add(
        f"bars_resample_{unit}",
        lambda s, d, u=unit: dated(B.resample(B.counting_bars(s, d), F.date_trunc(u, "bar_date").cast("date")), "bucket").withColumn("volume", F.round("volume", 2)),
        f"{BARS} select symbol, cast(cast(date_trunc('{unit}', bar_date) as date) as varchar) as bucket, arg_min(open, bar_date) as open, max(high) as high, min(low) as low, arg_max(close, bar_date) as close, arg_max(adj_close, bar_date) as adj_close, round(sum(volume), 2) as volume, count(*) as bars from b group by symbol, date_trunc('{unit}', bar_date)",
    )


def running_week(s: SparkSession, d: str) -> DataFrame:
    """The week's bar as it stands at each day: the partial bucket a rule sees while the week goes on."""
    w = W.partitionBy("symbol", F.date_trunc("week", "bar_date")).orderBy("bar_date")
    return dated(B.counting_bars(s, d).select("symbol", "bar_date", F.first("open").over(w).alias("open"), F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"), "close", F.round(F.sum("volume").over(w), 2).alias("volume")), "bar_date")


SO_FAR = "(partition by symbol, date_trunc('week', bar_date) order by bar_date)"
add("bars_resample_running", running_week, f"{BARS} select symbol, cast(bar_date as varchar) as bar_date, first_value(open) over {SO_FAR} as open, max(high) over {SO_FAR} as high, min(low) over {SO_FAR} as low, close, round(sum(volume) over {SO_FAR}, 2) as volume from b")
add("calendar_union", lambda s, d: dated(B.counting_bars(s, d).select("bar_date").distinct(), "bar_date"), f"{BARS} select distinct cast(bar_date as varchar) as bar_date from b")
FLAGS = ", ".join(f"bar_date = min(bar_date) over (partition by date_trunc('{u}', bar_date)) as first_of_{u}, bar_date = max(bar_date) over (partition by date_trunc('{u}', bar_date)) as last_of_{u}" for u in ("month", "week", "year"))
add("calendar_flags", lambda s, d: dated(B.period_flags(B.counting_bars(s, d).select("bar_date").distinct()).withColumn("day_index", F.col("day_index").cast("long")), "bar_date"), f"{BARS}, days as (select distinct bar_date from b) select cast(bar_date as varchar) as bar_date, row_number() over (order by bar_date) - 1 as day_index, {FLAGS} from days")


def calendar_of(s: SparkSession, d: str) -> DataFrame:
    """Each symbol's calendar: by its ticker's form where it has under 20 bars; else continuous where over a tenth of its bars lies on weekends."""
    weekend = F.dayofweek("bar_date").isin(1, 7).cast("int")
    g = B.counting_bars(s, d).groupBy("symbol").agg(F.count("*").alias("bars"), F.sum(weekend).alias("weekend"))
    name = days.calendar_of_ticker(F.col("symbol"))
    seen = F.when(F.col("weekend") > 0.1 * F.col("bars"), "continuous").when(name == "continuous", "session").otherwise(name)
    return g.select("symbol", "bars", "weekend", F.when(F.col("bars") < 20, name).otherwise(seen).alias("calendar"))


BY_TICKER = "case when regexp_matches(symbol, '-(USD|USDT|EUR|GBP)$') then 'continuous' when symbol like '%=X' then 'fx' else 'session' end"
CALENDAR = f"case when count(*) < 20 then {BY_TICKER} when count(*) filter (where isodow(bar_date) >= 6) > 0.1 * count(*) then 'continuous' when {BY_TICKER} = 'continuous' then 'session' else {BY_TICKER} end"
add("calendar_inferred", calendar_of, f"{BARS} select symbol, count(*) as bars, count(*) filter (where isodow(bar_date) >= 6) as weekend, {CALENDAR} as calendar from b group by symbol")

# -- as-of and interval joins ------------------------------------------------------------------------------------------------


def month_ends(s: SparkSession, d: str) -> DataFrame:
    """Each symbol at the last session of each month of the calendar, from two months before its first bar to two after its last."""
    b = B.counting_bars(s, d)
    ends = b.groupBy(F.trunc("bar_date", "month").alias("m")).agg(F.max("bar_date").alias("bar_date"))
    month = lambda c, n: F.add_months(F.trunc(c, "month"), n)
    spans = b.groupBy("symbol").agg(F.min("bar_date").alias("a"), F.max("bar_date").alias("z"))
    wanted = spans.select("symbol", F.explode(F.sequence(month("a", -2), month("z", 2), F.expr("interval 1 month"))).alias("m"))
    return wanted.join(ends, "m").select("symbol", "bar_date")


ENDS = f"{BARS}, e as (select max(bar_date) as bar_date, date_trunc('month', bar_date) as m from b group by date_trunc('month', bar_date)), l as (select s.symbol, e.bar_date from (select symbol, date_trunc('month', min(bar_date)) - interval 2 month as a, date_trunc('month', max(bar_date)) + interval 2 month as z from b group by symbol) s join e on e.m between s.a and s.z)"
add("join_asof", lambda s, d: dated(B.asof(month_ends(s, d), B.counting_bars(s, d), ["symbol"], "bar_date", ["close"]), "bar_date"), f"{ENDS} select l.symbol, cast(l.bar_date as varchar) as bar_date, b.close from l asof left join b on l.symbol = b.symbol and l.bar_date >= b.bar_date")
add("join_asof_lagged", lambda s, d: dated(B.asof(month_ends(s, d), B.counting_bars(s, d), ["symbol"], "bar_date", ["close"], lag_days=F.lit(30)), "bar_date"), f"{ENDS} select l.symbol, cast(l.bar_date as varchar) as bar_date, b.close from l asof left join b on l.symbol = b.symbol and l.bar_date - 30 >= b.bar_date")
add("join_asof_back_filled", lambda s, d: dated(B.asof(month_ends(s, d), B.counting_bars(s, d), ["symbol"], "bar_date", ["close"], back_fill=True), "bar_date"), f"{ENDS}, f as (select symbol, arg_min(close, bar_date) as first_close from b group by symbol), j as (select l.symbol, l.bar_date, b.close from l asof left join b on l.symbol = b.symbol and l.bar_date >= b.bar_date) select j.symbol, cast(j.bar_date as varchar) as bar_date, coalesce(j.close, first_close) as close from j join f on j.symbol = f.symbol")
add("join_asof_forward", lambda s, d: dated(B.asof(month_ends(s, d), B.counting_bars(s, d), ["symbol"], "bar_date", ["close"], forward=True), "bar_date"), f"{ENDS} select l.symbol, cast(l.bar_date as varchar) as bar_date, b.close from l asof left join b on l.symbol = b.symbol and l.bar_date <= b.bar_date")


def lagged_change(s: SparkSession, d: str) -> DataFrame:
    """Change of the as-of value over 365 calendar days (two as-of joins)."""
    b = B.counting_bars(s, d)
    now = B.asof(month_ends(s, d), b, ["symbol"], "bar_date", ["close"])
    then = B.asof(now.withColumnRenamed("close", "now"), b, ["symbol"], "bar_date", ["close"], lag_days=F.lit(365))
    return dated(then.select("symbol", "bar_date", F.round(F.col("now") / F.col("close") - 1, 6).alias("change")), "bar_date")


add("join_asof_change", lagged_change, f"{ENDS}, j as (select l.symbol, l.bar_date, b.close as now from l asof left join b on l.symbol = b.symbol and l.bar_date >= b.bar_date), k as (select j.symbol, j.bar_date, j.now, b.close from j asof left join b on j.symbol = b.symbol and j.bar_date - 365 >= b.bar_date) select symbol, cast(bar_date as varchar) as bar_date, round(now / close - 1, 6) as change from k")


def members(s: SparkSession, d: str) -> DataFrame:
    """Index members on each month end, by continuous periods: a range join made an equi-join on month buckets."""
    from barloom.queries.problems import valid_tenures

    t = valid_tenures(s, d).groupBy("index_name", "symbol", "from_day").agg(F.max_by("to_day", F.struct("recorded_at", "tenure_id")).alias("to_day"))
    ends = B.counting_bars(s, d).groupBy(F.trunc("bar_date", "month").alias("m")).agg(F.max("bar_date").alias("bar_date"))
    spans = ends.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    bounded = t.join(F.broadcast(spans)).select("index_name", "symbol", "from_day", "to_day", F.greatest(F.trunc("from_day", "month"), "lo").alias("a"), F.least(F.trunc("to_day", "month"), "hi").alias("b")).where("a <= b")
    monthly = bounded.select("index_name", "symbol", "from_day", "to_day", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    inside = (F.col("from_day") <= F.col("bar_date")) & (F.col("to_day").isNull() | (F.col("bar_date") <= F.col("to_day")))
    return dated(monthly.join(ends, "m").where(inside).select("index_name", "symbol", "bar_date").distinct(), "bar_date")


add("join_interval_members", members, f"""{BARS}, t as (select index_name, upper(trim(symbol)) as symbol, try_cast(left(trim(from_day), 10) as date) as a, try_cast(left(nullif(trim(to_day), ''), 10) as date) as z, recorded_at, tenure_id from tenures),
v as (select * from t where a is not null and (z is null or z >= a)), u as (select * from (select *, row_number() over (partition by index_name, symbol, a order by recorded_at desc nulls last, tenure_id desc) as rn from v) where rn = 1),
e as (select max(bar_date) as bar_date from b group by date_trunc('month', bar_date))
select distinct index_name, symbol, cast(bar_date as varchar) as bar_date from u join e on a <= bar_date and (z is null or bar_date <= z)""")

# -- ranking -----------------------------------------------------------------------------------------------------------------

METRICS = {
    "momentum": (lambda: I.momentum(20), f"c / nullif(lag(c, 20) over {ORDER}, 0) - 1"), "volatility": (lambda: I.volatility(20), when_full(20, f"stddev_samp(r) over {frame(20)} * sqrt(252)", "r")),
    "price": (lambda: F.col("c"), "c"), "drawdown": (lambda: I.drawdown(20), f"c / max(c) over {frame(20)} - 1"), "volume": (lambda: F.avg(F.col("c") * F.col("v")).over(I.last(20)), f"avg(c * v) over {frame(20)}"),
}


def ranked(s: SparkSession, d: str, metric: str, n: int = 5, ascending: bool = False) -> DataFrame:
    """The n best symbols of each day; null scores are left out; ties go to the symbol that sorts first."""
    df = I.with_inputs(B.adjusted(B.counting_bars(s, d))).select("symbol", "bar_date", F.round(METRICS[metric][0](), 6).alias("score")).where("score is not null")
    order = F.asc("score") if ascending else F.desc("score")
    top = df.withColumn("rank", F.row_number().over(W.partitionBy("bar_date").orderBy(order, "symbol")).cast("long")).where(F.col("rank") <= n)
    return dated(top, "bar_date")


for metric, (_, e) in METRICS.items():
    add(f"rank_{metric}", lambda s, d, m=metric: ranked(s, d, m), f"{BARS}, z as (select symbol, bar_date, round({e}, 6) as score from y), q as (select *, row_number() over (partition by bar_date order by score desc, symbol) as rank from z where score is not null) select symbol, cast(bar_date as varchar) as bar_date, score, rank from q where rank <= 5")
