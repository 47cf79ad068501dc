"""Queries of sources, functions, records and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.common import table
from barloom.functions import days, maths, text
from barloom.operators import bars as B
from barloom.queries.market import BARS, dated
from barloom.queries.runs import CURVE, curve, shown
from barloom.sources import files, ledger
from barloom.streaming import bars as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def csv_lines(s: SparkSession, d: str) -> DataFrame:
    """The bars as lines of vendors' files: symbols of even length of hash with US dates and other names of columns."""
    b = B.counting_bars(s, d)
    us = F.pmod(F.crc32("symbol"), F.lit(2)) == 0
    cell = lambda c: F.col(c).cast("string")
    one = F.concat_ws(",", cell("bar_date"), *map(cell, ("open", "high", "low", "close", "adj_close", "volume")))
    two = F.concat_ws(",", cell("volume"), F.date_format("bar_date", "MM/dd/yyyy"), cell("close"), cell("adj_close"), F.lit(""), F.lit("0"), cell("low"))
    head = b.select("symbol").distinct().select(F.col("symbol").alias("file"), F.lit(-1).cast("long").alias("at"), F.when(us, "Vol,Date,Close,Adj Close,Open,High,Low").otherwise("date,open,high,low,close,adj_close,volume").alias("line"))
    return head.unionByName(b.select(F.col("symbol").alias("file"), F.unix_date("bar_date").cast("long").alias("at"), F.when(us, two).otherwise(one).alias("line")))


add("source_csv", lambda s, d: dated(files.parsed_bars(csv_lines(s, d)).select(F.col("file").alias("symbol"), "bar_date", "low", "close", "adj_close", "volume"), "bar_date"), f"{BARS} select symbol, cast(bar_date as varchar) as bar_date, low, close, adj_close, volume from b")


def chained(s: SparkSession, d: str) -> DataFrame:
    b = B.counting_bars(s, d).select("symbol", "bar_date", "close", "volume")
    return dated(files.chain([b.where("volume > 5000000"), b]).withColumn("source", F.col("source").cast("long")), "bar_date")


add("source_chain", chained, f"{BARS}, u as (select symbol, bar_date, close, volume, 0 as source from b where volume > 5000000 union all select symbol, bar_date, close, volume, 1 from b), f as (select symbol, min(source) as m from u group by symbol) select u.symbol, cast(bar_date as varchar) as bar_date, close, volume, cast(source as bigint) as source from u join f on u.symbol = f.symbol and source = m")


def merge(s: SparkSession, d: str) -> DataFrame:
    b = B.counting_bars(s, d).select("symbol", "bar_date", "close")
    new = b.where("dayofmonth(bar_date) <= 10").withColumn("close", F.round(F.col("close") * 2, 4))
    return dated(files.merged(b, new, ["symbol", "bar_date"]), "bar_date")


add("source_merge", merge, f"{BARS} select symbol, cast(bar_date as varchar) as bar_date, case when day(bar_date) <= 10 then round(close * 2, 4) else close end as close from b")
add("source_synthetic", lambda s, d: dated(files.synthetic(s, ["AAA", "BBB", "CCC"], "2020-01-01", "2021-12-31"), "bar_date"))
add("source_intraday", lambda s, d: dated(shown(files.intraday_of(B.counting_bars(s, d), 6), 6), "bar_date"), f"{BARS}, k as (select *, unnest(range(0, 6)) as slot from b), l as (select *, open + (close - open) * slot / 6 as a, open + (close - open) * (slot + 1) / 6 as z from k) select symbol, cast(bar_date as varchar) as bar_date, slot, round(a, 6) as open, round(case when slot = 2 then high else greatest(a, z) end, 6) as high, round(case when slot = 4 then low else least(a, z) end, 6) as low, round(z, 6) as close, round(volume / 6, 6) as volume from l")
add("source_compressed", lambda s, d: dated(files.compressed(B.counting_bars(s, d), "symbol", "bar_date", "close", 0.05), "bar_date"))
add("source_thinned", lambda s, d: dated(files.thinned(curve(s, d), "run_id", "bar_date", "value", 20), "bar_date"), f"{CURVE}, s as (select run_id, min(bar_date) as a, max(bar_date) as z from c group by run_id), j as (select c.run_id, bar_date, value, cast(least(19, floor((bar_date - a) * 20.0 / greatest(z - a, 1))) as bigint) as col from c join s on c.run_id = s.run_id), g as (select run_id, col, min(struct_pack(v := value, a := bar_date)) as lo, max(struct_pack(v := value, a := bar_date)) as hi from j group by run_id, col) select distinct run_id, col as column, cast(p.a as varchar) as bar_date, p.v as value from (select run_id, col, unnest([lo, hi]) as p from g)")
add("fn_tidy", lambda s, d: table(s, d, "ai_calls").select("call_id", text.tidy(F.col("response")).alias("value")), r"select call_id, trim(regexp_replace(response, '\s+', ' ', 'g'), ' ') as value from ai_calls")
add("fn_numberless", lambda s, d: table(s, d, "ai_calls").select(text.numberless(F.col("prompt")).alias("value")).groupBy("value").agg(F.count("*").alias("calls")), r"select regexp_replace(prompt, '\d+(?:\.\d+)*', 'N', 'g') as value, count(*) as calls from ai_calls group by 1")
add("fn_slug", lambda s, d: table(s, d, "series").select("symbol", text.slug(F.col("name")).alias("value")), "select symbol, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as value from series")
add("fn_hash", lambda s, d: table(s, d, "ai_calls").select("call_id", text.fingerprint(F.col("prompt")).alias("value")), "select call_id, case when prompt = '' then '' else sha256(prompt) end as value from ai_calls")
add("fn_json_in", lambda s, d: table(s, d, "ai_calls").select("call_id", F.get_json_object(text.json_in(F.col("response")), "$.action").alias("value")).where("value is not null"))
add("fn_without_tags", lambda s, d: table(s, d, "ai_calls").select("call_id", text.without_tags(F.col("response")).alias("value")))
add("fn_dataset_key", lambda s, d: table(s, d, "day_records").groupBy("run_id").agg(F.array_distinct(F.flatten(F.collect_list("positions.symbol"))).alias("x"), F.min(F.substring("day_stamp", 1, 10)).alias("a"), F.max(F.substring("day_stamp", 1, 10)).alias("z")).select("run_id", text.dataset_key(F.col("x"), F.col("a"), F.col("z"), F.lit("1d")).alias("value")), "with p as (select run_id, unnest(positions) as p from day_records), n as (select run_id, list_sort(list(distinct upper(trim(p.symbol)))) as x from p where p.symbol is not null group by run_id), s as (select run_id, min(left(day_stamp, 10)) as a, max(left(day_stamp, 10)) as z from day_records group by run_id) select s.run_id, concat_ws(':', coalesce(array_to_string(x, ','), ''), a, z, '1d') as value from s left join n on n.run_id = s.run_id")
add("fn_normal_cdf", lambda s, d: table(s, d, "events").select("event_id", F.round(maths.normal_cdf((F.col("value") - 50) / 20), 5).alias("p")))
add("calendar_trading_days", lambda s, d: dated(days.trading_days(s, "2019-01-01", "2023-12-31").withColumn("no", F.col("no").cast("long")), "day"))


def entries(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "ai_calls")
    return c.select(F.col("run_id").alias("dataset"), F.col("day_stamp").alias("at"), F.col("provider").alias("strategy"), F.lit(1).cast("long").alias("trials"), F.col("kind").alias("objective"), F.col("millis").cast("double").alias("score")).where("dataset is not null")


add("ledger_summary", lambda s, d: shown(ledger.summary(entries(s, d))), "select run_id as dataset, count(*) as entries, count(*) as trials, min(day_stamp) as first_at, max(day_stamp) as last_at, count(distinct provider) as strategies, arg_max(kind, struct_pack(a := day_stamp, b := kind)) as objective, max(cast(millis as double)) as best, round(avg(millis), 6) as weighted_score from ai_calls where run_id is not null group by run_id")


def log(s: SparkSession, d: str) -> DataFrame:
    c = curve(s, d).withColumn("day", F.col("bar_date").cast("string"))
    return ledger.verified(ledger.sealed(c, "run_id", "day", ["run_id", "day", "value", "exposure"]), "run_id", "day")


add("log_verified", log, f"{CURVE} select run_id, count(*) as entries, cast(null as varchar) as broken_at from c group by run_id")
HOURS = r"""
with e as (select upper(trim(symbol)) as symbol, regexp_extract(bar_stamp, '^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2})(?::(\d{2}))?(Z|[+-]\d{2}:\d{2})?$', ['d', 'h', 'm', 's', 'z']) as x, open, high, low, close, volume, bar_seq from intraday_bars where close is not null),
r as (select *, epoch(cast(x.d as timestamp)) + cast(x.h as int) * 3600 + cast(x.m as int) * 60 + coalesce(try_cast(x.s as int), 0) - case when left(x.z, 1) in ('+', '-') then (case when left(x.z, 1) = '-' then -1 else 1 end) * (cast(substr(x.z, 2, 2) as int) * 3600 + cast(substr(x.z, 5, 2) as int) * 60) else 0 end as ts from e where x.d <> ''),
m as (select max(ts) - 3600 as mark from r),
g as (select symbol, floor(ts / 3600) * 3600 as slot, arg_min(open, struct_pack(a := ts, b := bar_seq)) as open, max(high) as high, min(low) as low, arg_max(close, struct_pack(a := ts, b := bar_seq)) as close, sum(volume) as volume, count(*) as readings from r group by 1, 2)
select symbol, cast(slot as bigint) as slot, open, high, low, close, volume, readings from g, m where slot + 3600 <= mark
"""


def streamed(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parquet*")


add("stream_resample", lambda s, d: stream.run_available(stream.resampled(streamed(s, d, "intraday_bars"))), HOURS)
add("stream_sessions", lambda s, d: shown(stream.run_available(stream.sessions(streamed(s, d, "events"))), 4), "with e as (select user_id, epoch(ts) as t, value, ts from events), n as (select *, case when t - lag(t) over (partition by user_id order by t) < 1800 then 0 else 1 end as new from e), i as (select *, sum(new) over (partition by user_id order by t) as no from n), g as (select user_id, no, min(t) as a, max(t) + 1800 as z, count(*) as events, sum(value) as value from i group by user_id, no), m as (select max(t) - 3600 as mark from e) select user_id, cast(floor(a) as bigint) as from_s, cast(floor(z) as bigint) as to_s, events, round(value, 4) as value from g, m where z <= mark")

# -- more functions and records --------------------------------------------------------------------------------------------------

add("fn_cache_key", lambda s, d: table(s, d, "ai_calls").select("call_id", text.cache_key([F.col("provider"), F.col("model"), F.col("prompt")]).alias("value")), "select call_id, sha256(concat(strlen(coalesce(provider, '')), ':', coalesce(provider, ''), strlen(coalesce(model, '')), ':', coalesce(model, ''), strlen(coalesce(prompt, '')), ':', coalesce(prompt, ''))) as value from ai_calls")
add("fn_vendor_symbol", lambda s, d: table(s, d, "series").select("symbol", text.vendor_symbol(F.col("symbol")).alias("value")), "select symbol, case when lower(trim(symbol)) = '^gspc' then '^spx' when lower(trim(symbol)) like '^%' then lower(trim(symbol)) when regexp_matches(lower(trim(symbol)), '-(usd|eur|gbp)$') then replace(lower(trim(symbol)), '-', '') when contains(symbol, '.') then lower(trim(symbol)) else lower(trim(symbol)) || '.us' end as value from series")
add("fn_fnv32", lambda s, d: table(s, d, "series").select("symbol", text.fnv32(F.upper("symbol")).alias("value")))
add("fn_end_of_day", lambda s, d: table(s, d, "day_records").select("record_id", days.end_of_day(F.col("day_stamp")).alias("until"), days.moved(F.col("day_stamp"), 30).alias("later")), "select record_id, case when length(trim(day_stamp)) = 10 then trim(day_stamp) || 'T23:59' else trim(day_stamp) end as until, cast(try_cast(left(trim(day_stamp), 10) as date) + 30 as varchar) || substr(trim(day_stamp), 11) as later from day_records")
add("fn_coin_flips", lambda s, d: shown(table(s, d, "ai_calls").where("kind is not null").groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", maths.coin_flips(F.col("n"))[0].alias("low"), maths.coin_flips(F.col("n"))[1].alias("high"))), "select kind, count(*) as n, round(greatest(0, 0.5 - 1.96 * sqrt(0.25 / count(*))), 6) as low, round(least(1, 0.5 + 1.96 * sqrt(0.25 / count(*))), 6) as high from ai_calls where kind is not null group by kind")
add("ledger_spread", lambda s, d: shown(ledger.spread(entries(s, d)), 4), "select run_id as dataset, round(case when count(millis) > 1 then stddev_samp(millis) end, 4) as spread from ai_calls where run_id is not null group by run_id")


def used_up(s: SparkSession, d: str) -> DataFrame:
    """Each dataset's next search of three trials, and whether others have used its data up."""
    e = entries(s, d)
    return ledger.warned(e, e.select("dataset", F.lit(3).cast("long").alias("trials")).distinct()).select("dataset", "entries", "before", "warned")


add("ledger_warned", used_up, "select run_id as dataset, count(*) as entries, count(*) as before, count(*) >= 5 and count(*) >= 6 as warned from ai_calls where run_id is not null group by run_id")


def run_again(s: SparkSession, d: str) -> DataFrame:
    """Each curve against itself with its exposure changed from the tenth day on and its last day lost."""
    from pyspark.sql import Window as W

    was = curve(s, d)
    w = W.partitionBy("run_id").orderBy("bar_date")
    now = was.withColumns({"no": F.row_number().over(w), "left": F.lead("bar_date").over(w)}).where("left is not null").withColumn("exposure", F.when(F.col("no") >= 10, F.col("exposure") + 1).otherwise(F.col("exposure")))
    return dated(ledger.first_divergence(was, now.select("run_id", "bar_date", "value", "exposure"), ["run_id"], "bar_date", ["value", "exposure"]), "first")


add("bundle_first_divergence", run_again, f"{CURVE}, n as (select run_id, bar_date, row_number() over (partition by run_id order by bar_date) as no, lead(bar_date) over (partition by run_id order by bar_date) as nx from c), x as (select *, case when nx is null then 'missing' when no >= 10 then 'exposure' end as what from n) select run_id, cast(min(case when what is not null then bar_date end) as varchar) as first, count(what) as rows, arg_min(what, case when what is not null then bar_date end) as what from x group by run_id")
add("bars_exact", lambda s, d: dated(B.on_day(B.counting_bars(s, d), F.lit("2020-03-16").cast("date")).select("symbol", "bar_date", "close"), "bar_date"), f"{BARS} select symbol, cast(bar_date as varchar) as bar_date, close from b where bar_date = date '2020-03-16'")
add("bars_range", lambda s, d: dated(B.between(B.counting_bars(s, d), F.lit("2020-01-01").cast("date"), F.lit("2020-06-30").cast("date")).select("symbol", "bar_date", "close"), "bar_date"), f"{BARS} select symbol, cast(bar_date as varchar) as bar_date, close from b where bar_date between date '2020-01-01' and date '2020-06-30'")


def five_later(s: SparkSession, d: str) -> DataFrame:
    b = B.counting_bars(s, d).select("symbol", "bar_date")
    return dated(B.bars_later(b.where("dayofmonth(bar_date) <= 3"), b, 5), "bar_date", "later")


add("bars_later", five_later, f"{BARS}, q as (select symbol, bar_date, lead(bar_date, 5) over (partition by symbol order by bar_date) as later from b) select symbol, cast(bar_date as varchar) as bar_date, cast(later as varchar) as later from q where day(bar_date) <= 3")


def group_calendars(s: SparkSession, d: str) -> DataFrame:
    """The calendar of each first letter's symbols: the widest of theirs, and all that there are."""
    from barloom.queries.market import calendar_of

    g = calendar_of(s, d).groupBy(F.substring("symbol", 1, 1).alias("letter")).agg(F.sort_array(F.collect_set("calendar")).alias("all"))
    return g.select("letter", days.widest(F.col("all")).alias("calendar"), F.array_join("all", ",").alias("distinct_calendars"))


from barloom.queries.market import CALENDAR  # noqa: E402

add("calendar_of_universe", group_calendars, f"{BARS}, k as (select symbol, {CALENDAR} as calendar from b group by symbol) select left(symbol, 1) as letter, case when list_contains(list(calendar), 'continuous') then 'continuous' when list_contains(list(calendar), 'fx') then 'fx' else 'session' end as calendar, array_to_string(list_sort(list(distinct calendar)), ',') as distinct_calendars from k group by left(symbol, 1)")
add("records_rollup", lambda s, d: shown(table(s, d, "day_records").where("run_id is not null").rollup(F.substring("day_stamp", 1, 4).alias("year"), F.substring("day_stamp", 6, 2).alias("month")).agg(F.count("*").alias("records"), F.sum("ret").alias("ret"), F.grouping_id().cast("long").alias("level")), 4), "select substr(day_stamp, 1, 4) as year, substr(day_stamp, 6, 2) as month, count(*) as records, round(sum(ret), 4) + 0 as ret, cast(grouping(substr(day_stamp, 1, 4), substr(day_stamp, 6, 2)) as bigint) as level from day_records where run_id is not null group by rollup(substr(day_stamp, 1, 4), substr(day_stamp, 6, 2))")
