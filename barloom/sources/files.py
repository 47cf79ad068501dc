"""Readers and writers of bars and reference tables in text form, fallback chains and merging.

Parsing is Column code over lines, so a folder of any number of files is read in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.text import flexible_day

#: Names of columns that vendors use.
ALIASES = {
    "bar_date": ["date", "day", "time", "datetime", "timestamp", "bar_date"], "open": ["open", "o"], "high": ["high", "h"], "low": ["low", "l"], "close": ["close", "c", "last", "price"],
    "adj_close": ["adjclose", "adj_close", "adjustedclose", "adjusted", "adj"], "volume": ["volume", "vol", "v"],
}


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all files of a folder: file, at (order inside the file), line."""
    raw = spark.read.text(folder, wholetext=False).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return raw.where(F.trim("line") != "")


def parsed_bars(lines: DataFrame) -> DataFrame:
    """Bars of comma-separated files with a header: file, at, bar_date, open, high, low, close, adj_close, volume.

    Columns may come in any order under any of ALIASES. Rows without a readable date or with a close of 0 or less are dropped; missing or
    non-positive open, high, low and adj_close take the close; a bad volume is 0.
    """
    cells = F.transform(F.split("line", ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    rows = lines.where("line is not null").select("file", "at", cells.alias("cells"))
    # the first line of a file is its header
    heads = rows.groupBy("file").agg(F.min_by("cells", "at").alias("head"), F.min("at").alias("first"))
    names = F.transform("head", lambda x: F.regexp_replace(F.lower(x), r"[^a-z]", ""))
    place = lambda k: F.coalesce(*(F.nullif(F.array_position(names, re.sub(r"[^a-z]", "", a)), F.lit(0).cast("bigint")) for a in ALIASES[k]))
    heads = heads.select("file", "first", *(place(k).cast("int").alias(f"_{k}") for k in ALIASES))
    at = lambda k: F.when(F.col(f"_{k}").isNotNull(), F.try_element_at("cells", F.col(f"_{k}")))
    joined = rows.join(heads, "file").where("at > first")
    number = lambda k: at(k).try_cast("double")
    p = joined.select("file", "at", flexible_day(at("bar_date")).alias("bar_date"), *(number(k).alias(k) for k in ("open", "high", "low", "close", "adj_close", "volume"))).where("bar_date is not null and close > 0")
    kept = lambda k: F.when(F.col(k) > 0, F.col(k)).otherwise(F.col("close"))
    return p.withColumns({k: kept(k) for k in ("open", "high", "low", "adj_close")}).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


STRICT = "date,open,high,low,close,adj_close,volume"


def strict_bars(lines: DataFrame) -> DataFrame:
    """Bars of files that this library wrote: the header must be STRICT and every cell a finite number, else the read fails and names the file."""
    heads = lines.groupBy("file").agg(F.min_by("line", "at").alias("_head"), F.min("at").alias("_first"))
    rows = lines.join(heads, "file").where("at > _first")
    bad = lambda text: F.raise_error(F.concat(F.lit(text), F.col("file")))
    rows = rows.withColumn("_c", F.when(F.col("_head") == STRICT, F.split("line", ",")).otherwise(bad("another header in ").cast("array<string>")))
    number = lambda i: F.try_element_at("_c", F.lit(i)).try_cast("double")
    finite = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(bad("a value that is no number in ").cast("double"))
    day = F.try_to_date(F.col("_c")[0], "yyyy-MM-dd")
    return rows.select("file", F.coalesce(day, bad("a day that is none in ").cast("date")).alias("bar_date"), *(finite(number(i)).alias(k) for i, k in enumerate(("open", "high", "low", "close", "adj_close", "volume"), 2)))


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of a folder of SYMBOL.csv files; of rows of one day the last in the file counts."""
    p = parsed_bars(lines_of(spark, folder)).withColumn("symbol", F.upper(F.regexp_replace(F.regexp_extract("file", r"([^/]+)\.csv$", 1), "_", "-")))
    rest = ["open", "high", "low", "close", "adj_close", "volume"]
    g = p.groupBy("symbol", "bar_date").agg(F.max_by(F.struct(*rest), "at").alias("x"))
    return g.select("symbol", "bar_date", *(F.col("x").getField(c).alias(c) for c in rest))


def write_bars(bars: DataFrame, folder: str) -> None:
    """One folder per symbol with a header; doubles in their shortest exact form."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "bar_date").write.mode("overwrite").partitionBy("symbol").option("header", True).csv(folder)


def chain(sources: list[DataFrame], by: str = "symbol") -> DataFrame:
    """Of each symbol the rows of the first source that has any; never a mixture."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("source", F.lit(i))
        every = s if every is None else every.unionByName(s)
    first = every.groupBy(by).agg(F.min("source").alias("_first"))
    return every.join(first, by).where("source = _first").drop("_first")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both; where both have a key the new row counts."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_n").alias("_x"))
    return g.select(*keys, *(F.col("_x").getField(c).alias(c) for c in rest))


def compressed(steps: DataFrame, key: str, at: str, value: str, threshold: float = 0.005) -> DataFrame:
    """Observations that moved over ``threshold`` from the last one kept; first and last always stay.

    Of several observations of one key and ``at`` the largest counts; null values and ``at`` are left out. Which ones stay depends on
    what was kept before, so a key is passed over in order: its rows are sorted by Spark and streamed in Arrow batches with the last kept
    one as the only state, so a key of any length needs no memory of its own.
    """
    rows = steps.where(F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(value).alias(value)).select(key, at, value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, kept, begun, waiting = None, 0.0, False, None  # waiting: a row that stays only if it is its key's last
        for batch in batches:
            out = []
            for k, a, v in batch.itertuples(index=False, name=None):
                if not begun or k != name and not (pd.isna(k) and pd.isna(name)):
                    if waiting is not None:
                        out.append(waiting)
                    name, kept, begun, waiting = k, v, True, None
                    out.append((k, a, v))
                elif kept == 0 or abs(v / kept - 1) > threshold:
                    kept, waiting = v, None
                    out.append((k, a, v))
                else:
                    waiting = (k, a, v)
            yield pd.DataFrame(out, columns=[key, at, value])
        if waiting is not None:
            yield pd.DataFrame([waiting], columns=[key, at, value])

    return rows.repartition(key).sortWithinPartitions(key, at).mapInPandas(run, rows.schema)


def economic(lines: DataFrame) -> DataFrame:
    """Series of (date, value) lines: '.', blanks and headers are skipped."""
    cells = F.split("line", ",")
    return lines.select("file", F.try_to_date(F.trim(F.try_element_at(cells, F.lit(1))), "yyyy-MM-dd").alias("day"), F.trim(F.try_element_at(cells, F.lit(2))).try_cast("double").alias("value")).dropna(subset=["day", "value"])


def with_lags(series: DataFrame, lags: DataFrame | None = None, usual: int = 30) -> DataFrame:
    """Economic series (series, day, value) with the days that each is published late and whether it is revised later. ``lags``: series, lag_days, revised (a
    short table); series it doesn't name come ``usual`` days late and count as revised."""
    named = series.withColumn("series", F.upper(F.trim("series")))
    if lags is None:
        return named.withColumns({"lag_days": F.lit(usual), "revised": F.lit(True)})
    known = lags.select(F.upper(F.trim("series")).alias("series"), F.col("lag_days").cast("int").alias("_lag"), F.col("revised").alias("_revised")).dropDuplicates(["series"])
    return named.join(known, "series", "left").withColumns({"lag_days": F.coalesce("_lag", F.lit(usual)), "revised": F.coalesce("_revised", F.lit(True))}).drop("_lag", "_revised")


def share_lines(lines: DataFrame) -> DataFrame:
    """Share counts of lines symbol,from_day,shares: headers, comments (#) and rows without a day or with counts of 0 or less are skipped; of rows of one symbol and day the largest counts."""
    c = [F.trim(F.try_element_at(F.split("line", ","), F.lit(i))) for i in (1, 2, 3)]
    rows = lines.where("not startswith(ltrim(line), '#')").select(F.upper(c[0]).alias("symbol"), F.try_to_date(c[1], "yyyy-MM-dd").alias("from_day"), c[2].try_cast("double").alias("shares"))
    return rows.where("symbol != '' and from_day is not null and shares > 0").groupBy("symbol", "from_day").agg(F.max("shares").alias("shares"))


def tenure_lines(lines: DataFrame) -> DataFrame:
    """Membership of lines index,symbol,from,to: a blank from is the unknown beginning, a blank to is still a member; headers, comments and rows that end before they begin are skipped."""
    c = [F.trim(F.coalesce(F.try_element_at(F.split("line", ","), F.lit(i)), F.lit(""))) for i in (1, 2, 3, 4)]
    day = lambda x: F.try_to_date(x, "yyyy-MM-dd")
    rows = lines.where("not startswith(ltrim(line), '#')").select(F.lower(c[0]).alias("index_name"), F.upper(c[1]).alias("symbol"), day(c[2]).alias("from_day"), day(c[3]).alias("to_day"), (c[2] != "").alias("_f"), (c[3] != "").alias("_t"))
    ok = (F.col("from_day").isNotNull() | ~F.col("_f")) & (F.col("to_day").isNotNull() | ~F.col("_t")) & (F.col("to_day").isNull() | F.col("from_day").isNull() | (F.col("to_day") >= F.col("from_day")))
    return rows.where(ok & (F.col("index_name") != "") & (F.col("symbol") != "")).drop("_f", "_t").distinct()


def table_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as comma-separated lines: nulls are empty, doubles in their shortest exact form, texts with commas, quotes or line ends in quotes."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text) if kinds[c] == "string" else text

    return df.select(F.concat_ws(",", *map(cell, columns)).alias("line"))


def write_lines(df: DataFrame, columns: list[str], folder: str) -> None:
    """A folder of comma-separated files with a header each: sweep tables, folds, validation splits, share counts, tenures."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(folder)


# -- stores ---------------------------------------------------------------------------------------------------------------------


def covered(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Which requests a store can answer: asked rows with ``hit``.

    ``asked``: symbol, from_day, to_day; ``held``: symbol, requested_from (what was asked of the source before, so that a young symbol isn't fetched
    again and again), last_day. A request is a hit where what was asked for reaches back as far and the bars reach its end.
    """
    h = held.groupBy("symbol").agg(F.min("requested_from").alias("_from"), F.max("last_day").alias("_last"))
    j = asked.join(h, "symbol", "left")
    return j.withColumn("hit", F.coalesce((F.col("_from") <= F.col("from_day")) & (F.col("_last") >= F.col("to_day")), F.lit(False))).drop("_from", "_last")


def through_store(asked: DataFrame, store: DataFrame, held: DataFrame, source: DataFrame) -> DataFrame:
    """Bars of the requests: from the store where it covers them, else from the source. Nothing is fetched for symbols that are covered."""
    wanted = covered(asked, held)
    pick = lambda bars, hit: bars.join(wanted.where(F.col("hit") == F.lit(hit)).select("symbol", "from_day", "to_day"), "symbol").where("bar_date >= from_day and bar_date <= to_day").drop("from_day", "to_day")
    return pick(store, True).withColumn("stored", F.lit(True)).unionByName(pick(source, False).withColumn("stored", F.lit(False)))


def scanned(asked: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per asked symbol, also of those that can't be had: bars, first and last day, error (``no data`` or ``no bars in range``)."""
    every = bars.groupBy("symbol").agg(F.count("*").alias("_all"))
    inside = asked.join(bars, "symbol").where("bar_date >= from_day and bar_date <= to_day").groupBy("symbol").agg(F.count("*").alias("bars"), F.min("bar_date").alias("first_day"), F.max("bar_date").alias("last_day"))
    j = asked.select("symbol").distinct().join(every, "symbol", "left").join(inside, "symbol", "left")
    return j.select("symbol", F.coalesce("bars", F.lit(0)).alias("bars"), "first_day", "last_day", F.when(F.col("_all").isNull(), "no data").when(F.col("bars").isNull(), "no bars in range").alias("error"))


class Chain:
    """Sources in order, each with the bar sizes it offers: a symbol's bars come from the first that offers the size and has any; others are passed by, not failures."""

    def __init__(self, sources: dict[str, dict[str, DataFrame]]) -> None:
        self.sources = sources

    def sizes(self) -> list[str]:
        """All sizes that any source offers."""
        return sorted({size for s in self.sources.values() for size in s})

    def supports(self, name: str, size: str) -> bool:
        return size in self.sources[name]

    def bars(self, size: str = "1d") -> DataFrame:
        able = [s[size] for s in self.sources.values() if size in s]
        if not able:
            raise ValueError(f"no source has bars of {size}; there are {', '.join(self.sizes())}")
        return chain(able)


def first_found(answers: list[DataFrame]) -> DataFrame:
    """Of several sources' answers to one search the first that isn't empty (a job for each that is looked at)."""
    for a in answers[:-1]:
        if not a.isEmpty():
            return a
    return answers[-1]


def found_symbols(names: DataFrame, text: str, most: int = 20) -> DataFrame:
    """Symbols whose symbol or name holds the text, exact and leading matches first: a list for a search box, so ``most`` rows."""
    t = F.lit(text.strip().upper())
    hit = names.where(F.contains(F.upper("symbol"), t) | F.contains(F.upper(F.coalesce("name", F.lit(""))), t))
    return hit.orderBy(F.upper("symbol") != t, ~F.startswith(F.upper("symbol"), t), "symbol").limit(most)


def overlay(bars: DataFrame, symbols: list[str], most: int = 20) -> DataFrame:
    """Closes of several symbols on the union of their days, each carried forward and indexed to 100 at its first: a chart of at most ``most`` symbols."""
    names = list(dict.fromkeys(s.strip().upper() for s in symbols))
    if len(names) > most:
        raise ValueError(f"{len(names)} symbols; the limit is {most}")
    own = bars.where(F.col("symbol").isin(names)).select("symbol", "bar_date", "close")
    days = own.select("bar_date").distinct().select("bar_date", F.explode(F.array(*map(F.lit, names))).alias("symbol"))
    w = W.partitionBy("symbol").orderBy("bar_date")
    filled = days.join(own, ["symbol", "bar_date"], "left").withColumns({"close": F.last("close", ignorenulls=True).over(w), "_first": F.first("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    return filled.where("close is not null").select("symbol", "bar_date", "close", (100 * F.col("close") / F.when(F.col("_first") != 0, F.col("_first"))).alias("indexed"))


def borrow_rates(lines: DataFrame) -> DataFrame:
    """symbol, annual_pct, available of (symbol, rate, available) lines; rates in per cent; * is the general rate."""
    cells = F.split("line", ",")
    cell = lambda i: F.trim(F.coalesce(F.try_element_at(cells, F.lit(i)), F.lit("")))
    rate = F.regexp_replace(cell(2), "%$", "").try_cast("double")
    no = F.lower(cell(3)).isin("no", "n", "false", "0", "unavailable") | F.lower(cell(2)).isin("n/a", "na", "none", "")
    out = lines.select(F.when(F.lower(cell(1)).isin("*", "default"), "*").otherwise(F.upper(cell(1))).alias("symbol"), F.when(~no, rate).alias("annual_pct"), (~no).alias("available"))
    bad = F.col("available") & (F.col("annual_pct").isNull() | (F.col("annual_pct") < 0))
    return out.where("symbol not in ('', 'SYMBOL')").withColumn("annual_pct", F.when(bad, F.raise_error(F.concat(F.lit("bad rate for "), "symbol")).cast("double")).otherwise(F.col("annual_pct")))


def synthetic(spark: SparkSession, symbols: list[str], first: str, last: str, seed: int = 1) -> DataFrame:
    """Seeded random walks with a slow cycle on weekdays: the same for a symbol whatever else is asked for."""
    import zlib

    import numpy as np

    names = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    grid = names.withColumn("bar_date", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))).where("dayofweek(bar_date) not in (1, 7)")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_date")
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{pdf['symbol'].iloc[0]}".encode()))
        n = len(pdf)
        close = np.round(rng.uniform(20, 200) * np.exp(np.cumsum(0.0002 + 0.012 * rng.standard_normal(n)) + 0.05 * np.sin(np.arange(n) / 40)), 2)
        opened = np.round(np.r_[close[0], close[:-1]] * (1 + 0.003 * rng.standard_normal(n)), 2)
        high, low = np.round(np.maximum(opened, close) * (1 + np.abs(0.004 * rng.standard_normal(n))), 2), np.round(np.minimum(opened, close) * (1 - np.abs(0.004 * rng.standard_normal(n))), 2)
        return pdf.assign(open=opened, high=high, low=low, close=close, adj_close=close, volume=np.round(1e6 * np.exp(0.3 * rng.standard_normal(n))))

    return grid.groupBy("symbol").applyInPandas(walk, "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume double")


def intraday_of(bars: DataFrame, per_day: int) -> DataFrame:
    """Each daily bar as ``per_day`` bars on a straight line from open to close, the high a third in, the low two thirds in."""
    k = F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("slot")
    line = lambda c: F.col("open") + (F.col("close") - F.col("open")) * c / per_day
    b = bars.select("*", k)
    a, z = line(F.col("slot")), line(F.col("slot") + 1)
    high = F.when(F.col("slot") == per_day // 3, F.col("high")).otherwise(F.greatest(a, z))
    low = F.when(F.col("slot") == 2 * per_day // 3, F.col("low")).otherwise(F.least(a, z))
    return b.select("symbol", "bar_date", "slot", a.alias("open"), high.alias("high"), low.alias("low"), z.alias("close"), (F.col("volume") / per_day).alias("volume"))


def latest_window(df: DataFrame, by: str, at: str, n: int) -> DataFrame:
    """The n latest rows of each key (a chart's tail)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(at)))).where(f"_n <= {n}").drop("_n")


def thinned(points: DataFrame, by: str, at: str, value: str, columns: int) -> DataFrame:
    """A curve for a chart of so many columns: the lowest and highest point of each."""
    spans = points.groupBy(by).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    j = points.join(spans, by)
    column = F.least(F.lit(columns - 1), F.floor(F.datediff(at, "_a") * columns / F.greatest(F.datediff("_z", "_a"), F.lit(1))))
    g = j.groupBy(by, column.alias("column")).agg(F.min(F.struct(F.col(value).alias("v"), F.col(at).alias("a"))).alias("lo"), F.max(F.struct(F.col(value).alias("v"), F.col(at).alias("a"))).alias("hi"))
    return g.select(by, "column", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("p")).select(by, "column", F.col("p.a").alias(at), F.col("p.v").alias(value))
