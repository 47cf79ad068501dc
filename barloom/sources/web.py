"""Tables from what web sources deliver: filed facts, ticker directories, dated articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FACTS = "cik string, facts map<string, map<string, struct<units: map<string, array<struct<end: string, val: double, filed: string, form: string>>>>>>"


def share_facts(documents: DataFrame, tags: list[str], unit: str = "shares") -> DataFrame:
    """Share counts from filed facts (a JSON document per row in ``body``): cik, from_day (when filed), shares.

    The first of ``tags`` that a company has counts. Of several facts filed on one day the one for the latest period counts; broken
    documents give nothing. A document is parsed where it lies; nothing is shuffled but the facts of the tags.
    """
    d = documents.select(F.from_json("body", FACTS).alias("d")).where("d.cik is not null")
    rows = d.select(F.lpad("d.cik", 10, "0").alias("cik"), F.explode("d.facts").alias("taxonomy", "by_tag")).select("cik", F.explode("by_tag").alias("tag", "fact"))
    place = F.coalesce(*(F.when(F.col("tag") == t, i) for i, t in enumerate(tags)))
    values = rows.withColumn("place", place).where("place is not null").select("cik", "place", F.inline(F.try_element_at("fact.units", F.lit(unit))))
    values = values.select("cik", "place", F.col("val").alias("shares"), F.try_to_date("end", "yyyy-MM-dd").alias("end"), F.try_to_date("filed", "yyyy-MM-dd").alias("from_day")).where("shares > 0 and from_day is not null")
    first = values.groupBy("cik").agg(F.min("place").alias("first"))
    return values.join(first, "cik").where("place = first").groupBy("cik", "from_day").agg(F.max_by("shares", F.struct("end", "shares")).alias("shares"))


def directory(documents: DataFrame) -> DataFrame:
    """ticker, cik, title of a directory document: {"0": {"cik_str": 1, "ticker": "A", "title": "…"}, …}."""
    entry = "map<string, struct<cik_str: long, ticker: string, title: string>>"
    rows = documents.select(F.explode(F.from_json("body", entry)).alias("k", "e"))
    return rows.select(F.upper("e.ticker").alias("ticker"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"), F.col("e.title").alias("title"))


def ticker_in(c: Column) -> Column:
    """The first word of a text that looks like a ticker: two to five capitals and digits with a capital first, perhaps with a class."""
    return F.nullif(F.regexp_extract(c, r"(?:^|[^A-Za-z0-9.$])\$?([A-Z][A-Z0-9]{1,4}(?:[.-][A-Z])?)(?![A-Za-z0-9])", 1), F.lit(""))


def dated_articles(wanted: DataFrame, articles: DataFrame, key: str, days: int = 7, limit: int = 5) -> DataFrame:
    """For each wanted (key, day): the latest articles published in the ``days`` days up to the day, titles once without regard to case.

    ``articles``: key, day, title, id. An article is laid on the few days it can be seen from, so this is an equi-join; nothing published
    later than the day is ever seen. The copies of one title are reduced before they are ranked.
    """
    seen = articles.where(f"{key} is not null and day is not null and title is not null").select(key, F.col("day").alias("published"), "title", "id", F.explode(F.sequence("day", F.date_add("day", days))).alias("day"))
    hits = wanted.select(key, "day").distinct().join(seen, [key, "day"])
    once = hits.groupBy(key, "day", F.lower("title").alias("_t")).agg(F.max(F.struct("published", "id", "title")).alias("a"))
    ranked = once.withColumn("place", F.row_number().over(W.partitionBy(key, "day").orderBy(F.desc("a.published"), F.desc("a.id"))))
    return ranked.where(F.col("place") <= limit).select(key, "day", F.col("place").cast("long").alias("place"), "a.published", "a.id", "a.title")


CHART = "chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"


def chart_bars(documents: DataFrame) -> DataFrame:
    """Daily bars of chart documents (a JSON document per row in ``body``): symbol, bar_date, open, high, low, close, adj_close, volume.

    Points with a null or non-positive close are skipped; missing fields take the close, a missing volume is 0. Broken documents give nothing.
    """
    r = documents.select(F.explode(F.from_json("body", CHART)["chart"]["result"]).alias("r"))
    q, adj = F.col("r.indicators.quote")[0], F.col("r.indicators.adjclose")[0]["adjclose"]
    none = F.transform("r.timestamp", lambda _: F.lit(None).cast("double"))
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), *(F.coalesce(q[k], none).alias(k) for k in ("open", "high", "low", "close", "volume")), F.coalesce(adj, none).alias("adj"))
    p = r.select(F.upper("r.meta.symbol").alias("symbol"), F.inline(zipped)).where("symbol is not null and t is not null and close > 0")
    own = lambda k: F.when(F.col(k) > 0, F.col(k)).otherwise(F.col("close"))
    return p.select("symbol", F.to_date(F.timestamp_seconds("t")).alias("bar_date"), *(own(k).alias(k) for k in ("open", "high", "low")), "close", own("adj").alias("adj_close"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def wiki_rows(documents: DataFrame) -> DataFrame:
    """Rows of wiki tables (a page per row in ``body``): page, no, cells. Rows begin with |-, cells with | or || (! in heads); references are taken out."""
    plain = F.regexp_replace(F.regexp_replace("body", r"(?s)<ref[^>/]*>.*?</ref>|<ref[^>]*/>|<!--.*?-->", ""), r"\r", "")
    tables = F.regexp_extract_all(plain, F.lit(r"(?s)\{\|(.*?)\n\|\}"), 1)
    t = documents.select("page", F.explode(tables).alias("t")).select("page", F.posexplode(F.split("t", r"\n\|-[^\n]*")).alias("no", "row"))
    # a link's own bar isn't a cell's
    row = F.regexp_replace("row", r"\[\[([^\]|]*)\|([^\]]*)\]\]", "$2")
    cells = F.transform(F.split(row, r"\n[|!](?!\})|\|\|"), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\[\[|\]\]|\{\{|\}\}", ""), r"^[^|]*\|", "")))
    return t.select("page", "no", F.filter(cells, lambda c: c != "").alias("cells")).where("size(cells) > 0")


def wiki_ticker(c: Column) -> Column:
    """The ticker of a cell: its last part that looks like one, dots as dashes."""
    return F.nullif(F.replace(F.regexp_extract(F.trim(c), r"(?:^|[|:\s])([A-Z][A-Z0-9]{0,4}(?:[.-][A-Z])?)$", 1), F.lit("."), F.lit("-")), F.lit(""))


def wiki_day(c: Column) -> Column:
    """A day of a cell: ISO, or June 1, 2020, or 1 June 2020."""
    text = F.trim(F.regexp_replace(c, r"\{\{[^|]*\|?|\}\}", ""))
    return F.coalesce(*(F.try_to_date(text, f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy")))


def wiki_changes(rows: DataFrame, day: int = 1, added: int = 2, removed: int = 4) -> DataFrame:
    """A log of changes from the rows of a table: day, added, removed (tickers by the places of their cells); rows without a day are heads."""
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    return rows.select("page", wiki_day(cell(day)).alias("day"), wiki_ticker(cell(added)).alias("added"), wiki_ticker(cell(removed)).alias("removed")).where("day is not null and (added is not null or removed is not null)")
