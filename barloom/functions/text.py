"""String, hash and JSON functions as Column expressions."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" "))


def numberless(c: Column) -> Column:
    """Every number, decimal point included, as N."""
    return F.regexp_replace(c, r"\d+(?:\.\d+)*", "N")


def without_tags(c: Column) -> Column:
    """Tags to spaces, entities resolved, white space collapsed."""

    @F.pandas_udf("string")
    def resolve(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return tidy(resolve(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))


def host(c: Column) -> Column:
    """Host of an address, port included, without a leading www."""
    return F.regexp_replace(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/?#]*)", 1), r"^www\.", "")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))


def safe_name(c: Column) -> Column:
    """A symbol as a file name."""
    return F.regexp_replace(F.upper(c), r"[^A-Z0-9._-]", "_")


def dataset_key(symbols: Column, first: Column, last: Column, interval: Column) -> Column:
    """SYMBOLS:from:to:interval, symbols sorted and once each, * for an open end."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(symbols, lambda s: F.upper(F.trim(s))))), ",")
    bound = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("*"))
    return F.concat_ws(":", names, bound(first), bound(last), interval)


def params_label(params: Column) -> Column:
    """k=v k=v of a map, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def fingerprint(c: Column) -> Column:
    """SHA-256 in hex; '' of ''."""
    return F.when(c == "", "").otherwise(F.sha2(c, 256))


def json_in(c: Column) -> Column:
    """The outermost JSON object or array inside prose or a fence; null if there is none that is closed."""

    def find(text: str) -> str | None:
        for start, ch in enumerate(text):
            if ch in "{[":
                try:
                    _, end = json.JSONDecoder().raw_decode(text[start:])
                    return text[start : start + end]
                except (ValueError, RecursionError):
                    continue
        return None

    @F.pandas_udf("string")
    def extract(s: pd.Series) -> pd.Series:
        return s.map(find, na_action="ignore")

    return extract(c)


def without_fence(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^\s*```[\w+-]*\n(.*?)\n?```\s*$", "$1")


def flexible_day(c: Column) -> Column:
    """A date in one of several notations: seconds since 1970, Y-m-d, Y/m/d, m/d/Y before d/m/Y, Ymd; a time of day is cut off."""
    text = F.regexp_replace(F.trim(c), r"[T ].*$", "")
    number = text.try_cast("bigint")
    tried = [F.try_to_date(text, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy")]
    return F.when(text.rlike(r"^\d{9,11}$"), F.date_from_unix_date((number / 86400).cast("int"))).when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")).otherwise(F.coalesce(*tried))


def fnv32(c: Column) -> Column:
    """FNV-1a hash of 32 bits of a text's UTF-8 bytes. The basis and the prime are the published ones."""
    pairs = F.hex(F.encode(c, "UTF-8"))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(pairs) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(pairs, i, F.lit(2)), 16, 10).cast("bigint"))
    step = lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619).cast("bigint"), F.lit(2**32).cast("bigint"))
    return F.when(c.isNull(), None).when(F.length(c) == 0, F.lit(2166136261).cast("bigint")).otherwise(F.aggregate(at, F.lit(2166136261).cast("bigint"), step))


def cache_key(parts: list[Column]) -> Column:
    """Hash of several texts: each with its length before it, so that no two lists of parts are written alike."""
    joined = F.concat(*(F.concat(F.octet_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts))
    return F.sha2(joined, 256)


def rates_fingerprint(symbol: str = "symbol", rate: str = "annual_pct", available: str = "available") -> Column:
    """One hash of a schedule of borrow rates, whatever its order: an aggregate."""
    line = F.concat_ws("=", F.col(symbol), F.when(F.col(available), F.col(rate).cast("string")).otherwise("none"))
    return F.sha2(F.array_join(F.sort_array(F.collect_set(line)), ";"), 256)


def vendor_symbol(c: Column) -> Column:
    """A symbol as a vendor of plain files names it: an index by its own name, pairs without the dash, shares with .us; lower case."""
    s = F.lower(F.trim(c))
    index = F.when(s == "^gspc", "^spx").when(s.startswith("^"), s)
    return F.coalesce(index, F.when(s.rlike("-(usd|eur|gbp)$"), F.replace(s, F.lit("-"), F.lit(""))).when(F.contains(s, F.lit(".")), s).otherwise(F.concat(s, F.lit(".us"))))


def same_params(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Whether two maps of numbers have the same names and, within the tolerance, the same values."""
    names = F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))
    return names & F.forall(F.map_entries(a), lambda e: F.abs(e["value"] - F.element_at(b, e["key"])) <= tolerance)
