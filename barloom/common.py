"""Helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(c: Column) -> Column:
    """The text without surrounding white space (also tabs and line ends)."""
    return F.btrim(c, F.lit(" \t\n\r"))


def symbol_of(c: Column | str) -> Column:
    """Symbols are compared trimmed and in upper case; a blank one is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def leading_day(text: Column) -> Column:
    dashes = (text.substr(5, 1) == "-") & (text.substr(8, 1) == "-")
    return F.when(dashes & (F.length(text) >= 10) & text.substr(11, 1).isin("", "T", " "), text.substr(1, 10).try_cast("date"))


def day_of(c: Column | str) -> Column:
    """Date of a day or stamp string (its first ten characters); null where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return leading_day(trimmed(c.cast("string")))


def epoch_of(c: Column | str) -> Column:
    """Seconds since 1970 UTC of a day or stamp string, whatever the session's time zone.

    ``YYYY-MM-DD``, ``YYYY-MM-DD[T ]HH:MM[:SS]`` with ``Z``, an offset ``+HH:MM`` or nothing (UTC); anything else is null.
    The notations are made one by places, and that is cast: regular expressions took nine tenths of a scan's time, and a
    longer expression outgrows generated code.
    """
    c = F.col(c) if isinstance(c, str) else c
    text = trimmed(c.cast("string"))
    seconds = F.when(text.substr(17, 1) == ":", "").otherwise(":00")
    zone = F.when(text.endswith("Z") | text.substr(-6, 1).isin("+", "-"), "").otherwise("Z")
    whole = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text.substr(1, 16), seconds, F.substring(text, 17, 40), zone))
    return F.unix_seconds(whole.try_cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (a local master, as in tests) a temporary folder is taken; on a
    cluster without it this raises, as executors would write to disks that nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "barloom-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in :func:`shared_folder` (runs a job)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
