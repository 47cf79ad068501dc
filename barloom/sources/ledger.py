"""Append-only records: a ledger of trials, a hash-chained log, bundles of results."""

from __future__ import annotations

import hashlib
import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTRY = "dataset string, at string, strategy string, trials long, objective string, score double"


def record(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema: str = ENTRY) -> DataFrame:
    """Torn lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def summary(entries: DataFrame) -> DataFrame:
    """Per dataset: entries, all trials, first and last time, strategies, the latest objective and the best score."""
    return entries.groupBy("dataset").agg(
        F.count("*").alias("entries"), F.sum("trials").alias("trials"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_distinct("strategy").alias("strategies"),
        F.max_by("objective", F.struct("at", "objective")).alias("objective"), F.max("score").alias("best"), (F.sum(F.col("score") * F.col("trials")) / F.nullif(F.sum(F.when(F.col("score").isNotNull(), F.col("trials"))), F.lit(0))).alias("weighted_score"),
    )


def datasets(entries: DataFrame) -> DataFrame:
    """Datasets with how many trials they have seen, the most first."""
    g = entries.groupBy("dataset").agg(F.sum("trials").alias("trials"), F.max("at").alias("last_at"))
    return g.orderBy(F.desc("trials"), "dataset")


def spread(entries: DataFrame) -> DataFrame:
    """Per dataset the deviation of scores, each weighted by its trials; of datasets with one entry none."""
    w = F.when(F.col("score").isNotNull(), F.col("trials"))
    g = entries.groupBy("dataset").agg(F.sum(w).alias("_n"), F.sum(w * F.col("score")).alias("_s"), F.sum(w * F.col("score") * F.col("score")).alias("_q"), F.count("score").alias("_k"))
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.nullif(F.col("_n"), F.lit(0))) / F.nullif(F.col("_n") - 1, F.lit(0))
    return g.select("dataset", F.when(F.col("_k") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("spread"))


def warned(entries: DataFrame, now: DataFrame, least: int = 5, times: float = 2.0) -> DataFrame:
    """Searches (dataset, trials) on data that other searches have used up before: at least ``least`` entries and ``times`` as many trials as now."""
    before = entries.groupBy("dataset").agg(F.count("*").alias("entries"), F.sum("trials").alias("before"))
    return now.join(before, "dataset", "left").withColumn("warned", F.coalesce((F.col("entries") >= least) & (F.col("before") >= times * F.col("trials")), F.lit(False)))


def reset(entries: DataFrame, dataset: str) -> DataFrame:
    """The ledger without one dataset; it is to be written to a new place and then put in the old one's."""
    return entries.where(~F.col("dataset").eqNullSafe(F.lit(dataset)))


def kept_runs(runs: DataFrame, n: int, at: str = "at") -> DataFrame:
    """The latest n stored runs; older ones are given up. The n are few (a list to choose from), so this is a limit by its nature."""
    return runs.orderBy(F.desc(at), "run_id").limit(n)


def first_divergence(was: DataFrame, now: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Compare a run again with what was stored of it: per key the first ``order`` at which a value differs or a row is missing (null: the same), how many rows
    differ, and what differs first. Values are compared exactly."""
    j = was.withColumn("_w", F.lit(True)).withColumnsRenamed({v: f"_w_{v}" for v in values}).join(now.withColumn("_n", F.lit(True)).withColumnsRenamed({v: f"_n_{v}" for v in values}), [*keys, order], "full")
    what = F.when(F.col("_n").isNull(), "missing").when(F.col("_w").isNull(), "new")
    for v in values:
        what = what.when(~F.col(f"_w_{v}").eqNullSafe(F.col(f"_n_{v}")), v)
    j = j.withColumn("_what", what)
    return j.groupBy(*keys).agg(F.min(F.when(F.col("_what").isNotNull(), F.col(order))).alias("first"), F.count("_what").alias("rows"), F.min_by("_what", F.when(F.col("_what").isNotNull(), F.col(order))).alias("what"))


def sealed(entries: DataFrame, chain: str, order: str, content: list[str]) -> DataFrame:
    """Adds body (JSON of ``content``), prev and hash: each entry's hash covers its body and the hash before it.

    A chain is sequential by nature: one task seals one chain, holding bodies' digests only.
    """
    body = entries.select(chain, order, *[c for c in content if c not in (chain, order)]).withColumn("body", F.to_json(F.struct(*content)))

    def seal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "body"], kind="stable")
        prev, out = "", []
        for b in pdf["body"]:
            h = hashlib.sha256(f"{prev}\n{b}".encode()).hexdigest()
            out.append((prev, h))
            prev = h
        return pdf.assign(prev=[p for p, _ in out], hash=[h for _, h in out])[[chain, order, "body", "prev", "hash"]]

    kind = dict(entries.dtypes)
    return body.select(chain, order, "body").groupBy(chain).applyInPandas(seal, f"{chain} {kind[chain]}, {order} {kind[order]}, body string, prev string, hash string")


def verified(log: DataFrame, chain: str, order: str) -> DataFrame:
    """Per chain: entries, and the first order at which a hash or a link is wrong (null: intact). Fully parallel."""
    w = W.partitionBy(chain).orderBy(order, "body")
    right = (F.sha2(F.concat("prev", F.lit("\n"), "body"), 256) == F.col("hash")) & (F.col("prev") == F.coalesce(F.lag("hash").over(w), F.lit("")))
    return log.withColumn("_ok", right).groupBy(chain).agg(F.count("*").alias("entries"), F.min(F.when(~F.col("_ok"), F.col(order))).alias("broken_at"))


def write_bundle(path: str, tables: dict[str, DataFrame], manifest: dict) -> str:
    """Tables as Parquet with a manifest that holds row counts and an order-independent digest of each; returns the manifest's hash."""
    entry = dict(manifest)
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        entry[name] = digest(df)
    text = json.dumps(entry, sort_keys=True, default=str)
    df0 = next(iter(tables.values()))
    df0.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return hashlib.sha256(text.encode()).hexdigest()


def digest(df: DataFrame) -> dict:
    cols = sorted(df.columns)
    row = df.select(F.xxhash64(*(F.col(c) for c in cols)).alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor")).first()
    return {"rows": row["rows"], "xor": row["xor"]}


def open_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle, after checking names, counts and digests."""
    entry = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    out = {}
    for name, want in entry.items():
        if not isinstance(want, dict) or "xor" not in want:
            continue
        if os.sep in name or name.startswith("."):
            raise ValueError(f"unsafe name: {name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
        if digest(out[name]) != want:
            raise ValueError(f"{name} isn't what the manifest says")
    return out
