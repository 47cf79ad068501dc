"""Queries of the text problems (p4, p8, p9, p10) with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.common import table
from barloom.llm.leakage import leaks
from barloom.llm.packing import packed
from barloom.llm.pairs import broken_pairs
from barloom.llm.residue import residue, without_residue


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return broken_pairs(table(spark, sf, "ai_calls"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"), table(spark, sf, "capacities"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "documents")).select("doc_id")


def p10_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus without residue."""
    return without_residue(table(spark, sf, "documents")).select("doc_id", "text")


QUERIES = {f.__name__: f for f in (p4_found, p8_containers, p9_found, p10_found, p10_clean)}
SQL: dict[str, str] = {}
