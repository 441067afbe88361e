"""Queries p6 to p8 over the pages and their helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.leaks import leaked_passages
from barloom.llm.mixing import mix_sources, scan_quality
from barloom.llm.reading import fit_levels, predict_levels
from barloom.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold a passage of a held-out item."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), weight=F.coalesce(scan_quality(F.col("line_boxes")), F.lit(0.85)))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined set: pages with the number of their copies."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixed(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band of each English page."""
    documents = table(spark, sf_dir, "documents")
    model = fit_levels(documents, table(spark, sf_dir, "reading_labels"))
    return predict_levels(documents.where(F.col("lang") == "en"), model).select("doc_id", "band")


QUERIES = {"p6_found": p6_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}
ORACLES: dict[str, str] = {}
