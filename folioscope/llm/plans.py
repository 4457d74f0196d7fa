"""Queries of the operators for text corpora, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import addresses, conduct, leakage, names, packing, plaintext
from folioscope.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return plaintext.found(table(spark, d, "cells"))


def p1_plain(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct non-empty value of the cells in plain form."""
    n = plaintext.normalize(table(spark, d, "cells"), "cell_id", ["text", "company", "amount"])
    return n.select(F.col("record_id").alias("cell_id"), "field_name", "plain")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "parties"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: the class of its exact name and how many classes are linked to it."""
    return names.classes_with_links(table(spark, d, "parties"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.found(table(spark, d, "parties"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with an address: its class and how many classes are linked to it."""
    return names.per_record(*addresses.link_places(table(spark, d, "parties")))


def p5_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """The rewrites that were mined from the addresses."""
    _, rules = addresses.normalise(table(spark, d, "parties"))
    return spark.createDataFrame(rules, "written string, meant string")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per window kind: bins, the fewest there could be, tokens placed, share of the space used."""
    return packing.fill(p6_windows(spark, d), table(spark, d, "context_windows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items, each with the number of documents that hold it."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return conduct.found(table(spark, d, "documents"), table(spark, d, "review_examples"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return conduct.score_documents(table(spark, d, "documents"), table(spark, d, "review_examples"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return conduct.rates(table(spark, d, "documents"), table(spark, d, "review_examples"))


QUERIES = {
    "p1_found": p1_found, "p1_plain": p1_plain, "p2_found": p2_found, "p2_classes": p2_classes, "p5_found": p5_found, "p5_classes": p5_classes, "p5_rewrites": p5_rewrites, "p6_windows": p6_windows, "p6_fill": p6_fill, "p7_found": p7_found, "p7_items": p7_items,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
}
ORACLE: dict[str, str] = {}
