"""Queries of the general data-quality operators: quantities in common units, differences between copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import copies, units
from folioscope.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.units_found(table(spark, d, "measures"), table(spark, d, "source_units"))


def p3_origins(spark: SparkSession, d: str) -> DataFrame:
    """How many measures were converted on which ground, and how many wait for review, by kind."""
    c = units.convert(table(spark, d, "measures"), table(spark, d, "source_units"))
    return c.groupBy("quantity_kind", "origin").agg(F.count("*").alias("n"))


def p3_review(spark: SparkSession, d: str) -> DataFrame:
    return units.review(table(spark, d, "measures"), table(spark, d, "source_units"))


def p3_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy and calibration of the classifier, by kind."""
    return units.held_out_accuracy(table(spark, d, "measures"), table(spark, d, "source_units"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies_found(table(spark, d, "cells"), table(spark, d, "cells_b"), table(spark, d, "sections"))


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("record_kind", "difference").agg(F.count("*").alias("n"))


QUERIES = {"p3_found": p3_found, "p3_origins": p3_origins, "p3_review": p3_review, "p3_accuracy": p3_accuracy, "p4_found": p4_found, "p4_summary": p4_summary}

_NEWEST = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY loaded_at DESC) AS rn FROM {t}"


def _diff_sql(kind: str, key: str, a: str, b: str, fields: list[str]) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{kind}' AS record_kind, a.{key} AS record_id, '{f}' AS difference FROM ({a}) a JOIN ({b}) b ON a.{key} = b.{key} AND a.rn = 1 AND b.rn = 1 WHERE a.{f} IS DISTINCT FROM b.{f}"
        for f in fields
    )
    sides = " UNION ALL ".join(
        f"SELECT DISTINCT '{kind}', x.{key}, '{name}' FROM ({x}) x WHERE NOT EXISTS (SELECT 1 FROM ({y}) y WHERE y.{key} = x.{key})" for name, x, y in (("only_a", a, b), ("only_b", b, a))
    )
    return f"{pairs} UNION ALL {sides}"


_P4 = " UNION ALL ".join([
    _diff_sql("cell", "cell_id", _NEWEST.format(k="cell_id", t="cells"), _NEWEST.format(k="cell_id", t="cells_b"), ["text", "row_idx", "col_idx"]),
    _diff_sql("section", "section_id", *(_NEWEST.format(k="section_id", t="sections") + f" WHERE system_name = '{s}'" for s in "ab"), ["title"]),
])

ORACLE = {"p4_found": _P4, "p4_summary": f"SELECT record_kind, difference, count(*) AS n FROM ({_P4}) GROUP BY record_kind, difference"}
