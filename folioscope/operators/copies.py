"""Differences between two copies of a dataset, field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def compare_copies(a: DataFrame, b: DataFrame, key: str, fields: list[str], newest: str | None = None) -> DataFrame:
    """Rows ``(record_id, difference)`` for every record that is not the same in both copies.

    Both sides are tagged, united and grouped once by key; the group keeps one struct per side
    (partial aggregation before the shuffle, so a record delivered very often stays small).
    ``difference`` is ``only_a``, ``only_b`` or the name of a field whose stored values differ.

    Defined results: null is a value (null equals null, differs from the empty string); a null key
    is a key like any other; repeated deliveries count once, the one with the greatest ``newest``
    (then the greatest field values) wins; an empty side makes every record of the other one-sided;
    columns besides ``key``, ``fields`` and ``newest`` are never looked at, whatever their names.
    """

    def tagged(df: DataFrame, side: int) -> DataFrame:
        order = df[newest] if newest else F.lit(None).cast("timestamp")
        record = F.struct(order.alias("o"), *(df[f].alias(f"v{i}") for i, f in enumerate(fields)))
        return df.select(df[key].alias("k"), F.lit(side).alias("side"), record.alias("r"))

    kept = tagged(a, 0).unionByName(tagged(b, 1)).groupBy("k").agg(
        F.max(F.when(F.col("side") == 0, F.col("r"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("r"))).alias("b"),
    )
    quoted = [f.replace("\\", "\\\\").replace("'", "\\'") for f in fields]
    parts = ", ".join(f"named_struct('f', '{q}', 'd', NOT (a.v{i} <=> b.v{i}))" for i, q in enumerate(quoted))
    differing = F.expr(
        "CASE WHEN b IS NULL THEN array('only_a') WHEN a IS NULL THEN array('only_b') "
        f"ELSE transform(filter(array({parts}), x -> x.d), x -> x.f) END"
    )
    return kept.select(F.col("k").alias("record_id"), F.explode(differing).alias("difference"))


def copies_found(cells: DataFrame, cells_b: DataFrame, sections: DataFrame) -> DataFrame:
    """Differences of both record kinds: ``(record_kind, record_id, difference)``."""
    of_cells = compare_copies(cells, cells_b, "cell_id", ["text", "row_idx", "col_idx"], "loaded_at")
    of_sections = compare_copies(
        sections.where("system_name = 'a'"), sections.where("system_name = 'b'"), "section_id", ["title"], "loaded_at"
    )
    return of_cells.select(F.lit("cell").alias("record_kind"), "record_id", "difference").unionByName(
        of_sections.select(F.lit("section").alias("record_kind"), "record_id", "difference")
    )
