"""Geometry of cells and structure of documents as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.operators.cells import TABLE


def overlap_ratio(a: Column, b: Column) -> Column:
    """Area of the intersection over the smaller box; 0 for boxes without an area."""
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    side = lambda lo, hi: F.greatest(F.least(at(a, hi), at(b, hi)) - F.greatest(at(a, lo), at(b, lo)), F.lit(0.0))
    area = lambda c: (at(c, 2) - at(c, 0)) * (at(c, 3) - at(c, 1))
    return F.coalesce(F.try_divide(side(0, 2) * side(1, 3), F.least(area(a), area(b))), F.lit(0.0))


def horizontal_overlap(a: Column, b: Column) -> Column:
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    shared = F.greatest(F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)), F.lit(0.0))
    return F.coalesce(F.try_divide(shared, F.least(at(a, 2) - at(a, 0), at(b, 2) - at(b, 0))), F.lit(0.0))


def union_box(box: str) -> list[Column]:
    """Aggregates that give the smallest box around a group's boxes."""
    return [f(F.get(box, F.lit(i))).alias(n) for f, i, n in ((F.min, 0, "x0"), (F.min, 1, "y0"), (F.max, 2, "x1"), (F.max, 3, "y1"))]


def nearest_header(cells: DataFrame, least: float = 0.2) -> DataFrame:
    """For each body cell the header cell of its table above it that overlaps it across by ``least``, the nearest first.

    An equi-join on the table with the geometry as residual condition; a table holds few headers.
    """
    h = cells.where("row_role = 'header'").select(*TABLE, F.col("cell_id").alias("header_id"), F.col("bbox").alias("hb"))
    b = cells.where("row_role = 'body'").select(*TABLE, "cell_id", "bbox")
    gap = F.get("bbox", F.lit(1)) - F.get("hb", F.lit(3))
    j = b.join(h, TABLE).where((horizontal_overlap(F.col("bbox"), F.col("hb")) >= least) & (gap >= 0))
    return j.groupBy("cell_id").agg(F.min(F.struct(gap.alias("gap"), "header_id")).alias("m")).select("cell_id", "m.header_id", "m.gap")


def _section(prefix: str = "") -> Column:
    return F.concat_ws(":", F.lit("section"), "system_name", f"{prefix}section_id")


def graph_nodes(cells: DataFrame, sections: DataFrame) -> DataFrame:
    tables = cells.groupBy(*TABLE).agg(F.count("*").alias("n")).select(F.concat_ws(":", F.lit("table"), *TABLE).alias("node"), F.lit("table").alias("kind"))
    heads = sections.select(_section().alias("node"), F.lit("section").alias("kind")).distinct()
    docs = cells.select("doc_key").union(sections.select("doc_key")).distinct().select(F.concat_ws(":", F.lit("doc"), "doc_key").alias("node"), F.lit("document").alias("kind"))
    return tables.unionByName(heads).unionByName(docs)


def graph_edges(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """``source, relation, target``: documents have tables and sections, sections of a system follow each other."""
    doc = F.concat_ws(":", F.lit("doc"), "doc_key")
    tables = cells.select(*TABLE).distinct().select(doc.alias("source"), F.lit("has_table").alias("relation"), F.concat_ws(":", F.lit("table"), *TABLE).alias("target"))
    s = sections.groupBy("doc_key", "system_name", "section_id").agg(F.min("section_order").alias("o"))
    has = s.select(doc.alias("source"), F.lit("has_section").alias("relation"), _section().alias("target"))
    w = Window.partitionBy("doc_key", "system_name").orderBy("o", "section_id")
    follows = s.withColumn("next_section_id", F.lead("section_id").over(w)).where("next_section_id IS NOT NULL")
    return tables.unionByName(has).unionByName(follows.select(_section().alias("source"), F.lit("next").alias("relation"), _section("next_").alias("target")))


def heading_paths(headings: DataFrame, group: list[str], order: list[str], level: str, name: str) -> DataFrame:
    """Adds ``path``, the names of the headings a heading stands under and its own, outermost first.

    A heading closes all open ones of its own or a deeper level. The open heading of a level is the last
    one of that level, unless one of a higher level came after it. Levels are few by nature; which there
    are is taken from the data. Null levels stand under nothing and close nothing. One sort per group, streamed through window functions.
    """
    levels = [r[0] for r in headings.where(F.col(level).isNotNull()).select(level).distinct().orderBy(level).collect()]
    numbered = headings.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    upto = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    open_ = numbered
    for i, k in enumerate(levels):
        open_ = open_.withColumns({
            f"_h{i}": F.last(F.when(F.col(level) == k, F.struct(F.col("_at").alias("at"), F.col(name).alias("name"))), ignorenulls=True).over(upto),
            f"_c{i}": F.coalesce(F.last(F.when(F.col(level) < k, F.col("_at")), ignorenulls=True).over(upto), F.lit(0)),
        })
    stands = [F.when((F.lit(k) <= F.col(level)) & (F.col(f"_h{i}.at") > F.col(f"_c{i}")), F.col(f"_h{i}.name")) for i, k in enumerate(levels)]
    return open_.withColumn("path", F.array_compact(F.array(*stands)) if stands else F.array().cast("array<string>")).select(*headings.columns, "path")
