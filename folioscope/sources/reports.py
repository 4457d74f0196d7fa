"""Differences as reports, and graphs as JSON-LD, written and read by partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _escaped(c: Column, pairs: tuple) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
_MARKDOWN = (("\\", "\\\\"), ("|", "\\|"), ("\n", " "))


def markdown_rows(events: DataFrame, columns: list[str]) -> DataFrame:
    """Each event as a row of a Markdown table."""
    return events.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(_escaped(F.col(c).cast("string"), _MARKDOWN) for c in columns)), F.lit(" |")).alias("value"))


def html_rows(events: DataFrame, columns: list[str]) -> DataFrame:
    """Each event as a row of an HTML table, its kind as class."""
    cells = [F.concat(F.lit("<td>"), _escaped(F.col(c).cast("string"), _HTML), F.lit("</td>")) for c in columns]
    return events.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def write_report(events: DataFrame, columns: list[str], path: str, form: str) -> None:
    """Rows of a report as text files, one per partition: ``markdown``, ``html`` or ``json`` (the hand-off form)."""
    if form == "json":
        events.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)
    else:
        {"markdown": markdown_rows, "html": html_rows}[form](events, columns).write.mode("overwrite").text(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """Edges ``source, relation, target`` as JSON-LD lines, one node a line."""
    g = edges.groupBy("source", "relation").agg(F.array_sort(F.collect_list("target")).alias("targets")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("relation", "targets"))).alias("edges"))
    g.select(F.to_json(F.struct(F.col("source").alias("@id"), "edges")).alias("value")).write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """The edges of a written graph."""
    node = F.from_json("value", "`@id` string, edges map<string,array<string>>")
    e = spark.read.text(path).select(node.alias("n")).select(F.col("n.@id").alias("source"), F.explode("n.edges").alias("relation", "targets"))
    return e.select("source", "relation", F.explode("targets").alias("target"))
