"""Queries on geometry and structure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from folioscope.operators import cells as C, kernels as K, layout as L
from folioscope.plans.cells import C1, cells_of
from folioscope.runtime import table


def sections_of(spark, d):
    """The sections of both systems, delivered once."""
    return C.delivered_once(table(spark, d, "sections"), ["section_id", "system_name"])


def table_boxes(spark, d):
    return cells_of(spark, d).groupBy(*C.TABLE).agg(*L.union_box("bbox"))


def bbox_overlap(spark, d):
    """Neighbouring cells of a row whose boxes overlap or touch by how much."""
    w = Window.partitionBy(*C.TABLE, "row_idx").orderBy("col_idx", "cell_id")
    c = cells_of(spark, d).withColumn("before", F.lag("bbox").over(w)).where("before IS NOT NULL")
    return c.select("cell_id", F.round(L.overlap_ratio(F.col("bbox"), F.col("before")), 6).alias("overlap"), F.round(L.horizontal_overlap(F.col("bbox"), F.col("before")), 6).alias("across"))


def nearest_header(spark, d):
    return L.nearest_header(cells_of(spark, d))


def graph_nodes(spark, d):
    return L.graph_nodes(cells_of(spark, d), sections_of(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


def graph_edges(spark, d):
    return L.graph_edges(cells_of(spark, d), sections_of(spark, d))


def graph_json(spark, d):
    """Each node's edges as one JSON-LD text, by relation in order."""
    e = L.graph_edges(cells_of(spark, d), sections_of(spark, d))
    g = e.groupBy("source").agg(*(F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.col("target")))).alias(r) for r in ("has_table", "has_section", "next")))
    kind = F.when(F.col("source").startswith("doc:"), "document").otherwise("section")
    return g.select("source", F.to_json(F.struct(F.col("source").alias("@id"), kind.alias("@type"), "has_table", "has_section", "next")).alias("json"))


def heading_carry_forward(spark, d):
    """The headings every section stands under, and its own, by id."""
    s = sections_of(spark, d).withColumn("id", F.col("section_id").cast("string"))
    p = L.heading_paths(s, ["doc_key", "system_name"], ["section_order", "section_id"], "heading_level", "id")
    return p.select("system_name", "section_id", F.array_join("path", "/").alias("path"))


def page_sides(spark, d):
    """Cells left and right of the middle of their table."""
    c = cells_of(spark, d).join(table_boxes(spark, d), C.TABLE)
    middle = (F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))) / 2
    return c.groupBy(*C.TABLE, F.when(middle < (F.col("x0") + F.col("x1")) / 2, "left").otherwise("right").alias("side")).agg(F.count("*").alias("n"))


def row_gaps(spark, d):
    """How far the rows of all tables start below the row above, and how often."""
    r = cells_of(spark, d).groupBy(*C.TABLE, "row_idx").agg(F.min(F.get("bbox", F.lit(1))).alias("y"))
    w = Window.partitionBy(*C.TABLE).orderBy("row_idx")
    return r.withColumn("gap", F.col("y") - F.lag("y").over(w)).where("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))


def column_centers(spark, d):
    """One-dimensional clusters of the cells' left edges per table."""
    c = cells_of(spark, d).select(*C.TABLE, F.get("bbox", F.lit(0)).alias("x"))
    return K.per_group(c, C.TABLE, "n_centers int, first double", lambda _, g: [(len(m), float(m[0])) for m in [K.centers(g["x"].to_numpy(), 20.0)]])


def alignment_energy(spark, d):
    """Share of the roughness of each table's row tops that smoothing leaves."""
    r = cells_of(spark, d).groupBy(*C.TABLE, "row_idx").agg(F.min(F.get("bbox", F.lit(1))).alias("y"))

    def energy(_: tuple, g) -> list[tuple]:
        y = g.sort_values("row_idx")["y"].to_numpy(float)
        rough = lambda v: float(np.sum(np.diff(v, 2) ** 2)) if len(v) > 2 else 0.0
        before = rough(y)
        return [(round(rough(K.smooth(y, 2.0)) / before if before else 1.0, 6),)]

    return K.per_group(r, C.TABLE, "ratio double", energy)


def box_clusters(spark, d):
    """Groups of touching boxes per table."""
    c = cells_of(spark, d).select(*C.TABLE, "cell_id", "bbox")

    def clusters(_: tuple, g) -> list[tuple]:
        g = g.sort_values("cell_id")
        numbers = K.box_groups(np.array(g["bbox"].tolist(), float))
        return [(int(numbers.max()) + 1, len(g))]

    return K.per_group(c, C.TABLE, "n_groups int, n_boxes int", clusters)


def merged_pages(spark, d):
    """Tables that go on over consecutive pages with the same headers: the first page and how many pages."""
    h = cells_of(spark, d).where("row_idx = 0").groupBy(*C.TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "cell_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "|").alias("h"))
    w = Window.partitionBy("doc_key", "h").orderBy("page", "table_index")
    h = h.withColumn("new", F.coalesce((F.col("page") - F.lag("page").over(w) > 1).cast("int"), F.lit(1)))
    h = h.withColumn("part", F.sum("new").over(w))
    return h.groupBy("doc_key", "h", "part").agg(F.min("page").alias("first_page"), F.count_distinct("page").alias("n_pages")).where("n_pages > 1").select("doc_key", F.col("h").alias("headers"), "first_page", "n_pages")


QUERIES = {
    f.__name__: f
    for f in (table_boxes, bbox_overlap, nearest_header, graph_nodes, graph_edges, graph_json, heading_carry_forward, page_sides, row_gaps, column_centers, alignment_energy, box_clusters, merged_pages)
}

_T = "doc_key, page, table_index"
_S1 = "s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY section_id, system_name ORDER BY loaded_at DESC) AS rn FROM sections) WHERE rn = 1)"
_TN = "'table:' || doc_key || ':' || page || ':' || table_index"
_BOX = f"SELECT {_T}, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1 FROM c GROUP BY ALL"
_EDGES = f"""SELECT DISTINCT 'doc:' || doc_key AS source, 'has_table' AS relation, {_TN} AS target FROM c
UNION ALL SELECT 'doc:' || doc_key, 'has_section', 'section:' || system_name || ':' || section_id FROM s
UNION ALL SELECT 'section:' || system_name || ':' || section_id, 'next', 'section:' || system_name || ':' || n FROM (SELECT system_name, section_id, lead(section_id) OVER (PARTITION BY doc_key, system_name ORDER BY section_order, section_id) AS n FROM s) WHERE n IS NOT NULL"""
# A heading's parent is the nearest earlier one of a lower level; paths follow parents up.
_PATHS = """o AS (SELECT *, row_number() OVER (PARTITION BY doc_key, system_name ORDER BY section_order, section_id) AS pos FROM s),
  p AS (SELECT a.doc_key, a.system_name, a.section_id, a.pos, max(b.pos) AS parent FROM o a LEFT JOIN o b ON a.doc_key = b.doc_key AND a.system_name = b.system_name AND b.pos < a.pos AND b.heading_level < a.heading_level GROUP BY ALL),
  r AS (SELECT doc_key, system_name, section_id, section_id::VARCHAR AS path, parent FROM p UNION ALL SELECT r.doc_key, r.system_name, r.section_id, p.section_id || '/' || r.path, p.parent FROM r JOIN p ON p.doc_key = r.doc_key AND p.system_name = r.system_name AND p.pos = r.parent)"""
ORACLE = {
    "table_boxes": f"WITH {C1} {_BOX}",
    "bbox_overlap": f"""WITH {C1}, p AS (SELECT cell_id, bbox AS b, lag(bbox) OVER (PARTITION BY {_T}, row_idx ORDER BY col_idx, cell_id) AS a FROM c), m AS (SELECT cell_id, greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) AS w, greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0) AS h,
      least((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2])) AS area, least(a[3] - a[1], b[3] - b[1]) AS width FROM p WHERE a IS NOT NULL) SELECT cell_id, round(coalesce(w * h / nullif(area, 0), 0), 6) AS overlap, round(coalesce(w / nullif(width, 0), 0), 6) AS across FROM m""",
    "nearest_header": f"""WITH {C1}, h AS (SELECT {_T}, cell_id AS header_id, bbox AS hb FROM c WHERE row_role = 'header'), j AS (SELECT c.cell_id, header_id, bbox[2] - hb[4] AS gap FROM c JOIN h USING ({_T}) WHERE row_role = 'body' AND bbox[2] - hb[4] >= 0
      AND coalesce(greatest(least(bbox[3], hb[3]) - greatest(bbox[1], hb[1]), 0) / nullif(least(bbox[3] - bbox[1], hb[3] - hb[1]), 0), 0) >= 0.2) SELECT cell_id, header_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY gap, header_id) AS rn FROM j) WHERE rn = 1""",
    "graph_nodes": f"WITH {C1}, {_S1} SELECT 'table' AS kind, count(*) AS n FROM (SELECT DISTINCT {_T} FROM c) UNION ALL SELECT 'section', count(*) FROM s UNION ALL SELECT 'document', count(*) FROM (SELECT doc_key FROM c UNION SELECT doc_key FROM s)",
    "graph_edges": f"WITH {C1}, {_S1} {_EDGES}",
    "graph_json": f"""WITH {C1}, {_S1}, e AS ({_EDGES}), g AS (SELECT source, {", ".join(f"coalesce(list(target ORDER BY target) FILTER (WHERE relation = '{r}'), []) AS {r}" for r in ("has_table", "has_section", "next"))} FROM e GROUP BY source)
      SELECT source, to_json({{'@id': source, '@type': CASE WHEN starts_with(source, 'doc:') THEN 'document' ELSE 'section' END, 'has_table': has_table, 'has_section': has_section, 'next': next}})::VARCHAR AS json FROM g""",
    "heading_carry_forward": f"WITH RECURSIVE {_S1}, {_PATHS} SELECT system_name, section_id, path FROM r WHERE parent IS NULL",
    "page_sides": f"WITH {C1}, b AS ({_BOX}) SELECT {_T}, CASE WHEN (bbox[1] + bbox[3]) / 2 < (x0 + x1) / 2 THEN 'left' ELSE 'right' END AS side, count(*) AS n FROM c JOIN b USING ({_T}) GROUP BY ALL",
    "row_gaps": f"WITH {C1}, r AS (SELECT {_T}, row_idx, min(bbox[2]) AS y FROM c GROUP BY ALL), g AS (SELECT *, y - lag(y) OVER (PARTITION BY {_T} ORDER BY row_idx) AS gap FROM r) SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap",
    "merged_pages": f"WITH {C1}, h AS (SELECT {_T}, array_to_string(list(coalesce(text, '') ORDER BY col_idx, cell_id), '|') AS h FROM c WHERE row_idx = 0 GROUP BY ALL), n AS (SELECT *, coalesce((page - lag(page) OVER w > 1)::INT, 1) AS new FROM h WINDOW w AS (PARTITION BY doc_key, h ORDER BY page, table_index)), p AS (SELECT *, sum(new) OVER (PARTITION BY doc_key, h ORDER BY page, table_index) AS part FROM n) SELECT doc_key, h AS headers, min(page) AS first_page, count(DISTINCT page) AS n_pages FROM p GROUP BY doc_key, h, part HAVING count(DISTINCT page) > 1",
}
