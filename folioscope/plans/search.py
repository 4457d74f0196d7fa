"""Queries on hybrid retrieval, hashes, filters, routing and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import words
from folioscope.operators import cells as C, hybrid as H, retrieval as R
from folioscope.plans.cells import C1, cells_of
from folioscope.plans.retrieval import _QA, _bm25, qa_best_documents
from folioscope.runtime import table

_TERMS = ["total", "valve"]
_TEXT = "total valve in the table, bottom right"


def hybrid_breakdown(spark, d):
    """Cells under all parts of the hybrid score: the parts of the fifty best."""
    c = cells_of(spark, d)
    v = table(spark, d, "embeddings")
    objects = c.join(v.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("vector")), "cell_id", "left").select(
        "cell_id", "header", "confidence", "vector", F.concat_ws(".", F.lit("table"), "row_role").alias("zone"), F.concat_ws(":", *C.TABLE).alias("table_id"), F.lit(None).cast("string").alias("caption"),
    )
    seeds = c.where("row_role = 'total'").select("cell_id")
    near = H.neighbors(c, C.TABLE).join(seeds.withColumnRenamed("cell_id", "a"), "a", "left_semi").select(F.col("b").alias("cell_id"))
    lexical = R.bm25(c.select("cell_id", "text"), "cell_id", words.plain_tokens(F.col("text")), _TERMS)
    probe = F.array(*(F.lit(float(x)) for x in v.where("vec_id = 0").first().embedding))  # one vector
    s = H.hybrid(objects, "cell_id", _TEXT, lexical, near, probe, r"table\.(body|total)", ["amount"], ["unit"])
    return s.select("cell_id", "score", "parts.*").orderBy(F.desc("score"), "cell_id").limit(50)


def hash_similar_vectors(spark, d):
    """Vectors by the share of equal signs with the first one."""
    v = table(spark, d, "embeddings").select("vec_id", H.hash_bits(F.col("embedding")).alias("bits"))
    probe = v.where("vec_id = 0").select(F.col("bits").alias("probe"))
    return v.crossJoin(F.broadcast(probe)).select("vec_id", F.round(H.hash_similarity(F.col("bits"), F.col("probe")), 6).alias("score"))  # one row


def object_types(spark, d):
    """What kind of object tables and sections are."""
    t = cells_of(spark, d).select(F.concat_ws(":", *C.TABLE).alias("table_id"), F.lit(None).cast("string").alias("caption")).distinct()
    s = C.delivered_once(table(spark, d, "sections"), ["section_id", "system_name"]).select(F.lit(None).cast("string").alias("table_id"), F.col("title").alias("caption"))
    return t.unionByName(s).groupBy(H.object_type(F.col("table_id"), F.col("caption")).alias("kind")).agg(F.count("*").alias("n"))


def neighbor_cells(spark, d):
    return H.neighbors(cells_of(spark, d), C.TABLE).groupBy("a").agg(F.count("*").alias("n")).withColumnRenamed("a", "cell_id")


def struct_filtered(spark, d):
    """Cells of given columns and rows of a range, headers compared in plain form."""
    c = cells_of(spark, d)
    keep = R.metadata_filter({"col_idx": [1, 2], "row_idx": lambda r: r.between(1, 3), "header_norm": ["qty", "quantity", "unit price"]})
    return c.withColumn("header_norm", words.header_key(F.col("header"))).where(keep).select("cell_id", "header_norm")


def review_routing(spark, d):
    """Cells that need a look, and why."""
    reason = F.array_compact(F.array(
        F.when(F.col("confidence") < 0.58, "low_confidence"), F.when(F.col("confidence").isNull(), "no_confidence"), F.when(F.coalesce("text", F.lit("")) == "", "no_text"), F.when(F.col("header").isNull(), "no_header"),
    ))
    return cells_of(spark, d).select("cell_id", F.array_join(reason, ",").alias("reasons")).where("reasons <> ''")


def focus_cells(spark, d):
    """Cells a focus set asks for: by trace, by table, or by reason; the sets are joined, not collected."""
    c = cells_of(spark, d)
    bad_tables = c.groupBy(*C.TABLE).agg(F.avg("confidence").alias("m")).where("m < 0.75").select(*C.TABLE, F.lit(True).alias("by_table"))
    changed = table(spark, d, "cells_b").where("text IS NULL").select("trace_id", F.lit(True).alias("by_trace")).where("trace_id IS NOT NULL").distinct()
    j = c.join(bad_tables, C.TABLE, "left").join(changed, "trace_id", "left")
    return j.where("by_table OR by_trace OR (low_conf AND header IS NULL)").select("cell_id", F.coalesce("by_table", F.lit(False)).alias("by_table"), F.coalesce("by_trace", F.lit(False)).alias("by_trace"))


def trust_at_k(spark, d):
    """Of the three best documents of every question: is one relevant (hit), and what share is (trust), by kind."""
    best = qa_best_documents(spark, d).where("rank <= 3")
    items = table(spark, d, "eval_items").select("item_id", "visual_type", "answers")
    text = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    j = best.join(text, "doc_id").join(items, "item_id").select("item_id", F.exists("answers", lambda a: F.contains(F.col("text"), F.lower(a))).cast("int").alias("hit"))
    per = items.join(j.groupBy("item_id").agg(F.max("hit").alias("hit"), (F.sum("hit") / F.count("*")).alias("trust")), "item_id", "left")
    return per.groupBy("visual_type").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("hit_rate"), F.round(F.avg(F.coalesce("trust", F.lit(0.0))), 6).alias("trust"))


def reprocess_rates(spark, d):
    """Low-confidence cells per document that the other copy read anew, and how many of those it changed."""
    b = C.delivered_once(table(spark, d, "cells_b")).select("cell_id", F.col("text").alias("other"), F.lit(1).alias("again"))
    j = cells_of(spark, d).where("low_conf").join(b, "cell_id", "left")
    n, again = F.count("*"), F.sum(F.coalesce("again", F.lit(0)))
    changed = F.count_if((F.col("again") == 1) & ~F.col("text").eqNullSafe(F.col("other")))
    return j.groupBy("doc_key").agg(n.alias("n_low"), again.alias("n_again"), changed.alias("n_changed"), F.round(again / n, 6).alias("again_rate"), F.round(F.try_divide(changed, again), 6).alias("changed_rate"))


def fresh_questions(spark, d):
    """Questions in plain form, each once, without those that are a section's title already."""
    q = table(spark, d, "eval_items").select(words.header_key(F.col("query")).alias("question"), "item_id").groupBy("question").agg(F.min("item_id").alias("item_id"))
    titles = table(spark, d, "sections").select(words.header_key(F.col("title")).alias("question")).distinct()
    return q.join(titles, "question", "left_anti")


QUERIES = {f.__name__: f for f in (hybrid_breakdown, hash_similar_vectors, object_types, neighbor_cells, struct_filtered, review_routing, focus_cells, trust_at_k, reprocess_rates, fresh_questions)}

_T = "doc_key, page, table_index"
_CD = "d AS (SELECT cell_id AS doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\-._]+', ' ', 'g'), '\\s+'), lambda t: t <> '') AS t FROM c)"
_NEAR = f"n AS (SELECT x.cell_id AS a, y.cell_id AS b FROM c x JOIN c y USING ({_T}) WHERE abs(x.row_idx - y.row_idx) + abs(x.col_idx - y.col_idx) = 1)"
_KEY = "lower(trim(regexp_replace(coalesce({c}, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))"
_B1 = "b AS (SELECT * FROM cells_b QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) = 1)"
ORACLE = {
    "hybrid_breakdown": f"""WITH {C1}, {_CD}, {_bm25(_TERMS)}, {_NEAR}, z AS (SELECT DISTINCT n.b AS cell_id FROM n JOIN c ON c.cell_id = n.a WHERE row_role = 'total'), p AS (SELECT embedding::DOUBLE[] AS p FROM embeddings WHERE vec_id = 0),
      x AS (SELECT c.cell_id, lower(header) AS h, confidence, coalesce(list_dot_product(embedding::DOUBLE[], p) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(p, p))), 0) AS dense, coalesce(s.score, 0) AS bm25, (z.cell_id IS NOT NULL)::INT::DOUBLE AS neighbor
        FROM c LEFT JOIN embeddings e ON e.vec_id = c.cell_id LEFT JOIN s ON s.doc_id = c.cell_id LEFT JOIN z ON z.cell_id = c.cell_id, p WHERE row_role IN ('body', 'total')),
      y AS (SELECT cell_id, dense, bm25, 1.0::DOUBLE AS zone, (CASE WHEN h = 'amount' THEN 1.0 WHEN starts_with(h, 'unit') THEN 0.5 ELSE 0.0 END)::DOUBLE AS header, neighbor, 0.0::DOUBLE AS symbolic, 0.0::DOUBLE AS keyword, 1.6::DOUBLE AS intent, (1 - greatest(least(coalesce(confidence, 1.0), 1.0), 0.0)) * 0.5 AS penalty FROM x)
      SELECT cell_id, round(0.35 * dense + 0.25 * bm25 + 0.2 * zone + 0.1 * header + 0.1 * neighbor + 0.2 * intent - 0.2 * penalty, 6) AS score, round(dense, 6) AS dense, round(bm25, 6) AS bm25, zone, header, neighbor, symbolic, keyword, round(intent, 6) AS intent, round(penalty, 6) AS penalty FROM y ORDER BY score DESC, cell_id LIMIT 50""",
    "hash_similar_vectors": "SELECT e.vec_id, round(1 - len(list_filter(list_zip(e.embedding, p.embedding), lambda x: (x[1] > 0) <> (x[2] > 0))) / 64, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p",
    "object_types": f"WITH {C1}, s AS (SELECT DISTINCT section_id, system_name, title FROM sections), k AS (SELECT 'table' AS kind FROM (SELECT DISTINCT {_T} FROM c) UNION ALL SELECT CASE WHEN regexp_matches(lower(coalesce(title, '')), 'figure|diagram|chart|schematic|graph') THEN 'figure' ELSE 'text' END FROM s) SELECT kind, count(*) AS n FROM k GROUP BY kind",
    "neighbor_cells": f"WITH {C1}, {_NEAR} SELECT a AS cell_id, count(DISTINCT b) AS n FROM n GROUP BY a",
    "struct_filtered": f"WITH {C1}, h AS (SELECT *, {_KEY.format(c='header')} AS header_norm FROM c) SELECT cell_id, header_norm FROM h WHERE col_idx IN (1, 2) AND row_idx BETWEEN 1 AND 3 AND header_norm IN ('qty', 'quantity', 'unit price')",
    "review_routing": f"WITH {C1} SELECT cell_id, reasons FROM (SELECT cell_id, concat_ws(',', CASE WHEN confidence < 0.58 THEN 'low_confidence' END, CASE WHEN confidence IS NULL THEN 'no_confidence' END, CASE WHEN coalesce(text, '') = '' THEN 'no_text' END, CASE WHEN header IS NULL THEN 'no_header' END) AS reasons FROM c) WHERE reasons <> ''",
    "focus_cells": f"WITH {C1}, f AS (SELECT cell_id, coalesce(avg(confidence) OVER (PARTITION BY {_T}) < 0.75, false) AS by_table, trace_id IS NOT NULL AND trace_id IN (SELECT trace_id FROM cells_b WHERE text IS NULL AND trace_id IS NOT NULL) AS by_trace, low_conf AND header IS NULL AS r FROM c) SELECT cell_id, by_table, by_trace FROM f WHERE by_table OR by_trace OR r",
    "trust_at_k": f"{_QA}, h AS (SELECT r.item_id, (len(list_filter(answers, lambda a: contains(lower(text), lower(a)))) > 0)::INT AS hit FROM r JOIN d USING (doc_id) JOIN eval_items e ON e.item_id = r.item_id WHERE rank <= 3), g AS (SELECT item_id, max(hit) AS hit, sum(hit) / count(*) AS trust FROM h GROUP BY item_id) SELECT visual_type, round(avg(coalesce(hit, 0)), 6) AS hit_rate, round(avg(coalesce(trust, 0)), 6) AS trust FROM eval_items LEFT JOIN g USING (item_id) GROUP BY visual_type",
    "reprocess_rates": f"WITH {C1}, {_B1} SELECT c.doc_key, count(*) AS n_low, count(b.cell_id) AS n_again, count(*) FILTER (WHERE b.cell_id IS NOT NULL AND c.text IS DISTINCT FROM b.text) AS n_changed, round(count(b.cell_id) / count(*), 6) AS again_rate, round(count(*) FILTER (WHERE b.cell_id IS NOT NULL AND c.text IS DISTINCT FROM b.text) / nullif(count(b.cell_id), 0), 6) AS changed_rate FROM c LEFT JOIN b USING (cell_id) WHERE low_conf GROUP BY c.doc_key",
    "fresh_questions": f"WITH q AS (SELECT {_KEY.format(c='query')} AS question, min(item_id) AS item_id FROM eval_items GROUP BY 1) SELECT * FROM q WHERE question NOT IN (SELECT {_KEY.format(c='title')} FROM sections)",
}
