"""Queries on differences between the two copies: events, severity, summaries, pairings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioscope.functions import values as V, words
from folioscope.operators import cells as C, kernels as K
from folioscope.runtime import table


def _pair(spark: SparkSession, d: str) -> DataFrame:
    a = C.delivered_once(table(spark, d, "cells")).select("cell_id", "doc_key", "page", "table_index", "row_idx", "col_idx", "header", F.col("text").alias("old"))
    b = C.delivered_once(table(spark, d, "cells_b")).select("cell_id", F.col("text").alias("new"))
    return a.join(b, "cell_id")


def diff_cell_updates(spark, d):
    """Changed texts with the numeric change where both sides are numbers."""
    p = _pair(spark, d).where(~F.col("old").eqNullSafe(F.col("new")))
    x, y = V.plain_number(F.col("old")), V.plain_number(F.col("new"))
    delta = y - x
    relative = delta / F.when(x == 0, 1.0).otherwise(F.abs(x))
    return p.select("cell_id", "header", (F.round(delta, 4) + 0.0).alias("delta"), (F.round(relative, 6) + 0.0).alias("relative"))


def diff_confidence(spark, d):
    """How sure a numeric change is a real one: base, distance of the texts, size of the change."""
    u = diff_cell_updates(spark, d).join(_pair(spark, d).select("cell_id", "old", "new"), "cell_id")
    marked = lambda c: F.regexp_replace(c, "[^ -~]", "?")  # noqa: E731  (one mark per other character, the same on any engine)
    gap = F.levenshtein(marked("old"), marked("new")) / F.greatest(F.length("old"), F.length("new"), F.lit(1))
    raw = 0.35 + 0.45 * gap + F.coalesce(0.4 * F.least(F.abs("relative"), F.lit(4.0)) / 4, F.lit(0.0))
    return u.where("old IS NOT NULL AND new IS NOT NULL").select("cell_id", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), raw)), 3).alias("confidence"))


def diff_severity(spark, d):
    c = diff_confidence(spark, d)
    level = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return c.groupBy(level.alias("severity")).agg(F.count("*").alias("n"))


def diff_numeric_summary(spark, d):
    """Numeric changes by kind of number: how many went up and down, and by how much in all."""
    u = diff_cell_updates(spark, d).where("delta IS NOT NULL").join(_pair(spark, d).select("cell_id", "old"), "cell_id")
    kind = F.when(F.col("old").rlike("%"), "percent").when(F.col("old").rlike("[¥$€]"), "currency").otherwise("generic")
    return u.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"), F.round(F.sum(F.abs("delta")), 2).alias("moved")
    )


def diff_top_changes(spark, d):
    u = diff_cell_updates(spark, d).where("delta IS NOT NULL")
    return u.select("cell_id", F.abs("delta").alias("change")).orderBy(F.desc("change"), "cell_id").limit(5)


def diff_tokens(spark, d):
    """Bags of words of changed texts: common, gone and new tokens, and their overlap."""
    p = _pair(spark, d).where("old <> new")
    bag = lambda c: F.filter(F.split(F.lower(c), r"[^0-9a-zà-öø-ÿ]+"), lambda t: t != "")
    a = p.select("cell_id", F.explode(bag(F.col("old"))).alias("token"), F.lit(1).alias("o"), F.lit(0).alias("w"))
    b = p.select("cell_id", F.explode(bag(F.col("new"))).alias("token"), F.lit(0).alias("o"), F.lit(1).alias("w"))
    t = a.unionByName(b).groupBy("cell_id", "token").agg(F.sum("o").alias("o"), F.sum("w").alias("w"))
    return t.groupBy("cell_id").agg(
        F.sum(F.least("o", "w")).alias("common"), F.sum(F.greatest(F.col("o") - F.col("w"), F.lit(0))).alias("gone"), F.sum(F.greatest(F.col("w") - F.col("o"), F.lit(0))).alias("fresh"),
        F.round(F.sum(F.least("o", "w")) / F.sum(F.greatest("o", "w")), 6).alias("overlap"),
    )


def diff_moved(spark, d):
    """Cells that stand in another row or column in the other copy."""
    a = C.delivered_once(table(spark, d, "cells")).select("cell_id", "row_idx", "col_idx")
    b = C.delivered_once(table(spark, d, "cells_b")).select("cell_id", F.col("row_idx").alias("row_b"), F.col("col_idx").alias("col_b"))
    return a.join(b, "cell_id").where("row_idx <> row_b OR col_idx <> col_b").select("cell_id", (F.col("row_b") - F.col("row_idx")).alias("rows"), (F.col("col_b") - F.col("col_idx")).alias("cols"))


def diff_rows(spark, d):
    """Rows of tables that only one copy has."""
    place = [*C.TABLE, "row_idx"]
    a, b = (C.delivered_once(table(spark, d, t)).select(*place).distinct() for t in ("cells", "cells_b"))
    gone = a.join(b, place, "left_anti").select(*place, F.lit("row_removed").alias("event"))
    return gone.unionByName(b.join(a, place, "left_anti").select(*place, F.lit("row_added").alias("event")))


def diff_tables(spark, d):
    """Header sets of the tables of both copies compared by position: overlap of their first rows."""
    firsts = lambda t: C.delivered_once(table(spark, d, t)).where("row_idx = 0").groupBy(*C.TABLE).agg(F.sort_array(F.collect_set(words.header_key(F.col("text")))).alias("h"))
    a, b = firsts("cells"), firsts("cells_b").withColumnRenamed("h", "g")
    j = a.join(b, C.TABLE, "full")
    return j.select(*C.TABLE, F.round(F.when(F.col("h").isNull() | F.col("g").isNull(), 0.0).otherwise(words.jaccard(F.col("h"), F.col("g"))), 6).alias("overlap"))


def _sections(spark, d, system):
    return C.delivered_once(table(spark, d, "sections").where(F.col("system_name") == system), "section_id")


def diff_section_events(spark, d):
    a, b = (_sections(spark, d, s).select("section_id", "doc_key", F.col("title").alias(f"t_{s}"), F.col("heading_level").alias(f"l_{s}")) for s in "ab")
    j = a.join(b.drop("doc_key").withColumn("in_b", F.lit(1)), "section_id", "full")
    events = F.array_compact(F.array(
        F.when(F.col("doc_key").isNull(), "section_added"), F.when(F.col("in_b").isNull(), "section_removed"),
        F.when(F.col("doc_key").isNotNull() & F.col("in_b").isNotNull() & ~F.col("t_a").eqNullSafe(F.col("t_b")), "title_changed"),
        F.when(F.col("doc_key").isNotNull() & F.col("in_b").isNotNull() & ~F.col("l_a").eqNullSafe(F.col("l_b")), "level_changed"),
    ))
    return j.select("section_id", F.explode(events).alias("event"))


def diff_section_summary(spark, d):
    e = diff_section_events(spark, d).join(table(spark, d, "sections").select("section_id", "doc_key").distinct(), "section_id")
    return e.groupBy("doc_key").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("event")), ",").alias("events"))


def diff_unified_lines(spark, d):
    """One line of text per change, as a report shows it."""
    p = _pair(spark, d).where(~F.col("old").eqNullSafe(F.col("new")))
    show = lambda c: F.coalesce(F.col(c), F.lit("(null)"))
    return p.select("cell_id", F.concat(F.lit("~ "), F.coalesce("header", F.lit("?")), F.lit(": "), show("old"), F.lit(" -> "), show("new")).alias("line"))


def diff_handoff(spark, d):
    """Changes per document with up to three samples, the most changed documents first."""
    u = _pair(spark, d).where(~F.col("old").eqNullSafe(F.col("new")))
    g = u.groupBy("doc_key").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_list("cell_id")), 1, 3), ",").alias("samples"))
    return g.orderBy(F.desc("n"), "doc_key").limit(20)


def section_pairs(spark, d):
    """Optimal pairing of the sections of both systems by title within each document."""
    a, b = (_sections(spark, d, s) for s in "ab")
    return K.match_by_text(a, b, ["doc_key"], "section_id", "title", 0.55)


def section_line_diff(spark, d):
    a, b = (_sections(spark, d, s) for s in "ab")
    return K.line_diffs(a, b, ["doc_key"], "section_order", "title")


def copy_set_operations(spark, d):
    """Sizes of the intersection and both differences of the two copies as sets of (cell, text)."""
    a, b = (table(spark, d, t).select("cell_id", "text").distinct() for t in ("cells", "cells_b"))
    counts = [a.intersect(b).select(F.lit("both").alias("part")), a.exceptAll(b).select(F.lit("only_a").alias("part")), b.exceptAll(a).select(F.lit("only_b").alias("part"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("part").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        diff_cell_updates, diff_confidence, diff_severity, diff_numeric_summary, diff_top_changes, diff_tokens, diff_moved, diff_rows, diff_tables, diff_section_events, diff_section_summary,
        diff_unified_lines, diff_handoff, section_pairs, section_line_diff, copy_set_operations,
    )
}

_N = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY loaded_at DESC) AS rn FROM {t}) WHERE rn = 1"
_P = f"""a AS ({_N.format(k='cell_id', t='cells')}), b AS ({_N.format(k='cell_id', t='cells_b')}),
p AS (SELECT a.cell_id, a.doc_key, a.header, a.text AS old, b.text AS new, a.row_idx, a.col_idx, b.row_idx AS row_b, b.col_idx AS col_b FROM a JOIN b USING (cell_id)),
u0 AS (SELECT *, TRY_CAST(translate(old, ',¥$€ ', '') AS DOUBLE) AS x, TRY_CAST(translate(new, ',¥$€ ', '') AS DOUBLE) AS y FROM p WHERE old IS DISTINCT FROM new),
u AS (SELECT cell_id, header, old, new, round(y - x, 4) + 0.0 AS delta, round((y - x) / (CASE WHEN x = 0 THEN 1.0 ELSE abs(x) END), 6) + 0.0 AS relative FROM u0),
f AS (SELECT cell_id, round(greatest(0.05, least(1.0, 0.35 + 0.45 * levenshtein(regexp_replace(old, '[^ -~]', '?', 'g'), regexp_replace(new, '[^ -~]', '?', 'g')) / greatest(length(old), length(new), 1) + coalesce(0.4 * least(abs(relative), 4.0) / 4, 0.0))), 3) AS confidence FROM u WHERE old IS NOT NULL AND new IS NOT NULL)"""
_S = f"""a AS ({_N.format(k='section_id', t="(SELECT * FROM sections WHERE system_name = 'a')")}), b AS ({_N.format(k='section_id', t="(SELECT * FROM sections WHERE system_name = 'b')")}),
e AS (SELECT section_id, 'section_added' AS event FROM b WHERE section_id NOT IN (SELECT section_id FROM a) UNION ALL SELECT section_id, 'section_removed' FROM a WHERE section_id NOT IN (SELECT section_id FROM b)
UNION ALL SELECT a.section_id, 'title_changed' FROM a JOIN b USING (section_id) WHERE a.title IS DISTINCT FROM b.title UNION ALL SELECT a.section_id, 'level_changed' FROM a JOIN b USING (section_id) WHERE a.heading_level IS DISTINCT FROM b.heading_level)"""
_R = "SELECT DISTINCT doc_key, page, table_index, row_idx FROM {t}"
_FH = "SELECT doc_key, page, table_index, list_sort(list(DISTINCT lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))))) AS {n} FROM {t} WHERE row_idx = 0 GROUP BY ALL"
ORACLE = {
    "diff_cell_updates": f"WITH {_P} SELECT cell_id, header, delta, relative FROM u",
    "diff_confidence": f"WITH {_P} SELECT cell_id, confidence FROM f",
    "diff_severity": f"WITH {_P} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM f GROUP BY 1",
    "diff_numeric_summary": f"WITH {_P} SELECT CASE WHEN contains(old, '%') THEN 'percent' WHEN regexp_matches(old, '[¥$€]') THEN 'currency' ELSE 'generic' END AS kind, count(*) AS n, count(*) FILTER (WHERE delta > 0) AS up, count(*) FILTER (WHERE delta < 0) AS down, round(sum(abs(delta)), 2) AS moved FROM u WHERE delta IS NOT NULL GROUP BY 1",
    "diff_top_changes": f"WITH {_P} SELECT cell_id, abs(delta) AS change FROM u WHERE delta IS NOT NULL ORDER BY change DESC, cell_id LIMIT 5",
    "diff_tokens": f"""WITH {_P}, t AS (SELECT cell_id, unnest(string_split_regex(lower(old), '[^0-9a-zà-öø-ÿ]+')) AS token, 1 AS o, 0 AS w FROM p WHERE old <> new UNION ALL SELECT cell_id, unnest(string_split_regex(lower(new), '[^0-9a-zà-öø-ÿ]+')), 0, 1 FROM p WHERE old <> new),
      g AS (SELECT cell_id, token, sum(o) AS o, sum(w) AS w FROM t WHERE token <> '' GROUP BY ALL) SELECT cell_id, sum(least(o, w))::BIGINT AS common, sum(greatest(o - w, 0))::BIGINT AS gone, sum(greatest(w - o, 0))::BIGINT AS fresh, round(sum(least(o, w)) / sum(greatest(o, w)), 6) AS overlap FROM g GROUP BY cell_id""",
    "diff_moved": f"WITH {_P} SELECT cell_id, row_b - row_idx AS rows, col_b - col_idx AS cols FROM p WHERE row_idx <> row_b OR col_idx <> col_b",
    "diff_rows": f"WITH {_P} SELECT *, 'row_removed' AS event FROM ({_R.format(t='a')} EXCEPT {_R.format(t='b')}) UNION ALL SELECT *, 'row_added' FROM ({_R.format(t='b')} EXCEPT {_R.format(t='a')})",
    "diff_tables": f"WITH {_P}, h AS ({_FH.format(n='h', t='a')}), g AS ({_FH.format(n='g', t='b')}) SELECT doc_key, page, table_index, round(CASE WHEN h IS NULL OR g IS NULL THEN 0 ELSE len(list_intersect(h, g)) / len(list_distinct(list_concat(h, g))) END, 6) AS overlap FROM h FULL JOIN g USING (doc_key, page, table_index)",
    "diff_section_events": f"WITH {_S} SELECT section_id, event FROM e",
    "diff_section_summary": f"WITH {_S} SELECT doc_key, count(*) AS n, array_to_string(list_sort(list(DISTINCT event)), ',') AS events FROM e JOIN (SELECT DISTINCT section_id, doc_key FROM sections) USING (section_id) GROUP BY doc_key",
    "diff_unified_lines": f"WITH {_P} SELECT cell_id, '~ ' || coalesce(header, '?') || ': ' || coalesce(old, '(null)') || ' -> ' || coalesce(new, '(null)') AS line FROM p WHERE old IS DISTINCT FROM new",
    "diff_handoff": f"WITH {_P} SELECT doc_key, count(*) AS n, array_to_string(list_sort(list(cell_id))[1:3], ',') AS samples FROM p WHERE old IS DISTINCT FROM new GROUP BY doc_key ORDER BY n DESC, doc_key LIMIT 20",
    "copy_set_operations": "WITH a AS (SELECT DISTINCT cell_id, text FROM cells), b AS (SELECT DISTINCT cell_id, text FROM cells_b), x AS (SELECT 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT part, count(*) AS n FROM x GROUP BY part",
}
