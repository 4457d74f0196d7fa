"""Queries over exported cells: typed values, profiles, context, exports, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioscope.functions import values as V, words
from folioscope.operators import cells as C
from folioscope.runtime import table


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    return C.delivered_once(table(spark, d, "cells"))


def cells_once(spark, d):
    return cells_of(spark, d).groupBy("row_role").agg(F.count("*").alias("n"), F.count_distinct("doc_key").alias("n_docs"))


def norm_amount(spark, d):
    return cells_of(spark, d).select("cell_id", V.whole_amount(F.col("amount")).alias("value")).where("value IS NOT NULL")


def norm_date(spark, d):
    return cells_of(spark, d).select("cell_id", V.iso_date(F.col("text")).alias("day")).where("day IS NOT NULL")


def try_number(spark, d):
    return cells_of(spark, d).select("cell_id", V.plain_number(F.col("text")).alias("number")).where("number IS NOT NULL")


def regex_entities(spark, d):
    p = table(spark, d, "parties")
    return p.select("party_id", V.first(F.col("postal_code"), V.POSTAL).alias("postal"), V.first(F.col("corporate_id"), V.CORPORATE).alias("corporate")).where("postal IS NOT NULL OR corporate IS NOT NULL")


def type_signature(spark, d):
    s = cells_of(spark, d).withColumn("signature", V.type_signature(F.col("text")))
    return s.groupBy("signature").agg(F.count("*").alias("n"))


def concept_tags(spark, d):
    t = cells_of(spark, d).where("text IS NOT NULL").select(F.array_join(V.concept_tags(F.col("text")), ",").alias("tags"))
    return t.groupBy("tags").agg(F.count("*").alias("n"))


def context_line(spark, d):
    return C.context_lines(cells_of(spark, d))


def kv_window(spark, d):
    """The quantity of each row, found under any of its headers in the context line."""
    lines = C.context_lines(cells_of(spark, d)).withColumn("m", C.key_values(F.col("line")))
    got = F.coalesce(*(F.element_at("m", k) for k in ("Qty", "Quantity", "Quantité", "数量")))
    return lines.select(*C.TABLE, "row_idx", F.regexp_extract(got, r"\d+", 0).try_cast("bigint").alias("qty")).where("qty IS NOT NULL")


def header_kind_profile(spark, d):
    return C.column_profile(cells_of(spark, d))


def column_deviation(spark, d):
    return C.column_deviation(cells_of(spark, d))


def weak_cells(spark, d):
    weak = (F.coalesce("text", F.lit("")) == "") | F.coalesce("low_conf", F.lit(False)) | (F.coalesce("confidence", F.lit(1.0)) < 0.55)
    return cells_of(spark, d).where(weak).select("cell_id")


def monitor_counters(spark, d):
    c = cells_of(spark, d).join(table(spark, d, "documents").select("doc_key", "doc_domain"), "doc_key", "left")
    return c.groupBy("doc_domain").agg(
        F.count("*").alias("total"), F.count_if("low_conf").alias("low"), F.round(F.count_if("low_conf") / F.greatest(F.count("*"), F.lit(1)), 6).alias("low_rate"), F.count("company").alias("named")
    )


def confidence_bands(spark, d):
    return cells_of(spark, d).groupBy(F.floor(F.col("confidence") * 10).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


def chunk_consistency(spark, d):
    """Share of the cells that stand in the largest table of their page."""
    per = cells_of(spark, d).groupBy("doc_key", "page", "table_index").agg(F.count("*").alias("n"))
    return per.groupBy("doc_key", "page").agg(F.max("n").alias("m"), F.sum("n").alias("t")).agg(F.round(F.sum("m") / F.sum("t"), 6).alias("consistency"))


def flat_cells(spark, d):
    b = lambda i: F.get("bbox", F.lit(i))
    return cells_of(spark, d).select("cell_id", "doc_key", "page", "row_idx", "col_idx", b(0).alias("x0"), b(1).alias("y0"), b(2).alias("x1"), b(3).alias("y1"), F.coalesce("trace_id", F.lit("")).alias("trace"))


def page_sections(spark, d):
    """The first 40 cells of every page, in reading order, as one text: its hash and length."""
    w = Window.partitionBy("doc_key", "page").orderBy("table_index", "row_idx", "col_idx", "cell_id")
    c = cells_of(spark, d).withColumn("i", F.row_number().over(w)).where("i <= 40")
    g = c.groupBy("doc_key", "page").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("text", F.lit("")).alias("t")))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: x["t"]), "\n")
    return g.select("doc_key", "page", F.size("a").alias("n_cells"), F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


def table_shapes(spark, d):
    return cells_of(spark, d).groupBy(*C.TABLE).agg(F.count_distinct("row_idx").alias("n_rows"), F.count_distinct("col_idx").alias("n_cols"), F.count("*").alias("n_cells"))


def tabulate_pivot(spark, d):
    """Rows of every table with one text per column of the table, however many it has, missing cells empty; joined by tabs."""
    c = cells_of(spark, d)
    width = c.groupBy(*C.TABLE).agg(F.max("col_idx").alias("last"))
    places = c.groupBy(*C.PLACE).agg(F.max_by("text", "cell_id").alias("text"))
    rows = places.groupBy(*C.TABLE, "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "text"))).alias("m"))
    texts = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.element_at("m", i), F.lit("")))
    return rows.join(width, C.TABLE).select(*C.TABLE, "row_idx", F.array_join(texts, "\t").alias("texts"))


def hotspots(spark, d):
    h = C.hotspots(cells_of(spark, d), F.when(F.col("low_conf"), F.lit(1)).otherwise(F.lit(0)), 8)
    return h.select("level", "rank", "doc_key", "page", "table_index", "row_idx", "score", "n")


def hotspot_share(spark, d):
    """Share of the 16 worst rows in all low-confidence cells."""
    r = cells_of(spark, d).where("low_conf").groupBy(*C.TABLE, "row_idx").agg(F.count("*").alias("n"))
    best = r.orderBy(F.desc("n"), *C.TABLE, "row_idx").limit(16).agg(F.sum("n").alias("b"))
    return best.crossJoin(F.broadcast(r.agg(F.sum("n").alias("t")))).select(F.round(F.col("b") / F.col("t"), 6).alias("share"))  # one row each


def reanalysis_apply(spark, d):
    """Texts of the other copy taken over where the cell was read with low confidence."""
    b = table(spark, d, "cells_b").select("trace_id", F.col("text").alias("new_text"), F.lit(0.75).alias("new_confidence"), F.col("loaded_at").alias("at"))
    return C.apply_corrections(cells_of(spark, d), b).where("changed").select("cell_id", "text", "confidence")


def header_mode(spark, d):
    """Most frequent header of each column position of a document, the smaller text among equals."""
    c = cells_of(spark, d).where("header IS NOT NULL").groupBy("doc_key", "col_idx", words.header_key(F.col("header")).alias("h")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_key", "col_idx").orderBy(F.desc("n"), "h")
    return c.withColumn("i", F.row_number().over(w)).where("i = 1").select("doc_key", "col_idx", "h", "n")


def row_signature(spark, d):
    g = cells_of(spark, d).groupBy(*C.TABLE, "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "cell_id", F.coalesce("text", F.lit("")).alias("t")))).alias("a"))
    return g.select(*C.TABLE, "row_idx", F.substring(F.sha1(F.array_join(F.transform("a", lambda x: x["t"]), "|")), 1, 10).alias("signature"))


def diff_row_keys(spark, d):
    return C.disambiguated_keys(cells_of(spark, d))


def header_rows_skipped(spark, d):
    """First rows that only repeat the headers."""
    w = Window.partitionBy(*C.TABLE)
    c = cells_of(spark, d).withColumn("first", F.min("row_idx").over(w)).where("row_idx = first")
    same = F.every(F.coalesce(words.header_key(F.col("text")) == words.header_key(F.col("header")), F.lit(False)))
    return c.groupBy(*C.TABLE).agg(same.alias("same")).where("same").select(*C.TABLE)


def char_transitions(spark, d):
    c = cells_of(spark, d).where("header IS NOT NULL").select("cell_id", F.posexplode(F.split("header", "")).alias("i", "ch"))
    w = Window.partitionBy("cell_id").orderBy("i")
    return c.withColumn("before", F.lag("ch").over(w)).where("before IS NOT NULL AND ch <> ''").groupBy("before", "ch").agg(F.count("*").alias("n"))


def bigram_surprisal(spark, d):
    return C.bigram_surprisal(table(spark, d, "sections").groupBy("title").count(), "title", "title")


def second_difference(spark, d):
    """Energy of the second difference of the row heights of each table."""
    h = cells_of(spark, d).groupBy(*C.TABLE, "row_idx").agg(F.max(F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1))).alias("h"))
    w = Window.partitionBy(*C.TABLE).orderBy("row_idx")
    e = F.lead("h").over(w) - 2 * F.col("h") + F.lag("h").over(w)
    return h.withColumn("e", e).groupBy(*C.TABLE).agg(F.sum(F.col("e") * F.col("e")).cast("bigint").alias("energy"))


def robust_column_count(spark, d):
    """Per table, the longest run of rows whose number of columns changes by one at most: how long it is and its usual number."""
    rows = cells_of(spark, d).groupBy(*C.TABLE, "row_idx").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*C.TABLE).orderBy("row_idx")
    rows = rows.withColumn("jump", F.coalesce((F.abs(F.col("n") - F.lag("n").over(w)) > 1).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("jump").over(w))
    runs = rows.groupBy(*C.TABLE, "run").agg(F.count("*").alias("length"))
    best = runs.groupBy(*C.TABLE).agg(F.max(F.struct("length", (-F.col("run")).alias("m"))).alias("b"))
    kept = rows.join(best, C.TABLE).where(F.col("run") == -F.col("b.m")).groupBy(*C.TABLE, F.col("b.length").alias("length"), "n").agg(F.count("*").alias("k"))
    return kept.groupBy(*C.TABLE, "length").agg(F.max(F.struct("k", (-F.col("n")).alias("m"))).alias("b")).select(*C.TABLE, "length", (-F.col("b.m")).alias("n_cols"))


def fact_tags(spark, d):
    tag = F.concat(F.lit('<fact trace="'), F.concat_ws("/", F.col("doc_key"), F.concat(F.lit("p"), "page"), F.concat(F.lit("t"), "table_index"), F.concat(F.lit("r"), "row_idx"), F.concat(F.lit("c"), "col_idx")), F.lit('">'), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</fact>"))
    return cells_of(spark, d).select("cell_id", tag.alias("tag"))


def html_rows(spark, d):
    g = cells_of(spark, d).groupBy(*C.TABLE, "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "cell_id", F.coalesce("text", F.lit("")).alias("t")))).alias("a"))
    return g.select(*C.TABLE, "row_idx", F.concat(F.lit("<tr>"), F.array_join(F.transform("a", lambda x: F.concat(F.lit("<td>"), x["t"], F.lit("</td>"))), ""), F.lit("</tr>")).alias("html"))


def safe_paths(spark, d):
    return table(spark, d, "eval_items").select("item_id", words.safe_segment(F.col("query")).alias("segment"), words.clip(F.col("passage"), 120).alias("clipped"), F.md5("passage").alias("digest"))


def masked_numbers(spark, d):
    c = cells_of(spark, d).where("text IS NOT NULL").select(words.mask_numbers(F.col("text")).alias("mask"))
    return c.groupBy("mask").agg(F.count("*").alias("n"))


def ambiguous_variants(spark, d):
    """Readings of short codes with letters and digits that look alike exchanged."""
    c = cells_of(spark, d).where(F.col("text").rlike("^[A-Z]{2}-[0-9]+$")).select("cell_id", "text")
    return c.select("cell_id", F.explode(F.array_distinct(F.array(F.col("text"), F.translate("text", "01", "OI"), F.translate("text", "OI", "01"), F.translate("text", "58", "SB")))).alias("variant"))


def hypotheses(spark, d):
    """Up to six readings of a low-confidence cell, best score first, equal texts once."""
    alike = ("OoIlSBZ", "0011582")
    readings = {
        0.6: F.col("text"), 0.5: F.translate("text", *alike), 0.45: F.regexp_replace("text", r"\s", ""), 0.4: F.regexp_replace("text", "[^0-9]", ""),
        0.35: F.upper("text"), 0.3: F.regexp_replace("text", "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""),
    }
    h = F.array(*(F.struct(F.lit(-s).alias("s"), t.alias("t")) for s, t in readings.items()))
    best = F.filter(F.array_sort(h), lambda x: x["t"] != "")
    once = F.filter(best, lambda x, i: F.array_position(F.transform(F.slice(best, 1, i), lambda y: y["t"]), x["t"]) == 0)
    c = cells_of(spark, d).where("low_conf AND text <> ''").select("cell_id", once.alias("h"))
    return c.select("cell_id", F.posexplode("h").alias("rank", "x")).select("cell_id", "rank", F.col("x.t").alias("text"), (-F.col("x.s")).alias("score"))


def repeated_deliveries(spark, d):
    return table(spark, d, "cells").groupBy("cell_id").agg(F.count("*").alias("n"), F.max("loaded_at").alias("last")).where("n > 1").select("cell_id", "n", "last")


def late_arrivals(spark, d):
    late = F.col("loaded_at") > F.col("captured_at") + F.expr("INTERVAL 1 DAY")
    return table(spark, d, "cells").groupBy("doc_key").agg(F.count_if(late).alias("n_late"), F.count("*").alias("n")).where("n_late > 0")


QUERIES = {
    f.__name__: f
    for f in (
        cells_once, norm_amount, norm_date, try_number, regex_entities, type_signature, concept_tags, context_line, kv_window, header_kind_profile, column_deviation, weak_cells, monitor_counters,
        confidence_bands, chunk_consistency, flat_cells, page_sections, table_shapes, tabulate_pivot, hotspots, hotspot_share, reanalysis_apply, header_mode, row_signature, diff_row_keys,
        header_rows_skipped, char_transitions, bigram_surprisal, second_difference, robust_column_count, fact_tags, html_rows, safe_paths, masked_numbers, ambiguous_variants, hypotheses,
        repeated_deliveries, late_arrivals,
    )
}

C1 = "c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1)"
_DATE = r"(20\d{2}|19\d{2})[./\-年](0?[1-9]|1[0-2])([./\-月](0?[1-9]|[12]\d|3[01])日?)?"
_T = "doc_key, page, table_index"
_ROWS = f"SELECT {_T}, row_idx, list({{'t': coalesce(text, ''), 'h': coalesce(header, '')}} ORDER BY col_idx, cell_id) AS a FROM c GROUP BY ALL"
_HK = "lower(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')))"
ORACLE = {
    "cells_once": f"WITH {C1} SELECT row_role, count(*) AS n, count(DISTINCT doc_key) AS n_docs FROM c GROUP BY row_role",
    "norm_amount": f"WITH {C1} SELECT cell_id, value FROM (SELECT cell_id, TRY_CAST(replace(regexp_extract(amount, '[¥￥$]?\\s*(\\d{{1,3}}(?:,\\d{{3}})+|\\d+)(?:\\.\\d+)?', 1), ',', '') AS BIGINT) AS value FROM c) WHERE value IS NOT NULL",
    "norm_date": f"WITH {C1}, m AS (SELECT cell_id, regexp_extract(text, '{_DATE}', 1) AS y, regexp_extract(text, '{_DATE}', 2) AS mo, regexp_replace(regexp_extract(text, '{_DATE}', 3), '[^0-9]', '', 'g') AS dd FROM c), j AS (SELECT cell_id, y || '-' || lpad(mo, 2, '0') || '-' || lpad(CASE WHEN dd = '' THEN '1' ELSE dd END, 2, '0') AS day FROM m WHERE y <> '') SELECT cell_id, day FROM j WHERE TRY_CAST(day AS DATE) IS NOT NULL",
    "try_number": f"WITH {C1} SELECT cell_id, number FROM (SELECT cell_id, TRY_CAST(translate(text, ',¥$€ ', '') AS DOUBLE) AS number FROM c) WHERE number IS NOT NULL",
    "regex_entities": r"SELECT party_id, postal, corporate FROM (SELECT party_id, nullif(regexp_extract(postal_code, '\b\d{3}-\d{4}\b'), '') AS postal, nullif(regexp_extract(corporate_id, '\b\d{13}\b'), '') AS corporate FROM parties) WHERE postal IS NOT NULL OR corporate IS NOT NULL",
    "context_line": f"WITH {C1}, r AS ({_ROWS}) SELECT {_T}, row_idx, array_to_string(list_transform(a, lambda x: x.h || '=' || x.t), ' | ') AS line FROM r",
    "header_kind_profile": f"WITH {C1} SELECT {_T}, col_idx, count(*) AS n, round(avg(regexp_matches(regexp_replace(text, '[,¥$€\\s]', '', 'g'), '^\\(?-?[0-9]+(\\.[0-9]+)?\\)?$')::INT), 6) AS numeric, round(avg(regexp_matches(text, '[¥$€]')::INT), 6) AS currency, round(avg(regexp_matches(text, '[0-9]\\.[0-9]')::INT), 6) AS decimal FROM c WHERE row_role = 'body' AND text <> '' GROUP BY ALL",
    "column_deviation": f"WITH {C1}, r AS (SELECT {_T}, row_idx, count(DISTINCT col_idx) AS n FROM c GROUP BY ALL), s AS (SELECT {_T}, n, count(*) AS k FROM r GROUP BY ALL), u AS (SELECT {_T}, n AS m FROM (SELECT *, row_number() OVER (PARTITION BY {_T} ORDER BY k DESC, n) AS rn FROM s) WHERE rn = 1) SELECT round(greatest(0.01, sum(k * abs(n - m) / greatest(m, 1)) / sum(k)), 6) AS deviation FROM s JOIN u USING ({_T})",
    "weak_cells": f"WITH {C1} SELECT cell_id FROM c WHERE coalesce(text, '') = '' OR coalesce(low_conf, false) OR coalesce(confidence, 1.0) < 0.55",
    "monitor_counters": f"WITH {C1} SELECT doc_domain, count(*) AS total, count(*) FILTER (WHERE low_conf) AS low, round(count(*) FILTER (WHERE low_conf) / count(*), 6) AS low_rate, count(company) AS named FROM c LEFT JOIN (SELECT doc_key, doc_domain FROM documents) USING (doc_key) GROUP BY doc_domain",
    "confidence_bands": f"WITH {C1} SELECT floor(confidence * 10)::BIGINT AS band, count(*) AS n, round(avg(confidence), 6) AS mean FROM c GROUP BY 1",
    "chunk_consistency": f"WITH {C1} SELECT round(sum(m) / sum(t), 6) AS consistency FROM (SELECT doc_key, page, max(n) AS m, sum(n) AS t FROM (SELECT {_T}, count(*) AS n FROM c GROUP BY ALL) GROUP BY doc_key, page)",
    "flat_cells": f"WITH {C1} SELECT cell_id, doc_key, page, row_idx, col_idx, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1, coalesce(trace_id, '') AS trace FROM c",
    "page_sections": f"WITH {C1}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_key, page ORDER BY table_index, row_idx, col_idx, cell_id) AS i FROM c), g AS (SELECT doc_key, page, list(coalesce(text, '') ORDER BY i) AS a FROM r WHERE i <= 40 GROUP BY ALL) SELECT doc_key, page, len(a)::INT AS n_cells, length(array_to_string(a, chr(10))) AS n_chars, md5(array_to_string(a, chr(10))) AS digest FROM g",
    "table_shapes": f"WITH {C1} SELECT {_T}, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols, count(*) AS n_cells FROM c GROUP BY ALL",
    "tabulate_pivot": f"WITH {C1}, w AS (SELECT {_T}, unnest(range(max(col_idx) + 1)) AS col_idx FROM c GROUP BY {_T}), r AS (SELECT DISTINCT {_T}, row_idx FROM c), p AS (SELECT {_T}, row_idx, col_idx, arg_max_null(text, cell_id) AS text FROM c GROUP BY ALL) SELECT {_T}, row_idx, string_agg(coalesce(text, ''), chr(9) ORDER BY col_idx) AS texts FROM r JOIN w USING ({_T}) LEFT JOIN p USING ({_T}, row_idx, col_idx) GROUP BY ALL",
    "hotspots": f"WITH {C1}, g AS (SELECT grouping_id(doc_key, page, table_index, row_idx) AS level, {_T}, row_idx, count(*) AS score, count(*) AS n FROM c WHERE low_conf GROUP BY GROUPING SETS ((doc_key), ({_T}), ({_T}, row_idx))) SELECT level, rank, {_T}, row_idx, score, n FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, n DESC, doc_key, page NULLS FIRST, table_index NULLS FIRST, row_idx NULLS FIRST) AS rank FROM g) WHERE rank <= 8",
    "hotspot_share": f"WITH {C1}, r AS (SELECT {_T}, row_idx, count(*) AS n FROM c WHERE low_conf GROUP BY ALL) SELECT round((SELECT sum(n) FROM (SELECT n FROM r ORDER BY n DESC, doc_key, page, table_index, row_idx LIMIT 16)) / sum(n), 6) AS share FROM r",
    "reanalysis_apply": f"WITH {C1}, b AS (SELECT trace_id, text AS nt FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY loaded_at DESC, text DESC NULLS LAST) AS rn FROM cells_b WHERE trace_id <> '') WHERE rn = 1) SELECT cell_id, nt AS text, 0.75::DOUBLE AS confidence FROM c JOIN b USING (trace_id) WHERE 0.75 > coalesce(confidence, 0)",
    "header_mode": f"WITH {C1}, h AS (SELECT doc_key, col_idx, {_HK.format(x='header')} AS h, count(*) AS n FROM c WHERE header IS NOT NULL GROUP BY ALL) SELECT doc_key, col_idx, h, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, col_idx ORDER BY n DESC, h) AS rn FROM h) WHERE rn = 1",
    "row_signature": f"WITH {C1}, r AS ({_ROWS}) SELECT {_T}, row_idx, substr(sha1(array_to_string(list_transform(a, lambda x: x.t), '|')), 1, 10) AS signature FROM r",
    "diff_row_keys": f"WITH {C1}, k AS (SELECT {_T}, row_idx, coalesce(first(text ORDER BY col_idx, cell_id), '') AS key FROM c GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY {_T}, key ORDER BY row_idx) AS n FROM k) SELECT {_T}, row_idx, CASE WHEN n = 1 THEN key ELSE key || '#' || n END AS row_key FROM n",
    "header_rows_skipped": f"WITH {C1}, f AS (SELECT *, min(row_idx) OVER (PARTITION BY {_T}) AS m FROM c) SELECT {_T} FROM f WHERE row_idx = m GROUP BY ALL HAVING bool_and({_HK.format(x='text')} = {_HK.format(x='header')})",
    "char_transitions": f"WITH {C1}, x AS (SELECT cell_id, unnest(string_split(header, '')) AS ch, generate_subscripts(string_split(header, ''), 1) AS i FROM c WHERE header IS NOT NULL), l AS (SELECT ch, lag(ch) OVER (PARTITION BY cell_id ORDER BY i) AS before FROM x) SELECT before, ch, count(*) AS n FROM l WHERE before IS NOT NULL AND ch <> '' GROUP BY ALL",
    "second_difference": f"WITH {C1}, h AS (SELECT {_T}, row_idx, max(bbox[4] - bbox[2]) AS h FROM c GROUP BY ALL), e AS (SELECT {_T}, lead(h) OVER w - 2 * h + lag(h) OVER w AS e FROM h WINDOW w AS (PARTITION BY {_T} ORDER BY row_idx)) SELECT {_T}, sum(e * e)::BIGINT AS energy FROM e GROUP BY ALL",
    "fact_tags": f"WITH {C1} SELECT cell_id, '<fact trace=\"' || doc_key || '/p' || page || '/t' || table_index || '/r' || row_idx || '/c' || col_idx || '\">' || replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;') || '</fact>' AS tag FROM c",
    "html_rows": f"WITH {C1}, r AS ({_ROWS}) SELECT {_T}, row_idx, '<tr>' || array_to_string(list_transform(a, lambda x: '<td>' || x.t || '</td>'), '') || '</tr>' AS html FROM r",
    "safe_paths": "SELECT item_id, regexp_replace(regexp_replace(query, '[^A-Za-z0-9\\-_.]+', '_', 'g'), '^_+|_+$', '', 'g') AS segment, CASE WHEN length(passage) > 120 THEN substr(passage, 1, 119) || '…' ELSE passage END AS clipped, md5(passage) AS digest FROM eval_items",
    "masked_numbers": f"WITH {C1} SELECT regexp_replace(text, '[-+]?[¥$€£]?\\d[\\d,]*(?:\\.\\d+)?%?', '<num>', 'g') AS mask, count(*) AS n FROM c WHERE text IS NOT NULL GROUP BY 1",
    "hypotheses": f"""WITH {C1}, h AS (SELECT cell_id, unnest([{{'s': 0.6, 't': text}}, {{'s': 0.5, 't': translate(text, 'OoIlSBZ', '0011582')}}, {{'s': 0.45, 't': regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')}}, {{'s': 0.4, 't': regexp_replace(text, '[^0-9]', '', 'g')}}, {{'s': 0.35, 't': upper(text)}},
      {{'s': 0.3, 't': regexp_replace(text, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '', 'g')}}]) AS x FROM c WHERE low_conf AND text <> ''), o AS (SELECT cell_id, x.t AS text, max(x.s)::DOUBLE AS score FROM h WHERE x.t <> '' GROUP BY ALL) SELECT cell_id, (row_number() OVER (PARTITION BY cell_id ORDER BY score DESC) - 1)::INT AS rank, text, score FROM o""",
    "ambiguous_variants": f"WITH {C1} SELECT cell_id, unnest(list_distinct([text, translate(text, '01', 'OI'), translate(text, 'OI', '01'), translate(text, '58', 'SB')])) AS variant FROM c WHERE regexp_full_match(text, '[A-Z]{{2}}-[0-9]+')",
    "repeated_deliveries": "SELECT cell_id, count(*) AS n, max(loaded_at) AS last FROM cells GROUP BY cell_id HAVING count(*) > 1",
    "late_arrivals": "SELECT doc_key, count(*) FILTER (WHERE loaded_at > captured_at + INTERVAL 1 DAY) AS n_late, count(*) AS n FROM cells GROUP BY doc_key HAVING n_late > 0",
}

# Classes of tokens and kinds of characters, said in SQL.
_TOKEN = r"regexp_replace(regexp_replace(trim(tok), '^[()\[\]{}]+|[()\[\]{}]+$', '', 'g'), '[.,;:、。]+$', '')"
_CLASSES = (
    r"CASE WHEN t = '' THEN 'TEXT' WHEN regexp_full_match(t, '[-+]?\d[\d,]*(\.\d+)?%?') THEN 'NUM' WHEN regexp_full_match(lower(t), '(mm|cm|m|kg|g|t|kpa|mpa|bar|v|a|w|hz|rpm|min|h|s|pcs|個|枚|本|箱)') THEN 'UNIT' "
    r"WHEN regexp_full_match(upper(t), '[A-Z]{1,4}-?\d[\dA-Z-]*') THEN 'ID' WHEN regexp_full_match(t, '[^A-Za-z0-9぀-鿿]+') THEN 'SYM' ELSE 'TEXT' END"
)
SIGNATURES = rf"""k AS (SELECT cell_id, generate_subscripts(a, 1) AS i, unnest(a) AS tok FROM (SELECT cell_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS a FROM c)),
  l AS (SELECT cell_id, i, {_CLASSES} AS kind FROM (SELECT cell_id, i, {_TOKEN} AS t FROM k)), m AS (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY cell_id ORDER BY i) AS keep FROM l),
  g AS (SELECT c.cell_id, any_value(c.text) AS text, coalesce(string_agg(kind, '-' ORDER BY i) FILTER (WHERE keep), '') AS signature FROM c LEFT JOIN m USING (cell_id) GROUP BY c.cell_id)"""
_TAGS = [
    ("alpha", "regexp_matches(text, '[A-Za-z]')"), ("currency", "regexp_matches(text, '[¥$€]')"), ("date", f"regexp_matches(text, '{V.DATE}')"), ("decimal", "regexp_matches(text, '[0-9][.][0-9]')"), ("digit", "regexp_matches(text, '[0-9]')"),
    ("integer", "regexp_full_match(text, '[0-9]+')"), ("lower", "regexp_full_match(text, '[^A-Z]*[a-z][^A-Z]*')"), ("upper", "regexp_full_match(text, '[^a-z]*[A-Z][^a-z]*')"),
]
ORACLE["type_signature"] = f"WITH {C1}, {SIGNATURES} SELECT signature, count(*) AS n FROM g GROUP BY signature"
ORACLE["concept_tags"] = f"WITH {C1} SELECT tags, count(*) AS n FROM (SELECT concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _TAGS) + ") AS tags FROM c WHERE text IS NOT NULL) GROUP BY tags"
ORACLE["robust_column_count"] = f"""WITH {C1}, r AS (SELECT {_T}, row_idx, count(*) AS n FROM c GROUP BY ALL), j AS (SELECT *, coalesce((abs(n - lag(n) OVER w) > 1)::INT, 0) AS jump FROM r WINDOW w AS (PARTITION BY {_T} ORDER BY row_idx)), u AS (SELECT *, sum(jump) OVER (PARTITION BY {_T} ORDER BY row_idx) AS run FROM j),
  l AS (SELECT {_T}, run, length FROM (SELECT *, row_number() OVER (PARTITION BY {_T} ORDER BY length DESC, run) AS rn FROM (SELECT {_T}, run, count(*) AS length FROM u GROUP BY ALL)) WHERE rn = 1), k AS (SELECT {_T}, length, n, count(*) AS k FROM u JOIN l USING ({_T}, run) GROUP BY ALL)
  SELECT {_T}, length, n AS n_cols FROM (SELECT *, row_number() OVER (PARTITION BY {_T} ORDER BY k DESC, n) AS rn FROM k) WHERE rn = 1"""
_ASKED = ", ".join(f"arg_max(coalesce(text, ''), (col_idx, cell_id)) FILTER (WHERE header = '{h}') AS q{i}" for i, h in enumerate(("Qty", "Quantity", "Quantité", "数量")))
ORACLE["kv_window"] = f"WITH {C1}, k AS (SELECT {_T}, row_idx, {_ASKED} FROM c GROUP BY ALL) SELECT * FROM (SELECT {_T}, row_idx, TRY_CAST(regexp_extract(coalesce(q0, q1, q2, q3), '[0-9]+') AS BIGINT) AS qty FROM k) WHERE qty IS NOT NULL"
ORACLE["bigram_surprisal"] = f"""WITH t AS (SELECT DISTINCT title FROM sections WHERE length(title) >= 2), g AS (SELECT title, unnest(list_transform(range(1, length(title)), lambda i: substr(title, i, 2))) AS g FROM t), p AS (SELECT g, count(*) AS c FROM g GROUP BY g), l AS (SELECT substr(g, 1, 1) AS a, sum(c) AS ca FROM p GROUP BY 1),
  v AS (SELECT greatest(count(DISTINCT substr(g, 2, 1)), 8) AS v FROM p), b AS (SELECT p.g, -log2((c + 1) / (ca + v)) AS bits FROM p JOIN l ON a = substr(p.g, 1, 1), v) SELECT title, round(avg(bits), 6) AS surprisal FROM g JOIN b USING (g) GROUP BY title"""
