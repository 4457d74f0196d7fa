"""Queries on fields, labels, headings, statistics of exports, and tables matched by content."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folioscope.functions import words
from folioscope.operators import cells as C, fields as X, layout as L, matching as M
from folioscope.plans.cells import C1, cells_of
from folioscope.runtime import table


def heading_lines(spark, d):
    return X.heading_lines(table(spark, d, "documents"), "doc_id", "text")


def line_sections(spark, d):
    """Heading paths of the documents' lines: how many headings stand how deep."""
    p = L.heading_paths(heading_lines(spark, d), ["doc_id"], ["line"], "level", "heading")
    return p.groupBy("level", F.size("path").alias("depth")).agg(F.count("*").alias("n"))


def line_labels(spark, d):
    """Labels of the lines of the sections' titles and cells' texts, numbers taken out."""
    t = table(spark, d, "sections").select(F.col("title").alias("t")).where("t IS NOT NULL").distinct()
    return t.select("t", X.line_label(F.col("t")).alias("label"))


def header_variants(spark, d):
    return cells_of(spark, d).where("header IS NOT NULL").select("header").distinct().select("header", F.array_join(X.header_variants(F.col("header")), "|").alias("variants"))


def schema_tokens(spark, d):
    return cells_of(spark, d).groupBy(X.schema_token(F.col("header")).alias("token")).agg(F.count("*").alias("n"))


def html_headers(spark, d):
    """Headers written to HTML and read back."""
    text = F.coalesce("text", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    h = cells_of(spark, d).where("row_role = 'header'").groupBy(*C.TABLE).agg(F.array_sort(F.collect_list(F.struct("col_idx", "cell_id", F.concat(F.lit("<th><b>"), text, F.lit("</b></th>")).alias("t")))).alias("a"))
    html = F.concat(F.lit("<tr>"), F.array_join(F.transform("a", lambda x: x["t"]), ""), F.lit("</tr>"))
    return h.select(*C.TABLE, F.array_join(X.html_headers(html), "|").alias("headers"))


def row_keywords(spark, d):
    """Up to twelve numbers and dates of each row, sorted."""
    c = cells_of(spark, d).where("text IS NOT NULL").select(*C.TABLE, "row_idx", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9][0-9,.\-/]*[0-9]|[0-9])"), F.lit(1))).alias("k")).distinct()
    return c.groupBy(*C.TABLE, "row_idx").agg(F.array_join(F.slice(F.array_sort(F.collect_list("k")), 1, 12), " ").alias("keywords"))


def date_roles(spark, d):
    """What the dates in the documents' lines are for."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"[12][0-9]{3}-[0-9]{2}-[0-9]{2}"))
    day = F.regexp_extract("line", r"([12][0-9]{3}-[0-9]{2}-[0-9]{2})", 1)
    return lines.groupBy("doc_id", X.date_role(F.col("line")).alias("role")).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def entity_fields(spark, d):
    """Tax numbers, phone numbers and percentages in the documents."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    n = lambda p: F.size(F.regexp_extract_all("t", F.lit(p), F.lit(0)))
    return t.select("doc_id", n(X.TAX_ID).alias("n_tax"), n(X.PHONE).alias("n_phone"), n(X.PERCENT).alias("n_percent")).where("n_tax + n_phone + n_percent > 0")


def company_fields(spark, d):
    """Names that carry a company form, and the whole number where there is one."""
    p = table(spark, d, "parties").where("company IS NOT NULL")
    number = F.nullif(F.regexp_extract(F.regexp_replace(F.coalesce("corporate_id", F.lit("")), "[^0-9]", ""), "^([0-9]{13})$", 1), F.lit(""))
    return p.select("party_id", F.when(F.col("company").rlike(X.COMPANY_FORMS), F.trim("company")).alias("name"), number.alias("number")).where("name IS NOT NULL OR number IS NOT NULL")


def address_fields(spark, d):
    """Addresses that begin with a prefecture."""
    p = table(spark, d, "parties").select("party_id", F.trim("address").alias("a"), F.regexp_extract(F.trim("address"), X.PREFECTURE, 1).alias("prefecture"))
    return p.where("prefecture <> ''").select("party_id", "prefecture", F.length("a").alias("n_chars"))


def row_fields(spark, d):
    return X.row_fields(cells_of(spark, d))


def money_values(spark, d):
    return cells_of(spark, d).select("cell_id", F.round(X.money(F.col("amount")), 4).alias("value")).where("value IS NOT NULL")


def column_kinds(spark, d):
    return X.column_kinds(cells_of(spark, d))


def restored_separators(spark, d):
    return X.restore_separators(cells_of(spark, d))


def profile_differences(spark, d):
    """Profiles of each document in both section systems, as paths and values, wherever they differ."""

    def profile(system):
        s = C.delivered_once(table(spark, d, "sections"), ["section_id", "system_name"]).where(F.col("system_name") == system)
        p = s.groupBy("doc_key").agg(F.count("*").alias("n"), F.max("heading_level").alias("deepest"), F.min("page").alias("first"), F.max("page").alias("last"), F.min_by("title", F.struct("section_order", "section_id")).alias("t"))
        paths = {"sections.count": "n", "sections.deepest": "deepest", "pages.first": "first", "pages.last": "last", "title": "t"}
        rows = F.explode(F.array(*(F.struct(F.lit(k).alias("path"), F.col(c).cast("string").alias("value")) for k, c in paths.items())))
        return p.select("doc_key", rows.alias("x")).select("doc_key", "x.path", "x.value")

    return X.map_differences(profile("a"), profile("b"), ["doc_key"])


def export_signals(spark, d):
    """Shares of cells with low confidence, without text, and marked for review, by role."""
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("int"), F.lit(0))), 6)
    return cells_of(spark, d).groupBy("row_role").agg(
        F.count("*").alias("n"), share(F.col("low_conf")).alias("low"), share(F.col("confidence") < 0.58).alias("unsure"), share(F.coalesce("text", F.lit("")) == "").alias("blank"), F.round(F.median("confidence"), 6).alias("median_confidence")
    )


def reanalysis_summary(spark, d):
    """What the other copy's reading did to low-confidence cells: longer, shorter, equal, lost."""
    b = C.delivered_once(table(spark, d, "cells_b")).select("cell_id", F.col("text").alias("t"), F.lit(1).alias("there"))
    j = cells_of(spark, d).where("low_conf").join(b, "cell_id", "left")
    what = F.when(F.col("there").isNull(), "missing").when(F.col("text").eqNullSafe(F.col("t")), "unchanged").when(F.col("t").isNull(), "lost").when(F.length("t") > F.length(F.coalesce("text", F.lit(""))), "longer").otherwise("other")
    gap = F.length(F.coalesce("t", F.lit(""))) - F.length(F.coalesce("text", F.lit("")))
    return j.groupBy(what.alias("outcome")).agg(F.count("*").alias("n"), F.min(F.when(F.col("there") == 1, gap)).alias("least"), F.max(F.when(F.col("there") == 1, gap)).alias("most"))


def title_mentions(spark, d):
    """Sections whose title, without its number, is named in the text of their own document."""
    s = C.delivered_once(table(spark, d, "sections"), ["section_id", "system_name"]).select("section_id", "system_name", "doc_key", F.lower(F.trim(F.regexp_replace("title", r"^[0-9.]+ ", ""))).alias("t")).where("t <> ''")
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_key", F.lower("text").alias("x"))
    return s.join(docs, "doc_key").where(F.contains("x", "t")).select("section_id", "system_name")


def nearest_sections(spark, d):
    """For each section of one system the nearest section of the other in order."""
    s = C.delivered_once(table(spark, d, "sections"), ["section_id", "system_name"])
    side = lambda n: s.where(F.col("system_name") == n).select("doc_key", "section_order", "section_id")
    return X.nearest_by_order(side("a"), side("b"), ["doc_key"], "section_order", "section_id")


def heading_coherence(spark, d):
    """How usual the letters of a header are: geometric mean probability and mean surprisal of its pairs, add-one smoothed over all headers."""
    h = cells_of(spark, d).where("length(header) >= 2").select(F.lower("header").alias("h"))
    pairs = h.select("h", F.explode(F.transform(F.sequence(F.lit(1), F.length("h") - 1), lambda i: F.substr("h", i, F.lit(2)))).alias("p")).select("h", "p", F.substr("p", F.lit(1), F.lit(1)).alias("c"))
    counts, firsts = pairs.groupBy("p").agg(F.count("*").alias("n")), pairs.groupBy("c").agg(F.count("*").alias("m"))
    size = pairs.select(F.count_distinct("c").alias("v"))
    own = h.distinct().select("h", F.explode(F.transform(F.sequence(F.lit(1), F.length("h") - 1), lambda i: F.substr("h", i, F.lit(2)))).alias("p")).withColumn("c", F.substr("p", F.lit(1), F.lit(1)))
    j = own.join(counts, "p").join(firsts, "c").crossJoin(F.broadcast(size))  # one row
    log = F.log((F.col("n") + 1) / (F.col("m") + F.col("v")))
    return j.groupBy("h").agg(F.round(F.exp(F.avg(log)), 6).alias("coherence"), F.round(-F.avg(log) / F.log(F.lit(2.0)), 6).alias("surprisal"))


def matched_table_events(spark, d):
    """Differences between the tables of both copies matched by content, by kind."""
    a, b = (C.delivered_once(table(spark, d, t)) for t in ("cells", "cells_b"))
    return M.diff_tables(a, b).groupBy("doc_key", "page", "event").agg(F.count("*").alias("n"))


def handoff_by_domain(spark, d):
    """Changed cells by the domain of their document and what to do about them."""
    b = C.delivered_once(table(spark, d, "cells_b")).select("cell_id", F.col("text").alias("t"))
    j = cells_of(spark, d).join(b, "cell_id").where(~F.col("text").eqNullSafe(F.col("t"))).join(table(spark, d, "documents").select("doc_key", "doc_domain"), "doc_key", "left")
    action = F.when(F.col("low_conf"), "read again").when(F.col("text").rlike("[0-9]"), "check number").otherwise("check text")
    return j.groupBy(F.coalesce("doc_domain", F.lit("-")).alias("domain"), action.alias("action")).agg(F.count("*").alias("n"), F.count_distinct("doc_key").alias("n_docs"))


def latest_per_hour(spark, d):
    """The last event of every hour and type, and the change of its value to the hour before."""
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    w = Window.partitionBy("event_type").orderBy("hour")
    return e.select("event_type", F.unix_timestamp("hour").alias("hour"), F.round("value", 4).alias("value"), F.round(F.col("value") - F.lag("value").over(w), 4).alias("change"))


QUERIES = {
    f.__name__: f
    for f in (
        heading_lines, line_sections, line_labels, header_variants, schema_tokens, html_headers, row_keywords, date_roles, entity_fields, company_fields, address_fields, row_fields, money_values, column_kinds,
        restored_separators, profile_differences, export_signals, reanalysis_summary, title_mentions, nearest_sections, heading_coherence, matched_table_events, handoff_by_domain, latest_per_hour,
    )
}

_T = "doc_key, page, table_index"
_B1 = "b AS (SELECT * FROM cells_b QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) = 1)"
_S1 = "s AS (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY section_id, system_name ORDER BY loaded_at DESC) = 1)"
_WS = "[ \\t\\n\\r\\f\\v]+"
_KEY = f"lower(trim(regexp_replace(coalesce({{c}}, ''), '{_WS}', ' ', 'g')))"
_LETTERS = "0-9a-zà-öø-ÿ぀-ヿ一-鿿"
_NUM = "regexp_replace(regexp_extract(text, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '', 'g')"


def _kind(*names: str) -> str:
    return f"max(TRY_CAST({_NUM} AS DOUBLE)) FILTER (WHERE {_KEY.format(c='header')} IN ({', '.join(repr(n) for n in names)}))"


ORACLE = {
    "heading_lines": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line, regexp_replace(unnest(a), '[\\r\\t]', ' ', 'g') AS raw, a FROM l),
      y AS (SELECT doc_id, line, raw, trim(raw, ' ') AS p, trim(regexp_replace(coalesce(a[line + 2], ''), '[\\r\\t]', ' ', 'g'), ' ') AS below, regexp_extract(raw, '{X.MARKDOWN}', 1) AS m FROM x),
      z AS (SELECT doc_id, line, CASE WHEN m <> '' THEN regexp_extract(raw, '{X.MARKDOWN}', 2) ELSE p END AS heading, CASE WHEN p = '' THEN NULL WHEN m <> '' THEN length(m) WHEN regexp_full_match(below, '[=\\-]{{3,}}') THEN CASE WHEN starts_with(below, '=') THEN 1 ELSE 2 END
        WHEN regexp_matches(p, '{X.ARTICLE}') OR regexp_matches(lower(p), '{X.KEYWORD}') THEN 2 END AS level FROM y) SELECT * FROM z WHERE level IS NOT NULL""",
    "line_labels": f"SELECT t, trim(trim(regexp_replace(replace(regexp_replace(t, '[-+]?[¥$€£]?\\d[\\d,]*(?:\\.\\d+)?%?', '<num>', 'g'), '<num>', ''), '{_WS}', ' ', 'g'), ' '), ' :|-•') AS label FROM (SELECT DISTINCT title AS t FROM sections WHERE title IS NOT NULL)",
    "header_variants": f"""WITH {C1}, k AS (SELECT DISTINCT header, {_KEY.format(c='header')} AS h FROM c WHERE header IS NOT NULL) SELECT header, array_to_string(list_sort(list_distinct(list_filter([h, replace(h, ' ', ''), trim(regexp_replace(h, '[(\\[（【][^)\\]）】]*[)\\]）】]', '', 'g')), regexp_replace(h, '[^{_LETTERS} ]', '', 'g')], lambda x: x <> ''))), '|') AS variants FROM k""",
    "schema_tokens": f"WITH {C1} SELECT regexp_replace(lower(coalesce(header, '')), '[^{_LETTERS}]', '', 'g') AS token, count(*) AS n FROM c GROUP BY 1",
    "html_headers": f"WITH {C1} SELECT {_T}, array_to_string(list(coalesce(text, '') ORDER BY col_idx, cell_id), '|') AS headers FROM c WHERE row_role = 'header' GROUP BY ALL",
    "row_keywords": f"WITH {C1}, k AS (SELECT DISTINCT {_T}, row_idx, unnest(regexp_extract_all(text, '([0-9][0-9,.\\-/]*[0-9]|[0-9])', 1)) AS k FROM c WHERE text IS NOT NULL) SELECT {_T}, row_idx, array_to_string(list(k ORDER BY k)[1:12], ' ') AS keywords FROM k GROUP BY ALL",
    "date_roles": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, regexp_extract(line, '([12][0-9]{3}-[0-9]{2}-[0-9]{2})', 1) AS day, CASE " + " ".join(f"WHEN regexp_matches(lower(line), '{p}') THEN '{r}'" for r, p in X.DATE_ROLES) + " ELSE 'date' END AS role FROM l WHERE regexp_matches(line, '[12][0-9]{3}-[0-9]{2}-[0-9]{2}')) SELECT doc_id, role, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM r GROUP BY doc_id, role",
    "entity_fields": f"SELECT * FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{X.TAX_ID}')) AS n_tax, len(regexp_extract_all(coalesce(text, ''), '{X.PHONE}')) AS n_phone, len(regexp_extract_all(coalesce(text, ''), '{X.PERCENT}')) AS n_percent FROM documents) WHERE n_tax + n_phone + n_percent > 0",
    "company_fields": f"SELECT * FROM (SELECT party_id, CASE WHEN regexp_matches(company, '{X.COMPANY_FORMS}') THEN trim(company, ' ') END AS name, nullif(regexp_extract(regexp_replace(coalesce(corporate_id, ''), '[^0-9]', '', 'g'), '^([0-9]{{13}})$', 1), '') AS number FROM parties WHERE company IS NOT NULL) WHERE name IS NOT NULL OR number IS NOT NULL",
    "address_fields": f"SELECT * FROM (SELECT party_id, regexp_extract(trim(address, ' '), '{X.PREFECTURE}', 1) AS prefecture, length(trim(address, ' ')) AS n_chars FROM parties) WHERE prefecture <> ''",
    "row_fields": f"WITH {C1}, r AS (SELECT {_T}, row_idx, {_kind('qty', 'quantity', 'qté', 'quantité', '数量')} AS qty, {_kind('unit price', 'price', 'prix unitaire', 'p.u.', '単価')} AS unit_price, {_kind('amount', 'montant', '金額')} AS amount FROM c WHERE row_role <> 'header' GROUP BY ALL) SELECT * FROM r WHERE qty IS NOT NULL OR unit_price IS NOT NULL OR amount IS NOT NULL",
    "money_values": f"""WITH {C1}, t AS (SELECT cell_id, lower(translate(amount, '，．', ',.')) AS t FROM c), p AS (SELECT cell_id, t, TRY_CAST(regexp_replace(regexp_extract(t, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '', 'g') AS DOUBLE) AS v, regexp_extract(t, '[0-9] ?(億|万|千|bn|mm|m|b|k)(?:[^a-z]|$)', 1) AS w FROM t)
      SELECT cell_id, round(CASE WHEN regexp_matches(t, '^[^0-9]*[-−△▲][^0-9]*[0-9]|\\([^0-9)]*[0-9][^)]*\\)') THEN -1 ELSE 1 END * v * CASE w WHEN '億' THEN 1e8 WHEN '万' THEN 1e4 WHEN '千' THEN 1e3 WHEN 'bn' THEN 1e9 WHEN 'mm' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 'k' THEN 1e3 ELSE 1 END, 4) AS value FROM p WHERE v IS NOT NULL""",
    "column_kinds": f"""WITH {C1}, g AS (SELECT {_T}, col_idx, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(text, '[-+(]?[¥$€]?[0-9][0-9,. ]*€?\\)?')) AS n_number, count(*) FILTER (WHERE regexp_matches(text, '[0-9],[0-9]{{3}}')) AS n_grouped, count(*) FILTER (WHERE regexp_matches(text, '[0-9] *%')) AS n_percent FROM c WHERE row_role = 'body' AND text <> '' GROUP BY ALL)
      SELECT *, CASE WHEN n_percent > n / 2 THEN 'percent' WHEN n_grouped > n / 2 THEN 'amount' WHEN n_number > n / 2 THEN 'number' ELSE 'text' END AS kind FROM g""",
    "restored_separators": f"WITH {C1}, g AS (SELECT {_T}, col_idx FROM c WHERE row_role = 'body' AND regexp_matches(text, '[0-9],[0-9]{{3}}') GROUP BY ALL HAVING count(*) >= 2) SELECT cell_id, text, format('{{:,}}', text::BIGINT) AS restored FROM c JOIN g USING ({_T}, col_idx) WHERE row_role = 'body' AND regexp_full_match(text, '[0-9]{{4,18}}')",
    "profile_differences": f"""WITH {_S1}, p AS (SELECT doc_key, system_name, count(*) AS n, max(heading_level) AS deepest, min(page) AS first, max(page) AS last, arg_min_null(title, (section_order, section_id)) AS t FROM s GROUP BY ALL),
      q AS (SELECT doc_key, system_name, unnest([{{'path': 'sections.count', 'value': n::VARCHAR}}, {{'path': 'sections.deepest', 'value': deepest::VARCHAR}}, {{'path': 'pages.first', 'value': first::VARCHAR}}, {{'path': 'pages.last', 'value': last::VARCHAR}}, {{'path': 'title', 'value': t}}], recursive := true) FROM p)
      SELECT doc_key, path, a.value AS local, b.value AS "foreign" FROM (SELECT * FROM q WHERE system_name = 'a') a FULL JOIN (SELECT * FROM q WHERE system_name = 'b') b USING (doc_key, path) WHERE a.value IS DISTINCT FROM b.value""",
    "export_signals": f"WITH {C1} SELECT row_role, count(*) AS n, round(avg(coalesce(low_conf::INT, 0)), 6) AS low, round(avg(coalesce((confidence < 0.58)::INT, 0)), 6) AS unsure, round(avg((coalesce(text, '') = '')::INT), 6) AS blank, round(median(confidence), 6) AS median_confidence FROM c GROUP BY row_role",
    "reanalysis_summary": f"WITH {C1}, {_B1}, j AS (SELECT c.text AS o, b.text AS t, b.cell_id IS NOT NULL AS there FROM c LEFT JOIN b USING (cell_id) WHERE low_conf) SELECT CASE WHEN NOT there THEN 'missing' WHEN o IS NOT DISTINCT FROM t THEN 'unchanged' WHEN t IS NULL THEN 'lost' WHEN length(t) > length(coalesce(o, '')) THEN 'longer' ELSE 'other' END AS outcome, count(*) AS n, min(length(coalesce(t, '')) - length(coalesce(o, ''))) FILTER (WHERE there) AS least, max(length(coalesce(t, '')) - length(coalesce(o, ''))) FILTER (WHERE there) AS most FROM j GROUP BY 1",
    "title_mentions": f"WITH {_S1}, t AS (SELECT section_id, system_name, doc_key, lower(trim(regexp_replace(title, '^[0-9.]+ ', ''), ' ')) AS t FROM s) SELECT section_id, system_name FROM t JOIN documents USING (doc_key) WHERE t <> '' AND contains(lower(text), t)",
    "nearest_sections": f"WITH {_S1}, j AS (SELECT a.doc_key, a.section_id, b.section_id AS nearest, abs(a.section_order - b.section_order) AS gap, row_number() OVER (PARTITION BY a.doc_key, a.section_id ORDER BY abs(a.section_order - b.section_order), b.section_order, b.section_id) AS rn FROM s a JOIN s b ON a.doc_key = b.doc_key AND a.system_name = 'a' AND b.system_name = 'b') SELECT doc_key, section_id, nearest, gap FROM j WHERE rn = 1",
    "heading_coherence": f"""WITH {C1}, h AS (SELECT lower(header) AS h FROM c WHERE length(header) >= 2), p AS (SELECT h, unnest(list_transform(range(1, length(h)), lambda i: substr(h, i, 2))) AS p FROM h), n AS (SELECT p, count(*) AS n FROM p GROUP BY p), m AS (SELECT substr(p, 1, 1) AS c, count(*) AS m FROM p GROUP BY 1),
      o AS (SELECT h, unnest(list_transform(range(1, length(h)), lambda i: substr(h, i, 2))) AS p FROM (SELECT DISTINCT h FROM h)), l AS (SELECT h, ln((n + 1) / (m + (SELECT count(*) FROM m))) AS l FROM o JOIN n USING (p) JOIN m ON m.c = substr(p, 1, 1)) SELECT h, round(exp(avg(l)), 6) AS coherence, round(-avg(l) / ln(2), 6) AS surprisal FROM l GROUP BY h""",
    "handoff_by_domain": f"WITH {C1}, {_B1} SELECT coalesce(doc_domain, '-') AS domain, CASE WHEN low_conf THEN 'read again' WHEN regexp_matches(c.text, '[0-9]') THEN 'check number' ELSE 'check text' END AS action, count(*) AS n, count(DISTINCT c.doc_key) AS n_docs FROM c JOIN b USING (cell_id) LEFT JOIN documents ON documents.doc_key = c.doc_key WHERE c.text IS DISTINCT FROM b.text GROUP BY 1, 2",
    "latest_per_hour": "WITH e AS (SELECT event_type, date_trunc('hour', ts) AS hour, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL) SELECT event_type, epoch(hour)::BIGINT AS hour, round(value, 4) AS value, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY hour), 4) AS change FROM e",
}
