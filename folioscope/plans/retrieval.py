"""Queries over the corpus: token statistics, BM25, fusion, vectors and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import words
from folioscope.operators import retrieval as R
from folioscope.runtime import table

QUERY = ["flange", "cold", "store", "flange"]
QUERY_2 = ["invoice", "gearbox"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "doc_domain")




def _t():
    return words.plain_tokens(F.col("text"))


def df_stats(spark, d):
    return R.document_frequency(_docs(spark, d), "doc_id", _t())


def tf_top(spark, d):
    """The 50 most frequent tokens of the corpus with their number of occurrences."""
    p = R.postings(_docs(spark, d), "doc_id", _t())
    return p.groupBy("token").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "token").limit(50)


def corpus_stats(spark, d):
    return R.corpus_stats(_docs(spark, d), "doc_id", _t()).select("n", F.round("avgdl", 6).alias("avgdl"))


def doclen_summary(spark, d):
    n = R.lengths(_docs(spark, d), "doc_id", _t())
    return n.agg(
        F.min("dl").alias("shortest"), F.max("dl").alias("longest"), F.round(F.avg("dl"), 6).alias("mean"),
        F.round(F.percentile("dl", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("dl", F.lit(0.95)), 6).alias("p95"),
    )


def bm25_topk(spark, d):
    return R.top(R.bm25(_docs(spark, d), "doc_id", _t(), QUERY), "doc_id", 10)


def bm25_by_language(spark, d):
    """Best document of each language for the query."""
    s = R.bm25(_docs(spark, d), "doc_id", _t(), QUERY)
    j = s.join(_docs(spark, d).select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang")), "doc_id").withColumn("s", F.round("score", 6))
    return j.groupBy("lang").agg(F.max(F.struct("s", (-F.col("doc_id")).alias("k"))).alias("m")).select("lang", (-F.col("m.k")).alias("doc_id"), F.col("m.s").alias("score"))


def rrf_merge(spark, d):
    docs = _docs(spark, d)
    lists = [R.top(R.bm25(docs, "doc_id", _t(), q), "doc_id", 50) for q in (QUERY, QUERY_2)]
    return R.reciprocal_ranks(lists, "doc_id", 10)


def cosine_topk(spark, d):
    """Nearest vectors to the vector 0."""
    e = table(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select("embedding").first().embedding
    return R.nearest(e, "vec_id", "embedding", probe, 10)


def centroid_norms(spark, d):
    """Length of the mean vector of each label."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"), F.count("*").alias("dims"))


def l2_normalised(spark, d):
    """Sum of the components of each vector brought to length one."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def linear_fusion_topk(spark, d):
    """Weighted sum of BM25, a keyword boost and the intent of the query."""
    docs = _docs(spark, d)
    text = F.lower("text")
    boost = F.when(F.contains(text, F.lit("invoice")), 0.5).otherwise(0.0) + F.when(F.contains(text, F.lit("total due")), 0.25).otherwise(0.0)
    s = R.bm25(docs, "doc_id", _t(), QUERY_2).join(docs.select("doc_id", boost.alias("kw")), "doc_id")
    return R.top(s.select("doc_id", (F.col("score") + 0.6 * F.col("kw")).alias("score")), "doc_id", 10)


def hybrid_cells_topk(spark, d):
    """Cells for the query 'unit price': header match, confidence penalty, zone and amount boost together."""
    c = _cells(spark, d)
    score = R.header_match(F.col("header"), ["unit price"], ["unit", "price"]) * 0.4 + F.when(F.col("row_role") == "body", 0.2).otherwise(0.0) - 0.2 * R.confidence_penalty(F.col("confidence"), F.lit(0.5))
    return R.top(c.select("cell_id", score.alias("score")), "cell_id", 25)


def _cells(spark, d):
    return table(spark, d, "cells").drop("loaded_at", "captured_at", "bbox").distinct()


def symbolic_match(spark, d):
    f = F.map_from_arrays(F.array(F.lit("amount"), F.lit("company"), F.lit("role")), F.array(F.coalesce("amount", F.lit("")), F.coalesce("company", F.lit("")), F.coalesce("row_role", F.lit(""))))
    s = R.symbolic_score(f, "total 1,234", ["total", "1,234"])
    return _cells(spark, d).select("cell_id", F.round(s, 6).alias("score")).where("score > 0")


def filter_equality(spark, d):
    return _cells(spark, d).where(R.metadata_filter({"row_role": "header", "table_index": 0})).select("cell_id", "header")


def filter_membership(spark, d):
    return _cells(spark, d).where(R.metadata_filter({"page": [2, 3], "header": ["Qty", "Quantity", "Amount"]})).select("cell_id", "page", "header")


def filter_regex(spark, d):
    return _cells(spark, d).where(R.metadata_filter({"header": "re:(Unit|Amount)"})).select("cell_id", "header")


def filter_predicate(spark, d):
    return _cells(spark, d).where(R.metadata_filter({"confidence": lambda c: c < 0.6, "row_role": "body"})).select("cell_id", "confidence")


def zone_filter(spark, d):
    zone = F.concat_ws(".", F.lit("table"), "row_role", F.lit("row"))
    return _cells(spark, d).withColumn("zone", zone).where(R.metadata_filter({"zone": "re:table\\.(total|header).*"})).groupBy("zone").agg(F.count("*").alias("n"))


def mixed_token_stats(spark, d):
    """Tokens of the company names: Latin words, numbers, pairs of other characters."""
    c = table(spark, d, "parties").select("party_id", F.explode(words.mixed_tokens(F.col("company"))).alias("token"))
    return c.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("party_id").alias("n_parties"))


def script_profile(spark, d):
    r = words.script_ratios(F.col("text"))
    return _docs(spark, d).select("doc_id", *(F.round(v, 6).alias(k) for k, v in r.items()))


def context_windows_of_lines(spark, d):
    """Lines of short documents with the line before and after."""
    from pyspark.sql import Window

    lines = _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    return lines.select("doc_id", "i", F.length("line").alias("n"), F.length(F.lag("line").over(w)).alias("n_before"), F.length(F.lead("line").over(w)).alias("n_after"))


def doc_languages(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("n"))


def domain_vote(spark, d):
    """Votes of weighted phrases for a domain, per stated domain; the best vote wins, then the name."""
    phrases = [("invoice", "invoice", 1.0), ("invoice", "total due", 0.5), ("contract", "clause", 1.0), ("contract", "supplier", 0.25), ("delivery", "crates left", 1.0), ("delivery", "dispatch", 0.5)]
    text = F.lower(F.coalesce("text", F.lit("")))
    votes = {n: sum((F.when(F.contains(text, F.lit(p)), w).otherwise(0.0) for m, p, w in phrases if m == n), F.lit(0.0)) for n in sorted({x[0] for x in phrases})}
    best = F.greatest(*votes.values())
    winner = F.when(best == 0, "-")
    for n, v in votes.items():
        winner = winner.when(v == best, n)
    return _docs(spark, d).select("doc_domain", winner.alias("voted")).groupBy("doc_domain", "voted").agg(F.count("*").alias("n"))


def qa_best_documents(spark, d):
    """The three best documents for the question of every evaluation item."""
    q = table(spark, d, "eval_items").select("item_id", "query")
    return R.bm25_many(_docs(spark, d), "doc_id", _t(), q, "item_id", words.plain_tokens(F.col("query")), 3)


def qa_answer_rate(spark, d):
    """Share of the items, by visual type, one of whose three best documents holds one of the answers."""
    items = table(spark, d, "eval_items").select("item_id", "visual_type", "answers")
    best = qa_best_documents(spark, d).join(_docs(spark, d).select("doc_id", F.lower("text").alias("text")), "doc_id")
    hit = best.join(items, "item_id").select("item_id", F.exists("answers", lambda a: F.contains(F.col("text"), F.lower(a))).alias("hit"))
    per = items.join(hit.groupBy("item_id").agg(F.max(F.col("hit").cast("int")).alias("hit")), "item_id", "left")
    return per.groupBy("visual_type").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        df_stats, tf_top, corpus_stats, doclen_summary, bm25_topk, bm25_by_language, rrf_merge, cosine_topk, centroid_norms, l2_normalised, linear_fusion_topk, hybrid_cells_topk,
        symbolic_match, filter_equality, filter_membership, filter_regex, filter_predicate, zone_filter, mixed_token_stats, script_profile, context_windows_of_lines, doc_languages, domain_vote, qa_best_documents, qa_answer_rate,
    )
}

_TOK = "list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\-._]+', ' ', 'g'), '\\s+'), lambda t: t <> '')"
_D = f"d AS (SELECT doc_id, lang, source, doc_domain, text, {_TOK} AS t FROM documents)"
_CELLS = "c AS (SELECT DISTINCT cell_id, doc_key, page, table_index, row_idx, col_idx, header, row_role, text, company, amount, confidence, low_conf, trace_id FROM cells)"


def _bm25(query: list[str], name: str = "s") -> str:
    values = ", ".join(f"('{w}', {query.count(w)})" for w in sorted(set(query)))
    return f"""{name}q(token, qtf) AS (VALUES {values}),
    {name}st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM d),
    {name}p AS (SELECT doc_id, len(t) AS dl, token, qtf, len(list_filter(t, lambda x: x = token)) AS tf FROM d, {name}q),
    {name}df AS (SELECT token, count(*) FILTER (WHERE tf > 0) AS df FROM {name}p GROUP BY token),
    {name} AS (SELECT doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM {name}p JOIN {name}df USING (token), {name}st GROUP BY doc_id HAVING sum(tf) > 0)"""


_CLAMP = "(1 - greatest(least(coalesce(confidence, 1.0), 1.0), 0.0))"
ORACLE = {
    "df_stats": f"WITH {_D} SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM d) GROUP BY token",
    "tf_top": f"WITH {_D} SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM d) GROUP BY token ORDER BY n DESC, token LIMIT 50",
    "corpus_stats": f"WITH {_D} SELECT count(*) AS n, round(sum(len(t)) / count(*), 6) AS avgdl FROM d",
    "doclen_summary": f"WITH {_D} SELECT min(len(t)) AS shortest, max(len(t)) AS longest, round(avg(len(t)), 6) AS mean, round(quantile_cont(len(t), 0.5), 6) AS median, round(quantile_cont(len(t), 0.95), 6) AS p95 FROM d",
    "bm25_topk": f"WITH {_D}, {_bm25(QUERY)} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 10",
    "bm25_by_language": f"WITH {_D}, {_bm25(QUERY)} SELECT lang, doc_id, score FROM (SELECT coalesce(lang, '-') AS lang, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY coalesce(lang, '-') ORDER BY round(score, 6) DESC, doc_id) AS rn FROM s JOIN d USING (doc_id)) WHERE rn = 1",
    "rrf_merge": f"""WITH {_D}, {_bm25(QUERY, 'a')}, {_bm25(QUERY_2, 'b')},
      u AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM (SELECT doc_id, round(score, 6) AS score FROM a ORDER BY 2 DESC, 1 LIMIT 50)
      UNION ALL SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM (SELECT doc_id, round(score, 6) AS score FROM b ORDER BY 2 DESC, 1 LIMIT 50))
      SELECT doc_id, round(sum(part), 6) AS score FROM u GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""",
    "cosine_topk": "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]))), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p ORDER BY score DESC, e.vec_id LIMIT 10",
    "centroid_norms": "WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM e GROUP BY label, i) SELECT label, round(sqrt(sum(m * m)), 6) AS norm, count(*) AS dims FROM m GROUP BY label",
    "l2_normalised": "SELECT vec_id, round(list_sum(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS total FROM embeddings",
    "linear_fusion_topk": f"WITH {_D}, {_bm25(QUERY_2)} SELECT doc_id, round(score + 0.6 * ((CASE WHEN contains(lower(text), 'invoice') THEN 0.5 ELSE 0 END) + (CASE WHEN contains(lower(text), 'total due') THEN 0.25 ELSE 0 END)), 6) AS score FROM s JOIN d USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10",
    "hybrid_cells_topk": f"WITH {_CELLS}, h AS (SELECT *, lower(header) AS h FROM c) SELECT cell_id, round(0.4 * coalesce(CASE WHEN h = 'unit price' THEN 1.0 ELSE (CASE WHEN starts_with(h, 'unit') THEN 0.5 ELSE 0 END) + (CASE WHEN starts_with(h, 'price') THEN 0.5 ELSE 0 END) END, 0) + (CASE WHEN row_role = 'body' THEN 0.2 ELSE 0 END) - 0.2 * {_CLAMP} * 0.5, 6) AS score FROM h ORDER BY score DESC, cell_id LIMIT 25",
    "symbolic_match": f"""WITH {_CELLS}, v AS (SELECT cell_id, unnest([coalesce(amount, ''), coalesce(company, ''), coalesce(row_role, '')]) AS v FROM c),
      k AS (SELECT cell_id, CASE WHEN trim(v) = '' THEN 0 ELSE (CASE WHEN contains('total 1,234', lower(trim(v))) THEN 2.0 ELSE 0 END) + (CASE WHEN contains(lower(trim(v)), 'total') THEN 1.0 ELSE 0 END) + (CASE WHEN contains(lower(trim(v)), '1,234') THEN 1.0 ELSE 0 END) + (CASE WHEN contains(regexp_replace(v, '[^0-9]', '', 'g'), '1234') THEN 1.5 ELSE 0 END) END AS h FROM v)
      SELECT cell_id, round(sum(h::DOUBLE) + 0.5 * least(count(*) FILTER (WHERE h > 0), 4), 6) AS score FROM k GROUP BY cell_id HAVING sum(h) > 0""",
    "filter_equality": f"WITH {_CELLS} SELECT cell_id, header FROM c WHERE row_role = 'header' AND table_index = 0",
    "filter_membership": f"WITH {_CELLS} SELECT cell_id, page, header FROM c WHERE page IN (2, 3) AND header IN ('Qty', 'Quantity', 'Amount')",
    "filter_regex": f"WITH {_CELLS} SELECT cell_id, header FROM c WHERE regexp_matches(header, '^(?:Unit|Amount)')",
    "filter_predicate": f"WITH {_CELLS} SELECT cell_id, confidence FROM c WHERE confidence < 0.6 AND row_role = 'body'",
    "zone_filter": f"WITH {_CELLS} SELECT 'table.' || row_role || '.row' AS zone, count(*) AS n FROM c WHERE row_role IN ('total', 'header') GROUP BY 1",
    "mixed_token_stats": r"""WITH p AS (SELECT party_id, coalesce(company, '') AS x, regexp_replace(coalesce(company, ''), '[\x00-\x7F\s\p{Z}]', '', 'g') AS y0 FROM parties),
      t AS (SELECT party_id, lower(unnest(regexp_extract_all(x, '([A-Za-z]+|\d+(?:,\d{3})*(?:\.\d+)?)'))) AS token FROM p)
      SELECT token, count(*) AS n, count(DISTINCT party_id) AS n_parties FROM t GROUP BY token""",
    "doc_languages": "SELECT source, coalesce(array_to_string(list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL)), ','), '') AS langs, count(*) AS n FROM documents GROUP BY source",
    "context_windows_of_lines": r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i FROM l) SELECT doc_id, i, length(line) AS n, length(lag(line) OVER w) AS n_before, length(lead(line) OVER w) AS n_after FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)",
    "domain_vote": f"""WITH v AS (SELECT doc_domain, (CASE WHEN contains(t, 'clause') THEN 1.0 ELSE 0 END) + (CASE WHEN contains(t, 'supplier') THEN 0.25 ELSE 0 END) AS a,
      (CASE WHEN contains(t, 'crates left') THEN 1.0 ELSE 0 END) + (CASE WHEN contains(t, 'dispatch') THEN 0.5 ELSE 0 END) AS b, (CASE WHEN contains(t, 'invoice') THEN 1.0 ELSE 0 END) + (CASE WHEN contains(t, 'total due') THEN 0.5 ELSE 0 END) AS c
      FROM (SELECT doc_domain, lower(coalesce(text, '')) AS t FROM documents))
      SELECT doc_domain, CASE WHEN greatest(a, b, c) = 0 THEN '-' WHEN a = greatest(a, b, c) THEN 'contract' WHEN b = greatest(a, b, c) THEN 'delivery' ELSE 'invoice' END AS voted, count(*) AS n FROM v GROUP BY 1, 2""",
    "script_profile": r"WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s', '', 'g') AS x FROM documents) SELECT doc_id, round(len(regexp_replace(x, '[^\x{4E00}-\x{9FFF}]', '', 'g')) / greatest(len(x), 1), 6) AS kanji, round(len(regexp_replace(x, '[^\x{3040}-\x{30FF}]', '', 'g')) / greatest(len(x), 1), 6) AS kana, round(len(regexp_replace(x, '[^A-Za-z]', '', 'g')) / greatest(len(x), 1), 6) AS latin, round(len(regexp_replace(x, '[^0-9]', '', 'g')) / greatest(len(x), 1), 6) AS digit FROM s",
}
del ORACLE["mixed_token_stats"]
_QA = f"""WITH {_D}, q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(query), '[a-z0-9\\-._]+')) AS token FROM eval_items) GROUP BY ALL),
  st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM d), x AS (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM d),
  tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM x WHERE token IN (SELECT token FROM q) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  s AS (SELECT item_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (token) JOIN q USING (token), st GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""
ORACLE["qa_best_documents"] = f"{_QA} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 3"
ORACLE["qa_answer_rate"] = f"{_QA}, h AS (SELECT r.item_id, max(len(list_filter(answers, lambda a: contains(lower(text), lower(a)))) > 0)::INT AS hit FROM r JOIN d USING (doc_id) JOIN eval_items e ON e.item_id = r.item_id WHERE rank <= 3 GROUP BY r.item_id) SELECT visual_type, count(*) AS n, round(avg(coalesce(hit, 0)), 6) AS rate FROM eval_items LEFT JOIN h USING (item_id) GROUP BY visual_type"
