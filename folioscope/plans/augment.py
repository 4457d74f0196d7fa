"""Queries on enriched cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import values as V, words
from folioscope.functions.marks import narrow_sql
from folioscope.operators import augment as A, cells as C, embeddings as E
from folioscope.plans.cells import C1, SIGNATURES, cells_of, hypotheses
from folioscope.runtime import table

FAMILIES = {"quantity": "qty|quantity|quantité|数量", "price": "price|prix|単価", "amount": "amount|montant|金額|total"}


def era_dates(spark, d):
    c = A.era_date(F.col("text"))
    return cells_of(spark, d).select("cell_id", *(v.alias(k) for k, v in c.items())).where("day IS NOT NULL")


def header_kinds(spark, d):
    return cells_of(spark, d).groupBy("header", A.header_kind(F.col("header")).alias("kind")).agg(F.count("*").alias("n"))


def signed_numbers(spark, d):
    return cells_of(spark, d).where("amount IS NOT NULL").select("cell_id", A.signed_number(F.col("amount")).alias("number")).where("number IS NOT NULL")


def enforced_numbers(spark, d):
    """Sum of the numbers of each kind of column per document."""
    c = cells_of(spark, d).where("row_role = 'body'").select("doc_key", A.header_kind(F.col("header")).alias("kind"), A.signed_number(F.col("text")).alias("n")).where("kind IS NOT NULL AND n IS NOT NULL")
    return c.groupBy("doc_key", "kind").agg(F.count("*").alias("n"), F.round(F.sum(F.col("n").cast("decimal(20,4)")).cast("double"), 2).alias("total"))


def structural_grams(spark, d):
    g = A.structural_gram(F.col("text"))
    return cells_of(spark, d).select("cell_id", *(v.alias(k) for k, v in g.items())).groupBy("signature").agg(F.count("*").alias("n"), F.count("first_number").alias("n_numbers"), F.count("low").alias("n_ranges"))


def missing_families(spark, d):
    return A.missing_families(cells_of(spark, d), FAMILIES)


def total_rows(spark, d):
    return A.total_rows(cells_of(spark, d))


def with_placeholders(spark, d):
    """Cells and one placeholder per missing family, united by name."""
    c = cells_of(spark, d).select(*C.TABLE, "text")
    p = A.missing_families(cells_of(spark, d), FAMILIES).withColumn("synthetic", F.lit(True)).withColumnRenamed("family", "text")
    u = c.unionByName(p, allowMissingColumns=True)
    return u.groupBy("doc_key").agg(F.count("*").alias("n"), F.count("synthetic").alias("n_synthetic"))


def table_similarity(spark, d):
    """Each table of copy A against the table at the same place in copy B: rows with as many cells."""
    def html(t):
        r = C.delivered_once(table(spark, d, t)).groupBy(*C.TABLE, "row_idx").agg(F.count("*").alias("n"))
        one = F.concat(F.lit("<tr>"), F.repeat(F.lit("<td></td>"), F.col("n").cast("int")), F.lit("</tr>"))
        return r.groupBy(*C.TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", one.alias("h")))), lambda x: x["h"]), "").alias("html"))

    a, b = html("cells"), html("cells_b").withColumnRenamed("html", "other")
    similarity = F.coalesce(A.row_count_similarity(F.col("html"), F.col("other")), F.lit(0.0))
    return a.join(b, C.TABLE, "full").select(*C.TABLE, F.round(F.when(F.col("html").isNotNull() & F.col("other").isNotNull(), similarity).otherwise(0.0), 6).alias("similarity"))


def reranked_readings(spark, d):
    """The likeliest reading of each low-confidence cell under the letters of all headers."""
    h = hypotheses(spark, d).select("cell_id", "text", "score")
    return A.rerank(h, C.bigram_surprisal(h.groupBy("text").count(), "text", "text"), "cell_id")


def confidence_ema(spark, d):
    c = cells_of(spark, d).where("confidence IS NOT NULL")
    return A.smoothed_rates(c, "doc_key", ["page", "table_index", "row_idx", "col_idx", "cell_id"], "confidence", 0.5)


def threshold_choice(spark, d):
    """The confidence threshold that flags closest to a tenth of the cells, out of twenty judged in one pass."""
    steps = [i / 20 for i in range(1, 20)]
    one = cells_of(spark, d).agg(F.count("confidence").alias("n"), *(F.count_if(F.col("confidence") < t).alias(f"t{i}") for i, t in enumerate(steps)))
    grid = one.select("n", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("flagged")) for i, t in enumerate(steps)))).alias("x")).select("n", "x.threshold", "x.flagged")
    return A.best_setting(grid, F.abs(F.col("flagged") / F.col("n") - 0.1)).select("threshold", "flagged", "score")


def derived_tax(spark, d):
    """Ten percent of every whole amount, rounded half to even, against the amount's last digits."""
    c = cells_of(spark, d).select("cell_id", V.whole_amount(F.col("amount")).alias("a")).where("a IS NOT NULL")
    return c.select("cell_id", F.bround(F.col("a") * F.lit(0.1).cast("decimal(3,1)"), 0).cast("bigint").alias("tax"))


def text_vectors_topk(spark, d):
    """Questions nearest to the first one by hashed words (Arrow-batched encoder)."""
    q = table(spark, d, "eval_items").select("item_id", "query")
    v = E.encode(q, "query", E.hashed_bag)
    probe = E.hashed_bag([q.orderBy("item_id").first().query])[0].tolist()
    s = v.select("item_id", words.cosine(F.col("vector"), F.array(*(F.lit(x) for x in probe))).alias("score"))
    return s.select("item_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "item_id").limit(10)


def fused_vectors(spark, d):
    """Late fusion of a vector's two halves: sum of the components."""
    half = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    v = table(spark, d, "embeddings").select("vec_id", E.late_fusion([half(1, 32), half(33, 32)], [2.0, 1.0]).alias("f"))
    return v.select("vec_id", F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        era_dates, header_kinds, signed_numbers, enforced_numbers, structural_grams, missing_families, total_rows, with_placeholders, table_similarity, reranked_readings, confidence_ema,
        threshold_choice, derived_tax, text_vectors_topk, fused_vectors,
    )
}

_T = "doc_key, page, table_index"
_FAM = {k: f"max(regexp_matches(lower(coalesce(header, '')), '{v}')) AS {k}" for k, v in FAMILIES.items()}
_MISS = f"m AS (SELECT {_T}, {', '.join(_FAM.values())} FROM c GROUP BY ALL), f AS (" + " UNION ALL ".join(f"SELECT {_T}, '{k}' AS family FROM m WHERE NOT {k}" for k in FAMILIES) + ")"
ORACLE = {
    "missing_families": f"WITH {C1}, {_MISS} SELECT * FROM f",
    "with_placeholders": f"WITH {C1}, {_MISS}, u AS (SELECT doc_key, 0 AS s FROM c UNION ALL SELECT doc_key, 1 FROM f) SELECT doc_key, count(*) AS n, sum(s)::BIGINT AS n_synthetic FROM u GROUP BY doc_key",
    "derived_tax": f"WITH {C1}, a AS (SELECT cell_id, TRY_CAST(replace(regexp_extract(amount, '[¥￥$]?\\s*(\\d{{1,3}}(?:,\\d{{3}})+|\\d+)(?:\\.\\d+)?', 1), ',', '') AS BIGINT) AS a FROM c) SELECT cell_id, (CASE WHEN a % 10 > 5 OR (a % 10 = 5 AND (a // 10) % 2 = 1) THEN a // 10 + 1 ELSE a // 10 END)::BIGINT AS tax FROM a WHERE a IS NOT NULL",
    "threshold_choice": f"WITH {C1}, g AS (SELECT t.threshold, count(*) FILTER (WHERE confidence < t.threshold) AS flagged, count(confidence) AS n FROM c, (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS threshold) t GROUP BY ALL) SELECT threshold, flagged, round(abs(flagged / n - 0.1), 6) AS score FROM g ORDER BY score, n, threshold LIMIT 1",
    "table_similarity": f"""WITH a AS (SELECT {_T}, row_idx, count(*) AS n FROM (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) = 1) GROUP BY ALL), b AS (SELECT {_T}, row_idx, count(*) AS n FROM (SELECT * FROM cells_b QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) = 1) GROUP BY ALL),
      x AS (SELECT {_T}, list(n ORDER BY row_idx) AS x FROM a GROUP BY ALL), y AS (SELECT {_T}, list(n ORDER BY row_idx) AS y FROM b GROUP BY ALL)
      SELECT {_T}, round(len(list_filter(list_zip(x, y), lambda p: p[1] = p[2])) / greatest(len(x), len(y)), 6) AS similarity FROM x JOIN y USING ({_T})
      UNION ALL SELECT {_T}, 0.0 FROM (SELECT {_T} FROM x ANTI JOIN y USING ({_T}) UNION ALL SELECT {_T} FROM y ANTI JOIN x USING ({_T}))""",
    "confidence_ema": f"WITH {C1}, r AS (SELECT doc_key, confidence, row_number() OVER (PARTITION BY doc_key ORDER BY page DESC, table_index DESC, row_idx DESC, col_idx DESC, cell_id DESC) AS k, count(*) OVER (PARTITION BY doc_key) AS n FROM c WHERE confidence IS NOT NULL) SELECT doc_key, round(sum(confidence * pow(0.5, k - 1) * CASE WHEN k = n THEN 1 ELSE 0.5 END), 6) AS ema FROM r GROUP BY doc_key",
    "fused_vectors": "SELECT vec_id, round((2 * list_sum(embedding[1:32]::DOUBLE[]) + list_sum(embedding[33:64]::DOUBLE[])) / 3, 5) AS total FROM embeddings",
}

_HEADER, _TEXT = narrow_sql("coalesce(header, '')"), narrow_sql("coalesce(text, '')")
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower({_HEADER}), '{p}') THEN '{k}'" for k, p in A.HEADER_KINDS) + " END"


def _signed(column: str) -> str:
    """The signed number of a text in one SQL expression."""
    t = narrow_sql(column)
    bare = rf"regexp_replace({t}, '[¥$€円 \t\n\r\f\v]|jpy|eur|usd', '', 'g')"
    french = rf"(regexp_matches({t}, ',\d{{1,2}} *€? *$') AND NOT regexp_matches({t}, '\.\d'))"
    plain = f"(CASE WHEN {french} THEN replace({bare}, ',', '.') ELSE replace({bare}, ',', '') END)"
    digits = rf"regexp_replace({plain}, '[()\-]', '', 'g')"
    n = f"TRY_CAST(regexp_replace({digits}, '%$', '') AS DOUBLE) / CASE WHEN ends_with({digits}, '%') THEN 100 ELSE 1 END"
    return rf"({n} * CASE WHEN regexp_matches({plain}, '^\(.*\)$|^-|-$') THEN -1 ELSE 1 END)"


_LABEL = f"regexp_matches(lower({_TEXT}), '^(grand |sub)?total|^合計|^小計|^montant à payer|^total général|^amount due|^balance due')"
_SPAN = r"(-?\d+(?:\.\d+)?)[ \t\n\r\f\v]*[~〜–][ \t\n\r\f\v]*(-?\d+(?:\.\d+)?)"
ORACLE |= {
    "header_kinds": f"WITH {C1} SELECT header, {_KIND} AS kind, count(*) AS n FROM c GROUP BY ALL",
    "signed_numbers": f"WITH {C1} SELECT cell_id, number FROM (SELECT cell_id, {_signed('amount')} AS number FROM c WHERE amount IS NOT NULL) WHERE number IS NOT NULL",
    "enforced_numbers": f"WITH {C1}, k AS (SELECT doc_key, {_KIND} AS kind, {_signed('text')} AS v FROM c WHERE row_role = 'body') SELECT doc_key, kind, count(*) AS n, round(sum(v::DECIMAL(20, 4))::DOUBLE, 2) AS total FROM k WHERE kind IS NOT NULL AND v IS NOT NULL GROUP BY ALL",
    "total_rows": f"WITH {C1} SELECT {_T}, row_idx, max({_signed('text')}) AS largest FROM c GROUP BY ALL HAVING max({_LABEL})",
    "structural_grams": rf"WITH {C1}, {SIGNATURES} SELECT signature, count(*) AS n, count(TRY_CAST(replace(nullif(regexp_extract(text, '-?\d[\d,]*(?:\.\d+)?'), ''), ',', '') AS DOUBLE)) AS n_numbers, count(TRY_CAST(nullif(regexp_extract(text, '{_SPAN}', 1), '') AS DOUBLE)) AS n_ranges FROM g GROUP BY signature",
}
