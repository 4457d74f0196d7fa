"""Postings, scorers and rank fusion."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.words import cosine
from folioscope.runtime import cut

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``(key, token, tf)``: exploded and counted per document, combined before the shuffle."""
    return docs.select(F.col(key), F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    return docs.select(F.col(key), F.size(tokens).cast("bigint").alias("dl"))


def document_frequency(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    return lengths(docs, key, tokens).agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def bm25(docs: DataFrame, key: str, tokens: Column, query: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """``(key, score)`` of every document that holds a query token.

    Only counts leave the document: one pass counts the query's tokens and the length per row without a
    shuffle and keeps these numbers; document frequencies are a handful of sums over them, sent back as one row. A token
    repeated in the query counts as often; unknown tokens and an empty query score nothing.
    """
    terms = Counter(query)
    words = sorted(terms)
    if not words:
        return docs.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    t = docs.select(F.col(key), tokens.alias("t"))
    equals = lambda w: lambda x: x == F.lit(w)
    tf = [F.size(F.filter("t", equals(w))).alias(f"f{i}") for i, w in enumerate(words)]
    counted = cut(t.select(key, F.size("t").alias("dl"), *tf))  # a few numbers per document, read twice; the texts are read once
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words))))
    both = counted.where(" OR ".join(f"f{i} > 0" for i in range(len(words)))).crossJoin(F.broadcast(totals))  # one row
    norm = k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1.0)))
    parts = []
    for i, w in enumerate(words):
        idf = F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5) + 1)
        parts.append(F.lit(float(terms[w])) * idf * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + norm))
    return both.select(key, sum(parts[1:], parts[0]).alias("score"))


def bm25_many(docs: DataFrame, key: str, tokens: Column, queries: DataFrame, query_key: str, query_tokens: Column, k: int) -> DataFrame:
    """``(query_key, key, score, rank)``: the k best documents of every query of a stated set.

    Documents are counted against the queries' vocabulary only: tokens outside it are dropped by a semi
    join before anything is shuffled, term counts are combined per document first. Ties go to the
    smaller key. A query without known tokens has no rows.
    """
    terms = queries.select(query_key, F.explode(query_tokens).alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("qtf"))
    vocabulary = terms.select("token").distinct()
    t = docs.select(key, tokens.alias("t"))
    sizes = t.select(key, F.size("t").alias("dl"))
    stats = sizes.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    tf = cut(t.select(key, F.size("t").alias("dl"), F.explode("t").alias("token")).join(vocabulary, "token", "left_semi").groupBy(key, "dl", "token").agg(F.count("*").alias("tf")))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    p = tf.join(df, "token").crossJoin(F.broadcast(stats))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = p.select(key, "token", part.alias("part")).join(terms, "token").groupBy(query_key, key).agg(F.round(F.sum(F.col("qtf") * F.col("part")), 6).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top(scored: DataFrame, key: str, k: int, places: int = 6) -> DataFrame:
    """The k best, the smaller key first among equals (sorted per partition, merged at the end)."""
    return scored.select(key, F.round("score", places).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest(vectors: DataFrame, key: str, vector: str, probe: list[float], k: int) -> DataFrame:
    scored = vectors.select(key, cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in probe))).alias("score"))
    return top(scored, key, k)


def reciprocal_ranks(lists: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """Fusion of ranked lists ``(key, score)``: the sum of 1 / (constant + rank)."""
    ranked = []
    for one in lists:  # each list is a top-k already, so its ranking is one small task
        w = Window.orderBy(F.desc("score"), key)
        ranked.append(one.select(key, (1.0 / (constant + F.row_number().over(w))).alias("part")))
    merged = ranked[0]
    for r in ranked[1:]:
        merged = merged.unionByName(r)
    return top(merged.groupBy(key).agg(F.sum("part").alias("score")), key, k)


def header_match(header: Column, exact: list[str], prefixes: list[str]) -> Column:
    """1 for each equal header; only without one, 0.5 for each prefix."""
    h = F.lower(header)
    equal = sum((F.when(h == x.lower(), 1.0).otherwise(0.0) for x in exact), F.lit(0.0))
    starts = sum((F.when(h.startswith(x.lower()), 0.5).otherwise(0.0) for x in prefixes), F.lit(0.0))
    return F.coalesce(F.when(equal > 0, equal).otherwise(starts), F.lit(0.0))


def confidence_penalty(ocr: Column, structure: Column) -> Column:
    clamp = lambda c: F.greatest(F.least(F.coalesce(c, F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    return (1 - clamp(ocr)) * (1 - clamp(structure))


def symbolic_score(filters: Column, query: str, tokens: list[str]) -> Column:
    """How well a map of attributes answers a query: value in query 2, token in value 1, digits in digits 1.5; and 0.5 a key, four at most."""
    import re

    text = query.strip().lower()
    digits = [re.sub(r"[.,]", "", d) for d in re.findall(r"\d+(?:[.,]\d+)?", query)]

    def one(entry: Column) -> Column:
        value = F.lower(F.trim(entry["value"]))
        only = F.regexp_replace(entry["value"], r"\D", "")
        hits = F.when(F.contains(F.lit(text), value), 2.0).otherwise(0.0)
        hits += sum((F.when(F.contains(value, F.lit(t)), 1.0).otherwise(0.0) for t in tokens if t), F.lit(0.0))
        hits += sum((F.when(F.contains(only, F.lit(d)), 1.5).otherwise(0.0) for d in digits if d), F.lit(0.0))
        return F.when(F.coalesce(value, F.lit("")) == "", 0.0).otherwise(hits)

    scores = F.transform(F.map_entries(filters), one)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(total + 0.5 * F.least(F.size(F.filter(scores, lambda x: x > 0)), F.lit(4)), F.lit(0.0))


def metadata_filter(conditions: dict) -> Column:
    """All conditions hold. A list asks for membership, ``re:`` for a match from the start, a callable builds its own
    condition; anything else is equality. Null rejects; ``None`` conditions don't count."""
    held = F.lit(True)
    for name, wanted in conditions.items():
        if wanted is None:
            continue
        c = F.col(name)
        if callable(wanted):
            test = wanted(c)
        elif isinstance(wanted, (list, tuple, set)):
            test = c.isin(*wanted)
        elif isinstance(wanted, str) and wanted.startswith("re:"):
            test = c.rlike(f"^(?:{wanted[3:]})")
        else:
            test = c == F.lit(wanted)
        held = held & c.isNotNull() & F.coalesce(test, F.lit(False))
    return held
