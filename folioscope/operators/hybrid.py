"""Hybrid retrieval: lexical, dense, structural and visual evidence in one score with its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.words import cosine
from folioscope.operators.retrieval import confidence_penalty, header_match

#: Words of a query that ask for a kind of object, and the usual weights of the parts.
FIGURE_WORDS = "diagram schematic figure chart graph plot visual illustration map".split()
TABLE_WORDS = "table grid column row spreadsheet csv".split()
SPATIAL_WORDS = ["top left", "bottom right", "layout", "coordinate", "axis"]
WEIGHTS = {"dense": 0.35, "bm25": 0.25, "zone": 0.2, "header": 0.1, "neighbor": 0.1, "symbolic": 0.0, "keyword": 0.0, "intent": 0.2, "penalty": 0.2}


def hash_bits(vector: Column) -> Column:
    """The signs of up to 64 components as the bits of a bigint, the first one lowest."""
    return F.aggregate(F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit hashes; null hashes have none."""
    return F.coalesce(1 - F.bit_count(a.bitwiseXOR(b)) / 64, F.lit(0.0))


def object_type(table_id: Column, caption: Column) -> Column:
    """``table`` where a table is named, ``figure`` where the caption says so, else ``text``."""
    return F.when(table_id.isNotNull(), "table").when(F.lower(F.coalesce(caption, F.lit(""))).rlike("figure|diagram|chart|schematic|graph"), "figure").otherwise("text")


def intent_boost(query: str, kind: Column, table_id: Column) -> Column:
    """What a query's words say about the kind of object wanted; the query is known, so only its parts that count remain in the plan."""
    q = query.lower()
    has = lambda ws: any(w in q for w in ws)
    parts = [F.when((kind == "figure") & F.lit(has(FIGURE_WORDS)), 1.0).otherwise(0.0), F.when((kind == "table") & F.lit(has(TABLE_WORDS)), 1.0).otherwise(0.0)]
    parts += [F.when((kind != "text") & F.lit(has(SPATIAL_WORDS)), 0.3).otherwise(0.0), F.when(table_id.isNotNull() & F.lit("table" in q), 0.3).otherwise(0.0)]
    return sum(parts[1:], parts[0])


def neighbors(cells: DataFrame, place: list[str]) -> DataFrame:
    """``(a, b)`` of cells side by side in a row or below each other in a column of one table; equi-joins only."""
    at = cells.select("cell_id", *place, "row_idx", "col_idx")
    pairs = []
    for down, right in ((0, 1), (1, 0)):
        other = at.select(F.col("cell_id").alias("b"), *place, (F.col("row_idx") - down).alias("row_idx"), (F.col("col_idx") - right).alias("col_idx"))
        pairs.append(at.join(other, [*place, "row_idx", "col_idx"]).select(F.col("cell_id").alias("a"), "b"))
    one = pairs[0].unionByName(pairs[1])
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def hybrid(
    objects: DataFrame, key: str, query: str, bm25: DataFrame, seeds_near: DataFrame, probe: Column, zone: str | None = None, headers: list[str] = (), prefixes: list[str] = (), weights: dict | None = None,
) -> DataFrame:
    """``key, score, parts``: the weighted sum of all parts per object, and the parts themselves.

    ``objects`` has ``zone, header, table_id, caption, confidence, vector`` and the columns of ``symbolic``
    and ``keyword`` where these count. A ``zone`` pattern is a hard filter and scores one. ``bm25`` is
    ``(key, score)``, ``seeds_near`` the keys next to the seeds, ``probe`` the query's vector. What an
    object lacks counts nothing.
    """
    w = WEIGHTS | (weights or {})
    kept = objects if zone is None else objects.where(F.col("zone").rlike(f"^(?:{zone})"))
    j = kept.join(bm25.select(key, F.col("score").alias("_bm25")), key, "left").join(seeds_near.select(key).distinct().withColumn("_near", F.lit(1.0)), key, "left")
    kind = object_type(F.col("table_id"), F.col("caption"))
    zero = F.lit(0.0)
    part = {
        "dense": F.coalesce(cosine(F.col("vector"), probe), zero), "bm25": F.coalesce("_bm25", zero), "zone": F.lit(0.0 if zone is None else 1.0), "header": header_match(F.col("header"), list(headers), list(prefixes)),
        "neighbor": F.coalesce("_near", zero), "symbolic": F.col("symbolic") if "symbolic" in objects.columns else zero, "keyword": F.col("keyword") if "keyword" in objects.columns else zero,
        "intent": intent_boost(query, kind, F.col("table_id")), "penalty": confidence_penalty(F.col("confidence"), F.lit(0.5)),
    }
    score = sum(((-1 if n == "penalty" else 1) * w[n] * c for n, c in part.items()), zero)
    return j.select(key, F.round(score, 6).alias("score"), F.struct(*(F.round(c, 6).alias(n) for n, c in part.items())).alias("parts"))
