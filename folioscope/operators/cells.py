"""Relational operators over exported cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TABLE = ["doc_key", "page", "table_index"]
PLACE = [*TABLE, "row_idx", "col_idx"]


def delivered_once(cells: DataFrame, key: str | list[str] = "cell_id", newest: str = "loaded_at") -> DataFrame:
    """One row per key, the newest delivery, without ``newest``.

    One aggregate per column, so that the optimizer drops those nobody reads, down to the scan; partial
    aggregation takes care of hot keys. Repeated deliveries differ in ``newest`` only; a null ``newest`` is the oldest.
    """
    keys = [key] if isinstance(key, str) else key
    at = F.coalesce(F.unix_micros(F.col(newest).cast("timestamp")), F.lit(-(1 << 62)))
    return cells.groupBy(*keys).agg(*(F.max_by(c, at).alias(c) for c in cells.columns if c not in (*keys, newest)))


def context_lines(cells: DataFrame, limit: int = 120) -> DataFrame:
    """``header=text | header=text`` for each row of a table, in column order; a row is bounded by its columns."""
    part = F.concat_ws("=", F.coalesce("header", F.lit("")), F.coalesce("text", F.lit("")))
    rows = cells.groupBy(*TABLE, "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "cell_id", part.alias("p")))).alias("a"))
    return rows.select(*TABLE, "row_idx", F.array_join(F.transform("a", lambda x: x["p"]), " | ").alias("line"))


def key_values(line: Column) -> Column:
    """``k=v | k=v`` read back as a map; the last of equal keys wins."""
    pairs = F.filter(F.transform(F.split(line, r"\|"), F.trim), lambda s: F.contains(s, F.lit("=")) & ~s.startswith("="))
    keys = F.transform(pairs, lambda s: F.trim(F.substring_index(s, "=", 1)))
    values = F.transform(pairs, lambda s: F.trim(F.substr(s, F.position(F.lit("="), s) + 1)))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), x["k"]) == 0)
    return F.map_from_entries(last)


def column_profile(cells: DataFrame) -> DataFrame:
    """Shares of numeric, currency and decimal values among the non-empty body cells of each column."""
    body = cells.where("row_role = 'body' AND text <> ''")
    number = F.regexp_replace("text", r"[,¥$€\s]", "").rlike(r"^\(?-?[0-9]+(\.[0-9]+)?\)?$")
    return body.groupBy(*TABLE, "col_idx").agg(
        F.count("*").alias("n"), F.round(F.avg(number.cast("int")), 6).alias("numeric"),
        F.round(F.avg(F.col("text").rlike("[¥$€]").cast("int")), 6).alias("currency"), F.round(F.avg(F.col("text").rlike(r"[0-9]\.[0-9]").cast("int")), 6).alias("decimal"),
    )


def column_deviation(cells: DataFrame) -> DataFrame:
    """How far the rows of each table are from its usual number of columns, on average over all rows (at least 0.01)."""
    rows = cells.groupBy(*TABLE, "row_idx").agg(F.count_distinct("col_idx").alias("n"))
    sizes = rows.groupBy(*TABLE, "n").agg(F.count("*").alias("rows"))
    usual = sizes.groupBy(*TABLE).agg(F.max(F.struct("rows", (-F.col("n")).alias("m"))).alias("u"))
    both = sizes.join(usual, TABLE).withColumn("mode", -F.col("u.m"))
    return both.agg(F.round(F.greatest(F.lit(0.01), F.sum(F.col("rows") * F.abs(F.col("n") - F.col("mode")) / F.greatest("mode", F.lit(1))) / F.sum("rows")), 6).alias("deviation"))


def hotspots(cells: DataFrame, score: Column, k: int) -> DataFrame:
    """Score and count per document, per table and per row at once (grouping sets), the k best of each level."""
    s = cells.withColumn("s", score).where("s > 0")
    g = s.groupingSets([["doc_key"], TABLE, [*TABLE, "row_idx"]], *TABLE, "row_idx").agg(
        F.sum("s").alias("score"), F.count("*").alias("n"), F.grouping_id().alias("level")
    )
    w = Window.partitionBy("level").orderBy(F.desc("score"), F.desc("n"), "doc_key", "page", "table_index", "row_idx")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def apply_corrections(cells: DataFrame, corrections: DataFrame) -> DataFrame:
    """Left join on ``trace_id`` with the best correction of each trace (most confident, then latest).

    ``corrections`` has ``trace_id, new_text, new_confidence, at``. A cell without a trace keeps its text.
    """
    best = corrections.where("trace_id <> ''").groupBy("trace_id").agg(F.max(F.struct("new_confidence", "at", "new_text")).alias("b"))
    joined = cells.join(best, "trace_id", "left")
    better = F.col("b.new_confidence") > F.coalesce("confidence", F.lit(0.0))
    return joined.select(
        "cell_id", F.when(better, F.col("b.new_text")).otherwise(F.col("text")).alias("text"),
        F.when(better, F.col("b.new_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.coalesce(better, F.lit(False)).alias("changed"),
    )


def disambiguated_keys(cells: DataFrame) -> DataFrame:
    """Key of each row (its first column's text); a key that stands again gets #2, #3 in row order."""
    firsts = cells.groupBy(*TABLE, "row_idx").agg(F.min(F.struct("col_idx", "cell_id", "text")).alias("f")).select(*TABLE, "row_idx", F.coalesce("f.text", F.lit("")).alias("key"))
    w = Window.partitionBy(*TABLE, "key").orderBy("row_idx")
    n = F.row_number().over(w)
    return firsts.withColumn("n", n).select(*TABLE, "row_idx", F.when(F.col("n") == 1, F.col("key")).otherwise(F.concat_ws("#", "key", "n")).alias("row_key"))


def bigram_surprisal(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Mean surprisal in bits of the character bigrams of each text, under the bigram counts of all texts (add-one smoothed).

    Texts are counted by distinct bigram first, so a frequent text costs no more than its characters.
    """
    t = texts.select(key, text).where(F.length(text) >= 2)
    grams = t.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(F.col(text), i, F.lit(2)))).alias("g"))
    per = grams.groupBy(key, "g").agg(F.count("*").alias("n"))
    pair = per.groupBy("g").agg(F.sum("n").alias("c"))
    lead = pair.groupBy(F.substring("g", 1, 1).alias("a")).agg(F.sum("c").alias("ca"))
    vocab = pair.agg(F.greatest(F.count_distinct(F.substring("g", 2, 1)), F.lit(8)).alias("v"))
    p = pair.withColumn("a", F.substring("g", 1, 1)).join(lead, "a").crossJoin(F.broadcast(vocab))  # one row
    bits = p.select("g", (-F.log2((F.col("c") + 1) / (F.col("ca") + F.col("v")))).alias("bits"))
    return per.join(bits, "g").groupBy(key).agg(F.round(F.sum(F.col("bits") * F.col("n")) / F.sum("n"), 6).alias("surprisal"))
