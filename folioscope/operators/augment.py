"""Enrichment of cells: dates with eras, numbers by kind of column, grams, missing structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions import values as V, words
from folioscope.functions.marks import narrow
from folioscope.operators.cells import TABLE

#: The year before the first of each era.
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925, "大正": 1911, "明治": 1867}

#: Header words of each kind of number.
HEADER_KINDS = [
    ("tax_rate", r"税率|tax rate|taux"), ("tax_amount", r"消費税|税額|tax amount|tva"), ("unit_price", r"単価|unit price|prix unitaire"), ("qty", r"数量|qty|quantity|quantité"),
    ("subtotal", r"小計|subtotal|sous-total"), ("amount", r"金額|amount|total|montant|debit|credit|balance|débit|crédit|solde|入金|出金|残高"),
]


def era_date(text: Column) -> dict[str, Column]:
    """``day`` (YYYY-MM-DD or YYYY-MM) and ``precision`` (ymd or ym) of the first date: with separators, in kanji, by era (元 is 1), or eight digits."""
    t = narrow(text)
    names = "|".join(ERAS)
    era, number = F.regexp_extract(t, rf"({names})", 1), F.regexp_extract(t, rf"(?:{names})(元|\d{{1,2}})年", 1)
    offset = F.coalesce(*(F.when(era == k, F.lit(v)) for k, v in ERAS.items()), F.lit(None))
    by_era = offset + F.when(number == "元", 1).otherwise(number.try_cast("int"))
    plain = r"((?:19|20)\d{2})\s?[-/.年]\s?(\d{1,2})(?:\s?[-/.月]\s?(\d{1,2}))?"
    compact = r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])([0-2]\d|3[01])(?!\d)"
    in_era = rf"(?:{names})(?:元|\d{{1,2}})年\s?(\d{{1,2}})月(?:\s?(\d{{1,2}})日)?"
    pick = lambda i: F.coalesce(V.first(t, plain, i), V.first(t, compact, i)).try_cast("int")
    year = F.coalesce(by_era, pick(1))
    month = F.coalesce(F.when(by_era.isNotNull(), V.first(t, in_era, 1).try_cast("int")), F.when(by_era.isNull(), pick(2)))
    day = F.coalesce(F.when(by_era.isNotNull(), V.first(t, in_era, 2).try_cast("int")), F.when(by_era.isNull(), pick(3)))
    ok = year.between(1900, 2100) & month.between(1, 12) & F.coalesce(day.between(1, 31), F.lit(True))
    head = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"))
    whole = F.when(day.isNotNull(), F.concat_ws("-", head, F.lpad(day.cast("string"), 2, "0"))).otherwise(head)
    return {"day": F.when(ok, whole), "precision": F.when(ok, F.when(day.isNotNull(), "ymd").otherwise("ym"))}


def header_kind(header: Column) -> Column:
    h = F.lower(narrow(F.coalesce(header, F.lit(""))))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(HEADER_KINDS):
        kind = F.when(h.rlike(pattern), name).otherwise(kind)
    return kind


def signed_number(text: Column) -> Column:
    """A number with currency signs, separators and brackets (negative); a decimal comma after spaced groups is read as a point."""
    t = F.regexp_replace(narrow(text), r"[¥$€円\s]|jpy|eur|usd", "")
    french = narrow(text).rlike(r",\d{1,2}\s*€?\s*$") & ~narrow(text).rlike(r"\.\d")
    t = F.when(french, F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    negative = t.rlike(r"^\(.*\)$|^-|-$")
    digits = F.regexp_replace(t, r"[()\-]", "")
    n = F.regexp_replace(digits, "%$", "").try_cast("double")
    n = F.when(digits.endswith("%"), n / 100).otherwise(n)
    return F.when(negative, -n).otherwise(n)


def structural_gram(text: Column) -> dict[str, Column]:
    """Class sequence of a cell's tokens, its first number, and its range when it states one."""
    t = F.coalesce(text, F.lit(""))
    span = r"(-?\d+(?:\.\d+)?)\s*[~〜–]\s*(-?\d+(?:\.\d+)?)"
    return {
        "signature": V.type_signature(t), "first_number": F.replace(V.first(t, r"-?\d[\d,]*(?:\.\d+)?"), F.lit(","), F.lit("")).try_cast("double"),
        "low": V.first(t, span, 1).try_cast("double"), "high": V.first(t, span, 2).try_cast("double"),
    }


def missing_families(cells: DataFrame, families: dict[str, str]) -> DataFrame:
    """Tables that lack a header of a family: ``table, family`` (one aggregate per table, then a fixed explode)."""
    h = F.lower(narrow(F.coalesce("header", F.lit(""))))
    has = cells.groupBy(*TABLE).agg(*(F.max(h.rlike(p)).alias(name) for name, p in families.items()))
    lacking = F.explode(F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n in families))))
    return has.select(*TABLE, lacking.alias("family"))


def total_rows(cells: DataFrame) -> DataFrame:
    """Rows whose label says total, with the largest number in them."""
    label = F.lower(narrow(F.coalesce("text", F.lit("")))).rlike(r"^(grand |sub)?total|^合計|^小計|^montant à payer|^total général|^amount due|^balance due")
    rows = cells.groupBy(*TABLE, "row_idx").agg(F.max(label).alias("is_total"), F.max(signed_number(F.col("text"))).alias("largest"))
    return rows.where("is_total").select(*TABLE, "row_idx", "largest")


def row_count_similarity(a: Column, b: Column) -> Column:
    """Of two tables as HTML: the share of rows with as many cells as the row at the same place in the other."""
    sizes = lambda html: F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1)), lambda r: F.size(F.split(r, "<td>")) - 1)
    x, y = sizes(a), sizes(b)
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda v: v))
    return F.coalesce(F.try_divide(same, F.greatest(F.size(x), F.size(y))), F.lit(1.0))


def rerank(candidates: DataFrame, surprisal: DataFrame, key: str) -> DataFrame:
    """Best reading per key: its own score less a penalty for unlikely letters. ``candidates``: key, text, score; ``surprisal``: text, surprisal."""
    c = candidates.join(surprisal, "text", "left").withColumn("s", F.col("score") - 0.05 * F.coalesce("surprisal", F.lit(8.0)))
    best = c.groupBy(key).agg(F.max(F.struct(F.round("s", 6).alias("s"), "text")).alias("b"))
    return best.select(key, F.col("b.text").alias("text"), F.col("b.s").alias("score"))


def smoothed_rates(history: DataFrame, group: str, order: list[str], value: str, weight: float) -> DataFrame:
    """Exponential moving average of a value per group over its whole history.

    The average is a weighted sum: the k-th newest value of n counts ``weight * (1 - weight)^(k-1)``, the
    oldest ``(1 - weight)^(n-1)``. Ranks are given within the values of the first order column, whose
    counts are summed up before, so that a long history is no one task.
    """
    first = order[0]
    counts = history.groupBy(group, first).agg(F.count("*").alias("_m"))
    later = Window.partitionBy(group).orderBy(F.desc_nulls_last(first)).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_later": F.coalesce(F.sum("_m").over(later), F.lit(0)), "_n": F.sum("_m").over(Window.partitionBy(group))})
    within = Window.partitionBy(group, first).orderBy(*[F.desc_nulls_last(c) for c in order[1:]])
    ranked = history.withColumn("_i", F.row_number().over(within)).alias("h").join(counts.alias("c"), F.col(f"h.{group}").eqNullSafe(F.col(f"c.{group}")) & F.col(f"h.{first}").eqNullSafe(F.col(f"c.{first}")))
    k = F.col("_later") + F.col("_i")
    share = F.pow(F.lit(1 - weight), k - 1) * F.when(k == F.col("_n"), 1.0).otherwise(weight)
    return ranked.groupBy(F.col(f"h.{group}").alias(group)).agg(F.round(F.sum(F.col(value).cast("double") * share), 6).alias("ema"))


def best_setting(grid: DataFrame, score: Column) -> DataFrame:
    """The setting with the least score, all settings judged at once."""
    return grid.withColumn("score", F.round(score, 6)).orderBy("score", *grid.columns).limit(1)
