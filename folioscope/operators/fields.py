"""Fields, labels and headings read out of lines, cells and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions import words
from folioscope.operators.cells import TABLE

#: Patterns of headings, of identifiers, words of date roles and company forms, scales of numbers.
MARKDOWN, SETEXT = r"^ {0,3}(#{1,6}) +(.*[^ ]) *$", r"^[=\-]{3,}$"
ARTICLE, KEYWORD = r"^第[〇零一二三四五六七八九十百千0-9]+[条章節項]", r"^(section|article|clause|chapter|chapitre|annexe|annex|appendix|schedule) +[a-z0-9.\-]+([ :).\-–—]|$)"
TAX_ID, PHONE, PERCENT = r"\b[Tt][0-9]{10,13}\b", r"\b0[0-9]{1,3}-[0-9]{2,4}-[0-9]{3,4}\b", r"([0-9]{1,3}(?:\.[0-9]+)?) *(?:%|percent)"
DATE_ROLES = [("due", r"due|deadline|until|before|échéance|avant|期限|まで"), ("issue", r"issue|invoice|date:|émission|facture|発行|請求"), ("service", r"service|deliver|shipped|left|livraison|納品|出荷")]
COMPANY_FORMS = r"株式会社|有限会社|合名会社|合資会社|合同会社|Inc\.|Co\.|LLC|G\.K\.|K\.K\."
PREFECTURE = r"^(北海道|東京都|京都府|大阪府|[^ 0-9]{2,3}県)"
SCALES = [("億", 1e8), ("万", 1e4), ("千", 1e3), ("bn", 1e9), ("mm", 1e6), ("m", 1e6), ("b", 1e9), ("k", 1e3)]


def heading_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, heading, level`` of the lines that are headings: marked by ``#``, underlined by the next line, articles, and key words with a number."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("_a")).select(key, "_a", F.posexplode("_a").alias("line", "_raw"))
    raw = F.regexp_replace("_raw", "[\r\t]", " ")
    plain, below = F.trim(raw), F.trim(F.regexp_replace(F.coalesce(F.get("_a", F.col("line") + 1), F.lit("")), "[\r\t]", " "))
    marks = F.regexp_extract(raw, MARKDOWN, 1)
    level = (
        F.when(plain == "", None).when(marks != "", F.length(marks)).when(below.rlike(SETEXT), F.when(below.startswith("="), 1).otherwise(2))
        .when(plain.rlike(ARTICLE) | F.lower(plain).rlike(KEYWORD), 2)
    )
    name = F.when(marks != "", F.regexp_extract(raw, MARKDOWN, 2)).otherwise(plain)
    return lines.select(key, "line", name.alias("heading"), level.alias("level")).where("level IS NOT NULL")


def line_label(text: Column) -> Column:
    """What a line says beside its numbers: numbers out, no punctuation at the ends."""
    return F.btrim(words.squeeze(F.regexp_replace(words.mask_numbers(text), "<num>", "")), F.lit(" :|-•"))


def header_variants(header: Column) -> Column:
    """Forms under which a header may be looked up: as it is, without spaces, without brackets, without punctuation; lower case, each once."""
    h = words.header_key(header)
    bare = F.trim(F.regexp_replace(h, r"[(\[（【][^)\]）】]*[)\]）】]", ""))
    forms = F.array(h, F.replace(h, F.lit(" "), F.lit("")), bare, F.regexp_replace(h, r"[^0-9a-zà-öø-ÿ぀-ヿ一-鿿 ]", ""))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: x != "")))


def schema_token(header: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), r"[^0-9a-zà-öø-ÿ぀-ヿ一-鿿]", "")


def html_headers(html: Column) -> Column:
    """Texts of the header cells of a table in HTML: tags out, entities back."""
    cells = F.regexp_extract_all(html, F.lit(r"(?s)<th[^>]*>(.*?)</th>"), F.lit(1))
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(F.regexp_replace(x, "<[^>]*>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.transform(cells, plain)


def date_role(text: Column) -> Column:
    """Whether a date is one of payment, issue or service by the words beside it, else ``date``."""
    low, out = F.lower(text), F.lit("date")
    for role, pattern in reversed(DATE_ROLES):
        out = F.when(low.rlike(pattern), role).otherwise(out)
    return out


def money(text: Column) -> Column:
    """A number with its scale and sign: brackets or a minus mean negative, ``k``, ``m``, ``bn``, 千, 万, 億 scale; null without a number."""
    t = F.lower(F.translate(text, "，．", ",."))
    digits = F.regexp_replace(F.regexp_extract(t, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "")
    word = F.regexp_extract(t, r"[0-9] ?(億|万|千|bn|mm|m|b|k)(?![a-z])", 1)
    scale = F.coalesce(*(F.when(word == w, F.lit(f)) for w, f in SCALES), F.lit(1.0))
    negative = t.rlike(r"^[^0-9]*[-−△▲][^0-9]*[0-9]|\([^0-9)]*[0-9][^)]*\)")
    return F.when(negative, -1.0).otherwise(1.0) * digits.try_cast("double") * scale


def row_fields(cells: DataFrame) -> DataFrame:
    """Quantity, unit price and amount of each row, by the headers of its cells; a row without any of them is left out."""
    h = words.header_key(F.col("header"))
    number = lambda c: F.regexp_replace(F.regexp_extract(c, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")
    kind = lambda *names: F.max(F.when(h.isin(*names), number(F.col("text"))))
    r = cells.where("row_role <> 'header'").groupBy(*TABLE, "row_idx").agg(
        kind("qty", "quantity", "qté", "quantité", "数量").alias("qty"), kind("unit price", "price", "prix unitaire", "p.u.", "単価").alias("unit_price"), kind("amount", "montant", "金額").alias("amount")
    )
    return r.where("qty IS NOT NULL OR unit_price IS NOT NULL OR amount IS NOT NULL")


def column_kinds(cells: DataFrame) -> DataFrame:
    """Per column of a table: cells of its body, those that are numbers, have separators or percent signs, and what it is by their majority."""
    body = cells.where("row_role = 'body' AND text IS NOT NULL AND text <> ''")
    low = F.col("text")
    g = body.groupBy(*TABLE, "col_idx").agg(
        F.count("*").alias("n"), F.count_if(low.rlike(r"^[-+(]?[¥$€]?[0-9][0-9,. ]*€?\)?$")).alias("n_number"), F.count_if(low.rlike("[0-9],[0-9]{3}")).alias("n_grouped"), F.count_if(low.rlike("[0-9] *%")).alias("n_percent"),
    )
    half = F.col("n") / 2
    return g.withColumn("kind", F.when(F.col("n_percent") > half, "percent").when(F.col("n_grouped") > half, "amount").when(F.col("n_number") > half, "number").otherwise("text"))


def restore_separators(cells: DataFrame) -> DataFrame:
    """``cell_id, text, restored``: whole numbers of four digits or more in columns where at least two cells have separators."""
    grouped = column_kinds(cells).where("n_grouped >= 2").select(*TABLE, "col_idx")
    plain = cells.where(F.col("text").rlike("^[0-9]{4,18}$") & (F.col("row_role") == "body"))
    return plain.join(grouped, [*TABLE, "col_idx"], "left_semi").select("cell_id", "text", F.format_number(F.col("text").cast("bigint"), 0).alias("restored"))


def map_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, local, foreign`` wherever two nested records differ; ``a`` and ``b`` hold ``keys, path, value``, one row per path."""
    j = a.withColumnRenamed("value", "local").join(b.withColumnRenamed("value", "foreign"), [*keys, "path"], "full")
    return j.where(~F.col("local").eqNullSafe(F.col("foreign"))).select(*keys, "path", "local", "foreign")


def nearest_by_order(left: DataFrame, right: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` in its group that is nearest in order, the first on a tie.

    The nearest before and behind come from one sort of both sides, so no group is joined with itself.
    """
    both = left.select(*group, F.col(order).alias("o"), F.col(name).alias("l"), F.lit(None).cast(dict(right.dtypes)[name]).alias("r")).unionByName(
        right.select(*group, F.col(order).alias("o"), F.lit(None).cast(dict(left.dtypes)[name]).alias("l"), F.col(name).alias("r"))
    )
    at = F.when(F.col("r").isNotNull(), F.struct("o", "r"))
    w = Window.partitionBy(*group)
    # Of rows at one place the smallest name counts; those of ``left`` stand behind them, looking back, and before them, looking ahead.
    before = F.last(at, ignorenulls=True).over(w.orderBy(F.col("o"), F.col("r").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(at, ignorenulls=True).over(w.orderBy(F.col("o"), F.col("r").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing))
    c = both.withColumns({"before": before, "behind": behind}).where("l IS NOT NULL")
    options = F.array_compact(F.array(*(F.when(x.isNotNull(), F.struct(F.abs(x["o"] - F.col("o")).alias("gap"), x["o"].alias("o"), x["r"].alias("r"))) for x in (F.col("before"), F.col("behind")))))
    best = F.array_min(options)
    return c.select(*group, F.col("l").alias(name), best["r"].alias("nearest"), best["gap"].alias("gap")).where("nearest IS NOT NULL")
