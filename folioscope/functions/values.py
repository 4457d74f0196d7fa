"""Typed values out of cell text, as expressions. Nulls stay null; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed patterns for values in business documents.
AMOUNT = r"[¥￥$]?\s*(\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
DATE = r"(20\d{2}|19\d{2})[./\-年](0?[1-9]|1[0-2])([./\-月](0?[1-9]|[12]\d|3[01])日?)?"
POSTAL = r"\b\d{3}-\d{4}\b"
PERCENT = r"(\d{1,2}(?:\.\d+)?)\s*%"
CORPORATE = r"\b\d{13}\b"


def first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def whole_amount(text: Column) -> Column:
    """The first number without its thousands separators and decimals."""
    return F.regexp_replace(first(text, AMOUNT, 1), ",", "").try_cast("bigint")


def iso_date(text: Column) -> Column:
    """The first date as YYYY-MM-DD; without a day the first of the month; an impossible date is null.

    The fixed pattern takes the first alternative that fits, so a day of two digits not starting with 0 is
    read by its first digit; ``augment.era_date`` reads whole days.
    """
    year, month = first(text, DATE, 1), first(text, DATE, 2)
    day = F.coalesce(first(F.regexp_replace(first(text, DATE, 3), r"[^0-9]", ""), r"\d+"), F.lit("1"))
    joined = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year.isNotNull() & F.try_to_date(joined, "yyyy-MM-dd").isNotNull(), joined)


def plain_number(text: Column) -> Column:
    """After taking out separators and currency signs, the text as a number."""
    return F.translate(text, ",¥$€ ", "").try_cast("double")


def token_class(token: Column) -> Column:
    """NUM, UNIT, ID, SYM or TEXT, in this order."""
    t = F.regexp_replace(F.regexp_replace(F.trim(token), r"^[()\[\]{}]+|[()\[\]{}]+$", ""), r"[.,;:、。]+$", "")
    return (
        F.when(t == "", "TEXT")
        .when(t.rlike(r"^[-+]?\d[\d,]*(\.\d+)?%?$"), "NUM")
        .when(F.lower(t).rlike(r"^(mm|cm|m|kg|g|t|kpa|mpa|bar|v|a|w|hz|rpm|min|h|s|pcs|個|枚|本|箱)$"), "UNIT")
        .when(F.upper(t).rlike(r"^[A-Z]{1,4}-?\d[\dA-Z-]*$"), "ID")
        .when(t.rlike(r"^[^A-Za-z0-9぀-鿿]+$"), "SYM")
        .otherwise("TEXT")
    )


def type_signature(text: Column) -> Column:
    """Classes of the white-space tokens, neighbours of the same class taken as one, joined by a hyphen."""
    kinds = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""), token_class)
    kept = F.filter(kinds, lambda k, i: (i == 0) | (k != F.get(kinds, i - 1)))
    return F.array_join(kept, "-")


def concept_tags(text: Column) -> Column:
    """Sorted tags of what kinds of characters and values a text shows."""
    tag = lambda cond, name: F.when(cond, F.lit(name))
    tags = F.array(
        tag(text.rlike("[A-Za-z]"), "alpha"), tag(text.rlike("[0-9]"), "digit"), tag(text.rlike(DATE), "date"), tag(text.rlike(r"[0-9]\.[0-9]"), "decimal"),
        tag(text.rlike("[¥$€]"), "currency"), tag(text.rlike("^[^a-z]*[A-Z][^a-z]*$"), "upper"), tag(text.rlike("^[^A-Z]*[a-z][^A-Z]*$"), "lower"), tag(text.rlike("^[0-9]+$"), "integer"),
    )
    return F.array_sort(F.array_compact(tags))
