"""Tokenisers and small text functions as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of ``a-z 0-9 - . _``; everything else separates."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9\-._]+"), F.lit(0))


def mixed_tokens(text: Column) -> Column:
    """Latin words and numbers, then overlapping pairs of all other non-space characters in a row; lower case."""
    text = F.coalesce(text, F.lit(""))
    latin = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|\d+(?:,\d{3})*(?:\.\d+)?)"), F.lit(1))
    wide = F.regexp_replace(text, r"[\x00-\x7F\s]", "")
    pairs = F.when(
        F.length(wide) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(wide) - 1, F.lit(1))), lambda i: F.substr(wide, i, F.lit(2)))
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(latin, pairs), F.lower)


def squeeze(text: Column) -> Column:
    """Trimmed, white space collapsed, null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clip(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last being an ellipsis where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"[-+]?[¥$€£]?\d[\d,]*(?:\.\d+)?%?", "<num>")


def header_key(text: Column) -> Column:
    """Lower case, collapsed white space."""
    return F.lower(squeeze(text))


def safe_segment(text: Column) -> Column:
    """Usable as a path segment: other characters become ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9\-_.]+", "_"), r"^_+|_+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, unequal sizes or a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def script_ratios(text: Column) -> dict[str, Column]:
    """Share of kanji, kana, latin letters and digits among the non-space characters."""
    seen = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    n = F.greatest(F.length(seen), F.lit(1))
    keep = {"kanji": "[^\\u4E00-\\u9FFF]", "kana": "[^\\u3040-\\u30FF]", "latin": "[^A-Za-z]", "digit": "[^0-9]"}
    return {k: F.length(F.regexp_replace(seen, p, "")) / n for k, p in keep.items()}
