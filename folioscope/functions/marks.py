"""Plain forms of typographic variants, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Full-width printable ASCII stands at a fixed distance from ASCII.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "￥"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "¥"
_SPACES = "       　\t\r\n"
_MINUS = "‐‑‒–−"
_HIDDEN = "­​‌‍‎‏⁠﻿"


def narrow(text: Column) -> Column:
    """Full-width to ASCII, every space plain, minus signs ASCII, invisible characters gone."""
    source = _WIDE + _SPACES + _MINUS + _HIDDEN
    return F.translate(text, source, _NARROW + " " * len(_SPACES) + "-" * len(_MINUS))


def narrow_sql(expression: str) -> str:
    """The same in SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"translate({expression}, {quoted(_WIDE + _SPACES + _MINUS + _HIDDEN)}, {quoted(_NARROW + ' ' * len(_SPACES) + '-' * len(_MINUS))})"
