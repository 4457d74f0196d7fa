"""Tables, columns and rows of two copies matched by what they say, not by their ids."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from folioscope.operators.kernels import assignment, similarity

#: Least similarity of two tables' headers, two columns, two rows, and of a renamed header.
TABLES, COLUMNS, ROWS, RENAMED = 0.3, 0.3, 0.5, 0.3
_ID, _DATE = re.compile(r"\b[A-Z]{1,4}-\d[\dA-Z-]*\b"), re.compile(r"\b\d{4}-\d{2}-\d{2}\b")


def _norm(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


class Table:
    """One table as headers, columns and rows of texts."""

    def __init__(self, g: pd.DataFrame):
        g = g.sort_values(["row_idx", "col_idx", "cell_id"])
        self.cells = {(int(r), int(c)): t for r, c, t in zip(g["row_idx"], g["col_idx"], g["text"], strict=True)}
        top = min((r for r, _ in self.cells), default=0)
        self.columns = sorted({c for _, c in self.cells})
        self.headers = {c: _norm(self.cells.get((top, c))) for c in self.columns}
        self.rows = sorted({r for r, _ in self.cells if r > top})

    def column(self, c: int) -> str:
        return " ".join(_norm(self.cells.get((r, c))) for r in self.rows)

    def row(self, r: int) -> str:
        return " ".join(self.cells.get((r, c)) or "" for c in self.columns)


def _pairs(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    return [(i, j) for i, j in assignment(score.max(initial=0) - score) if score[i, j] >= least] if score.size else []


def match_tables(a: dict, b: dict) -> list[tuple]:
    """Each table of ``a`` in order takes the table of ``b`` with the most headers in common that is still free."""
    free, pairs = dict(b), []
    for i, x in a.items():
        xs = {h for h in x.headers.values() if h}
        overlap = lambda y: len(xs & y) / len(xs | y) if xs | y else 1.0
        best = max(free, key=lambda k: (overlap({h for h in free[k].headers.values() if h}), k == i), default=None)
        if best is not None and overlap({h for h in free[best].headers.values() if h}) >= TABLES:
            pairs.append((i, best))
            del free[best]
    return pairs


def match_columns(a: Table, b: Table) -> list[tuple[int, int]]:
    score = np.array([[max(similarity(a.headers[c], b.headers[e]) if a.headers[c] or b.headers[e] else 0.0, similarity(a.column(c), b.column(e)) if a.column(c) or b.column(e) else 0.0) for e in b.columns] for c in a.columns])
    return [(a.columns[i], b.columns[j]) for i, j in _pairs(score, COLUMNS)]


def match_rows(a: Table, b: Table) -> list[tuple[int, int]]:
    """Equal texts or a common id match fully, a common date nearly, else texts by likeness; the best assignment of all."""

    def like(x: str, y: str) -> float:
        if _norm(x) == _norm(y) or set(_ID.findall(x)) & set(_ID.findall(y)):
            return 1.0
        return 0.9 if set(_DATE.findall(x)) & set(_DATE.findall(y)) else similarity(x, y)

    score = np.array([[like(a.row(r), b.row(s)) for s in b.rows] for r in a.rows])
    return [(a.rows[i], b.rows[j]) for i, j in _pairs(score, ROWS)]


def table_events(x: Table, y: Table) -> list[tuple[str, int | None, int | None, str | None, str | None]]:
    """``(event, place in a, place in b, from, to)``: renamed, moved, added and removed columns, added and removed rows, changed cells."""
    columns, rows, out = dict(match_columns(x, y)), match_rows(x, y), []
    for c, e in columns.items():
        if x.headers[c] != y.headers[e] and similarity(x.headers[c], y.headers[e]) >= RENAMED:
            out.append(("header_renamed", c, e, x.headers[c], y.headers[e]))
        if c != e:
            out.append(("col_moved", c, e, x.headers[c], y.headers[e]))
    out += [("col_removed", c, None, x.headers[c], None) for c in x.columns if c not in columns]
    out += [("col_added", None, e, None, y.headers[e]) for e in y.columns if e not in columns.values()]
    out += [("row_removed", r, None, x.row(r), None) for r in x.rows if r not in {p for p, _ in rows}]
    out += [("row_added", None, s, None, y.row(s)) for s in y.rows if s not in {q for _, q in rows}]
    for r, s in rows:
        for c, e in columns.items():
            old, new = x.cells.get((r, c)), y.cells.get((s, e))
            if old != new:
                out.append(("cell_added" if (r, c) not in x.cells else "cell_removed" if (s, e) not in y.cells else "cell_updated", r, s, old, new))
    return out


def diff_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """``doc_key, page, table_a, table_b, event, at_a, at_b, old, new`` for every difference between the tables of two copies.

    Tables are matched within a page, so a group is what stands on one page of one document in both
    copies. A table without a partner gives ``table_added`` or ``table_removed``; an empty copy makes all of the other such.
    """
    schema = "doc_key string, page int, table_a int, table_b int, event string, at_a int, at_b int, old string, new string"
    names = [f.strip().split()[0] for f in schema.split(",")]

    def events(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        left, right = ({int(k): Table(g) for k, g in side.groupby("table_index")} for side in (x, y))
        pairs = match_tables(left, right)
        out = [(*key, i, None, "table_removed", None, None, None, None) for i in left if i not in {p for p, _ in pairs}]
        out += [(*key, None, j, "table_added", None, None, None, None) for j in right if j not in {q for _, q in pairs}]
        for i, j in pairs:
            out += [(*key, i, j, *e) for e in table_events(left[i], right[j])]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({c: "Int32" for c in ("table_a", "table_b", "at_a", "at_b")})

    columns = ["doc_key", "page", "table_index", "row_idx", "col_idx", "cell_id", "text"]
    whole = "table_index IS NOT NULL AND row_idx IS NOT NULL AND col_idx IS NOT NULL"
    return a.where(whole).select(*columns).groupBy("doc_key", "page").cogroup(b.where(whole).select(*columns).groupBy("doc_key", "page")).applyInPandas(events, schema)
