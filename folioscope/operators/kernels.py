"""Inherently sequential algorithms, one bounded group (a table, a page, a document pair) at a time."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Optimal assignment of rows to columns (shortest augmenting paths with potentials), any shape."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[j] = True
            free = np.flatnonzero(~done[1:]) + 1
            reduced = c[owner[j] - 1, free - 1] - u[owner[j]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j
            nxt = free[np.argmin(least[free])]
            step = least[nxt]
            u[owner[done]] += step
            v[np.flatnonzero(done)] -= step
            least[free] -= step
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; two empty texts are equal."""
    return 1.0 if not a and not b else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def match_by_text(left: DataFrame, right: DataFrame, group: list[str], key: str, text: str, least: float) -> DataFrame:
    """Optimal pairing of two sides' rows within a group by the similarity of their texts: ``group, key_a, key_b, score``.

    Groups must be bounded by nature (the sections of one document, the rows of one table).
    """
    a = left.select(*group, left[key].cast("bigint").alias("key"), left[text].alias("text"))
    b = right.select(*group, right[key].cast("bigint").alias("key"), right[text].alias("text"))
    types = dict(a.dtypes)
    schema = ", ".join(f"{g} {types[g]}" for g in group) + ", key_a bigint, key_b bigint, score double"

    def pair(group_key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values("key"), y.sort_values("key")
        rows = []
        if len(x) and len(y):
            s = np.array([[similarity(p or "", q or "") for q in y["text"]] for p in x["text"]])
            rows = [(*group_key, x["key"].iloc[i], y["key"].iloc[j], round(float(s[i, j]), 6)) for i, j in assignment(1 - s) if s[i, j] >= least]
        return pd.DataFrame(rows, columns=[*group, "key_a", "key_b", "score"])

    return a.groupBy(*group).cogroup(b.groupBy(*group)).applyInPandas(pair, schema)


def unified(left: list[str], right: list[str], context: int = 2) -> str:
    return "\n".join(difflib.unified_diff(left, right, "a", "b", n=context, lineterm=""))


def line_diffs(left: DataFrame, right: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """Unified diff of the ordered lines of both sides of each group that differ: ``group, diff``."""
    types = dict(left.dtypes)
    schema = ", ".join(f"{g} {types[g]}" for g in group) + ", diff string"

    def diff(group_key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        lines = [[v or "" for v in s.sort_values([order, text], na_position="first")[text]] for s in (x, y)]
        out = unified(*lines)
        return pd.DataFrame([(*group_key, out)] if out else [], columns=[*group, "diff"])

    a, b = (s.select(*group, order, text) for s in (left, right))
    return a.groupBy(*group).cogroup(b.groupBy(*group)).applyInPandas(diff, schema)


def smooth(values: np.ndarray, weight: float) -> np.ndarray:
    """Least squares with a penalty on first differences: one tridiagonal system, solved in one sweep."""
    n = len(values)
    if n < 2 or weight <= 0:
        return values.astype(float)
    diagonal = np.full(n, 1 + 2 * weight)
    diagonal[[0, -1]] = 1 + weight
    upper, rhs = np.zeros(n), values.astype(float).copy()
    upper[0] = -weight / diagonal[0]
    rhs[0] /= diagonal[0]
    for i in range(1, n):
        pivot = diagonal[i] + weight * upper[i - 1]
        upper[i] = -weight / pivot
        rhs[i] = (rhs[i] + weight * rhs[i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        rhs[i] -= upper[i] * rhs[i + 1]
    return rhs


def centers(values: np.ndarray, gap: float) -> np.ndarray:
    """One-dimensional clusters: sorted values join the running mean unless they are further than ``gap`` from it."""
    out: list[list[float]] = []
    for v in np.sort(values.astype(float)):
        if out and v - out[-1][0] <= gap:
            out[-1][1] += 1
            out[-1][0] += (v - out[-1][0]) / out[-1][1]
        else:
            out.append([v, 1])
    return np.array([c for c, _ in out])


def box_groups(boxes: np.ndarray) -> np.ndarray:
    """Connected components of intersecting boxes (x0, y0, x1, y1), numbered in order of their first box."""
    n = len(boxes)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.argsort(boxes[:, 0], kind="stable") if n else []
    active: list[int] = []
    for i in order:  # sweep from left to right: only boxes still open can intersect
        active = [j for j in active if boxes[j, 2] >= boxes[i, 0]]
        for j in active:
            if boxes[j, 1] <= boxes[i, 3] and boxes[i, 1] <= boxes[j, 3]:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        active.append(i)
    number: dict[int, int] = {}
    return np.array([number.setdefault(root(i), len(number)) for i in range(n)], int)


def per_group(df: DataFrame, group: list[str], schema: str, kernel: Callable[[tuple, pd.DataFrame], list[tuple]]) -> DataFrame:
    """``kernel(key, rows)`` for each group; its tuples follow the group's columns."""
    types = dict(df.dtypes)
    full = ", ".join(f"{g} {types[g]}" for g in group) + ", " + schema
    names = [*group, *(part.split()[0] for part in schema.split(", "))]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in kernel(key, rows)], columns=names)

    return df.groupBy(*group).applyInPandas(run, full)
