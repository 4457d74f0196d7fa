"""Vectors of texts and layouts: encoders as Arrow batches, fusion as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "vector", batch: int = 256) -> DataFrame:
    """Adds ``encoder(texts)`` in batches; null texts are encoded as empty ones. A wrong number of rows is an error."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            rows: list = []
            for i in range(0, len(texts), batch):
                got = encoder(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError("the encoder returned another number of rows")
                rows += [np.asarray(v, float).tolist() for v in got]
            yield pd.Series(rows)

    return df.withColumn(out, run(text))


def hashed_bag(texts: list[str], size: int = 64) -> np.ndarray:
    """A text's words hashed into a vector of length one: an encoder that needs no model."""
    import zlib

    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, zlib.crc32(w.encode()) % size] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def layout_features(box: Column, width: Column, height: Column, order: Column, count: Column) -> Column:
    """Corners relative to the page and place in the reading order."""
    at = lambda i: F.get(box, F.lit(i)).cast("double")
    return F.array(at(0) / width, at(1) / height, at(2) / width, at(3) / height, F.coalesce(F.try_divide(order, count - 1), F.lit(0.0)).cast("double"))


def concat_project(parts: list[Column], matrix: list[list[float]] | None = None) -> Column:
    """Vectors behind each other, times a projection matrix (one row per output) where given."""
    joined = F.concat(*parts)
    if matrix is None:
        return joined
    rows = [F.aggregate(F.zip_with(joined, F.array(*(F.lit(float(x)) for x in r)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for r in matrix]
    return F.array(*rows)


def late_fusion(parts: list[Column], weights: list[float]) -> Column:
    """Weighted mean of vectors, shorter ones padded with zeros; null vectors don't count."""
    longest = F.greatest(*(F.coalesce(F.size(p), F.lit(0)) for p in parts), F.lit(0))
    total = sum((F.when(p.isNotNull(), float(w)).otherwise(0.0) for p, w in zip(parts, weights, strict=True)), F.lit(0.0))
    each = lambda i: sum((F.coalesce(F.get(p, i), F.lit(0.0)) * float(w) for p, w in zip(parts, weights, strict=True)), F.lit(0.0))
    return F.when(longest == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0))), lambda i: F.coalesce(F.try_divide(each(i), total), F.lit(0.0))))
