"""Image kernels on grey pages: hashes, thresholds, components and projections (portable grey maps, no imaging library)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def decode(data: bytes) -> np.ndarray:
    """A binary grey map (``P5``) or colour map (``P6``) of eight bits as grey values."""
    fields: list[bytes] = []
    i = 0
    while len(fields) < 4:
        while data[i : i + 1].isspace():
            i += 1
        if data[i : i + 1] == b"#":
            i = data.index(b"\n", i) + 1
            continue
        j = i
        while j < len(data) and not data[j : j + 1].isspace():
            j += 1
        if j == i or j == len(data):
            raise ValueError("the header is cut")
        fields.append(data[i:j])
        i = j
    width, height = int(fields[1]), int(fields[2])
    raw = np.frombuffer(data, np.uint8, offset=i + 1)
    if fields[0] == b"P5":
        return raw[: width * height].reshape(height, width).astype(float)
    if fields[0] == b"P6":
        return raw[: width * height * 3].reshape(height, width, 3) @ np.array([0.299, 0.587, 0.114])
    raise ValueError("neither P5 nor P6")


def resize(image: np.ndarray, size: int) -> np.ndarray:
    """Mean of the pixels that fall into each field of a square grid."""
    rows = np.minimum(np.arange(image.shape[0]) * size // image.shape[0], size - 1)
    cols = np.minimum(np.arange(image.shape[1]) * size // image.shape[1], size - 1)
    total, n = np.zeros((size, size)), np.zeros((size, size))
    np.add.at(total, (rows[:, None], cols[None, :]), image)
    np.add.at(n, (rows[:, None], cols[None, :]), 1)
    return np.divide(total, n, out=np.zeros_like(total), where=n > 0)


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits: low cosine frequencies above their median, as a signed integer."""
    n = 32
    small = resize(image, n)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ small @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    value = int(sum(1 << i for i, b in enumerate(bits) if b))
    return value - (1 << 64) if value >= 1 << 63 else value


def small_vector(image: np.ndarray) -> np.ndarray:
    """The image as 16 by 16 fields with mean 0 and deviation 1."""
    v = resize(image, 16).ravel()
    return (v - v.mean()) / (v.std() or 1.0)


def otsu(image: np.ndarray) -> int:
    """The threshold that separates dark and light pixels best (largest variance between them)."""
    counts = np.bincount(np.clip(image, 0, 255).astype(np.uint8).ravel(), minlength=256).astype(float)
    weight, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    rest = weight[-1] - weight
    between = np.divide((mass[-1] * weight - mass * weight[-1]) ** 2, weight * rest, out=np.zeros(256), where=(weight > 0) & (rest > 0))
    return int(np.argmax(between))


def dilate(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Rectangular dilation by running sums."""
    for axis, size in ((0, height), (1, width)):
        before = (size - 1) // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before + 1, size - 1 - before)
        total = np.cumsum(np.pad(mask.astype(int), pad), axis=axis)
        n = mask.shape[axis]
        mask = np.take(total, np.arange(n) + size, axis=axis) - np.take(total, np.arange(n), axis=axis) > 0
    return mask


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes ``(x0, y0, x1, y1, pixels)`` of the four-connected components, by runs of each row."""
    boxes: list[list[int]] = []
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        runs = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            touching = [k for s, e, k in above if s < b and a < e]
            label = len(parent)
            parent.append(label)
            boxes.append([a, y, b, y + 1, b - a])
            for k in touching:
                i, j = sorted((root(k), root(label)))
                if i != j:
                    parent[j] = i
                    p, q = boxes[i], boxes[j]
                    boxes[i] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]), p[4] + q[4]]
            runs.append((a, b, label))
        above = runs
    return sorted(tuple(boxes[i]) for i in range(len(parent)) if root(i) == i)


def bands(mask: np.ndarray, axis: int = 1, gap: int = 2) -> list[tuple[int, int]]:
    """Runs of rows (or columns) that hold ink, runs closer than ``gap`` taken as one."""
    ink = np.concatenate(([0], (mask.sum(axis=axis) > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(ink))
    out: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if out and a - out[-1][1] < gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def profile(images: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key, phash64, small, threshold, n_components, n_bands`` of each image; what can't be decoded has nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, data in zip(b["key"], b["content"], strict=True):
                try:
                    image = decode(bytes(data))
                except (TypeError, ValueError, IndexError):
                    rows.append((k, None, None, None, None, None))
                    continue
                level = otsu(image)
                mask = image <= level
                rows.append((k, perceptual_hash(image), small_vector(image).tolist(), level, len(components(mask)), len(bands(mask))))
            yield pd.DataFrame(rows, columns=["key", "phash64", "small", "threshold", "n_components", "n_bands"]).astype({"phash64": "Int64", "threshold": "Int64", "n_components": "Int64", "n_bands": "Int64"})

    return images.select(images[key].alias("key"), images[content].alias("content")).mapInPandas(run, "key string, phash64 bigint, small array<double>, threshold bigint, n_components bigint, n_bands bigint")
