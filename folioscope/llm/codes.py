"""Texts as arrays of folded code points, many documents at a time (NumPy kernels inside Arrow batches)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from folioscope.llm import charmap

#: Classes in a folded array; every greater code is a letter or digit.
DROP, SPACE, BREAK, STOP, MASK, DOT, OTHER = 0, 1, 2, 3, 4, 5, 6
#: Codes handled at once at most, unless one text alone is longer: bounds a worker's memory.
CHUNK = 1 << 17
_EXPANDS = 7

_BREAKS = "\n\r  \u0085\x0b\x0c"
_STOPS = "。！？!?｡"
_MASKS = "*#@$%&"


def _fold(ch: str) -> int | str:
    """Code of one character; a string when it stands for several."""
    if ch in _BREAKS:
        return BREAK
    plain = charmap.plain_of(ch)
    letters = "".join(c for c in plain.lower() if not unicodedata.combining(c))
    if not letters:
        return DROP
    if len(letters) > 1:
        return letters
    if letters == " ":
        return SPACE
    if ch in _STOPS or letters in _STOPS:
        return STOP
    if letters in _MASKS:
        return MASK
    if letters == ".":
        return DOT
    if not letters.isalnum() and unicodedata.category(letters)[0] not in "L":
        return OTHER
    letters = charmap.TO_LATIN.get(letters, "3" if letters in "Зз" else letters)
    return ord(letters)


@cache
def _tables() -> tuple[np.ndarray, dict[int, str]]:
    table = np.arange(0x110000, dtype=np.uint32)
    expand: dict[int, str] = {}
    for cp in [*range(0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0080)]:
        code = _fold(chr(cp))
        if isinstance(code, str):
            expand[cp], code = code, _EXPANDS
        table[cp] = code
    table[0xD800:0xE000] = OTHER
    return table, expand


def _raw(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded codes of all texts in a row, and where each text ends: case, accents, width, look-alikes and invisible characters gone."""
    table, expand = _tables()
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    codes = table[_raw(texts)]
    several = np.flatnonzero(codes == _EXPANDS)
    if several.size:
        texts = list(texts)
        for i in np.unique(np.searchsorted(ends, several, "right")):
            texts[i] = texts[i].translate(expand)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        codes = table[_raw(texts)]
    keep = codes != DROP
    kept = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], kept[ends]


def only_letters(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = codes > OTHER
    kept = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], kept[ends]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and non-null texts of (id, text) batches, in groups of about CHUNK characters."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None:
                continue
            if texts and size + len(text) > CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(text)
            size += len(text)
        if texts:
            yield ids, texts
