"""Passages of held-out items inside the texts of a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm import codes
from folioscope.runtime import cut

#: Letters in a shingle: no more than the fewest that a window of WORDS words can have.
SHINGLE = 12
WORDS, CHARACTERS = 14, 45
#: Bits of the filter that goes to the workers, however many items there are.
_BITS = 25
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93))


@dataclass
class Item:
    """A passage as letters, and its windows as [start, end) among them, both ascending."""

    item_id: int
    letters: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _hashes(letters: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE letters from each position on."""
    if letters.size < SHINGLE:
        return np.empty(0, np.uint64)
    one = letters.astype(np.uint64) * _ODD[0]
    two = one[:-1] * _ODD[1] + one[1:]
    four = two[:-2] * _ODD[2] + two[2:]
    eight = four[:-4] * _ODD[3] + four[4:]
    h = eight[:-4] * _ODD[4] + four[8:]
    h ^= h >> np.uint64(29)
    return h * _ODD[0]


def item_windows(item_id: int, passage: str, lang: str | None) -> Item:
    """Windows of WORDS words between white space, or of CHARACTERS letters where the passage is Japanese."""
    letters, _ = codes.only_letters(*codes.fold([passage]))
    japanese = lang == "ja" or (lang not in ("en", "fr") and np.count_nonzero(letters > 0x2E80) * 2 > letters.size)
    if japanese:
        starts = np.arange(max(0, letters.size - CHARACTERS + 1))
        return Item(item_id, letters, starts, starts + CHARACTERS)
    words = passage.split()
    _, at = codes.only_letters(*codes.fold(words)) if words else (None, np.empty(0, np.int64))
    at = np.unique(np.concatenate(([0], at)))  # words without letters or digits are none
    return Item(item_id, letters, at[: max(0, at.size - WORDS)], at[WORDS:])


class _Filter:
    """Which hashes may be among known ones: one bit per leading bits of the hash, so its size is fixed. The join tells exactly."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, hashes: DataFrame) -> _Filter:
        """Built in a few parts from a column of hashes, put together on the driver."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << _BITS, bool)
            for batch in batches:
                bits[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - _BITS)] = True
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

        whole = np.zeros(1 << _BITS >> 3, np.uint8)
        for (packed,) in hashes.coalesce(2).mapInArrow(part, "bits binary").toLocalIterator():
            whole |= np.frombuffer(packed, np.uint8)
        return cls(whole)

    def find(self, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and text of each shingle that lies within one text and may be known."""
        at = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        at = np.flatnonzero(self.bits[at >> 3] & (128 >> (at & 7)).astype(np.uint8))
        text = np.searchsorted(ends, at, "right")
        inside = at + SHINGLE <= ends[text] if at.size else np.zeros(0, bool)
        return at[inside], text[inside]


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _shingles(items: DataFrame) -> DataFrame:
    """``(item, shingle, position)`` for every shingle of every item that has a window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, passage, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                item = item_windows(key, passage, lang)
                if item.starts.size:
                    h = _hashes(item.letters)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(h.size, key)), _signed(h), pa.array(np.arange(h.size))], ["item", "shingle", "position"])

    return items.select("item", "passage", "lang").mapInArrow(each, "item bigint, shingle bigint, position bigint")


def _rarity(texts: DataFrame, known: _Filter) -> DataFrame:
    """``(shingle, n)``: how often shingles that may be known occur in the corpus, counted per batch, added up after."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in codes.groups(batches):
            letters, ends = codes.only_letters(*codes.fold(group))
            h = _hashes(letters)
            at, _ = known.find(h, ends)
            each, n = np.unique(h[at], return_counts=True)
            if each.size:
                yield pa.RecordBatch.from_arrays([_signed(each), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return texts.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def _prefixes(items: DataFrame, shingles: DataFrame, rarity: DataFrame) -> DataFrame:
    """``(shingle, item, position)``: the rarest shingle of every window.

    A document that contains a window contains all its shingles, so a prefix of one suffices; a
    window with a shingle that never occurs occurs nowhere.
    """
    ranked = shingles.join(rarity, "shingle", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce("n", F.lit(0)).alias("n"), "shingle"))).alias("a"))  # as many as the passage has letters

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, passage, lang, ordered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                item, rank = item_windows(key, passage, lang), np.array([x["n"] for x in ordered])
                least = {start + int(np.argmin(rank[start : end - SHINGLE + 1])) for start, end in zip(item.starts, item.ends, strict=True)}
                at = sorted(p for p in least if rank[p])
                yield pa.RecordBatch.from_arrays([pa.array([ordered[p]["shingle"] for p in at], pa.int64()), pa.array([key] * len(at), pa.int64()), pa.array(at, pa.int64())], ["shingle", "item", "position"])

    return items.join(ranked, "item").select("item", "passage", "lang", "a").mapInArrow(choose, "shingle bigint, item bigint, position bigint")


def _occurrences(texts: DataFrame, wanted: _Filter) -> DataFrame:
    """``(doc_id, text, hits)`` of the documents that may hold a prefix, with the shingles and where they stand."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group in codes.groups(batches):
            letters, ends = codes.only_letters(*codes.fold(group))
            h = _hashes(letters)
            at, text = wanted.find(h, ends)
            starts = np.concatenate(([0], ends[:-1])) if ends.size else ends
            rows = np.unique(text)
            hits = [[{"shingle": int(s), "at": int(a)} for s, a in zip(h[at[text == t]].view(np.int64), at[text == t] - starts[t], strict=True)] for t in rows]
            if hits:
                kind = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t in rows], pa.int64()), pa.array([group[t] for t in rows]), pa.array(hits, kind)], ["doc_id", "text", "hits"])

    return texts.mapInArrow(find, "doc_id bigint, text string, hits array<struct<shingle: bigint, at: bigint>>")


def _contains(letters: np.ndarray, low: int, high: int, at: int, item: Item, position: int) -> bool:
    """Whether the text [low, high) around ``at`` equals the item around ``position`` over one of its windows."""
    before = min(position, at - low)
    after = min(item.letters.size - position, high - at)
    same = letters[at - before : at + after] == item.letters[position - before : position + after]
    unequal = np.flatnonzero(~same)
    cut = np.searchsorted(unequal, before)
    left = position - before + (unequal[cut - 1] + 1 if cut else 0)
    right = position - before + (unequal[cut] if cut < unequal.size else same.size)
    window = np.searchsorted(item.starts, left)
    return bool(window < item.starts.size and item.ends[window] <= right)


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` for every document that holds a window of an item's passage.

    A window is WORDS consecutive words, in Japanese passages CHARACTERS consecutive letters. Case,
    punctuation, spacing, line breaks and equal-looking characters don't count. Set join with prefix
    filter: the shingles of each window are ordered by how rarely they occur in the whole corpus,
    documents are joined on the rarest one, and exact containment is verified over the windows around
    the place where it stands, within the bounds of text and item. The corpus is read twice, to count
    and to join, however many items there are; of its texts only those that may hold a prefix travel.

    Defined results: null and short texts and passages hold nothing; repeated documents or items
    give their row once; an empty side gives no rows; other columns are not read.
    """
    texts = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    asked = items.select(F.col("item_id").cast("bigint"), "passage", "lang").where("item_id IS NOT NULL AND passage IS NOT NULL").distinct()
    asked = cut(asked.withColumn("item", F.monotonically_increasing_id()))
    shingles = cut(_shingles(asked))
    prefixes = cut(_prefixes(asked, shingles, _rarity(texts, _Filter.of(shingles.select("shingle")))))
    found = cut(_occurrences(texts, _Filter.of(prefixes.select("shingle"))).withColumn("row", F.monotonically_increasing_id()))
    places = found.select("row", F.explode("hits").alias("h")).select("row", "h.shingle", "h.at").join(prefixes, "shingle")
    pairs = places.groupBy("row", "item").agg(F.collect_set(F.struct("at", "position")).alias("places"))  # as many as the text has letters at most
    pairs = pairs.join(asked, "item").join(found.select("row", "doc_id", "text"), "row").select("doc_id", "item_id", "text", "passage", "lang", "places")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, text, passage, lang, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                item = item_windows(key, passage, lang)
                letters, _ = codes.only_letters(*codes.fold([text]))
                if any(_contains(letters, 0, letters.size, p["at"], item, p["position"]) for p in places):
                    out.append((doc, key))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([i for _, i in out], pa.int64())], ["doc_id", "item_id"])

    return pairs.mapInArrow(verify, "doc_id bigint, item_id bigint").distinct()
