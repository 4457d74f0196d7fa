"""Texts placed in windows of fixed capacity, sized in tokens, with little space unused."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioscope.runtime import cut

#: Ranks of a public byte-level tokenizer, and its pre-tokenisation (a fixed value of that tokenizer).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Ranks within a length are given in independent shares of about so many pieces, so that a length of very many texts is no one task.
SHARE = 100_000


class Tokenizer:
    """Counts and splits; the same ranks and pattern in any process."""

    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.encode = tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    @staticmethod
    def _kind(ch: str) -> str:
        return "S" if ch.isspace() else "L" if ch.isalpha() else "N" if ch.isnumeric() else "P"

    def _clean(self, before: str, after: str) -> bool:
        """Whether pre-tokenisation breaks here in either part as it does in the whole."""
        a, b = self._kind(before[-1]), self._kind(after[0])
        if b == "S":
            return a != "S" and len(after) > 1 and not after[1].isspace()
        return a not in ("S", b) and before[-1] != "'"

    def _fits(self, data: bytes, low: int, high: int, capacity: int) -> tuple[int, int]:
        """(end, tokens) of the longest part from ``low`` that ends at ``high`` or a little before and has at most ``capacity`` tokens by itself."""
        while True:
            while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
                high -= 1
            if high <= low:  # one character, even if it has more tokens than the capacity
                high = low + 1
                while high < len(data) and data[high] & 0xC0 == 0x80:
                    high += 1
                return high, len(self.encode(data[low:high].decode("utf-8")))
            tokens = self.encode(data[low:high].decode("utf-8"))
            if len(tokens) <= capacity:
                return high, len(tokens)
            high = low + int(self.size[tokens[:capacity]].sum())

    def split(self, data: bytes, tokens: list[int], capacity: int) -> list[tuple[int, int, int]]:
        """(start, end, tokens) in characters of consecutive parts of at most ``capacity`` tokens each.

        Parts end where pre-tokenisation breaks, at the last such place of the part's second half, so
        that its tokens are those of the whole; where there is none the part is encoded by itself, so the
        work grows with the text, broken or not.
        """
        stops = np.cumsum(self.size[tokens])
        parts, low, start, aligned = [], 0, 0, True
        while low < len(data):
            i = int(np.searchsorted(stops, low, "right"))
            j = min(i + capacity, len(tokens))
            high, n = int(stops[j - 1]), j - i
            if j < len(tokens) or not aligned:
                best = 0
                for k in range(j, i + (j - i) // 2, -1) if j < len(tokens) and aligned else ():
                    b = int(stops[k - 1])
                    if data[b] & 0xC0 != 0x80 and self._clean(data[max(low, b - 4) : b].decode("utf-8", "ignore") or "?", data[b : b + 8].decode("utf-8", "ignore")):
                        best = k
                        break
                if best:
                    high, n = int(stops[best - 1]), best - i
                else:
                    high, n = self._fits(data, low, high, capacity)
                    k = int(np.searchsorted(stops, high, "left"))
                    # Tokens of the rest are those of the whole only behind a clean break.
                    at = high < len(data) and k < len(tokens) and int(stops[k]) == high
                    aligned = at and self._clean(data[max(low, high - 4) : high].decode("utf-8", "ignore") or "?", data[high : high + 8].decode("utf-8", "ignore"))
            chars = len(data[low:high].decode("utf-8"))
            parts.append((start, start + chars, n))
            low, start = high, start + chars
        return parts


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def pieces(documents: DataFrame, windows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(window_id, doc_id, part, start_char, end_char, n_tokens)``: each text once per window kind, split only where it exceeds the capacity."""
    kinds = sorted((int(r.window_id), int(r.capacity_tokens)) for r in windows.where("window_id IS NOT NULL AND capacity_tokens > 0").select("window_id", "capacity_tokens").distinct().collect())
    names = ["window_id", "doc_id", "part", "start_char", "end_char", "n_tokens"]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = t.encode(text)
                data = b""
                for window, capacity in kinds:
                    if len(tokens) <= capacity:
                        parts = [(0, len(text), len(tokens))]
                    else:
                        data = data or text.encode("utf-8")
                        parts = t.split(data, tokens, capacity)
                    for i, (start, end, n) in enumerate(parts):
                        for column, value in zip(out, (window, key, i, start, end, n), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    texts = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return texts.mapInArrow(tokenize, ", ".join(f"{n} bigint" for n in names))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: runs ``(length, first_rank, end_rank, first_bin, per_bin)``.

    Bins with equal space left form groups of consecutive numbers. The texts of one length go, as many
    as fit, into the bins with the least sufficient space, else into new ones; a group is split where
    the count ends. The work depends on the number of lengths, not of texts.
    """
    groups: list[tuple[int, int, int]] = []  # (space left, first bin, bins), ascending
    runs, bins = [], 0
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(groups, (length, -1, -1))
            if k < len(groups):
                space, first, n = groups.pop(k)
            else:
                per = max(1, capacity // length)
                space, first, n = max(capacity, length), bins, -(-left // per)
                bins += n
            per = space // length
            full, some = min(n, left // per), 0
            if full:
                runs.append((length, rank, rank + full * per, first, per))
                rank, left = rank + full * per, left - full * per
                if space - per * length:
                    bisect.insort(groups, (space - per * length, first, full))
            if left and full < n:
                some = 1
                runs.append((length, rank, rank + left, first + full, left))
                if space - left * length:
                    bisect.insort(groups, (space - left * length, first + full, 1))
                rank, left = rank + left, 0
            if n - full - some:
                bisect.insort(groups, (space, first + full + some, n - full - some))
    if histogram.get(0):
        runs.append((0, 0, histogram[0], 0, histogram[0]))
    return runs


def assign(documents: DataFrame, windows: DataFrame, path: str = TOKENIZER, share_of: int = SHARE) -> DataFrame:
    """``(window_id, bin_id, doc_id, part, start_char, end_char, n_tokens)`` for every non-null text and window kind.

    Lengths are counted, the plan is made over the counts, and pieces take the planned slots by
    joining on their rank within their length. Ranks are given in shares of about ``share_of`` pieces that
    are counted first, so no length is ranked in one task.

    Defined results: null texts and ids and windows without a positive capacity are left out; the empty
    text has length 0 and stands in bin 0; repeated ids are texts of their own; a text of exactly the
    capacity is not split; parts follow each other without gaps; other columns are not read.
    """
    spark = documents.sparkSession
    p = cut(pieces(documents, windows, path))  # tokenised once, read twice
    share = F.pmod(F.xxhash64("doc_id", "part", "start_char"), F.lit(1 + p.count() // share_of))
    p = p.withColumn("share", share)
    counts = p.groupBy("window_id", "n_tokens", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("window_id", "n_tokens").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    capacity = {r.window_id: r.capacity_tokens for r in windows.collect()}
    histogram: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("window_id", "n_tokens").agg(F.sum("n").alias("n")).collect():  # at most capacity + 1 lengths per window kind
        histogram.setdefault(r.window_id, {})[r.n_tokens] = r.n
    runs = [(w, *run) for w, h in sorted(histogram.items()) for run in plan(h, capacity[w])]
    planned = spark.createDataFrame(runs, "window_id bigint, n_tokens bigint, first_rank bigint, end_rank bigint, first_bin bigint, per_bin bigint")
    mine = Window.partitionBy("window_id", "n_tokens", "share").orderBy("doc_id", "part", "start_char")
    ranked = p.withColumn("i", F.row_number().over(mine)).join(counts.select("window_id", "n_tokens", "share", "base"), ["window_id", "n_tokens", "share"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("i") - 1)
    placed = ranked.join(planned, ["window_id", "n_tokens"]).where("rank >= first_rank AND rank < end_rank")
    slot = F.col("first_bin") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_bin"))
    return placed.select("window_id", slot.cast("bigint").alias("bin_id"), "doc_id", "part", "start_char", "end_char", "n_tokens")


def fill(assigned: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window kind: bins, the fewest bins that could hold so many tokens, tokens placed, the fullest bin, share of the space used."""
    per_bin = assigned.groupBy("window_id", "bin_id").agg(F.sum("n_tokens").alias("used"))
    total = per_bin.groupBy("window_id").agg(F.count("*").alias("n_bins"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    kinds = windows.select("window_id", "capacity_tokens").distinct()
    return total.join(F.broadcast(kinds), "window_id").select("window_id", "n_bins", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_bins"), "n_tokens", "fullest", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("used_share"))
