"""Join of short strings a few edits apart on the hashes of their deletion variants, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm import letters
from folioscope.runtime import cut

_U = np.uint64
_BASE, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_DOWN = _U(pow(int(_BASE), -1, 1 << 64))
#: Hashes go to so many buckets (a power of two); each bucket is sorted on its own.
BUCKETS = 1 << 10
#: Strings longer than two zones are compared by the variants of their first and their last ZONE letters.
ZONE = 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _MIX
    return x ^ (x >> _U(29))


@cache
def _left_out(n: int, most: int) -> list[np.ndarray]:
    """For 0 to ``most`` deletions, the places that are left out of ``n``, a row for each choice."""
    choices = [list(combinations(range(n), d)) for d in range(min(most, n) + 1)]
    return [np.array(c, np.int64).reshape(len(c), d) for d, c in enumerate(choices)]


def _variants(letters_of: np.ndarray, most: int) -> np.ndarray:
    """Hashes of what remains of each row of letters after up to ``most`` deletions, a column for each choice."""
    n, size = letters_of.shape
    out = []
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([_U(1)], np.full(size, _BASE))), dtype=np.uint64)
        sums = np.concatenate((np.zeros((n, 1), np.uint64), np.cumsum(letters_of * up[:size], axis=1, dtype=np.uint64)), axis=1)
        for left_out in _left_out(size, most):
            gone = left_out.shape[1]
            total, down, start = np.full((n, left_out.shape[0]), up[size - gone]), _U(1), np.zeros(left_out.shape[0], np.int64)
            for k in range(gone + 1):  # the letters between two deletions move down by as many places as were left out before
                end = left_out[:, k] if k < gone else np.full(left_out.shape[0], size)
                total += (sums[:, end] - sums[:, start]) * down
                down, start = down * _DOWN, end + 1
            out.append(total)
    return np.concatenate(out, axis=1)


def _keys(texts: list[str], edits: list[int], seeds: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(hash, id)``: two texts of one seed that are at most ``edits`` apart (the lesser of both) share a hash.

    An insertion, a change and a swap of neighbours each leave both texts equal once one letter of each is
    deleted. Of a text of more than two zones either the first or the last letters have half of the edits at most.
    """
    shape = np.array([(len(t), e) for t, e in zip(texts, edits, strict=True)], np.int64).reshape(-1, 2)
    for size, most in np.unique(shape, axis=0).tolist():
        rows = np.flatnonzero((shape == (size, most)).all(axis=1))
        for part in np.array_split(rows, len(rows) // 2000 + 1):
            c = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), size).astype(np.uint64)
            each = []
            if size <= 2 * ZONE + most:
                each.append((_variants(c, most), 0))
            if size > 2 * ZONE:
                spread, half = most, most // 2
                for n in range(ZONE - spread, ZONE + spread + 1):
                    each += [(_variants(c[:, :n], half), 1), (_variants(c[:, -n:], half), 2)]
            with np.errstate(over="ignore"):
                for h, where in each:
                    yield _mixed(h + _mixed(seeds[part] + _U(where))[:, None]).ravel(), np.repeat(ids[part], h.shape[1])


def _spread(batches: Iterator[pa.RecordBatch], edits: int, syllable_edits: int) -> Iterator[pa.RecordBatch]:
    """``(bucket, keys, ids)``: the keys of all strings, packed by bucket."""
    for b in batches:
        ids, scopes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        texts, kana = b.column(2).to_pylist(), b.column(3).to_pylist()
        latin = np.array([max(t) <= "ɏ" for t in texts], bool)
        with np.errstate(over="ignore"):
            text_seed, kana_seed = scopes + np.where(latin, _U(16), _U(32)), scopes + _U(48)
        allowed = [(edits if len(t) >= 10 else 1) if x else syllable_edits for t, x in zip(texts, latin.tolist(), strict=True)]
        read = np.flatnonzero([k != "" for k in kana])
        got = [*_keys(texts, allowed, text_seed, ids), *_keys([kana[i] for i in read], [syllable_edits] * len(read), kana_seed[read], ids[read])]
        if not got:
            continue
        key, of = np.concatenate([k for k, _ in got]), np.concatenate([i for _, i in got])
        bucket = (key >> _U(32)).astype(np.int64) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        key, of, bucket = (key & _U(0xFFFFFFFF)).astype(np.uint32)[order], of[order], bucket[order]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.concatenate((at[1:], [bucket.size]))
        packed = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), packed(key), packed(of)], ["bucket", "keys", "ids"])


def _together(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(a, b)``: the distinct pairs of ids with an equal key, the smaller first."""
    order = np.argsort(key, kind="stable")
    key, ids = key[order], ids[order]
    at, step = np.arange(max(key.size - 1, 0)), 1
    pairs: list[np.ndarray] = []
    while at.size:
        at = at[at + step < key.size]
        at = at[key[at] == key[at + step]]
        a, b = ids[at], ids[at + step]
        pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b])
        step += 1
        if not at.size or sum(map(len, pairs)) > 1_000_000:
            some = np.concatenate(pairs)
            pairs = []
            if some.size:
                names, code = np.unique(some, return_inverse=True)
                code = code.reshape(-1, 2)
                both = np.unique(code[:, 0] * names.size + code[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(names[both // names.size]), pa.array(names[both % names.size])], ["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of ids that share a key; rows of one bucket follow each other."""
    now, keys, ids = -1, [], []
    for b in batches:
        for bucket, k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if bucket != now and keys:
                yield from _together(np.concatenate(keys), np.concatenate(ids))
                keys, ids = [], []
            now = bucket
            keys.append(np.frombuffer(k, np.uint32))
            ids.append(np.frombuffer(i, np.int64))
    if keys:
        yield from _together(np.concatenate(keys), np.concatenate(ids))


def near_pairs(strings: DataFrame, edits: int = 2, syllable_edits: int = 1) -> DataFrame:
    """``(scope, a, b, distance)`` for ordered pairs of distinct strings of one scope that are few edits apart.

    ``strings`` has ``scope`` (only strings of one scope are compared), ``text`` and ``kana`` (a second
    spelling in syllables, may be empty). Each string stands under the hashes of all that remains of it when
    as many letters are left out as edits are allowed; those few edits apart share one, others hardly ever do,
    so the candidates follow the pairs found and not the square of the strings. Verified by exact edit distance
    (swap of neighbours is one edit): ``edits`` in Latin text of ten letters or more, one in shorter text, ``syllable_edits``
    in kanji and between texts that both read as kana.
    No candidate is dropped. Null and empty texts have no pair.
    """
    s = strings.where("text IS NOT NULL AND text <> ''").select("scope", "text", F.coalesce("kana", F.lit("")).alias("kana")).distinct()
    s = cut(s.withColumn("size", F.length("text")).withColumn("id", F.monotonically_increasing_id()))
    keyed = s.select("id", F.xxhash64("scope"), "text", "kana").mapInArrow(lambda b: _spread(b, edits, syllable_edits), "bucket int, keys binary, ids binary")
    met = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "id bigint, id_b bigint").distinct()
    other = s.select(*(F.col(c).alias(f"{c}_b") for c in ("id", "scope", "text", "kana", "size")))
    pairs = met.join(s, "id").join(other, "id_b").where(f"scope = scope_b AND text <> text_b AND abs(size - size_b) <= {max(edits, 3 * syllable_edits)}")  # a syllable has three letters at most
    close = (F.levenshtein("text", "text_b", 2 * edits) >= 0) | ((F.col("kana") != "") & (F.levenshtein("kana", "kana_b", 2 * syllable_edits) >= 0))
    first, last = F.least(F.struct("text", "kana"), F.struct(F.col("text_b").alias("text"), F.col("kana_b").alias("kana"))), F.greatest(F.struct("text", "kana"), F.struct(F.col("text_b").alias("text"), F.col("kana_b").alias("kana")))
    pairs = pairs.where(close).select("scope", first.alias("x"), last.alias("y")).select("scope", "x.text", F.col("y.text").alias("text_b"), "x.kana", F.col("y.kana").alias("kana_b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for scope, x, y, kx, ky in zip(b["scope"], b["text"], b["text_b"], b["kana"], b["kana_b"], strict=True):
                script = max(x) > "ɏ" or max(y) > "ɏ"
                most = syllable_edits if script else edits if min(len(x), len(y)) >= 10 else 1
                if kx and ky:  # both are syllables
                    d = min(letters.distance(x, y, 1), letters.distance(kx, ky, syllable_edits))
                    ok = d <= 1 or d <= syllable_edits and letters.distance(kx, ky, syllable_edits) <= syllable_edits
                else:
                    d = letters.distance(x, y, most)
                    ok = d <= most
                if ok:
                    out.append((scope, x, y, d))
            yield pd.DataFrame(out, columns=["scope", "a", "b", "distance"])

    found = cut(pairs.mapInPandas(verify, "scope string, a string, b string, distance int").distinct())  # read in both directions
    turned = found.select("scope", F.col("b").alias("a"), F.col("a").alias("b"), "distance")
    return found.unionByName(turned)
