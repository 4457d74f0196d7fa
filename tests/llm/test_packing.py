from __future__ import annotations

import random
from collections import defaultdict

import pytest

from folioscope.llm import packing


def check_runs(histogram, capacity):
    used, got = defaultdict(int), defaultdict(int)
    for length, first, end, start, per in packing.plan(histogram, capacity):
        for rank in range(first, end):
            used[start + (rank - first) // per] += length
        got[length] += end - first
    assert got == {k: v for k, v in histogram.items() if v}
    assert max(used.values(), default=0) <= capacity
    return len(used), sum(k * v for k, v in histogram.items())


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_well(seed):
    rng = random.Random(seed)
    capacity = rng.choice([50, 512])
    histogram = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(30)}
    bins, tokens = check_runs(histogram, capacity)
    assert bins <= 1.25 * tokens / capacity + 2


def test_plan_small_cases():
    assert packing.plan({}, 10) == []
    assert check_runs({10: 3}, 10)[0] == 3
    assert check_runs({6: 2, 4: 2}, 10)[0] == 2
    assert check_runs({1: 1000}, 10)[0] == 100


DOCS = [
    (1, "plain words of a short text", 0), (2, "", 0), (3, None, 0), (4, "日本語の文章です。" * 90, 0), (5, "word " * 700, 0), (6, "ａ" * 900, 0), (7, "x\n\n  y  " * 300, 0), (8, "🙂🙃" * 150, 0), (9, "same", 0),
    (9, "same", 0), (10, "it's don't we'll " * 120, 0),
]


def test_assignment_is_whole(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, n_tokens int")
    windows = spark.createDataFrame([(1, "s", 64), (2, "m", 300), (3, "none", 0)], "window_id bigint, window_name string, capacity_tokens int")
    rows = packing.assign(docs, windows, share_of=3).collect()
    encode = packing.tokenizer(packing.TOKENIZER).encode
    capacity, texts = {1: 64, 2: 300}, {i: t for i, t, _ in DOCS}
    parts, bins = defaultdict(list), defaultdict(int)
    for r in rows:
        parts[(r.window_id, r.doc_id)].append((r.part, r.start_char, r.end_char, r.n_tokens))
        bins[(r.window_id, r.bin_id)] += r.n_tokens
    assert {k[1] for k in parts} == {i for i, t, _ in DOCS if t is not None} and {k[0] for k in parts} == {1, 2}
    assert all(n <= capacity[w] for (w, _), n in bins.items())
    for (w, i), ps in parts.items():
        ps = sorted(set(ps))
        text = texts[i]
        assert "".join(text[a:b] for _, a, b, _ in ps) == text and ps[0][1] == 0
        assert len(ps) == 1 or len(encode(text)) > capacity[w]
        for _, a, b, n in ps:
            assert len(encode(text[a:b])) == n <= capacity[w]
    assert len(parts[(1, 9)]) == 2  # repeated ids are texts of their own


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    windows = spark.createDataFrame([(1, "s", 64)], "window_id bigint, window_name string, capacity_tokens int")
    assert packing.assign(docs, windows).count() == 0
    assert packing.assign(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), windows.limit(0)).count() == 0


def test_unbroken_text_takes_time_in_proportion():
    import time

    t = packing.tokenizer(packing.TOKENIZER)

    def seconds(n):
        text = "漢字仮名交文" * n
        tokens, data = t.encode(text), text.encode()
        began = time.perf_counter()
        parts = t.split(data, tokens, 256)
        assert all(len(t.encode(text[a:b])) == k <= 256 for a, b, k in parts) and parts[-1][1] == len(text)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8_000) < 16 * max(seconds(1_000), 0.01)
