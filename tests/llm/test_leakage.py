from __future__ import annotations

import random

import pytest

from folioscope.llm import codes, leakage

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)]


def letters(text):
    c, _ = codes.only_letters(*codes.fold([text]))
    return "".join(map(chr, c))


def test_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices(WORDS, k=40)), "en") for i in range(12)]
    docs = []
    for d in range(120):
        text = " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))
        if d % 3 == 0:
            words = items[d % 12][1].split()
            n = rng.choice([10, 13, 14, 15, 30])
            at = rng.randint(0, 40 - n)
            text += "\n" + " , ".join(words[at : at + n]).upper() + " . " + " ".join(rng.choices(WORDS, k=5))
        docs.append((d, text))
    want = set()
    for i, passage, _ in items:
        words = passage.split()
        windows = [letters(" ".join(words[k : k + 14])) for k in range(len(words) - 13)]
        want |= {(d, i) for d, t in docs if any(w in letters(t) for w in windows)}
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string, lang string"))
    assert {tuple(r) for r in got.collect()} == want and want


@pytest.mark.parametrize("n,found", [(44, False), (45, True)])
def test_japanese_counts_characters(spark, n, found):
    passage = "".join(chr(0x4E00 + (i * 7) % 900) for i in range(80))
    text = "、".join(passage[10 : 10 + n]) + "別"
    got = leakage.find_leaks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(5, passage, "ja")], "item_id bigint, passage string, lang string"))
    assert (got.count() == 1) == found


def test_disguises_and_edges(spark):
    passage = " ".join(WORDS[:20])
    disguised = passage.replace("w", "ｗ").replace("a", "а").replace(" ", " ​\n")
    docs = spark.createDataFrame([(1, disguised, 9), (1, disguised, 9), (2, None, 9), (3, "", 9), (None, passage, 9), (4, passage * 500, 9), (5, " ".join(WORDS[:13]), 9)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, passage, "en", 1), (7, passage, "en", 1), (8, None, "en", 1), (9, "short", None, 1)], "item_id bigint, passage string, lang string, doc_id int")
    assert sorted(tuple(r) for r in leakage.find_leaks(docs, items).collect()) == [(1, 7), (4, 7)]
    assert leakage.find_leaks(docs.limit(0), items).count() == 0
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_items_with_words_in_common(spark):
    """Every item begins alike; the shared windows belong to all of them, the others to one."""
    shared, own = WORDS[:16], [WORDS[20 + i * 20 : 40 + i * 20] for i in range(7)]
    items = spark.createDataFrame([(i, " ".join(shared + w), "en") for i, w in enumerate(own)], "item_id bigint, passage string, lang string")
    docs = spark.createDataFrame([(i, "x " + " ".join(w)) for i, w in enumerate(own)] + [(100, " ".join(shared))], "doc_id bigint, text string")
    assert {tuple(r) for r in leakage.find_leaks(docs, items).collect()} == {(i, i) for i in range(7)} | {(100, i) for i in range(7)}
