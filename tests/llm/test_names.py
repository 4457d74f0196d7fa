from __future__ import annotations

import pytest

from folioscope.llm import letters, names
from folioscope.llm.similar import near_pairs

SAME = [
    ("Galpos Elmistrin Chemical Co., Ltd.", "CHEMICAL GALPOS ELMISTRIN COMPANY LIMITED"), ("Galpos Elmistrin Chemical Co., Ltd.", "Elmistrin, Galpps Chem."), ("株式会社ヒレドガヒ化学", "Hierdogahi Chemical KK"),
    ("㈱黒龍瀧坂宮化学　購買課", "黒竜滝坂宮化学株式会社"), ("Victoria Pelbel-Rinbrised", "Rinbrised"), ("Mx Victoria Pelbel-Rinbrised", "Pelel-Rinbrised, Vicky"), ("Électricité Narsed Varethkar SAS", "Narsedvarethkar Elec. S.A.S."),
    ("T. Rudeth-Prabelvel", "Thomas A. Rudeth-Prabelvel"), ("Tamost Elmvelelm Llc", "PKG. TAMOST ELMVELELM"),
    # words that stand in no list
    ("Hartwell Brothers Ltd", "Hartwell Bros. Ltd"), ("Meridia International plc", "Meridia Intl"), ("Castleford Insurance Co.", "Castleford Ins. Company"), ("Novexa Pharmaceutical Inc", "Novexa Pharma Inc."),
    ("Textiles Yamato Ltd", "Yamato Textiles Ltd"), ("Chidi Okafor", "C. Okafor"), ("Adaeze Nwosu-Bello", "Nwosu-Bello, Adaeze"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    rows, n = [], 0
    for a, b in SAME:
        rows += [(n, a, "x"), (n + 1, b, "x")]
        n += 2
    rows += [(100, "Belald Tamhastorn Electric", "x"), (101, "Belald Tamhastorn Manufacturing", "x"), (102, "Belald Tamhastorn LLC", "x"), (103, None, "x"), (104, "", "x"), (105, "---", "x"), (106, "Margaret Pelbel-Rinbrised", "x")]
    rows += [(300, "Hartwell Insurance Ltd", "x"), (301, "Meridia Brothers", "x"), (302, "Ngozi Okafor", "x")]
    rows += [(200 + i, "Oxkar Ludbel Foods Inc.", "x") for i in range(6)]
    df = spark.createDataFrame(rows, "party_id bigint, company string, core string")
    return {tuple(r) for r in names.found(df).collect()}


@pytest.mark.parametrize("i", [i for i in range(len(SAME)) if i != 4])
def test_same(pairs, i):
    assert (2 * i, 2 * i + 1) in pairs


def test_different(pairs):
    assert (100, 101) not in pairs  # another line of business
    assert (100, 102) not in pairs and (101, 102) not in pairs  # could be either
    assert not any(106 in p and (8 in p or 10 in p) for p in pairs)  # another given name
    assert not any(x in p and not {300, 301, 302} >= set(p) for p in pairs for x in (300, 301, 302) if x != 301 or 301 in p)
    assert not any({103, 104, 105} & set(p) for p in pairs)
    assert sum(a >= 200 and b >= 200 for a, b in pairs) == 15 and all(a < b for a, b in pairs)


def test_recall_by_kind_of_variant(spark):
    """Typo, abbreviation, reordering and nickname, each over thirty organisations or persons whose words stand in no list."""
    import random

    rng = random.Random(4)
    syllables = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    word = lambda n: "".join(rng.choices(syllables, k=n))
    common = ["brothers", "international", "insurance", "pharmaceutical", "associates", "ventures"]
    rows, want = [], {}
    for i in range(120):
        kind = ("typo", "abbreviation", "reordering", "nickname")[i % 4]
        a, b, c = word(3), word(4), rng.choice(common)
        full = f"{a} {b} {c}"
        if kind == "typo":
            k = rng.randrange(len(b))
            other = f"{a} {b[:k] + rng.choice('xqw') + b[k + 1:]} {c}"
        elif kind == "abbreviation":
            other = f"{a} {b} {c[0] + ''.join(x for x in c[1:] if x not in 'aeiou')}"
        elif kind == "reordering":
            other = f"{c} {b} {a}"
        else:
            full, other = f"Robert {a}{b}", f"Bob {a}{b}"
        rows += [(2 * i, full), (2 * i + 1, other)]
        want.setdefault(kind, set()).add((2 * i, 2 * i + 1))
    got = {tuple(r) for r in names.found(spark.createDataFrame(rows, "party_id bigint, company string")).collect()}
    for kind, pairs in want.items():
        assert len(pairs & got) >= 0.9 * len(pairs), kind
    assert len(got - set().union(*want.values())) <= 2


def test_the_threshold_rejects(spark):
    """Names that share a rare word and no more are weighed and rejected."""
    rows = [(i, f"Zebulon {w} Ltd", 0) for i, w in enumerate(("Foundry", "Orchard", "Mattress", "Bakery"))]
    df = spark.createDataFrame(rows, "party_id bigint, company string, x int")
    words = spark.createDataFrame([("org", f"zebulon{w}", ["zebulon", w]) for w in ("foundry", "foundries", "bakery")], "kind string, core string, words array<string>")
    assert names.found(df).count() == 0
    soft = {(r.a, r.b): r.soft for r in names.similar_words(words).collect()}
    assert all(v < names.ALIKE for k, v in soft.items() if "zebulonbakery" in k)


def test_empty(spark):
    assert names.found(spark.createDataFrame([], "party_id bigint, company string")).count() == 0


def test_near_pairs_against_brute_force(spark):
    import random

    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefgh", k=14)) for _ in range(25)]
    texts = set(base)
    for b in base:
        for _ in range(3):
            s = list(b)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(s) - 1)
                what = rng.randrange(4)
                if what == 0:
                    s[i] = rng.choice("abcdefgh")
                elif what == 1:
                    del s[i]
                elif what == 2:
                    s.insert(i, rng.choice("abcdefgh"))
                else:
                    s[i], s[i + 1] = s[i + 1], s[i]
            texts.add("".join(s))
    texts = sorted(t for t in texts if len(t) >= 10)
    want = {(a, b) for a in texts for b in texts if a != b and letters.distance(a, b, 2) <= 2}
    got = near_pairs(spark.createDataFrame([("s", t, "") for t in texts], "scope string, text string, kana string"))
    assert {(r.a, r.b) for r in got.collect()} == want


def test_candidates_do_not_grow_as_the_square(spark):
    """Strings of a few syllables share their rarest grams with ever more others, but hardly their deletion variants."""
    import random

    import pyarrow as pa

    from folioscope.llm import similar

    rng = random.Random(8)
    syllables = [c + v + d for c in "bdgklmnprst" for v in "aeiou" for d in "lrn"]

    def candidates(n):
        texts = sorted({"".join(rng.choices(syllables, k=5)) for _ in range(n)})
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int64()), pa.array(texts), pa.array([""] * len(texts))], ["id", "seed", "text", "kana"])
        met = list(similar._meet(similar._spread(iter([batch]), 2, 1)))
        return sum(m.num_rows for m in met)

    assert candidates(4000) < 40 and candidates(8000) < 80


@pytest.mark.parametrize("length", [12, 39, 41, 43, 90])
def test_near_pairs_of_any_length(spark, length):
    import random

    rng = random.Random(length)
    s = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=length))
    swap = lambda x, i: x[:i] + x[i + 1] + x[i] + x[i + 2 :]
    others = [swap(swap(s, 2), length - 4), "x" + s + "x", s[1:-1], swap(s, length // 2 - 1)[:-1], s[3:]]
    texts = [s, *others]
    want = {(a, b) for a in texts for b in texts if a != b and letters.distance(a, b, 2) <= 2}
    got = near_pairs(spark.createDataFrame([("s", t, "") for t in texts], "scope string, text string, kana string"))
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) >= 8


def test_pairs_are_not_shuffled(spark):
    """Every pair comes out once without being compared with the others, ids in several classes included."""
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (2, 4), (2, 4), (5, 4), (6, 6)] + [(100 + i, 100) for i in range(150)], "party_id bigint, class_id bigint")
    links = spark.createDataFrame([(1, 3), (1, 4), (3, 100)], "class_a bigint, class_b bigint")
    got = names.expand(members, links)
    assert "keys=[party_id_a" not in got._jdf.queryExecution().toString()
    rows = [tuple(r) for r in got.collect()]
    classes = {p: {c for q, c in ((1, 1), (2, 1), (3, 3), (4, 4), (2, 4), (5, 4), (6, 6)) if q == p} for p in range(1, 7)} | {100 + i: {100} for i in range(150)}
    near = {(1, 3), (1, 4), (3, 100), (3, 1), (4, 1), (100, 3)}
    want = {(a, b) for a in classes for b in classes if a < b and (classes[a] & classes[b] or any((x, y) in near for x in classes[a] for y in classes[b]))}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_distance():
    assert letters.distance("abcd", "abdc") == 1 and letters.distance("abc", "abc") == 0 and letters.distance("abc", "xyz", 2) == 3
    assert letters.kana_of("hiredogahi") and letters.romaji("ヒレドガヒ") == "hiredogahi" and letters.kana_of("strk") == ""
