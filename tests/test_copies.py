from __future__ import annotations

from datetime import datetime

from folioscope.operators.copies import compare_copies

SCHEMA = "id bigint, x string, y int, loaded_at timestamp, k string, a string, side int"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def run(spark, a, b, schema=SCHEMA):
    out = compare_copies(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "id", ["x", "y"], "loaded_at").collect()
    return sorted((r.record_id if r.record_id is not None else -1, r.difference) for r in out)


def row(i, x, y, t=T0):
    return (i, x, y, t, "clash", "clash", 1)


def test_all_differences(spark):
    a = [row(1, "p", 1), row(2, None, 1), row(3, "q", 1), row(4, "only", 1), row(5, "", 2)]
    b = [row(1, "p", 1), row(2, "", 1), row(3, "r", 2), row(6, "only", 1), row(5, "", 2)]
    assert run(spark, a, b) == [(2, "x"), (3, "x"), (3, "y"), (4, "only_a"), (6, "only_b")]


def test_repeats_newest_wins_and_null_key(spark):
    a = [row(1, "old", 1), row(1, "new", 1, T1), row(None, "n", 1)]
    b = [row(1, "new", 1)] * 50 + [row(None, "m", 1)]
    assert run(spark, a, b) == [(-1, "x")]


def test_empty_sides(spark):
    assert run(spark, [], []) == []
    assert run(spark, [row(1, None, None)], []) == [(1, "only_a")]
    assert run(spark, [], [row(1, "x" * 200_000, None)]) == [(1, "only_b")]


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    a = [row(i, rng.choice(["p", "q", None]), rng.choice([1, 2])) for i in range(200) if rng.random() < 0.9]
    b = [row(i, rng.choice(["p", "q", None]), rng.choice([1, 2])) for i in range(200) if rng.random() < 0.9]
    da, db = {r[0]: r for r in a}, {r[0]: r for r in b}
    want = []
    for i in sorted(da.keys() | db.keys()):
        if i not in db:
            want.append((i, "only_a"))
        elif i not in da:
            want.append((i, "only_b"))
        else:
            want += [(i, f) for f, k in (("x", 1), ("y", 2)) if da[i][k] != db[i][k]]
    assert run(spark, a, b) == sorted(want)
