from __future__ import annotations

import itertools

import numpy as np
import pytest

from folioscope.operators import kernels as K


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 4), (5, 3), (4, 6)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(10):
        cost = rng.integers(0, 20, shape).astype(float)
        got = K.assignment(cost)
        assert len(got) == min(shape) and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        small, large = sorted(shape)
        c = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert sum(cost[a, b] for a, b in got) == best


def test_smoothing_solves_its_system():
    y = np.array([1.0, 5, 2, 8, 3])
    n = len(y)
    d = np.diff(np.eye(n), axis=0)
    assert np.allclose(K.smooth(y, 2.0), np.linalg.solve(np.eye(n) + 2.0 * d.T @ d, y))
    assert K.smooth(np.array([4]), 2.0).tolist() == [4.0] and K.smooth(y, 0).tolist() == y.tolist()


def test_centers_and_boxes():
    assert K.centers(np.array([10, 12, 50, 11, 52]), 5).tolist() == [11.0, 51.0]
    assert K.centers(np.array([]), 5).size == 0
    boxes = np.array([[0, 0, 10, 10], [9, 9, 20, 20], [30, 0, 40, 10], [19, 0, 31, 5]], float)
    assert K.box_groups(boxes).tolist() == [0, 0, 1, 1]


def test_similarity_and_diff():
    assert K.similarity("", "") == 1.0 and K.similarity("abc", "") == 0.0
    assert K.unified(["a", "b"], ["a", "c"]).splitlines()[-2:] == ["-b", "+c"] and K.unified(["a"], ["a"]) == ""


def test_match_by_text(spark):
    schema = "doc string, id bigint, title string"
    a = spark.createDataFrame([("d", 1, "Safety notes"), ("d", 2, "Change orders"), ("d", 3, None), ("e", 4, "only here")], schema)
    b = spark.createDataFrame([("d", 11, "Change order"), ("d", 12, "Safety notes"), ("f", 13, "x")], schema)
    got = {(r.key_a, r.key_b) for r in K.match_by_text(a, b, ["doc"], "id", "title", 0.5).collect()}
    assert got == {(1, 12), (2, 11)}
    assert K.match_by_text(a.limit(0), b, ["doc"], "id", "title", 0.5).count() == 0
