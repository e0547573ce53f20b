"""Whitening against numpy, the polynomial and its roots against exact arithmetic, and odd tables."""

import numpy as np
import pytest

from cofferlake.llm.whitening import characteristic_polynomial, components, largest_roots, polynomial_mod, roots_above, whitened


def _product(roots):
    p = [1]
    for r in roots:
        p = [a - r * b for a, b in zip([0, *p], [*p, 0])]
    return p


def test_polynomial_of_known_roots(spark):
    chance = np.random.default_rng(5)
    diagonal = [0, 0, 7, 7, 10**15, 3]
    assert characteristic_polynomial(spark, [[d if i == j else 0 for j in range(6)] for i, d in enumerate(diagonal)]) == _product(diagonal)
    a = chance.integers(-(10**6), 10**6, (9, 5))
    matrix = [[int(x) for x in r] for r in a @ a.T]  # rank 5
    p = characteristic_polynomial(spark, matrix)
    assert p[:4] == [0, 0, 0, 0] and p[9] == 1 and p[8] == -sum(matrix[i][i] for i in range(9))
    assert np.allclose([r / 2**96 for r, m in largest_roots(p, 9) for _ in range(m)], np.linalg.eigvalsh(np.array(matrix, float))[::-1][:5], rtol=1e-9)
    for prime in (101, 2**31 - 1):
        assert polynomial_mod(np.array([[v % prime for v in r] for r in matrix]), prime) == [c % prime for c in p]


def test_roots_are_counted_with_multiplicity():
    p = _product([5, 5, 5, 9, 0, 2])
    assert [roots_above(p, a) for a in (-1, 0, 2, 4, 5, 9)] == [6, 5, 4, 4, 1, 0]
    assert [(r >> 96) + (r & (2**96 - 1) > 0) for r, m in largest_roots(p, 6) for _ in range(m)] == [9, 5, 5, 5, 2]


def test_a_space_of_equal_roots_gets_orthogonal_vectors():
    matrix = [[6, 0, 0], [0, 6, 0], [0, 0, 2]]
    v = components(matrix, [(6 << 96, 2), (2 << 96, 1)])
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-12) and abs(abs(v[2, 2]) - 1) < 1e-12


@pytest.mark.parametrize("n, width, rank, spread", [(300, 8, 8, 1.0), (60, 40, 40, 5.0), (200, 12, 4, 1.0), (400, 6, 6, 1e9)])
def test_whitened_equals_numpy(spark, n, width, rank, spread):
    chance = np.random.default_rng(n)
    c = (chance.standard_normal((n, rank)) * spread) @ chance.standard_normal((rank, width)) if rank < width else chance.standard_normal((n, width)) * spread
    odd = [(None, [1.0] * width), (-1, None), (-2, [None] + [1.0] * (width - 1)), (-3, [float("nan")] * width), (-4, [float("inf")] + [0.0] * (width - 1)), (-5, [1.0]), (-6, []), (3, c[0].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + odd
    found = whitened(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, component string, n int").repartition(3)).collect()
    x = [[int(np.floor(64 * float(e))) + 1_000_000 for e in v] for _, v in rows if v and len(v) == width and all(e is not None and np.isfinite(e) for e in v)]
    ids = [i for i, v in rows if v and len(v) == width and all(e is not None and np.isfinite(e) for e in v)]
    sums = [sum(col) for col in zip(*x)]
    m = len(x)
    away = [[m * e - s for e, s in zip(r, sums)] for r in x]
    values, axes = np.linalg.eigh(np.array(away, float).T @ np.array(away, float) / m**3)
    values, axes = values[::-1], axes[:, ::-1]
    kept = len({r.component for r in found})
    assert kept == min(32, width) and len(found) == m * kept  # floors leave no exact dependence
    squares = {}
    for i, r in zip(ids, away):
        squares.setdefault(i, set()).add(sum(e * e for e in r) if sum(e * e for e in r) < 2**63 else None)
    assert all(r.deviation in squares[r.vec_id] and r.n == m and r.identity_error < 1e-9 for r in found)
    project = np.abs(np.array(away, float) / m @ axes[:, :kept] / np.sqrt(values[:kept]))
    where = {i: k for k, i in enumerate(ids) if i != 3}
    for r in found:
        if r.vec_id in where:
            assert abs(abs(r.whitened) - project[where[r.vec_id], r.component - 1]) < 1e-6
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-6


def test_tables_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).count() == 0
    rows = whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.75, 1.0]), (2, [0.75, 1.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.deviation) for r in rows) == [(1, 1, 32 * 32), (2, 1, 16 * 16), (2, 1, 16 * 16)]
    assert {round(r.explained, 12) for r in rows} == {1.0}
