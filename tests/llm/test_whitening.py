import math
import random
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import whitening


def table(spark, vectors, extra=()):
    rows = [(i, v, 1, 2.0) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int, whitened double").repartition(3)


def brute(vectors, most=32):
    """Whole vectors, eigenvalues and vectors by another way: numpy on the centred matrix."""
    x = np.array([[math.floor(64 * c) for c in v] for v in vectors], np.float64)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)[:most]
    return centred, values[order], axes[:, order]


def check(rows, vectors, most=32):
    centred, values, axes = brute(vectors, most)
    spread = [e > 1e-9 * max(values) for e in values]
    values, axes = values[spread], axes[:, spread]
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(found) == len(rows) == len(vectors) * len(values)
    whole = [[math.floor(64 * c) + 10**6 for c in v] for v in vectors]
    sums, n = [sum(c) for c in zip(*whole)], len(vectors)
    for i, v in enumerate(whole):
        deviation = sum((n * x - s) ** 2 for x, s in zip(v, sums))
        assert {found[i, c + 1].deviation for c in range(len(values))} == {deviation}
    for c, e in enumerate(values):
        wanted, got = centred @ axes[:, c] / math.sqrt(e), np.array([found[i, c + 1].whitened for i in range(n)])
        assert abs(found[0, c + 1].explained * np.trace(centred.T @ centred) / n / e - 1) < 1e-9
        near = [abs(o / e - 1) < 1e-6 for k, o in enumerate(values) if k != c]
        if not any(near):  # else the axis may turn among its equals
            assert min(abs(got - wanted).max(), abs(got + wanted).max()) < 1e-7
    white = np.array([[found[i, c + 1].whitened for c in range(len(values))] for i in range(n)])
    error = abs(white.T @ white / n - np.outer(white.mean(axis=0), white.mean(axis=0)) - np.eye(len(values))).max()
    assert error < 1e-9 and all(abs(r.identity_error - error) < 1e-9 and r.n == n for r in rows)


def vectors_of(seed, count, width, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread * (1 + d)) for d in range(width)] for _ in range(count)]


@pytest.mark.parametrize("count,width", [(200, 5), (60, 40), (10, 24), (300, 1)])
def test_equals_numpy(spark, count, width):
    vectors = vectors_of(count, count, width)
    check(whitening.whitening_table(table(spark, vectors)).collect(), vectors)


def test_rows_without_a_vector_and_extra_columns(spark):
    vectors = vectors_of(3, 50, 4)
    extra = [(1000, None, 1, 1.0), (1001, [1.0, None, 2.0, 3.0], 1, 1.0), (1002, [1.0, math.nan, 2.0, 3.0], 1, 1.0),
             (1003, [1.0, math.inf, 2.0, 3.0], 1, 1.0), (1004, [-math.inf] * 4, 1, 1.0)]
    check(whitening.whitening_table(table(spark, vectors, extra)).collect(), vectors)


def test_equal_eigenvalues_and_copies(spark):
    cross = [[s * (10.0 if d == k else 0.0) for d in range(6)] for k in range(6) for s in (1, -1)] * 5
    check(whitening.whitening_table(table(spark, cross)).collect(), cross)
    hot = [[1.0, 2.0, 3.0]] * 300 + vectors_of(5, 30, 3)
    check(whitening.whitening_table(table(spark, hot)).collect(), hot)


def test_dimensions_without_spread_make_no_component(spark):
    flat = [[a, 2 * a, 5.0] for a in (1.0, 2.0, 4.0, 8.0)]
    rows = whitening.whitening_table(table(spark, flat)).collect()
    assert {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-12
    assert whitening.whitening_table(table(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whitening_table(table(spark, [[1.0, 2.0]] * 9)).count() == 0


def test_empty_tables(spark):
    assert whitening.whitening_table(table(spark, [])).count() == 0
    assert whitening.whitening_table(table(spark, [], [(1, None, 1, 1.0), (2, [], 1, 1.0)])).count() == 0


def test_repeated_and_null_ids_shorter_vectors(spark):
    rows = [(None, [1.0, 5.0], 1, 1.0), (7, [2.0, 1.0], 1, 1.0), (7, [2.0, 1.0], 1, 1.0), (8, [3.0], 1, 1.0), (9, [], 1, 1.0)]
    found = whitening.whitening_table(table(spark, [], rows)).collect()
    assert len(found) == 10 and sorted(str(r.vec_id) for r in found) == ["7"] * 4 + ["8"] * 2 + ["9"] * 2 + ["None"] * 2
    assert all(r.n == 5 and r.identity_error < 1e-9 for r in found)


def test_huge_entries_stay_exact(spark):
    vectors = [[3.0e9, 1.0], [-4.0e12, 2.0], [7.0e15, -3.0], [5.0, 4.0]]
    found = {(r.vec_id, r.component): r for r in whitening.whitening_table(table(spark, vectors)).collect()}
    whole = [[math.floor(64 * c) + 10**6 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*whole)]
    for i, v in enumerate(whole):
        exact = sum((4 * x - s) ** 2 for x, s in zip(v, sums))
        assert int(found[i, 1].deviation_exact) == exact
        assert found[i, 1].deviation == (exact if exact < 2**63 else None)
    matrix = [[sum((4 * a[i] - sums[i]) * (4 * a[j] - sums[j]) for a in whole) for j in range(2)] for i in range(2)]
    trace, det = matrix[0][0] + matrix[1][1], matrix[0][0] * matrix[1][1] - matrix[0][1] ** 2
    assert abs(found[0, 2].explained / float(Fraction(det, trace) / trace) - 1) < 1e-9
    assert found[0, 1].identity_error < 1e-4


@pytest.mark.parametrize("size", [1, 2, 7, 20])
def test_polynomial_and_roots(spark, size):
    rng = random.Random(size)
    factor = [[rng.randrange(-50, 50) for _ in range(size)] for _ in range(size)]
    matrix = [[sum(factor[k][i] * factor[k][j] for k in range(size)) for j in range(size)] for i in range(size)]
    found = whitening.characteristic_polynomial(spark, matrix)
    # Faddeev and LeVerrier in fractions of whole numbers: another exact way.
    wanted, work = [1], [[0] * size for _ in range(size)]
    for k in range(1, size + 1):
        work = [[sum(matrix[i][t] * work[t][j] for t in range(size)) + (wanted[-1] if i == j else 0) for j in range(size)] for i in range(size)]
        trace = sum(matrix[i][t] * work[t][i] for i in range(size) for t in range(size))
        assert trace % k == 0
        wanted.append(-trace // k)
    assert found == wanted
    shift, roots = whitening.largest_roots(found, size)
    values = sorted(np.linalg.eigvalsh(np.array(matrix, np.float64)), reverse=True)
    listed = [r / 2**shift for r, times in roots for _ in range(times)]
    assert np.allclose(listed, [v for v in values if v > 1e-6], rtol=1e-6, atol=1e-5)


def test_hessenberg_swaps_and_zero_columns():
    matrix = np.array([[2, 0, 0, 5], [0, 3, 0, 0], [0, 0, 3, 1], [5, 0, 1, 4]], np.int64)
    prime = 2_147_483_647
    exact = np.round(np.poly(matrix.astype(float))).astype(np.int64)
    assert whitening.polynomial_modulo(matrix, prime).tolist() == [int(c) % prime for c in exact]
