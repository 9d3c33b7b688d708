import math
import random
from fractions import Fraction

import numpy as np
import pytest

from presslens.llm import whitening as W
from presslens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n = len(x)
    dev = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, x.sum(axis=0))) for row in x]
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, dev, centred, e[::-1], v[:, ::-1]


def test_matches_numpy_on_vectors_with_far_apart_and_near_eigenvalues(spark):
    rng = np.random.default_rng(4)
    scale = np.array([9, 8.999, 4, 2, 2.0001, 1, 0.5, 0.05])
    data = rng.normal(size=(300, 8)) @ np.diag(scale) @ np.linalg.qr(rng.normal(size=(8, 8)))[0] + 3
    rows = [(i, r.tolist(), 0) for i, r in enumerate(data)]
    bad = [(900, None, 0), (901, [None] + [1.0] * 7, 0), (902, [math.nan] + [1.0] * 7, 0), (903, [math.inf] * 8, 0), (904, [], 0), (905, [1.0], 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(3)
    got = W.whitened(df.withColumnRenamed("label", "component")).collect()
    n, dev, centred, e, v = plain(data)
    assert len(got) == 300 * 8 and {r.n for r in got} == {300}
    assert {r.vec_id: r.deviation for r in got} == dict(enumerate(dev))
    want = centred @ v / np.sqrt(e)
    table = np.zeros((300, 8))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10 and r.identity_error < 1e-9
    sign = np.sign((table * want).sum(axis=0))
    assert np.allclose(table * sign, want, atol=1e-7)
    assert np.allclose(np.cov(table.T, bias=True), np.eye(8), atol=1e-9)


def test_query_over_whole_table_equals_numpy(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    got = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001").collect()
    n, dev, centred, e, v = plain([r.embedding for r in df])
    place = {r.vec_id: i for i, r in enumerate(df)}
    table = np.full((n, 32), np.nan)
    for r in got:
        i, k = place[r.vec_id], r.component - 1
        table[i, k] = r.whitened
        assert r.n == n and r.deviation == dev[i] and abs(r.explained / (e[k] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    want = centred @ v[:, :32] / np.sqrt(e[:32])
    assert np.allclose(table * np.sign((table * want).sum(axis=0)), want, atol=1e-6) and len(got) == n * 32


def determinant(m):
    m, out = [[Fraction(x) for x in r] for r in m], Fraction(1)
    for k in range(len(m)):
        pivot = next((i for i in range(k, len(m)) if m[i][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            m[k], m[pivot], out = m[pivot], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k])]
    return out


def test_polynomial_takes_the_values_of_the_determinant(spark):
    rng = random.Random(1)
    for d in (1, 2, 3, 6):
        b = [[rng.randint(-(10**9), 10**9) if rng.random() < 0.6 else 0 for _ in range(d)] for _ in range(d)]
        m = [[sum(r[i] * r[j] for r in b) for j in range(d)] for i in range(d)]
        p = W.polynomial(spark, m)
        for t in (0, 1, -5, 10**18):
            assert W._value(p, t) == determinant([[(t if i == j else 0) - m[i][j] for j in range(d)] for i in range(d)])


def test_roots_are_counted_and_narrowed():
    poly = [1]
    for r in (7, 7, 3, 0, 0, 1000):  # product of (t - r)
        poly = [a - r * b for a, b in zip([*poly, 0], [0, *poly])]
    assert [W.roots_above(poly, t) for t in (-1, 0, 2, 3, 6, 7, 999, 1000)] == [6, 4, 4, 3, 3, 1, 1, 0]
    roots, s = W.top_roots(poly, 1017, 10)
    assert [(y / 2**s, n) for y, n in roots] == [(1000, 1), (7, 2), (3, 1)]
    roots, s = W.top_roots([1, -3, 1], 3, 2)  # (3 +- sqrt 5) / 2
    assert [y / 2**s for y, _ in roots] == pytest.approx([(3 + 5**0.5) / 2, (3 - 5**0.5) / 2], rel=1e-15)
    assert W.top_roots([1, 0, 0], 5, 2)[0] == []


def test_equal_eigenvalues_get_orthogonal_components(spark):
    rows = [(i, [s if j == i % 4 else 0.0 for j in range(4)] + [5.0], 0) for i, s in enumerate([1.0] * 4 + [-1.0] * 4)]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and all(abs(r.explained - 0.25) < 1e-12 and r.identity_error < 1e-12 for r in got)


def test_few_constant_huge_and_no_vectors(spark):
    def run(vectors, wanted=32):
        return W.whitened(spark.createDataFrame([(None if i == 0 else i, v, 0) for i, v in enumerate(vectors)], SCHEMA), wanted=wanted).collect()

    assert run([]) == [] and run([[1.0, 2.0]]) == [] and run([[1.0, 2.0]] * 5) == [] and run([None, []]) == []
    two = run([[0.0, 1.0, 2.0], [1.0, 1.0, 0.0]])
    assert {r.component for r in two} == {1} and sorted(round(r.whitened, 9) for r in two) == [-1, 1] and {r.vec_id for r in two} == {None, 1}
    huge = run([[1e300, 1.0], [-1e300, 2.0], [1e17, 3.0], [0.0, 4.0]])
    assert {r.component for r in huge} == {1, 2} and all(r.deviation is None for r in huge) and all(r.identity_error < 1e-4 for r in huge)
    many = run([[float(i * j % 7 - 3) for j in range(5)] for i in range(30)], wanted=2)
    assert {r.component for r in many} == {1, 2} and len(many) == 60
    tied = run([[1.0, 2.0], [1.0], [3.0, 5.0], [2.0]])  # two lengths as common: the longer
    assert len(tied) == 2


def test_arithmetic_stays_exact_beyond_doubles():
    x = np.array([[2**40 + 1, -(2**39)], [3, 2**41]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(2)] for i in range(2)]
    assert W.products(x).tolist() == want
    assert W.products(np.array([[10**6, 5]] * 9000, np.int64)).tolist() == [[9000 * 10**12, 9000 * 5 * 10**6], [9000 * 5 * 10**6, 9000 * 25]]


def test_too_many_dimensions_are_refused(spark):
    with pytest.raises(ValueError):
        W.whitened(spark.createDataFrame([(1, [0.0] * 1025, 0)], SCHEMA))
