"""Closed-form and brute-force tests of the numpy blocks, codecs and column functions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import blocks as B
from nearfield.functions import codecs as C
from nearfield.functions import vectors as V


def data(n=300, d=32, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)) + 3 * rng.standard_normal((8, d))[rng.integers(0, 8, n)]


@given(st.integers(1, 12), st.integers(1, 30), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_top_keeps_order_and_ties(k, n, seed):
    rng = np.random.default_rng(seed)
    dist, ids = rng.integers(0, 4, (3, n)).astype(float), rng.permutation(n)
    rows, found, value = B.top(dist, ids, k)
    for r in range(3):
        want = sorted(zip(dist[r], ids))[:k]
        assert [(v, i) for v, i in zip(value[rows == r], found[rows == r])] == want


def test_distances_by_hand():
    a, b = np.array([[0.0, 3.0], [1.0, 0.0]]), np.array([[4.0, 0.0], [0.0, 0.0]])
    assert np.allclose(B.distances("euclidean", a, b), [[25, 9], [9, 1]])
    assert np.allclose(B.distances("manhattan", a, b), [[7, 3], [3, 1]])
    assert np.allclose(B.distances("cosine", a, b), [[1, 1], [0, 1]])  # a zero norm is 1 away
    for m in ("euclidean", "manhattan", "cosine"):
        assert np.allclose(B.pairs(m, a, b), np.diag(B.distances(m, a, b)))


def test_nearest_equals_brute_force():
    x = data(120)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    rows, ids, value = B.nearest("euclidean", x[:20], x, np.arange(120), 7)
    assert (ids.reshape(20, 7) == np.argsort(d[:20], axis=1, kind="stable")[:, :7]).all()
    assert np.allclose(value.reshape(20, 7), np.sort(d[:20], axis=1)[:, :7])


def test_bf16_rounds_to_nearest_even():
    x = np.array([[1.0, 1.00390625, 1.01171875, -2.5, 0.0]], np.float32)
    assert C.BFloat16("euclidean").decode(C.BFloat16("euclidean").encode(x)).tolist() == [[1.0, 1.0, 1.015625, -2.5, 0.0]]


def test_sq8_scale_rounding_and_constant_dimension():
    x = np.array([[1.28, 0.0, -2.0], [-0.645, 0.0, 1.0]])
    c = C.SQ8("euclidean").fit(x)
    assert c.scale.tolist() == [0.01, 1.0, 2 / 128]
    assert c.whole(x).tolist() == [[127, 0, -128], [-65, 0, 64]]
    assert c.score(x, c.encode(x))[0, 0] == 0


@pytest.mark.parametrize("codec", [C.BFloat16, C.SQ8, C.PQ, C.RaBitQ, C.TurboQuant])
def test_compressed_codecs_reject_manhattan(codec):
    with pytest.raises(ValueError):
        codec("manhattan")


def test_pq_limits_and_errors():
    with pytest.raises(ValueError):
        C.PQ("euclidean", 8, 16, False).fit(data(100, 30))
    with pytest.raises(ValueError):
        C.PQ("euclidean", 8, 256, False).fit(data(100, 32))
    x = data(400)
    p = C.PQ("euclidean", 16, 64, False).fit(x)
    codes = p.encode(x)
    assert np.allclose(p.score(x[:5], codes), B.distances("euclidean", x[:5], p.decode(codes)))
    o = C.OPQ("euclidean", 16, 64, False).fit(x)
    assert np.allclose(o.turn @ o.turn.T, np.eye(32), atol=1e-8)
    error = lambda c: ((c.decode(c.encode(x)) - x) ** 2).mean()
    assert error(o) <= 1.1 * error(p)


def test_hamming_and_binarisers():
    a = np.array([[0b10110000, 0xFF]], np.uint8)
    assert C.hamming_block(a, np.array([[0b00110001, 0x0F]], np.uint8)).tolist() == [[6.0]]
    x = data(200, 20)
    b = C.Binary("euclidean", 48, "pca").fit(x)
    assert b.axes.shape == (20, 48) and b.encode(x).shape == (200, 6)
    assert C.Binary("euclidean", 999, "sign").fit(x).bits == 20
    with pytest.raises(ValueError):
        C.Binary("euclidean", 8, "other")


def test_rabitq_estimate_is_close():
    x = data(300, 64)
    c = C.RaBitQ("euclidean").fit(x)
    true = np.sqrt(B.distances("euclidean", x[:20], x))
    mean = x.mean(0)
    got = c.score(x[:20], c.encode(x, mean), mean)
    far = true > 3
    assert np.median(np.abs(got - true)[far] / true[far]) < 0.1


@pytest.mark.parametrize("bits", [2, 3, 4])
def test_turboquant_levels_and_estimates(bits):
    levels = C.max_lloyd_levels(64, bits)
    assert len(levels) == 2**bits and (np.diff(levels) > 0).all() and np.allclose(levels, -levels[::-1])
    x = data(200, 64)
    c = C.TurboQuant("euclidean", bits).fit(x)
    true, got = B.distances("euclidean", x[:10], x), c.score(x[:10], c.encode(x))
    assert np.median(np.abs(got - true)[true > 5] / true[true > 5]) < {2: 0.2, 3: 0.12, 4: 0.07}[bits]
    with pytest.raises(ValueError):
        C.TurboQuant("euclidean", 4).fit(data(10, 30))


def test_column_functions(spark):
    df = spark.createDataFrame([([3.0, -4.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(V.squared_euclidean("a", "b"), V.dot("a", "b"), V.manhattan("a", "b"), V.canberra("a", "b"), V.cosine_distance("a", "b"), V.l2_norm("a"), V.l1_norm("a"), V.normalise("a"), V.subtract("a", "b"), V.add("a", "b")).collect()
    assert [round(v, 6) for v in got[0][:7]] == [45.0, -8.0, 9.0, 2.0, 1.8, 5.0, 7.0]
    assert list(got[0][7:]) == [[0.6, -0.8], [3.0, -6.0], [3.0, -2.0]]
    assert got[1][4] == 1.0 and got[1][7] == [0.0, 0.0]


def test_metric_names():
    assert V.parse_metric("L2") == "euclidean" and V.parse_metric("L1") == "manhattan"
    assert V.parse_metric("nonsense", strict=False) == "euclidean"
    with pytest.raises(ValueError):
        V.parse_metric("nonsense")


@pytest.mark.parametrize("bad", [None, [1.0, None], [1.0, math.nan], [1.0]])
def test_validation_raises_as_rows_are_read(spark, bad):
    df = spark.createDataFrame([([1.0, 2.0],), (bad,)], "vec array<double>")
    assert V.validate_vectors(df.limit(1), "vec", 2).count() == 1
    with pytest.raises(Exception, match="vec"):
        V.validate_vectors(df, "vec", 2).collect()
    with pytest.raises(TypeError):
        V.validate_vectors(df.withColumn("vec", F.lit("x")), "vec")
