import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfparc.functions import bits, special, vectors
from surfparc.operators import ranking
from surfparc.plans.queries import QUERIES


def test_cdln_agrees_between_branches_and_elementary_form():
    g = np.array([1e-3, 0.5, 10.0, 29.9, 30.1, 49.0, 51.0, 700.0, 1e5])
    got = special.cdln(g, 3)
    log_i = 0.5 * np.log(2 / (np.pi * g)) + g - math.log(2) + np.log1p(-np.exp(-2 * g))
    assert np.allclose(got, 0.5 * np.log(g) - log_i, atol=1e-12)
    assert np.isnan(special.cdln([0.0, -1.0], 3)).all()
    series = special._log_i_series(24.0, np.array([40.0]))[0]
    assert abs(series - special._debye(24.0, np.array([40.0]), np.sqrt, np.log)[0]) < 1e-9


def test_inverse_ratio_round_trip_and_overflow_fallback():
    k = np.array([5.0, 60.0, 300.0])
    assert np.allclose(special.inv_ad(63, special.bessel_ratio(63, k)), k, rtol=1e-9)
    d, r = 1174.0, 0.999
    start = (d - 1) * r / (1 - r * r) + d / (d - 1) * r
    assert special.inv_ad(d, r)[0] == pytest.approx(start - d / (d - 1) * r / 2)


def test_ratio_of_large_arguments_takes_bounded_work():
    for dim in (3.0, 64.0, 1482.0):
        k = np.array([np.inf, 1e17, 1e15, 1e12])
        assert np.allclose(special.bessel_ratio(dim, k), 1 - (dim - 1) / (2 * k), rtol=0, atol=1e-15)
        edge = max(100.0, dim * dim)
        below, above = special.bessel_ratio(dim, edge)[0], special._far_ratio(dim, np.array([edge]))[0]
        assert below == pytest.approx(above, abs=1e-14)
    x = np.array([0.5, 20.0, 3000.0])
    # The order 1/2 is elementary: coth(k) - 1/k.
    assert np.allclose(special.bessel_ratio(3, x), 1 / np.tanh(x) - 1 / x, rtol=1e-13)


def test_round_trip_of_parcels_of_one_vertex(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(v, v % 250 + 1, x[v].tolist()) for v in range(500)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["inv_ad_round_trip"](spark, str(tmp_path)).collect()
    assert len(got) == 500 and all(r.rbar == r.back == 1.0 for r in got)


def test_initial_concentration_hits_target():
    k = special.initial_concentration(63)
    assert special.log_bessel_i(63 / 2 - 1, k)[0] == pytest.approx(math.log(1e10), abs=1e-9)


def test_cdln_column_small_order_uses_batches(spark):
    df = spark.createDataFrame([(0.5,), (80.0,), (0.0,)], "k double").select(special.cdln_column(F.col("k"), 10).alias("c"))
    got = [r.c for r in df.collect()]
    assert got[:2] == pytest.approx(list(special.cdln([0.5, 80.0], 10))) and math.isnan(got[2])


@pytest.mark.parametrize("length", [1, 63, 64, 65, 130])
def test_bits_round_trip(spark, length):
    rng = np.random.default_rng(length)
    rows = [(i, [int(x) for x in rng.integers(0, 2, length)]) for i in range(5)] + [(5, [0] * length), (6, [1] * length)]
    df = spark.createDataFrame(rows, "i int, b array<int>").withColumn("w", bits.pack(F.col("b"), length))
    out = df.select("b", bits.unpack(F.col("w"), length).alias("u"), bits.popcount(F.col("w")).alias("p")).collect()
    assert all(r.b == r.u and r.p == sum(r.b) for r in out)


def test_packed_normalization_rules(spark):
    rows = [(0, [0, 0, 0, 0]), (1, [1, 1, 1, 1]), (2, [1, 0, 0, 0])]
    df = spark.createDataFrame(rows, "i int, b array<int>").withColumn("w", bits.pack(F.col("b"), 4))
    out = {r.i: r.x for r in bits.with_packed_stats(df, "w", 4).select("i", bits.normalized(F.col("w"), 4).alias("x")).collect()}
    assert out[0] == [0.0] * 4 and out[1] == [0.0] * 4
    x = np.array([1, 0, 0, 0]) - 0.25
    assert np.allclose(out[2], x / np.linalg.norm(x))


def test_constant_series_scores_zero(spark):
    df = spark.createDataFrame([([2.0, 2.0, 2.0],), ([1.0, 2.0, 4.0],)], "x array<double>")
    a, b = [r.z for r in vectors.zscore_unit(df, "x", "z").collect()]
    assert a == [0.0] * 3 and np.linalg.norm(b) == pytest.approx(1.0)


@pytest.mark.parametrize("settle", [5, 10_000])
@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.37, 1.0])
def test_top_fraction_is_exact_with_ties_and_a_hot_key(spark, settle, fraction):
    rng = np.random.default_rng(3)
    data = {0: rng.normal(size=900).round(2), 1: rng.integers(0, 3, 40).astype(float), 2: np.array([7.0]), 3: np.full(30, 1.5)}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs]
    got = dict(ranking.top_fraction_threshold(spark.createDataFrame(rows, "k int, x double"), ["k"], "x", fraction, settle, bins=8).collect())
    for k, xs in data.items():
        n = len(xs)
        rank = min(max(int(math.floor(n * fraction + 0.5)), 1), n)
        assert got[k] == np.sort(xs)[::-1][rank - 1]


@pytest.mark.parametrize("settle", [8, 1000])
def test_top_fraction_leaves_out_nan_and_ends_on_infinite_ranges(spark, settle):
    rows = [(1, float(i)) for i in range(40)] + [(1, float("nan"))] + [(2, float(i)) for i in range(30)] + [(2, float("inf"))] + [(2, float("-inf"))]
    got = dict(ranking.top_fraction_threshold(spark.createDataFrame(rows, "k int, x double"), ["k"], "x", 0.25, settle, bins=4).collect())
    assert got == {1: 30.0, 2: 23.0}


def test_convergence_truth_table(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.0004), ("b", 1, 0.0), ("c", 1, float("nan")), ("d", 1, 2.0), ("d", 2, 9.0)]
    out = {(r.k, r.i): r.converged for r in ranking.relative_change(spark.createDataFrame(rows, "k string, i int, c double"), ["k"], "i", "c").collect()}
    assert out == {("a", 1): False, ("a", 2): True, ("b", 1): True, ("c", 1): True, ("d", 1): False, ("d", 2): False}
