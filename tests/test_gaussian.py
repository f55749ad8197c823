"""Gaussian processes by inducing points against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftpool.operators.gaussian import Fitted, GaussianProcess, HeteroskedasticProcess, Kernel, _digamma, _trigamma, design_points, fitted, inducing_points, normal_sums
from siftpool.operators.surrogates import SurrogateError
from siftpool.space import Space, p_dbl, p_fct

BOX = Space((p_dbl("a", 0, 1), p_dbl("b", 0, 1)))


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, p), float(t)) for p, t in zip(x, y)], "a double, b double, y double").repartition(3)


def dense(x, y, noise, lengths, g, s2, kernel, at):
    """Log likelihood, and mean and variance of the process at points, by matrices of all rows."""
    c = kernel(x, x, lengths)
    k = s2 * (c + g * np.diag(noise))
    one = s2 * kernel(at, x, lengths)
    fit = -0.5 * (y @ np.linalg.solve(k, y) + np.linalg.slogdet(2 * np.pi * k)[1])
    return fit, one @ np.linalg.solve(k, y), s2 - np.einsum("ij,ji->i", one, np.linalg.solve(k, one.T))


@pytest.mark.parametrize("kind", ["matern", "exponential"])
def test_all_design_points_give_the_exact_process(spark, kind):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.random((25, 2)), 2, axis=0)  # replicates
    noise = np.repeat(np.exp(rng.normal(0, 1, 25)), 2)
    y = np.sin(5 * x[:, 0]) + x[:, 1] + 0.1 * np.sqrt(noise) * rng.normal(size=50)
    points = design_points(frame(spark, x, y), [F.col("a"), F.col("b")], F.col("y"))
    told = spark.createDataFrame([(p.tolist(), float(v)) for p, v in zip(x[::2], noise[::2])], "x array<double>, noise double")
    points = points.join(told, "x")
    z, kernel, lengths = inducing_points(points, 100), Kernel(kind, 1.5), np.array([0.5, 0.9])
    assert len(z) == 25
    got = Fitted(z, lengths, kernel, normal_sums(points, z, [lengths], kernel)[0])
    at = rng.random((7, 2))
    fit, mean, var = dense(x, y, noise, lengths, got.g, got.s2, kernel, at)
    assert np.isclose(got.bound, fit, atol=5e-3)
    np.testing.assert_allclose(got.at(at)[0], mean, atol=1e-4)
    np.testing.assert_allclose(got.at(at)[1], var, atol=1e-4)
    others = [dense(x, y, noise, lengths, got.g * f, got.s2 * h, kernel, at)[0] for f in (0.8, 1.2) for h in (0.8, 1, 1.2)]
    assert max(others) < fit  # noise and amplitude are the best


@pytest.mark.parametrize("kind", ["matern", "exponential"])
def test_slopes_of_the_bound_are_those_of_differences(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.random((120, 2))
    y = np.cos(4 * x[:, 0]) * x[:, 1] + 0.05 * rng.normal(size=120)
    points = design_points(frame(spark, x, y), [F.col("a"), F.col("b")], F.col("y")).withColumn("noise", F.lit(1.0))
    z, kernel, at = inducing_points(points, 15), Kernel(kind, 1.6), np.log([0.4, 0.7])
    assert len(z) == 15
    step = 1e-4
    trials = [at] + [at + s * step * e for e in np.eye(2) for s in (1, -1)]
    got = [Fitted(z, np.exp(t), kernel, s) for t, s in zip(trials, normal_sums(points, z, [np.exp(t) for t in trials], kernel))]
    by_hand = [(got[1 + 2 * j].bound - got[2 + 2 * j].bound) / (2 * step) for j in range(2)]
    np.testing.assert_allclose(got[0].slope, by_hand, rtol=2e-3, atol=1e-2)
    best = fitted(points, z, kernel, 12)
    assert best.bound > max(f.bound for f in got)
    assert np.abs(best.slope).max() < 0.5


def test_whole_archive_counts_and_se_grows_away_from_it(spark):
    rng = np.random.default_rng(3)
    x = rng.random((3000, 2)) * [0.6, 1]
    y = 10 + 3 * np.sin(6 * x[:, 0]) + 2 * x[:, 1] ** 2 + 0.2 * rng.normal(size=3000)
    model = GaussianProcess(inducing=40).fit(frame(spark, x, y).unionByName(spark.createDataFrame([(None, 0.5, 1e9), (0.3, 0.5, None), (0.3, float("nan"), 1e9)], "a double, b double, y double")), BOX, "y")
    assert model.model.sums.n == 3000
    grid = rng.random((200, 2)) * [0.6, 1]
    got = model.predict(frame(spark, grid, np.zeros(200))).toPandas()
    truth = 10 + 3 * np.sin(6 * got.a) + 2 * got.b**2
    assert np.sqrt(((got["mean"] - truth) ** 2).mean()) < 0.08
    assert np.isclose(model.scale * np.sqrt(model.model.s2 * model.model.g), 0.2, rtol=0.1)
    far = model.predict(frame(spark, [[3.0, 0.5]], [0])).first()
    assert far.se > 5 * got.se.max()
    odd = {r.b: r for r in model.predict(spark.createDataFrame([(None, 0.5), (0.2, 0.25)], "a double, b double")).collect()}
    assert odd[0.5]["mean"] is None and odd[0.5].se is None and odd[0.25].se > 0


def test_constant_columns_are_dropped(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.random(30), np.full(30, 2.0)])
    model = GaussianProcess(steps=3).fit(frame(spark, x, x[:, 0]), BOX, "y")
    assert model.ids == ["a"]
    with pytest.raises(SurrogateError, match="constant"):
        GaussianProcess().fit(frame(spark, [[1, 2]] * 3, [1, 2, 3]), BOX, "y")
    with pytest.raises(SurrogateError, match="no row"):
        GaussianProcess().fit(frame(spark, x, x[:, 0]).where("a > 5"), BOX, "y")
    with pytest.raises(SurrogateError):
        Kernel("other")
    with pytest.raises(SurrogateError):
        Kernel("exponential", 3)
    mixed = Space((p_dbl("a", 0, 1), p_fct("c", ["u", "v"])))
    assert GaussianProcess(steps=1).fit(frame(spark, x, x[:, 0]), mixed, "y").ids == ["a"]


def test_noise_follows_its_region(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((2000, 2)), 2)  # some replicates
    sd = np.where(x[:, 0] < 0.5, 0.1, 1.0)
    y = 2 * np.sin(5 * x[:, 1]) + sd * rng.normal(size=2000)
    model = HeteroskedasticProcess(inducing=40, rounds=2, steps=6).fit(frame(spark, x, y), BOX, "y")
    assert model.log_noise is not None
    got = {(r.a, r.b): r for r in model.predict(frame(spark, [[a, b] for a in (0.1, 0.25, 0.75, 0.9) for b in (0.3, 0.7)], [0] * 8)).collect()}
    for (a, b), r in got.items():
        assert (0.07 < r.se < 0.2) if a < 0.5 else (0.7 < r.se < 1.4)
        assert abs(r["mean"] - 2 * np.sin(5 * b)) < (0.15 if a < 0.5 else 0.5)
    same = HeteroskedasticProcess(inducing=30, rounds=1, steps=4).fit(frame(spark, x, 2 * np.sin(5 * x[:, 1]) + 0.3 * rng.normal(size=2000)), BOX, "y")
    se = [r.se for r in same.predict(frame(spark, [[0.1, 0.5], [0.9, 0.5]], [0, 0])).collect()]
    assert max(se) < 1.3 * min(se)


def test_gamma_functions():
    np.testing.assert_allclose(_digamma(np.array([0.5, 1.0, 10.0])), [-1.9635100260214235, -0.5772156649015329, 2.251752589066721], rtol=1e-9)
    np.testing.assert_allclose(_trigamma(np.array([0.5, 1.0, 10.0])), [np.pi**2 / 2, np.pi**2 / 6, 0.10516633568168575], rtol=1e-9)
