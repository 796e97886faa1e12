"""The search for groups, conditional information and the digamma text against matrices."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.numeric import digamma, digamma_sql
from weftline.operators import copula, interaction, multivariate, search

T, UNITS = 60, 6


@pytest.fixture(scope="module")
def z():
    g = np.random.default_rng(3)
    out = g.normal(size=(2, T, UNITS))
    out[:, :, 1] += out[:, :, 0]
    out[:, :, 3] += 0.7 * out[:, :, 2] - 0.5 * out[:, :, 0]
    return out


def scores(spark, z):
    rows = [(w, u, t, float(z[w, t, u])) for w in range(len(z)) for u in range(z.shape[2]) for t in range(z.shape[1])]
    return spark.createDataFrame(rows, "win_id int, unit int, t int, z double").repartition(3)


def test_groups_against_covariance_matrices(spark, z):
    pairs = copula.pair_correlations(scores(spark, z))
    got = {(r.win_id, *r.members): r.omega for r in search.group_omega(search.determinants(pairs, 5, ["win_id"]), T, ["win_id"]).collect()}
    want = {(w, *c): multivariate.o_information(np.cov(z[w][:, c].T), T) for w in range(2) for m in (3, 4, 5) for c in itertools.combinations(range(UNITS), m)}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-10


def test_groups_of_three_are_triplets(spark, z):
    pairs = copula.pair_correlations(scores(spark, z))
    three = {(r.win_id, r.i, r.j, r.k): r.omega for r in interaction.omega(pairs, T).collect()}
    got = {(r.win_id, *r.members): r.omega for r in search.group_omega(search.determinants(pairs, 3, ["win_id"]), T, ["win_id"]).collect()}
    assert got.keys() == three.keys() and max(abs(got[k] - three[k]) for k in got) < 1e-10


def test_groups_with_equal_units_are_left_out(spark, z):
    same = z.copy()
    same[:, :, 5] = same[:, :, 4]
    got = search.group_omega(search.determinants(copula.pair_correlations(scores(spark, same)), 4, ["win_id"]), T, ["win_id"]).collect()
    assert got and not any({4, 5} <= set(r.members) for r in got)


def test_strongest_groups_and_their_intervals(spark, z):
    s = scores(spark, z)
    rows = search.strongest_groups(spark, s, copula.pair_correlations(s), T, 2, 4, 3, 20).collect()
    picks = {}
    for r in interaction.picks(spark, 2, T, 20).collect():
        picks.setdefault((r.win_id, r.rep), []).extend([r.block] * r.times)
    every = {(w, *c): multivariate.o_information(np.cov(z[w][:, c].T), T) for w in range(2) for m in (3, 4) for c in itertools.combinations(range(UNITS), m)}
    for w, m, sign in itertools.product(range(2), (3, 4), (1, -1)):
        best = sorted((-abs(v), k[1:]) for k, v in every.items() if k[0] == w and len(k) == m + 1 and v * sign > 0)[:3]
        own = sorted((r for r in rows if (r.win_id, r.size, r.sign) == (w, m, sign)), key=lambda r: r["rank"])
        assert [tuple(r.members) for r in own] == [k for _, k in best]
        for r in own:
            values = [multivariate.o_information(np.cov(z[w][np.array(picks[w, b])][:, r.members].T), T) for b in range(20)]
            low, high = np.percentile(values, [2.5, 97.5])
            assert abs(r.low - low) < 1e-9 and abs(r.high - high) < 1e-9 and r.significant == (not low <= 0 <= high)


def test_information_given_the_class_against_matrices(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(300, 4))
    label = g.integers(0, 3, 300)
    x[:, 1] += x[:, 0] * label
    x[:, 3] += x[:, 2]
    rows = spark.createDataFrame([(n, int(label[n]), k, float(x[n, k])) for n in range(300) for k in range(4)], "row int, label int, dim int, v double").repartition(4)
    held = multivariate.class_scores(rows).cache()
    products = multivariate.class_products(held)
    z = np.zeros_like(x)
    for r in held.collect():
        z[r.row, r.dim] = r.z
    parts = [(label == c) for c in range(3)]

    def brute(a, b):
        out = 0.0
        for p in parts:
            own = z[p][:, a + b].T
            out += p.mean() * multivariate.mutual_information(own @ own.T / (p.sum() - 1), int(p.sum()), list(range(len(a))), list(range(len(a), len(a + b))))
        return out

    got = {(r.i, r.j): (r.cmi, r.mi) for r in multivariate.class_conditional(products).collect()}
    for i, j in itertools.combinations(range(4), 2):
        assert abs(got[i, j][0] - brute([i], [j])) < 1e-10
        assert abs(got[i, j][1] - multivariate.mutual_information(np.cov(z[:, [i, j]].T), 300, [0], [1])) < 1e-10
    assert abs(multivariate.class_conditional_groups(products, [0, 2], [1, 3]).first()[0] - brute([0, 2], [1, 3])) < 1e-10
    assert got[0, 1][0] > 0.2 > abs(got[0, 2][0])


def test_digamma_as_text(spark):
    rows = spark.range(1, 60).select((F.col("id") / 2).alias("x")).withColumn("d", F.expr(digamma_sql("x"))).collect()
    assert all(math.isclose(r.d, digamma(r.x), rel_tol=1e-12, abs_tol=1e-12) for r in rows)


def test_mixture_of_shapes_against_one_machine(spark):
    """Ranks, medians and deviations of each class, an odd and an even one, without ties and with."""
    g = np.random.default_rng(6)
    label = np.array([0] * 41 + [1] * 60 + [2] * 25)
    x = np.stack([g.normal(size=126) + label, g.normal(size=126) * (1 + label), np.round(g.normal(size=126), 1)], axis=1)
    rows = spark.createDataFrame([(n, int(label[n]), k, float(x[n, k])) for n in range(126) for k in range(3)], "row int, label int, roi int, v double").repartition(5)
    got = {r.roi: r.mi for r in multivariate.mixture_of_shapes(multivariate.class_shapes(rows)).collect()}
    assert all(abs(got[k] - multivariate.copula_mixture_information(x[:, [k]], label)) < 1e-9 for k in range(3))
    model = {r.roi: r.mi for r in multivariate.model_information(rows).collect()}
    from statistics import NormalDist

    for k in range(3):
        rank = np.argsort(np.argsort(x[:, k], kind="stable"), kind="stable") + 1
        z = np.array([NormalDist().inv_cdf(r / 127) for r in rank])[:, None]
        assert abs(model[k] - multivariate.class_information(z, label, False)) < 1e-9


def test_mixture_of_a_class_without_spread_is_null(spark):
    rows = spark.createDataFrame([(n, n % 2, 0, 1.0 if n % 2 else float(n)) for n in range(20)], "row int, label int, roi int, v double")
    assert multivariate.mixture_of_shapes(multivariate.class_shapes(rows)).first().mi is None
