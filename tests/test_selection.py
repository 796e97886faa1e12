"""Nested choice of a classifier against the same by numpy on one machine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import metrics, selection

G = np.random.default_rng(12)
N, GROUPS = 600, 11
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    x = G.normal(size=(N, 3)) * [1, 50, 0.1] + [3, -7, 0]
    group = G.integers(0, GROUPS, N)
    y = (x[:, 0] - 3 + 0.01 * (x[:, 1] + 7) + G.normal(size=N) > 0.6).astype(float)
    x[G.random(N) < 0.05, 0] = np.nan
    x[:, 2] = 0.25  # no spread
    return x, group, y


def frame(spark, table):
    x, group, y = table
    rows = [(n, f"g{group[n]}", float(y[n]), *(None if v != v and n % 2 else float(v) for v in x[n])) for n in range(N)]
    return spark.createDataFrame(rows, "id int, grp string, y double, a double, b double, c double").repartition(5)


def ridge(x, y, w, lam):
    """A logistic regression by many small Newton steps; the intercept is penalised like the rest."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ b))
        b -= 0.5 * np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + (lam + 1e-12) * np.eye(len(b)), x.T @ (w * (p - y)) + lam * b)
    return b


def precision_of(y, p):
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    return float((hit / np.arange(1, len(y) + 1))[y[order] == 1].sum() / y.sum())


@pytest.fixture(scope="module")
def choice(spark, table):
    return selection.Choice(frame(spark, table), "grp", NAMES, 4, (0.01, 1.0, 10.0))


def test_groups_stay_on_one_side(spark, table, choice):
    sides = {}
    for r in choice.manifest.collect():
        sides.setdefault(r.fold, {})[r.grp] = r.role
    assert len(sides) == 4 and all(set(s.values()) == {"train", "val", "test"} and len(s) == GROUPS for s in sides.values())
    tested = [g for s in sides.values() for g, role in s.items() if role == "test"]
    assert sorted(tested) == sorted({f"g{g}" for g in table[1]})


def test_choice_equals_the_same_on_one_machine(spark, table, choice):
    x, group, y = table
    sides = {(r.fold, r.grp): r.role for r in choice.manifest.collect()}
    coefficients = {(r.fold, r.feature): r.coefficient for r in choice.coefficients(spark).collect()}
    tested = {r.fold: r for r in choice.tested(spark).collect()}
    predicted = {(r.fold, r.id): r.p for r in choice.predicted().collect()}
    assert sorted(tested) == choice.folds == [0, 1, 2, 3]
    for fold in choice.folds:
        role = np.array([sides[fold, f"g{g}"] for g in group])
        tr, va, te = (role == k for k in ("train", "val", "test"))
        full = np.where(np.isnan(x), np.nanmedian(x[tr], axis=0), x)
        mean, spread = full[tr].mean(axis=0), full[tr].std(axis=0)
        z = (full - mean) / np.where(spread > 1e-12, spread, 1)
        w = tr.sum() / (2 * np.where(y[tr] == 1, (y[tr] == 1).sum(), (y[tr] == 0).sum()))
        models = [ridge(z[tr], y[tr], w, 1 / c) for c in (0.01, 1.0, 10.0)]
        areas = [precision_of(y[va], z[va] @ b[:-1] + b[-1]) for b in models]
        best = int(np.argmax(np.round(areas, 12)))
        assert tested[fold].c == (0.01, 1.0, 10.0)[best] and abs(tested[fold].val_pr_auc - areas[best]) < 1e-9
        b = models[best]
        assert np.allclose([coefficients[fold, k] for k in (*NAMES, "intercept")], b, atol=1e-6)
        score = z @ b[:-1] + b[-1]
        pos, neg = (y[va] == 1).sum(), (y[va] == 0).sum()
        curve = ridge(score[va][:, None], np.where(y[va] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2)), np.ones(va.sum()), 0.0)
        p = 1 / (1 + np.exp(-(curve[0] * score + curve[1])))
        assert all(abs(predicted[fold, n] - p[n]) < 1e-6 for n in np.flatnonzero(te))
        f1 = {t: 2 * (y[va] * (p[va] >= t)).sum() / ((p[va] >= t).sum() + pos) for t in p[va]}
        assert abs(f1[min(f1, key=lambda t: abs(t - tested[fold].threshold))] - max(f1.values())) < 1e-9
        hit = p[te] >= tested[fold].threshold - 1e-9
        assert abs(tested[fold].recall - (hit & (y[te] == 1)).sum() / (y[te] == 1).sum()) < 1e-9 and tested[fold].n == te.sum()
        assert abs(tested[fold].brier - ((p[te] - y[te]) ** 2).mean()) < 1e-6 and abs(tested[fold].pr_auc - precision_of(y[te], p[te])) < 1e-6


def test_null_sources_use_the_trained_model(spark, table, choice):
    """Features that a source lacks are missing values; rows without a class are left out."""
    rows = frame(spark, table)
    same = {r.fold: r.pr_auc for r in choice.nulls({"same": rows}).collect()}
    assert same == pytest.approx({r.fold: r.pr_auc for r in choice.tested(spark).collect()})
    empty = choice.nulls({"none": rows.drop("a", "b", "c"), "unknown": rows.withColumn("y", F.lit(None).cast("double"))}).collect()
    share = {r.fold: r.share for r in choice.predicted().groupBy("fold").agg(F.avg("y").alias("share")).collect()}
    assert {r.fold: r.pr_auc for r in empty} == pytest.approx(share) and {r.source for r in empty} == {"none"}


def test_steps_that_overshoot_are_taken_back(spark):
    """Classes far apart with hardly a penalty: plain Newton steps would run away."""
    rows = spark.createDataFrame([(0, [float(v)], float(v > 0), 1.0) for v in (-300, -200, -1, 2, 250, 400)] + [(1, [float(v)], float(n % 2), 1.0) for n, v in enumerate((1, 2, 3, 4, 5))], "fold int, x array<double>, y double, w double")
    got = selection.newton(rows, [1e-6, 1.0], [0, 1])
    assert all(np.isfinite(b).all() for b in got.values()) and got[0][0, 0] > 0
    x, y = np.array([[1.0], [2], [3], [4], [5]]), np.array([0.0, 1, 0, 1, 0])
    assert np.allclose(got[1][1], ridge(x, y, np.ones(5), 1.0), atol=1e-8)


def test_folds_of_one_class_are_skipped(spark):
    rows = spark.createDataFrame([(n, f"g{n % 3}", 1.0, float(n)) for n in range(30)], "id int, grp string, y double, a double")
    choice = selection.Choice(rows, "grp", ["a"], 3)
    assert choice.folds == [] and choice.chosen(spark).count() == choice.tested(spark).count() == 0 and choice.coefficients(spark).count() == 0


def test_best_threshold_by_group(spark):
    rows = [(g, int(G.random() < 0.4), float(G.integers(0, 20)) / 20) for g in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, y int, p double")
    got = {r.g: (r.threshold, r.f1) for r in metrics.best_f1(df, ["g"]).collect()}
    for g in (0, 1):
        one = metrics.best_f1(df.where(F.col("g") == g)).first()
        assert got[g] == (one.threshold, one.f1) and math.isfinite(one.f1)
