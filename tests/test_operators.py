import inspect
import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import numeric
from weftline.operators import copula, features, interaction, metrics, models, multivariate, raster, topology

RNG = np.random.default_rng(0)
models_curved_fit = models.curved_fit


def test_probit_equals_inverse_normal(spark):
    df = spark.range(1, 101).select((F.col("id") / 101.0).alias("p")).select("p", F.expr(numeric.probit_sql("p")).alias("z"))
    for p, z in df.collect():
        assert z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-12)


def test_digamma():
    assert numeric.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert numeric.digamma(0.5) == pytest.approx(-1.9635100260214235, abs=1e-12)


def test_combination_ranks_invert():
    for n, c in enumerate(sorted(itertools.combinations(range(1, 8), 3), key=lambda c: c[::-1]), 1):
        assert numeric.combination_of_rank(n, 3) == list(c)


def test_deformed_functions(spark):
    row = spark.range(1).select(
        numeric.deformed_sigmoid(F.lit(0.7), F.lit(0.0)).alias("a"), numeric.deformed_sigmoid(F.lit(0.7), F.lit(0.2)).alias("b"), numeric.gamma_tag(F.lit(-0.2)).alias("t"), numeric.coherence_sign(F.lit(-1.0), F.lit(-2.0)).alias("s"), numeric.coherence_sign(F.lit(0.0), F.lit(2.0)).alias("z")
    ).first()
    assert row.a == pytest.approx(1 / (1 + math.exp(-0.7)))
    x = (1 + 0.14) ** 5 / ((1 + 0.14) ** 5 + (1 - 0.14) ** 5)
    assert row.b == pytest.approx(x)
    assert (row.t, row.s, row.z) == ("gamma_m0.20", 1, -1)


def test_topic_pattern():
    import re

    assert re.match(numeric.topic_pattern("lab/+/log/#"), "lab/a/log/x/y")
    assert not re.match(numeric.topic_pattern("lab/+/log"), "lab/a/b/log")


def test_seconds_round_half_even(spark):
    got = spark.createDataFrame([(0.0005,), (0.0015,), (0.0025,)], "s double").select(raster.quantized(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == [0, 2, 2]


def test_window_rules():
    assert raster.window_starts(720, 100, 50) == list(range(0, 621, 50))
    assert raster.window_starts(99, 100, 50) == []
    assert raster.check_spec(10, 1, 0.5, 100, 20) == [] and len(raster.check_spec(5, 3, 0.1, 10, 2)) == 5


def _scores(spark, z, win=0):
    rows = [(win, u, t, float(z[t, u])) for t in range(len(z)) for u in range(z.shape[1])]
    return spark.createDataFrame(rows, "win_id int, unit int, t int, z double")


def test_triplet_omega_equals_entropies(spark):
    z = RNG.normal(size=(60, 4))
    z[:, 3] = z[:, 0] + z[:, 1] + 0.3 * z[:, 3]
    pairs = copula.pair_correlations(_scores(spark, z))
    got = {(r.i, r.j, r.k): r.omega for r in interaction.omega(pairs, 60).collect()}
    for c in itertools.combinations(range(4), 3):
        assert got[c] == pytest.approx(multivariate.o_information(np.cov(z[:, c].T), 60), abs=1e-9)


def test_bootstrap_from_block_sums(spark):
    z = RNG.normal(size=(40, 3))
    drawn = spark.createDataFrame([(0, 0, 0, 2), (0, 0, 2, 1), (0, 0, 3, 1)], "win_id int, rep int, block int, times long")
    got = {(r.i, r.j): r.r for r in interaction.bootstrap_pairs(interaction.block_sums(_scores(spark, z), 10), drawn).collect()}
    sample = np.concatenate([z[0:10], z[0:10], z[20:30], z[30:40]])
    for i, j in itertools.combinations(range(3), 2):
        assert got[i, j] == pytest.approx(np.corrcoef(sample[:, i], sample[:, j])[0, 1], abs=1e-9)


def test_shift_is_a_roll(spark):
    z = np.arange(20.0).reshape(20, 1)
    got = sorted((r.t, r.z) for r in interaction.shifted(_scores(spark, z), 1, 20, 5).collect())
    values = [v for _, v in got]
    k = int(values.index(0.0))
    assert values == np.roll(np.arange(20.0), k).tolist() and k >= 5
    with pytest.raises(ValueError):
        interaction.shifted(_scores(spark, z), 1, 20, 20)


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    df = spark.createDataFrame([(0, n, x) for n, x in enumerate(p)], "g int, n int, p double")
    assert interaction.benjamini_hochberg(df, ["g"], 0.05).where("discovery").count() == 2


def test_average_and_ordinal_ranks_agree_without_ties(spark):
    z = RNG.permutation(30).astype(float).reshape(-1, 1)
    df = _scores(spark, z).withColumnRenamed("z", "c")
    a = {r.t: r.z for r in copula.normal_scores(df, ["win_id", "unit"]).collect()}
    b = {r.t: r.z for r in copula.normal_scores(df, ["win_id", "unit"], ties="average").collect()}
    assert a == pytest.approx(b)


TRIANGLE = ([[], [], [], [0, 1], [0, 2], [1, 2], [3, 4, 5]], [0, 0, 0, 1, 1, 1, 2])


def test_single_triangle_pairs():
    assert topology.reduce_columns(*TRIANGLE) == [(1, 3), (2, 4), (5, 6)]


def test_reductions_agree():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        n = 6
        simplices = [(i,) for i in range(n)]
        e = [c for c in itertools.combinations(range(n), 2) if rng.random() < 0.8]
        rng.shuffle(e)
        t = [c for c in itertools.combinations(range(n), 3) if all(x in e or list(x) in [list(y) for y in e] for x in itertools.combinations(c, 2)) and rng.random() < 0.6]
        simplices += [tuple(int(v) for v in x) for x in e] + t
        columns, dims = topology.boundary_of(simplices)
        want = topology.reduce_columns(columns, dims, "standard")
        assert topology.reduce_columns(columns, dims, "twist") == want
        assert topology.dual_pairs(columns, dims) == want
        assert topology.dual_pairs(columns, dims, "standard") == want


def test_betti_of_a_hollow_triangle(spark):
    rows = [(0, n + 1, 1, *c, -1, w, n + 1) for n, (c, w) in enumerate(zip([(0, 1), (0, 2), (1, 2)], (3.0, 2.0, 1.0)))]
    kept = spark.createDataFrame(rows, "t long, ord int, dim int, i int, j int, k int, w double, arrival long")
    d = topology.persistence(kept).collect()
    assert [(r.birth, r.death, r.birth_arrival) for r in d] == [(-1.0, float("inf"), 3)]
    curve = {r["at"]: r.betti for r in topology.betti_curve(topology.persistence(kept), 5).collect()}
    assert curve == {3: 1, 5: 0}


def test_rips_equals_brute_force(spark):
    v = RNG.random((40, 3))
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "id int, v array<double>")
    got = {(r.a, r.b) for r in topology.rips_edges(df, 0.25).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(40), 2) if np.linalg.norm(v[a] - v[b]) <= 0.25}


def test_labels_lags_and_flags(spark):
    spans = spark.createDataFrame([(1, "r", 0.0), (2, "r", 10.0), (3, "q", 10.0)], "window_id int, recording_id string, t1 double")
    onsets = spark.createDataFrame([("r", 12.0), ("r", 10.0), ("q", 15.0)], "recording_id string, onset double")
    assert {r.window_id: r.y for r in features.horizon_labels(spans, onsets, 5.0).collect()} == {1: 0, 2: 1, 3: 0}
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("b", 1, None)], "g string, t0 int, x double")
    rows = features.missing_flags(features.lagged(df, ["x"], ["g"], "t0", 1), ["x", "x_lag1"]).orderBy("g", "t0").collect()
    assert [(r.x_isna, r.x_lag1_isna) for r in rows] == [(0, 1), (1, 0), (1, 1)]


def test_left_features_drop_clashing_columns(spark):
    base = spark.createDataFrame([(1, 5)], "window_id int, n int")
    block = spark.createDataFrame([(1, 9, 2.0)], "window_id int, n int, x double")
    assert features.left_features(base, block).first().asDict() == {"window_id": 1, "n": 5, "x": 2.0}
    assert features.left_features(base, None) is base


def test_scores_of_predictions(spark):
    y, p = RNG.integers(0, 2, 200), RNG.integers(0, 20, 200) / 20
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        tp, n = (pos >= s).sum(), (p >= s).sum()
        ap, last = ap + (tp / len(pos) - last) * tp / n, tp / len(pos)
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)


def test_one_class_scores_are_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.2)], "y int, p double")
    assert metrics.roc_auc(df).first()[0] is None


def test_group_folds_balance(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 3), ("c", 2), ("d", 1)) for _ in range(n)], "g string")
    assert metrics.group_folds(df, "g", 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert set(metrics.group_folds(df, "g", 9).values()) == {0, 1, 2, 3}


def test_model_recovers_couplings():
    j = np.array([[0, 0.5, 0], [0.5, 0, -0.4], [0, -0.4, 0.0]])
    s = 2.0 * models.gibbs(j, np.array([0.1, 0.0, -0.1]), 4000, 100, 2, 1) - 1
    found, h = models.fit_window(s)
    assert np.abs(found - j).max() < 0.12 and np.abs(h - [0.1, 0, -0.1]).max() < 0.12
    drawn = 2.0 * models.gibbs(found, h, 4000, 100, 2, 2) - 1
    m, c = models.moment_errors(s, drawn)
    assert m < 0.1 and c < 0.2


def test_positions_of_either_shape(spark):
    from weftline.sources import io

    rows = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]), (2, [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]]), (3, [[1.0], [2.0], [3.0]]), (4, None)], "recording_id int, positions array<array<double>>")
    got = sorted(tuple(r) for r in io.positions(rows).collect())
    assert got == [(n, u, 2.0 * u + 1, 2.0 * u + 2) for n in (1, 2) for u in range(3)]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    from weftline.sources import io

    (tmp_path / "m.txt").write_text("\n".join(f"{i} {i + 0.5}" for i in range(5000)) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = io.series_columns(spark, str(tmp_path / "m.txt")).where("roi = 1").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.t, r.v) for r in rows) == [(i, i + 0.5) for i in range(5000)]


def test_curved_fit_at_zero_is_logistic():
    s = RNG.choice([-1.0, 1.0], (300, 3))
    s[:, 2] = np.where(RNG.random(300) < 0.8, s[:, 0], s[:, 2])
    a = models.curved_node(s, 2, 0.0, np.zeros(3), 1e-4, 1e-4)
    b, h = models.fit_node(s, 2, 1e4)
    assert np.abs(a - np.append(np.delete(b, 2), h)).max() < 5e-3


def test_mixture_information_of_apart_classes():
    x = np.concatenate([RNG.normal(0, 1, (200, 1)), RNG.normal(50, 1, (200, 1))])
    c = np.repeat([0, 1], 200)
    assert multivariate.mixture_information(x, c) == pytest.approx(1.0, abs=0.05)


def test_linear_conditional_is_nonnegative():
    x, z = RNG.normal(size=(100, 1)), RNG.normal(size=(100, 1))
    assert multivariate.linear_conditional(x + 0.1 * RNG.normal(size=(100, 1)), x, z) > 0.5


def test_evenly_spaced_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(11)] + [("b", i) for i in range(2)], "g string, t int")
    got = features.evenly_spaced(df, ["g"], "t", 4).collect()
    assert sorted(r.t for r in got if r.g == "a") == [int(x) for x in np.linspace(0, 10, 4)]
    assert sum(r.g == "b" for r in got) == 2


def test_permuted_block_keeps_each_group(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(40)], "id int, g string, x double")
    got = features.permuted_block(df, ["x"], ["g"], "id", 3).collect()
    for g in "ab":
        assert sorted(r.x for r in got if r.g == g) == sorted(float(i) for i in range(40) if "ab"[i % 2] == g)
    assert any(r.x != r.id for r in got)


def test_percentile_interval(spark):
    df = spark.createDataFrame([(1, float(x)) for x in range(-5, 6)] + [(2, float(x)) for x in range(1, 12)], "g int, v double")
    got = {r.g: r.significant for r in interaction.percentile_interval(df, ["g"], "v").collect()}
    assert got == {1: False, 2: True}


def test_registered_curved_fits_take_all_gammas(monkeypatch):
    from weftline.plans import structure

    taken = []
    monkeypatch.setattr(structure, "_spins", lambda spark, d: None)
    monkeypatch.setattr(structure.models, "curved_fit", lambda spins, gammas: taken.append(gammas))
    structure.curved_fit(None, "")
    assert taken == [(-0.4, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4)]
    assert inspect.signature(models_curved_fit).parameters["gammas"].default == taken[0]  # what the choice of gamma runs


def gamma_brute(rows, p05):
    rows = sorted(rows)
    ll0 = next((x[1] for x in rows if x[0] == 0), rows[0][1])
    for g, ll, clip, ok, med in rows:
        if g > 0 and clip <= 0.05 and ok and ll <= 1.01 * ll0 and med <= p05:
            return g, True, False
    up = [x for x in rows if x[0] > 0]
    if len(up) >= 2 and all(b[1] - a[1] <= 1e-12 for a, b in zip(up, up[1:])):
        good = [(x[1], x[0]) for x in up if x[2] <= 0.05 and x[3]]
        return (min(good)[1] if good else 0.0), False, False
    return 0.0, False, True


def test_gamma_of_each_window_against_brute_force(spark):
    grid, base, want = [], [], {}
    for w in range(60):
        losses = np.sort(RNG.random(5))[::-1] if w % 3 == 0 else RNG.choice([0.5, 0.501, 0.6], 5)
        rows = [(g, float(ll), float(RNG.choice([0.0, 0.2])), bool(RNG.random() < 0.6), float(RNG.normal())) for g, ll in zip((-0.2, 0.0, 0.1, 0.2, 0.3), losses)]
        base.append((w, float(RNG.normal() - 0.5)))
        want[w] = gamma_brute(rows, base[-1][1])
        grid += [(w, *r) for r in rows]
    df = spark.createDataFrame(grid, "win_id int, gamma double, cv_log_loss double, clip_rate double, accepted boolean, median double")
    got = models.select_gamma(df.drop("accepted", "median"), df.select("win_id", "gamma", "accepted"), df.select("win_id", "gamma", "median"), spark.createDataFrame(base, "win_id int, p05 double"))
    assert {r.win_id: (r.gamma_star, r.ho_closure, r.no_closure) for r in got.collect()} == want and len(set(want.values())) > 3


@pytest.mark.parametrize("gamma", [-0.3, 0.0, 0.2])
def test_curved_slope_is_that_of_the_loss(gamma):
    s = RNG.choice([-1.0, 1.0], (200, 3))
    s[:, 2] = np.where(RNG.random(200) < 0.9, s[:, 0], s[:, 2])
    best = models.curved_node(s, 2, gamma, np.zeros(3))

    def loss(b):
        x = np.clip(2 * (s[:, :2] @ b[:2] + b[2]), -models.field_limit(gamma), models.field_limit(gamma))
        p = models.sigma_gamma(x, gamma)
        return -np.log(np.where(s[:, 2] > 0, p, 1 - p) + 1e-24).sum() + 1e-2 * (b[:2] ** 2).sum() + 1e-3 * b[2] ** 2

    least = loss(best)
    assert all(loss(best + RNG.normal(0, 0.02, 3)) >= least - 1e-6 * abs(least) for _ in range(50))


def test_curved_surrogates_report_their_errors(spark):
    s = RNG.choice([-1, 1], (60, 3))
    spins = spark.createDataFrame([(1, u, t, int(s[t, u])) for t in range(60) for u in range(3)], "win_id int, unit int, t int, s int")
    drawn = models.curved_surrogates(spins, models.curved_fit(spins, (0.0, 0.2))).toPandas()
    for g, one in drawn.groupby("gamma"):
        x = 2.0 * one.pivot(index="t", columns="unit", values="c").to_numpy() - 1
        m, c = models.moment_errors(s.astype(float), x)
        assert len(one) == 180 and one.m_err.iloc[0] == pytest.approx(m) and one.c_rel_err.iloc[0] == pytest.approx(c)
        assert one.accepted.iloc[0] == (m <= 0.02 and c <= 0.1)


def test_couplings_and_bounds(spark):
    model = spark.createDataFrame([(1, 0, 1, 0.5, None), (1, 0, 2, 0.0, None), (1, 1, 2, -0.25, None), *[(1, i, i, 0.0, 0.1) for i in range(3)]], "win_id int, i int, j int, coupling double, field double")
    r = models.coupling_summary(model).first()
    j = np.array([[0, 0.5, 0], [0.5, 0, -0.25], [0, -0.25, 0]])
    assert (r.mean_abs_j, r.max_abs_j) == (0.375, 0.5) and r.j_spectral_norm == pytest.approx(np.linalg.norm(j, 2))
    ours = spark.createDataFrame([(0, 0, 10), (1, 5, 15), (2, 10, 20)], "win_id int, start_bin int, end_bin int")
    held = spark.createDataFrame([(0, 0, 10), (1, 5, 16)], "win_id int, start_bin int, end_bin int")
    assert sorted(x.win_id for x in models.same_bounds(held, ours).collect()) == [1, 2]


def test_endless_deaths_become_the_largest_weight(spark):
    # A square without diagonals and triangles: one loop that never ends.
    kept = spark.createDataFrame([(1, n, 1, a, b, -1, w, n) for n, (a, b, w) in enumerate([(0, 1, 4.0), (1, 2, 3.0), (2, 3, 2.0), (0, 3, 1.0)], 1)], "t long, ord int, dim int, i int, j int, k int, w double, arrival long")
    diagram = topology.persistence(kept)
    assert [(r.birth, r.death) for r in diagram.collect()] == [(-1.0, float("inf"))]
    clean = topology.cleaned(diagram, spark.createDataFrame([(1, 4.5)], "t long, max_weight double"))
    assert [(r.birth, r.death) for r in clean.collect()] == [(-1.0, 4.5)]
    angles = [d * np.pi / 50 - np.pi / 2 for d in range(50)]
    want = np.mean([abs(-np.cos(a) + 4.5 * np.sin(a) - 1.75 * (np.cos(a) + np.sin(a))) for a in angles])
    got = {r.kind: r.distance for r in topology.diagram_indicators(clean).collect()}
    assert got == pytest.approx({"all": want, "ct": want})
    assert {r.dim: r.betti for r in topology.betti_numbers(kept).collect()} == {0: 1, 1: 1}


def test_registered_interval_takes_all_replicates(spark, data, monkeypatch):
    from weftline.plans import structure

    taken = []
    picks = structure.interaction.picks
    monkeypatch.setattr(structure.interaction, "picks", lambda spark, windows, blocks, reps: taken.append(reps) or picks(spark, windows, blocks, reps))
    assert set(structure.boot_interval(spark, data).columns) >= {"win_id", "i", "j", "k", "low", "high"}
    assert taken == [100]


def test_a_unit_without_variance_has_no_correlation(spark):
    """Silent units of a drawn surrogate have equal mean ranks; their pairs and triplets are null, not an error."""
    rows = [(0, u, t, c) for t in range(20) for u, c in enumerate((t % 3, (t * 7) % 5, 0))]
    pairs = copula.pair_correlations(copula.normal_scores(spark.createDataFrame(rows, "win_id int, unit int, t int, c int"), ["win_id", "unit"], ties="average")).cache()
    got = {(r.i, r.j): r.r for r in pairs.collect()}
    assert got[0, 2] is None and got[1, 2] is None and -1 < got[0, 1] < 1
    assert [r.omega for r in interaction.omega(pairs, 20).collect()] == [None]


def test_indicators_make_no_row_for_a_direction(spark):
    """One exchange by frame and kind; distances as by sorted projections in numpy."""
    g = np.random.default_rng(3)
    points = [(t, float(b), float(b + x)) for t in range(3) for b, x in zip(g.normal(size=12), g.random(12))]
    out = topology.diagram_indicators(spark.createDataFrame(points, "t long, birth double, death double"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    angles = np.arange(50) * np.pi / 50 - np.pi / 2
    for r in out.where("kind = 'all'").collect():
        b, d = np.array([p[1:] for p in points if p[0] == r.t]).T
        want = np.mean([np.abs(np.sort(b * np.cos(a) + d * np.sin(a)) - np.sort((b + d) / 2 * (np.cos(a) + np.sin(a)))).sum() for a in angles])
        assert r.distance == pytest.approx(want)
