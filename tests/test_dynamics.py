"""Dynamic O-information and moving blocks against matrices, and triplets of silent units."""

import itertools

import numpy as np
import pytest

from weftline.operators import lagged, multivariate

T, UNITS = 40, 5


@pytest.fixture(scope="module")
def z():
    g = np.random.default_rng(1)
    out = g.normal(size=(2, T, UNITS))
    out[:, 1:, 0] += 0.5 * out[:, :-1, 1] + 0.3 * out[:, :-1, 2]
    return out


def scores(spark, z, rename=None):
    rename = rename or {}
    rows = [(w, rename.get(u, u), t, float(z[w, t, u])) for w in range(len(z)) for u in range(z.shape[2]) for t in range(z.shape[1])]
    return spark.createDataFrame(rows, "win_id int, unit int, t int, z double").repartition(3)


def test_dynamic_omega_against_matrices(spark, z):
    for n in (2, 3):
        got = {tuple(r)[:-1]: r.domega for r in lagged.dynamic(scores(spark, z), T, n).collect()}
        assert len(got) == 2 * UNITS * len(list(itertools.combinations(range(UNITS - 1), n)))
        for (w, y, *sources), value in got.items():
            assert abs(value - multivariate.lagged_o_information(z[w], y, sources, 1)) < 1e-12


@pytest.mark.parametrize("block", [1, 5, 7])
def test_moving_blocks_equal_the_blocks_in_a_row(spark, z, block):
    """Also what crosses from one block into the next counts, and ends are left out as in one series."""
    drawn = lagged.draws(spark, 2, T, block, 4)
    starts = {}
    for r in drawn.collect():
        starts.setdefault((r.win_id, r.rep), {})[r.d] = r.start
        assert 0 <= r.start <= T - block
    got = {tuple(r)[:-1]: r.domega for r in lagged.moving_blocks(scores(spark, z, {0: lagged.TARGET}), drawn, T, block).collect()}
    assert len(got) == 8 * 4
    for (w, rep, *sources), value in got.items():
        at = np.concatenate([np.arange(starts[w, rep][d], starts[w, rep][d] + block) for d in range(T // block)])
        assert abs(value - multivariate.lagged_o_information(z[w][at], 0, sources, 1)) < 1e-11


def test_units_without_variance_give_null(spark, z):
    flat = z.copy()
    flat[:, :, 3] = 0.0
    got = lagged.dynamic(scores(spark, flat), T, 2).collect()
    assert all((r.domega is None) == (3 in (r.target, r.i, r.j)) for r in got)


def test_triplets_that_touch_a_silent_unit_go(spark):
    every = [(w, *c, 1.0) for w in (0, 1) for c in itertools.combinations(range(5), 3)]
    silent = [(0, 2), (1, 0), (1, 4)]
    rows = lagged.without_silent(spark.createDataFrame(every, "win_id int, i int, j int, k int, omega double"), spark.createDataFrame(silent, "win_id int, unit int"))
    assert sorted((r.win_id, r.i, r.j, r.k) for r in rows.collect()) == sorted(e[:4] for e in every if not any((e[0], u) in silent for u in e[1:4]))
