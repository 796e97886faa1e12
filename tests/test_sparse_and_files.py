"""Elastic-net spin models at their optimum, coupled-map files, tables by extension, pooled units."""

import numpy as np
import pytest

from weftline.operators import models, raster
from weftline.sources import io

G = np.random.default_rng(21)


def chain(t=400, n=5):
    s = np.where(G.random((t, n)) < 0.5, -1.0, 1.0)
    s[:, 1] = np.where(G.random(t) < 0.8, s[:, 0], -s[:, 0])
    return s


@pytest.mark.parametrize("c, l1", [(0.02, 1.0), (0.1, 0.5), (1.0, 0.9), (10.0, 0.0)])
def test_sparse_node_is_at_its_optimum(c, l1):
    """Slopes of the loss balance the penalty where a coefficient isn't zero, and stay within it where it is."""
    s = chain()
    for i in range(5):
        row, field = models.sparse_node(s, i, c, l1)
        b, b0 = 2 * np.delete(row, i), 2 * field
        x, y = np.delete(s, i, axis=1), (s[:, i] > 0).astype(float)
        slope = x.T @ (1 / (1 + np.exp(-(x @ b + b0))) - y)
        kept = b != 0
        assert np.abs(slope[kept] + (1 - l1) / c * b[kept] + l1 / c * np.sign(b[kept])).max(initial=0) < 1e-6
        assert (np.abs(slope[~kept]) <= l1 / c + 1e-6).all()
        assert abs((1 / (1 + np.exp(-(x @ b + b0))) - y).sum()) < 1e-6 and row[i] == 0
        if (c, l1) == (0.02, 1.0):
            assert (b == 0).sum() >= 3  # exact zeros


def test_sparse_node_of_a_constant_spin_is_finite():
    s = chain()
    s[:, 2] = 1.0
    row, field = models.sparse_node(s, 2, 1.0, 0.5)
    assert np.isfinite(row).all() and field > 0


def test_sparse_fit_averages_both_directions(spark):
    s = np.stack([chain(120, 4), chain(120, 4)])
    rows = [(w, u, t, int(s[w, t, u])) for w in range(2) for t in range(120) for u in range(4)]
    spins = spark.createDataFrame(rows, "win_id int, unit int, t int, s int").repartition(3)
    got = {(r.win_id, r.i, r.j): r for r in models.sparse_fit(spins, 0.2, 0.5).collect()}
    assert len(got) == 2 * 10
    for w in range(2):
        fits = [models.sparse_node(s[w], i, 0.2, 0.5) for i in range(4)]
        for (ww, i, j), r in got.items():
            if ww == w:
                assert abs(r.coupling - (0 if i == j else (fits[i][0][j] + fits[j][0][i]) / 2)) < 1e-12
                assert (r.field is None) == (i != j) and (i != j or abs(r.field - fits[i][1]) < 1e-12)
    assert models.coupling_summary(models.sparse_fit(spins, 0.2, 0.5)).count() == 2


def test_coupled_map_files(spark, tmp_path):
    """The first line and lines of two leading zeros are markers; the first column isn't a series."""
    lines = ["0 0 0 0.1", "1 .5 .6 .7", "2 .1 .2 .3", "0 0 0 0.2", "1 .4 .4 .4", "2 .9 .8 .7", "0 0 0 0.3"]
    (tmp_path / "a.txt_kaneko").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt_kaneko").write_text("7 7 7 0.5\n1 2 3 4\n")
    path = str(tmp_path)
    got = {(r.path[-12], r.roi, r.t): r.v for r in io.coupled_map_series(spark, path).collect()}
    data = [[float(x) for x in lines[n].split()][1:] for n in (1, 2, 4, 5)]
    assert got == {("a", k, t): data[t][k] for t in range(4) for k in range(3)} | {("b", 0, 0): 2.0, ("b", 1, 0): 3.0, ("b", 2, 0): 4.0}
    frames = sorted((r.path[-12], r.frame, r.start, r.eps) for r in io.coupled_map_frames(spark, path).collect())
    assert frames == [("a", 0, 0, 0.1), ("a", 1, 2, 0.2), ("a", 2, 4, 0.3), ("b", 0, 0, 0.5)]


@pytest.mark.parametrize("kind", ["tsv", "csv", "json", "parquet"])
def test_tables_by_extension_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a b", 0.5), (2, "c,d", -1.0)], "id int, name string, x double")
    path = str(tmp_path / f"table.{kind}")
    io.write_any(df, path)
    assert sorted(map(tuple, io.read_any(spark, path, df.schema.simpleString()[7:-1].replace(":", " ")).select("id", "name", "x").collect())) == [(1, "a b", 0.5), (2, "c,d", -1.0)]
    with pytest.raises(ValueError):
        io.write_any(df, str(tmp_path / "table.xyz"))


def test_pooled_units_are_numbered_in_order(spark):
    df = spark.createDataFrame([(i, n) for n, i in enumerate([90, 7, 7, 500, None, 90])], "orig_id int, t_ms int")
    assert sorted((r.orig_id, r.unit_id) for r in raster.pooled_units(df).collect()) == [(7, 0), (7, 0), (90, 1), (90, 1), (500, 2)]
