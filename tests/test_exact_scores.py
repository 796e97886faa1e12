"""Persistence diagrams whose ties, digits and missing weights don't hang on the order of rows: the query against its SQL, bit by bit."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.operators import topology
from weftline.plans import catalog, tables

NAMES = ("t", "dim", "birth", "death", "birth_arrival", "death_arrival")


def vectors(kind, n=60):
    rows = np.random.default_rng(1).normal(size=(n, 16)).astype("float32").tolist()
    if kind == "opposite":
        return [[r[c // 2] * (-1) ** c for c in range(8)] + r[8:] for r in rows]
    if kind == "constant":
        return [[1.5, *r[1:]] for r in rows]
    if kind == "missing":
        return [None, [None, *rows[1][1:]], rows[2][:5], *rows[3:]]
    return rows


@pytest.mark.parametrize("name", ["persistence_pairs", "persistence_chunks"])
def test_diagrams_equal_their_sql_exactly(spark, tmp_path, name):
    """Dimensions that repeat each other tie in every frame; a constant one has no weight, nor has a missing component."""
    for kind in ("opposite", "constant", "missing"):
        (tmp_path / kind).mkdir()
        rows = vectors(kind)
        embeddings = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))})
        pq.write_table(embeddings, tmp_path / kind / "embeddings.parquet")
        got = [tuple(r[c] for c in NAMES) for r in catalog.QUERIES[name](spark, str(tmp_path / kind)).collect()]
        want = duckdb.connect().sql(f"SELECT {', '.join(NAMES)} FROM ({catalog.ORACLES[name].replace('FROM embeddings', f'''FROM '{tmp_path / kind}/embeddings.parquet' ''')})").fetchall()
        assert got and sorted(map(str, got)) == sorted(map(str, want)), kind


def test_scores_are_the_same_in_any_order(spark):
    g = np.random.default_rng(3)
    rows = [(int(c), n, float(x)) for c, own in enumerate(g.standard_t(3, (4, 500)) * [[1.0], [1e-6], [1e9], [1.0]] + [[0.0], [5.0], [-1e9], [1e5]]) for n, x in enumerate(own)]
    once = None
    for seed in range(3):
        df = spark.createDataFrame([rows[n] for n in np.random.default_rng(seed).permutation(len(rows))], "roi int, t long, v double").repartition(3 + seed)
        series = topology.standardized(df)
        found = {(r.t, r.i, r.j, r.k): r.w for r in topology.triangles(series).collect()} | {(r.t, r.i, r.j): r.w for r in topology.edges(series).collect()}
        assert once is None or found == once
        once = found
    got = {(r.roi, r.t): r.v for r in topology.standardized(df).collect()}
    for c in range(4):
        own = np.array([x for k, _, x in rows if k == c])
        assert np.allclose([got[c, n] for n in range(500)], (own - own.mean()) / own.std(), atol=1e-9)
    same = topology.standardized(df.withColumn("v", F.lit(0.1)))
    assert {r.v for r in same.collect()} == {None}


def test_scores_keep_their_digits_beside_peaks(spark, tmp_path):
    """One peak in each dimension, at different times: products stay far below the product of the largest values."""
    own = np.random.default_rng(5).normal(size=(3000, 3)).astype("float32")
    for c in range(3):
        own[10 + c, c] = 1e6
    pq.write_table(pa.table({"vec_id": pa.array(range(3000), pa.int64()), "embedding": pa.array(own.tolist(), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    v = own.astype(float)
    p = ((v - v.mean(axis=0)) / v.std(axis=0)).prod(axis=1)
    want = (p - p.mean()) / p.std()
    query = {r.t: r.z for r in topology.triangles(topology.standardized(tables.series(spark, str(tmp_path)))).collect()}
    text = f"WITH {tables.EXACT_TRIANGLES} SELECT t, z FROM tri".replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet'")
    sql = dict(duckdb.connect().sql(text).fetchall())
    assert query == sql
    assert np.allclose([query[t] for t in range(3000)], want, rtol=1e-9, atol=1e-9)


def test_plan_of_a_filtration_stays_small(spark, data):
    """The driver holds the plan: what is known of the groups of scores is read, not repeated wherever scores meet."""
    kept = catalog.structure._filtration(spark, data)
    assert kept._jdf.queryExecution().analyzed().collectLeaves().size() < 50
