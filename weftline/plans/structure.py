"""Registered queries: topology, features, metrics, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.functions import numeric
from weftline.functions.numeric import rounded as r6
from weftline.operators import chunks, copula, features, interaction, metrics, models, multivariate, raster, rips, selection, topology
from weftline.sources.stored import stored
from weftline.streaming import streams

from . import signals
from . import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R6 = "round({}, 6) + 0.0"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _edges(spark, d):
    return topology.edges(topology.standardized(T.series(spark, d)))


def _triangles(spark, d):
    return topology.triangles(topology.standardized(T.series(spark, d)))


@query("edge_zscores", f"WITH {T.EDGES} SELECT t, i, j, {R6.format('z')} AS z FROM edges")
def edge_zscores(spark, d):
    return _edges(spark, d).select("t", "i", "j", r6(F.col("z")).alias("z"))


@query("triplet_zscores", f"WITH {T.TRIANGLES} SELECT t, i, j, k, {R6.format('z')} AS z FROM tri")
def triplet_zscores(spark, d):
    return _triangles(spark, d).select("t", "i", "j", "k", r6(F.col("z")).alias("z"))


@query("coherence_weights", f"WITH {T.TRIANGLES} SELECT t, i, j, k, {R6.format('w')} AS w FROM tri UNION ALL SELECT t, i, j, -1, {R6.format('w')} FROM edges")
def coherence_weights(spark, d):
    e = _edges(spark, d).select("t", "i", "j", F.lit(-1).alias("k"), "w")
    return e.unionByName(_triangles(spark, d).select("t", "i", "j", "k", "w")).withColumn("w", r6(F.col("w")))


@query("max_weight", f"WITH {T.TRIANGLES} SELECT t, {R6.format('max(abs(w))')} AS max_weight FROM (SELECT t, w FROM edges UNION ALL SELECT t, w FROM tri) GROUP BY t")
def max_weight(spark, d):
    return _edges(spark, d).select("t", "w").unionByName(_triangles(spark, d).select("t", "w")).groupBy("t").agg(r6(F.max(F.abs("w"))).alias("max_weight"))


def _admitted(spark, d):
    series = topology.standardized(T.series(spark, d))
    return topology.admissions(topology.edges(series), topology.triangles(series))


@query("violations", f"WITH {T.ADMITTED} SELECT t, i, j, k, {R6.format('w')} AS w, missing FROM adm WHERE missing > 0 AND w >= 0")
def violations(spark, d):
    return _admitted(spark, d).where("NOT admitted AND w >= 0").select("t", "i", "j", "k", r6(F.col("w")).alias("w"), "missing")


@query("hyper_coherence", f"WITH {T.ADMITTED} SELECT t, {R6.format('count(*) FILTER (w >= 0 AND missing > 0) / CAST(nullif(count(*) FILTER (w >= 0), 0) AS DOUBLE)')} AS hyper_coherence, {R6.format('avg(CASE WHEN w >= 0 AND missing > 0 THEN missing END)')} AS edge_violation FROM adm GROUP BY t")
def hyper_coherence(spark, d):
    return topology.hyper_coherence(_admitted(spark, d)).select("t", r6(F.col("hyper_coherence")).alias("hyper_coherence"), r6(F.col("edge_violation")).alias("edge_violation"))


@query("edge_projection", f"WITH {T.ADMITTED}, sides AS (SELECT t, i, j, w FROM adm WHERE missing > 0 AND w >= 0 UNION ALL SELECT t, i, k, w FROM adm WHERE missing > 0 AND w >= 0 UNION ALL SELECT t, j, k, w FROM adm WHERE missing > 0 AND w >= 0) SELECT t, i, j, {R6.format('sum(w)')} AS weight, count(*) AS n FROM sides GROUP BY 1, 2, 3")
def edge_projection(spark, d):
    return topology.edge_projection(_admitted(spark, d)).withColumn("weight", r6(F.col("weight")))


def _filtration(spark, d):
    series = topology.standardized(T.series(spark, d))
    edge = topology.edges(series)
    return topology.filtration(edge, topology.admissions(edge, topology.triangles(series)))


@query("arrival_index", f"WITH {T.ARRIVALS} SELECT t, dim, i, j, k, CAST(arrival AS BIGINT) AS arrival FROM arr WHERE kept")
def arrival_index(spark, d):
    return _filtration(spark, d).select("t", "dim", "i", "j", "k", "arrival")



DIAGRAM_SQL = f"""WITH RECURSIVE {T.EXACT_REDUCED}
SELECT t, dim, {R6.format("birth")} AS birth, {R6.format("death")} AS death, birth_arrival, death_arrival FROM diagram"""


def _rounded(diagram):
    return diagram.withColumns({"birth": r6(F.col("birth")), "death": r6(F.col("death"))})


@query("persistence_pairs", DIAGRAM_SQL)
def persistence_pairs(spark, d):
    return _rounded(topology.persistence(_filtration(spark, d)))


@query("persistence_chunks", DIAGRAM_SQL)
def persistence_chunks(spark, d):
    """The same diagrams by blocks of 32 columns: each frame of 92 columns at most is spread over tasks."""
    return _rounded(chunks.persistence(_filtration(spark, d), block=32))


CURVE_SQL = f"""WITH RECURSIVE {T.REDUCED}, steps AS (
  SELECT t, dim, birth_arrival AS "at", 1 AS d FROM diagram UNION ALL SELECT t, dim, CASE WHEN death_arrival < 0 THEN 100 ELSE death_arrival END, -1 FROM diagram
), changes AS (SELECT t, dim, "at", sum(d) AS d FROM steps GROUP BY 1, 2, 3)
SELECT t, dim, "at", CAST(sum(d) OVER (PARTITION BY t, dim ORDER BY "at") AS BIGINT) AS betti FROM changes"""


@query("betti_curve", CURVE_SQL)
def betti_curve(spark, d):
    return topology.betti_curve(topology.persistence(_filtration(spark, d)), 100)


SCAFFOLD_SQL = f"""WITH RECURSIVE {T.REDUCED}, lasting AS (
  SELECT d.t, d.v, d.arrival - e.arrival AS lasted FROM died d JOIN eo e ON e.t = d.t AND e.c = d.c WHERE d.arrival > e.arrival
), bits AS (SELECT t, v, lasted, unnest(range({T.ROIS * (T.ROIS - 1) // 2})) AS c FROM lasting)
SELECT b.t, e.i, e.j, count(*) AS n, CAST(sum(b.lasted) AS DOUBLE) AS persistence
FROM bits b JOIN eo e ON e.t = b.t AND e.c = b.c WHERE (b.v >> b.c) & 1 = 1 GROUP BY 1, 2, 3"""


@query("scaffold_cycles", SCAFFOLD_SQL)
def scaffold_cycles(spark, d):
    return topology.scaffold(_filtration(spark, d))


INDICATOR_SQL = f"""WITH RECURSIVE {T.REDUCED}, top AS (
  SELECT t, max(abs(w)) AS top FROM (SELECT t, w FROM edges UNION ALL SELECT t, w FROM tri) GROUP BY t
), clean AS (
  SELECT t, birth, CASE WHEN isinf(death) THEN top ELSE death END AS death FROM diagram JOIN top USING (t)
), kinds AS (
  SELECT *, CASE WHEN birth < 0 AND death <= 0 THEN 'fc' WHEN birth < 0 AND death > 0 THEN 'ct' WHEN birth > 0 THEN 'fd' END AS kind FROM clean
), every AS (SELECT * FROM kinds WHERE kind IS NOT NULL UNION ALL SELECT t, birth, death, 'all' FROM kinds),
spread AS (
  SELECT t, kind, d, birth * cos(a) + death * sin(a) AS x, (birth + death) / 2 * cos(a) + (birth + death) / 2 * sin(a) AS y
  FROM every, (SELECT i AS d, i * pi() / 50 - pi() / 2 AS a FROM range(50) r(i))
), xs AS (SELECT t, kind, d, x, row_number() OVER (PARTITION BY t, kind, d ORDER BY x) AS n FROM spread),
ys AS (SELECT t, kind, d, y, row_number() OVER (PARTITION BY t, kind, d ORDER BY y) AS n FROM spread)
SELECT t, kind, {R6.format("sum(abs(x - y)) / 50")} AS distance FROM xs JOIN ys USING (t, kind, d, n) GROUP BY 1, 2"""


@query("diagram_indicators", INDICATOR_SQL)
def diagram_indicators(spark, d):
    weights = topology.node_weights(_edges(spark, d), _triangles(spark, d))
    clean = topology.cleaned(topology.persistence(_filtration(spark, d)), weights)
    return topology.diagram_indicators(clean).withColumn("distance", r6(F.col("distance")))


@query("node_weight", f"WITH {T.TRIANGLES} SELECT t, {R6.format('max(abs(w))')} AS max_weight, ceil(max(abs(w))) AS node_weight FROM (SELECT t, w FROM edges UNION ALL SELECT t, w FROM tri) GROUP BY t")
def node_weight(spark, d):
    return topology.node_weights(_edges(spark, d), _triangles(spark, d)).withColumn("max_weight", r6(F.col("max_weight")))


BETTI_SQL = f"""WITH RECURSIVE {T.REDUCED}
SELECT t, 0 AS dim, CAST({T.ROIS} - count(*) FILTER (v <> 0 AND c >= 0) AS BIGINT) AS betti FROM ered GROUP BY t
UNION ALL SELECT t, 1, count(*) FILTER (death_arrival < 0) FROM diagram GROUP BY t"""


@query("betti_numbers", BETTI_SQL)
def betti_numbers(spark, d):
    return topology.betti_numbers(_filtration(spark, d))


COMPONENTS_SQL = f"""WITH RECURSIVE {T.REDUCED}, top AS (
  SELECT t, ceil(max(abs(w))) AS top FROM (SELECT t, w FROM edges UNION ALL SELECT t, w FROM tri) GROUP BY t
), ends AS (SELECT r.t, e.w, e.arrival FROM ered r JOIN eo e ON e.t = r.t AND e.c = r.c WHERE r.v <> 0)
SELECT t, {R6.format("-top")} AS birth, {R6.format("-w")} AS death, CAST(arrival AS BIGINT) AS death_arrival FROM ends JOIN top USING (t)
UNION ALL SELECT t, {R6.format("-top")}, 'infinity'::DOUBLE, -1 FROM top, range({T.ROIS} - (SELECT count(*) FROM ends WHERE ends.t = top.t))"""


@query("component_diagram", COMPONENTS_SQL)
def component_diagram(spark, d):
    """Diagrams of dimension 0, in which all nodes enter with the frame's largest weight, rounded up."""
    weights = topology.node_weights(_edges(spark, d), _triangles(spark, d))
    return _rounded(topology.persistence(_filtration(spark, d), 0, weights)).select("t", "birth", "death", "death_arrival")


#: Positions in space: the first three dimensions of the embeddings; and the reach of the complex.
POINTS_SQL = """p AS (SELECT vec_id AS id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
q AS (SELECT a.id AS a, b.id AS b, sqrt((a.v[1] - b.v[1]) ^ 2 + (a.v[2] - b.v[2]) ^ 2 + (a.v[3] - b.v[3]) ^ 2) AS d FROM p a JOIN p b ON a.id < b.id)"""
REACH = 0.02


def _points(spark, d):
    return T.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))


@query("rips_edges", f"WITH {POINTS_SQL} SELECT a, b, {R6.format('d')} AS d FROM q WHERE d <= {REACH}")
def rips_edges(spark, d):
    return topology.rips_edges(_points(spark, d), REACH).withColumn("d", r6(F.col("d")))


RIPS_SQL = f"""WITH {POINTS_SQL}, near AS MATERIALIZED (SELECT * FROM q WHERE d <= {2 * REACH})
SELECT 0 AS dim, CAST(id AS VARCHAR) AS members, 0.0::DOUBLE AS d FROM p
UNION ALL SELECT 1, a || ' ' || b, {R6.format("d")} FROM near
UNION ALL SELECT 2, x.a || ' ' || x.b || ' ' || y.b, {R6.format("greatest(x.d, y.d, z.d)")}
FROM near x JOIN near y ON y.a = x.a AND y.b > x.b JOIN near z ON z.a = x.b AND z.b = y.b"""


@query("rips_complex", RIPS_SQL)
def rips_complex(spark, d):
    """Points, pairs and triangles within twice the reach, with their diameters."""
    out = topology.rips_complex(_points(spark, d), 2 * REACH)
    return out.select("dim", F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("members"), r6(F.col("d")).alias("d"))


@query("rips_persistence")
def rips_persistence(spark, d):
    """Loops of the Rips complex of all points: one filtration, from the links of its edges."""
    return _rounded(rips.loops(_points(spark, d), 4 * REACH))


def _boundary(spark, d):
    """Orders as nodes, lineitems as edges to parts: a boundary matrix with one column per line."""
    rows = T.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("rows"))
    return rows.select(F.col("l_orderkey").alias("col"), (F.size("rows") - 1).alias("dim"), "rows")


@query("matrix_info", "WITH b AS (SELECT l_orderkey AS col, list_distinct(list(l_partkey)) AS rows FROM lineitem GROUP BY 1), r AS (SELECT unnest(rows) AS row FROM b), n AS (SELECT row, count(*) AS n FROM r GROUP BY 1) SELECT count(*) AS num_cols, CAST(max(len(rows)) - 1 AS INT) AS max_dim, CAST(max(len(rows)) AS BIGINT) AS max_col_entries, CAST(sum(len(rows)) AS BIGINT) AS entries, (SELECT max(n) FROM n) AS max_row_entries FROM b")
def matrix_info(spark, d):
    return topology.matrix_info(_boundary(spark, d))


@query("set_equality", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer) SELECT (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_left, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_right")
def set_equality(spark, d):
    a, b = T.read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), T.read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full")
    return both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


HOUR = T.EVENTS + ", spans AS (SELECT CAST(u.i * 1000 + w.i AS BIGINT) AS window_id, CAST(u.i AS INT) AS unit, w.i * 6.0::DOUBLE AS t0, w.i * 6.0::DOUBLE + 6 AS t1 FROM range(8) u(i), range(120) w(i))"


def _spans(spark):
    """Six-hour windows of each unit: ``(window_id, unit, t0, t1)`` in hours."""
    at = F.col("w") * 6.0
    grid = spark.range(8 * 120).select((F.floor(F.col("id") / 120)).cast("int").alias("unit"), (F.col("id") % 120).alias("w"))
    return grid.select((F.col("unit") * 1000 + F.col("w")).cast("long").alias("window_id"), "unit", at.alias("t0"), (at + 6).alias("t1"))


@query("label_horizon", f"WITH {HOUR} SELECT window_id, unit, t1, CAST(EXISTS (SELECT 1 FROM ev WHERE ev.unit = spans.unit AND event_type = 'error' AND t_ms / 3600000.0::DOUBLE >= t1 AND t_ms / 3600000.0::DOUBLE < t1 + 2) AS INT) AS y FROM spans")
def label_horizon(spark, d):
    onsets = T.events(spark, d).where("event_type = 'error'").select("unit", (F.col("t_ms") / 3600000.0).alias("onset"))
    return features.horizon_labels(_spans(spark).drop("t0"), onsets, 2.0, "unit").select("window_id", "unit", "t1", "y")


RATE = HOUR + ", rate AS (SELECT s.window_id, s.unit, s.t0, nullif(count(e.t_ms), 0) AS n FROM spans s LEFT JOIN ev e ON e.unit = s.unit AND CAST(floor(e.t_ms / 21600000.0::DOUBLE) AS BIGINT) = CAST(s.t0 / 6 AS BIGINT) GROUP BY 1, 2, 3)"


def _rate(spark, d):
    n = T.events(spark, d).groupBy("unit", (F.floor(F.col("t_ms") / 21600000.0) * 6.0).alias("t0")).agg(F.count(F.lit(1)).alias("n"))
    return _spans(spark).drop("t1").join(n, ["unit", "t0"], "left").select("window_id", "unit", "t0", "n")


@query("lag_features", f"WITH {RATE} SELECT window_id, n, lag(n, 1) OVER o AS n_lag1, lag(n, 2) OVER o AS n_lag2 FROM rate WINDOW o AS (PARTITION BY unit ORDER BY t0)")
def lag_features(spark, d):
    return features.lagged(_rate(spark, d), ["n"], ["unit"], "t0").select("window_id", "n", "n_lag1", "n_lag2")


@query("isna_flags", f"WITH {RATE} SELECT window_id, CAST(n IS NULL AS INT) AS n_isna, CAST(lag(n, 1) OVER o IS NULL AS INT) AS n_lag1_isna FROM rate WINDOW o AS (PARTITION BY unit ORDER BY t0)")
def isna_flags(spark, d):
    lag = features.lagged(_rate(spark, d), ["n"], ["unit"], "t0", 1)
    return features.missing_flags(lag, ["n", "n_lag1"]).select("window_id", "n_isna", "n_lag1_isna")


@query("feature_join", f"WITH {RATE} SELECT r.window_id, r.n, e.n_errors FROM rate r LEFT JOIN (SELECT s.window_id, count(*) AS n_errors FROM spans s JOIN ev e ON e.unit = s.unit AND CAST(floor(e.t_ms / 21600000.0::DOUBLE) AS BIGINT) = CAST(s.t0 / 6 AS BIGINT) WHERE event_type = 'error' GROUP BY 1) e USING (window_id)")
def feature_join(spark, d):
    errors = T.events(spark, d).where("event_type = 'error'").groupBy("unit", (F.floor(F.col("t_ms") / 21600000.0) * 6.0).alias("t0")).agg(F.count(F.lit(1)).alias("n_errors"))
    block = _spans(spark).join(errors, ["unit", "t0"]).select("window_id", "n_errors", F.lit(0).alias("n"))
    return features.left_features(_rate(spark, d), block).select("window_id", "n", "n_errors")


CURVE = T.PREDICTIONS + """, cur AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM preds GROUP BY p), run AS (
  SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM cur)"""


@query("pr_auc", f"WITH {CURVE} SELECT {R6.format('sum(pos / CAST(ap AS DOUBLE) * tp / (tp + fp))')} AS pr_auc FROM run")
def pr_auc(spark, d):
    return metrics.average_precision(T.predictions(spark, d)).select(r6(F.col("pr_auc")).alias("pr_auc"))


@query("roc_auc", f"WITH {CURVE} SELECT {R6.format('sum(neg * (tp - pos / 2.0::DOUBLE)) / CAST(max(ap * an) AS DOUBLE)')} AS roc_auc FROM run")
def roc_auc(spark, d):
    return metrics.roc_auc(T.predictions(spark, d)).select(r6(F.col("roc_auc")).alias("roc_auc"))


@query("pr_auc_by_group", f"WITH {T.PREDICTIONS}, cur AS (SELECT source, p, sum(y) AS pos, sum(1 - y) AS neg FROM preds GROUP BY 1, 2), run AS (SELECT *, sum(pos) OVER (PARTITION BY source ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY source ORDER BY p DESC) AS fp, sum(pos) OVER (PARTITION BY source) AS ap FROM cur) SELECT source, {R6.format('sum(pos / CAST(nullif(ap, 0) AS DOUBLE) * tp / (tp + fp))')} AS pr_auc FROM run GROUP BY 1")
def pr_auc_by_group(spark, d):
    return metrics.average_precision(T.predictions(spark, d), ["source"]).withColumn("pr_auc", r6(F.col("pr_auc")))


@query("calibration_bins", f"WITH {T.PREDICTIONS} SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, {R6.format('avg(y)')} AS mean_y, {R6.format('avg(p)')} AS mean_p FROM preds GROUP BY 1")
def calibration_bins(spark, d):
    return metrics.calibration_bins(T.predictions(spark, d)).select("bin", "n", r6(F.col("mean_y")).alias("mean_y"), r6(F.col("mean_p")).alias("mean_p"))


@query("ece10", f"WITH {T.PREDICTIONS}, b AS (SELECT count(*) AS n, avg(y) AS my, avg(p) AS mp FROM preds GROUP BY least(floor(p * 10), 9)) SELECT {R6.format('sum(n * abs(my - mp)) / sum(n)')} AS ece FROM b")
def ece10(spark, d):
    return metrics.expected_calibration_error(T.predictions(spark, d)).select(r6(F.col("ece")).alias("ece"))


@query("brier", f"WITH {T.PREDICTIONS} SELECT {R6.format('avg((p - y) * (p - y))')} AS brier, {R6.format('avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-9), 1 - 1e-9)) ELSE ln(1 - least(greatest(p, 1e-9), 1 - 1e-9)) END)')} AS log_loss FROM preds")
def brier(spark, d):
    return T.predictions(spark, d).agg(r6(metrics.brier()).alias("brier"), r6(metrics.log_loss()).alias("log_loss"))


@query("best_f1_threshold", f"WITH {CURVE}, f AS (SELECT *, round(2 * tp / CAST(tp + fp + ap AS DOUBLE), 12) AS f1 FROM run) SELECT {R6.format('p')} AS threshold, {R6.format('f1')} AS f1 FROM f ORDER BY f.f1 DESC, p LIMIT 1")
def best_f1_threshold(spark, d):
    return metrics.best_f1(T.predictions(spark, d)).select(r6(F.col("threshold")).alias("threshold"), r6(F.col("f1")).alias("f1"))


KFOLD_SQL = f"""WITH RECURSIVE {T.PREDICTIONS}, sizes AS (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM preds GROUP BY source
), deal(k, load, source, n, f) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range(least(5, (SELECT count(*) FROM sizes))), lambda x: CAST(0 AS BIGINT)), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
  SELECT s.k, list_transform(d.load, lambda x, i: CASE WHEN i = d.low THEN x + s.n ELSE x END), s.source, s.n, d.low
  FROM (SELECT k, load, list_position(load, list_min(load)) AS low FROM deal) d JOIN sizes s ON s.k = d.k + 1
)
SELECT CAST(f - 1 AS INT) AS fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups FROM deal WHERE source IS NOT NULL GROUP BY f"""


@query("group_kfold", KFOLD_SQL)
def group_kfold(spark, d):
    preds = T.predictions(spark, d)
    fold = metrics.group_folds(preds, "source", 5)
    table = spark.createDataFrame(sorted(fold.items()), "source string, fold int")
    return preds.join(F.broadcast(table), "source").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("groups"))


@query("kfold_blocks", "SELECT CAST(CASE WHEN i < 2 * 34 THEN i // 34 ELSE (i - 68) // 33 + 2 END AS INT) AS fold_first, CAST((i >= 33) AS INT) + CAST((i >= 67) AS INT) AS fold_linspace, count(*) AS n, min(vec_id) AS low FROM (SELECT vec_id, vec_id % 101 AS i FROM embeddings) GROUP BY 1, 2")
def kfold_blocks(spark, d):
    i = (F.col("vec_id") % 101).cast("int")
    # 101 positions in 3 folds: 34, 34, 33 by the first rule; bounds at 33 and 67 by the second.
    rows = T.read(spark, d, "embeddings").select("vec_id", metrics.contiguous_fold(i, 101, 3).alias("fold_first"), metrics.contiguous_fold(i, 101, 3, "floor").alias("fold_linspace"))
    return rows.groupBy("fold_first", "fold_linspace").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))


@query("deformed_sigmoid", f"WITH x AS (SELECT event_id, value / 50 - 1 AS x, ((event_id % 9) - 4) / 10.0::DOUBLE AS g FROM events), l AS (SELECT *, CASE WHEN g = 0 THEN x ELSE ln(greatest(1 + g * x, 1e-6)) / g END AS a, CASE WHEN g = 0 THEN -x ELSE ln(greatest(1 - g * x, 1e-6)) / g END AS b FROM x) SELECT event_id, {R6.format('1 / (1 + exp(-least(greatest(CASE WHEN g = 0 THEN x ELSE a - b END, -700), 700)))')} AS p FROM l")
def deformed_sigmoid(spark, d):
    x, g = F.col("value") / 50 - 1, ((F.col("event_id") % 9) - 4) / 10.0
    return T.read(spark, d, "events").select("event_id", r6(numeric.deformed_sigmoid(x, g)).alias("p"))


@query("combinadic_rank", "WITH c AS (SELECT DISTINCT l_linenumber AS n FROM lineitem), t AS (SELECT a.n AS i, b.n AS j, c.n AS k FROM c a JOIN c b ON a.n < b.n JOIN c ON b.n < c.n) SELECT i, j, k, CAST(1 + (i - 1) + (j - 1) * (j - 2) // 2 + (k - 1) * (k - 2) * (k - 3) // 6 AS BIGINT) AS rank FROM t")
def combinadic_rank(spark, d):
    """Triplets of the distinct values, from their one sorted list: each value takes those behind it along."""
    behind = lambda xs, x: F.filter(xs, lambda y: y > x)
    one = T.read(spark, d, "lineitem").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    two = one.select(F.explode("n").alias("i"), "n").select("i", F.explode(behind(F.col("n"), F.col("i"))).alias("j"), "n")
    t = two.select("i", "j", F.explode(behind(F.col("n"), F.col("j"))).alias("k"))
    return t.select("i", "j", "k", numeric.combination_rank([F.col("i"), F.col("j"), F.col("k")]).alias("rank"))


MODEL_SQL = f"""WITH raw AS (
  SELECT vec_id, label, unnest(range({T.ROIS})) AS roi, unnest(embedding[1:{T.ROIS}]) AS v FROM embeddings
), z AS (
  SELECT roi, label, {T.probit_sql('p')} AS z
  FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY v, vec_id) / CAST(count(*) OVER (PARTITION BY roi) + 1 AS DOUBLE) AS p FROM raw)
), tot AS (SELECT roi, count(*) AS n, var_samp(z) AS v FROM z GROUP BY roi), cls AS (SELECT roi, label, count(*) AS n, var_samp(z) AS v FROM z GROUP BY 1, 2)
SELECT CAST(t.roi AS INT) AS roi, {R6.format('(0.5 * ln(any_value(t.v)) - sum(c.n / CAST(t.n AS DOUBLE) * 0.5 * ln(c.v))) / ln(2)')} AS mi
FROM tot t JOIN cls c ON c.roi = t.roi WHERE c.n > 1 GROUP BY t.roi"""


def _by_class(spark, d):
    return T.read(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "label", F.posexplode(F.slice("embedding", 1, T.ROIS)).alias("roi", "v"))


@query("gcmi_model_cd", MODEL_SQL)
def gcmi_model_cd(spark, d):
    """Information between each dimension and the class, without bias terms (one variable: variances suffice)."""
    return multivariate.model_information(_by_class(spark, d)).withColumn("mi", r6(F.col("mi")))


MIXTURE_SQL = f"""WITH raw AS (
  SELECT vec_id, label, unnest(range({T.ROIS})) AS roi, CAST(unnest(embedding[1:{T.ROIS}]) AS DOUBLE) AS v FROM embeddings
), placed AS (
  SELECT *, {T.probit_sql('p')} AS z FROM (
    SELECT *, row_number() OVER (PARTITION BY roi, label ORDER BY v, vec_id) / CAST(count(*) OVER (PARTITION BY roi, label) + 1 AS DOUBLE) AS p, median(v) OVER (PARTITION BY roi, label) AS med FROM raw)
), shapes AS MATERIALIZED (
  SELECT roi, label, n / sum(n) OVER (PARTITION BY roi) AS w, med + {multivariate.MAD_SCALE!r}::DOUBLE * mad * m AS mean, {multivariate.MAD_SCALE!r}::DOUBLE * mad * s AS sd
  FROM (SELECT roi, label, count(*) AS n, any_value(med) AS med, median(abs(v - med)) AS mad, avg(z) AS m, stddev_samp(z) AS s FROM placed GROUP BY 1, 2)
), points AS (SELECT roi, label, w, unnest([mean - sd, mean + sd]) AS x FROM shapes),
dens AS (
  SELECT p.roi, p.label, any_value(p.w) AS w, p.x, ln(sum(s.w * exp(-(((p.x - s.mean) / s.sd) ^ 2) / 2) / (s.sd * sqrt(2 * pi())))) AS l
  FROM points p JOIN shapes s ON s.roi = p.roi GROUP BY p.roi, p.label, p.x
), mixed AS (SELECT roi, -sum(w * l) / 2 AS h FROM dens GROUP BY 1), alone AS (SELECT roi, sum(w * (ln(sd) + 0.5 * ln(2 * pi() * exp(1)))) AS h FROM shapes GROUP BY 1)
SELECT CAST(roi AS INT) AS roi, {R6.format("(mixed.h - alone.h) / ln(2)")} AS mi FROM mixed JOIN alone USING (roi)"""


@query("mixture_mi", MIXTURE_SQL)
def mixture_mi(spark, d):
    return multivariate.mixture_of_shapes(multivariate.class_shapes(_by_class(spark, d))).withColumn("mi", r6(F.col("mi")))


def _spins(spark, d):
    return raster.spins(T.full(spark, d))


INTERVAL_SQL = f"""WITH {signals.BOOT}, v AS (SELECT win_id, i, j, k, {signals.GC} AS o FROM bt), q AS (
  SELECT CAST(win_id AS INT) AS win_id, i, j, k, quantile_cont(o, 0.025) AS low, quantile_cont(o, 0.975) AS high FROM v GROUP BY 1, 2, 3, 4)
SELECT win_id, i, j, k, {R6.format("low")} AS low, {R6.format("high")} AS high, NOT (low <= 0 AND high >= 0) AS significant FROM q"""


@query("boot_interval", INTERVAL_SQL)
def boot_interval(spark, d):
    """Percentile intervals of triplet interactions over block bootstrap replicates."""
    drawn = interaction.bootstrap_pairs(interaction.block_sums(T.scores(spark, d), 10), interaction.picks(spark, T.WINDOWS, T.WIDTH // 10, 100))
    out = interaction.percentile_interval(interaction.omega(drawn, T.WIDTH, by=["win_id", "rep"]), ["win_id", "i", "j", "k"], "omega")
    return out.withColumns({"low": r6(F.col("low")), "high": r6(F.col("high"))})


@query("block_importance")
def block_importance(spark, d):
    """Average precision lost when scores are dealt anew within sources."""
    preds = T.predictions(spark, d)
    shuffled = features.permuted_block(preds, ["p"], ["source"], "doc_id", 1)
    base = metrics.average_precision(preds).select(F.col("pr_auc").alias("base"))
    return base.crossJoin(metrics.average_precision(shuffled)).select(r6(F.col("base") - F.col("pr_auc")).alias("importance"))


@query("ising_fit")
def ising_fit(spark, d):
    return models.ising_fit(_spins(spark, d))


@query("ising_sparse")
def ising_sparse(spark, d):
    """Couplings with an elastic-net penalty: those that aren't needed are zero."""
    fit = models.sparse_fit(_spins(spark, d), 0.1)
    return fit.withColumns({"coupling": r6(F.col("coupling")), "field": r6(F.col("field"))})


@query("gibbs_surrogate")
def gibbs_surrogate(spark, d):
    return models.surrogates(models.ising_fit(_spins(spark, d)), T.WIDTH)


@query("coupling_summary")
def coupling_summary(spark, d):
    return models.coupling_summary(models.ising_fit(_spins(spark, d)))


@query("ising_choose_c")
def ising_choose_c(spark, d):
    """The C that the first three windows agree on in the median."""
    return models.choose_c(_spins(spark, d)).agg(F.median("c").alias("c"), F.count(F.lit(1)).alias("windows"))


@query("curved_fit")
def curved_fit(spark, d):
    return models.curved_fit(_spins(spark, d), models.GAMMAS)


def _kept(spark, df):
    """An iterative fit is written once, as several tables follow from it."""
    path = f"{streams.shared_folder(spark)}/fit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query("surrogate_qc")
def surrogate_qc(spark, d):
    spins = _spins(spark, d)
    drawn = models.curved_surrogates(spins, models.curved_fit(spins))
    return drawn.select("win_id", "gamma", "m_err", "c_rel_err", "accepted").distinct()


@query("gamma_select")
def gamma_select(spark, d):
    """Gamma of each window, from fits, checked surrogates, their differences and the shuffled differences."""
    spins = _spins(spark, d)
    grid = _kept(spark, models.curved_fit(spins))
    drawn = _kept(spark, models.curved_surrogates(spins, grid))
    quality = drawn.select("win_id", "gamma", "accepted").distinct()
    by = ["win_id", "gamma"]
    real = interaction.omega(copula.pair_correlations(T.scores(spark, d)), T.WIDTH).withColumnRenamed("omega", "real")
    null = interaction.omega(copula.pair_correlations(copula.normal_scores(drawn, [*by, "unit"]), by=by), T.WIDTH, by=by)
    medians = null.join(real, ["win_id", "i", "j", "k"]).groupBy(*by).agg(F.median(F.col("real") - F.col("omega")).alias("median"))
    iso = models.surrogates(models.ising_fit(spins), T.WIDTH)
    iso = interaction.omega(copula.pair_correlations(copula.normal_scores(iso, ["win_id", "unit"], ties="average")), T.WIDTH).withColumnRenamed("omega", "iso")
    rolled = interaction.shifted(T.scores(spark, d, "average").select("win_id", "unit", "t", "z"), 50, T.WIDTH, 10)
    rolled = interaction.omega(copula.pair_correlations(rolled, by=["win_id", "perm"]), T.WIDTH, by=["win_id", "perm"])
    baseline = rolled.join(iso, ["win_id", "i", "j", "k"]).groupBy("win_id").agg(F.percentile(F.col("omega") - F.col("iso"), F.lit(0.05)).alias("p05"))
    return models.select_gamma(grid, quality, medians, baseline)


DOC_FEATURES = ["n_chars", "n_words", "n_lines", "n_signs"]


def _document_features(spark, d):
    """``(doc_id, source, y, n_chars, n_words, n_lines, n_signs)`` of labelled documents."""
    words, lines = F.size(F.split("text", r"\s+")), F.size(F.split("text", r"\n"))
    docs = T.read(spark, d, "documents").select(
        "doc_id", "source", F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("n_words"), lines.cast("double").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[\p{L}\s]", "")).cast("double").alias("n_signs"),
    )
    return docs.join(T.read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")


@query("classifier_eval")
def classifier_eval(spark, d):
    """Held-out scores of a logistic regression and a random forest on document features, folds by source."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = _document_features(spark, d).withColumnRenamed("y", "label")
    share = rows.agg(F.avg("label")).first()[0]
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    test, names = F.crc32(F.col("source")) % 5 == 0, DOC_FEATURES
    head = [Imputer(inputCols=names, outputCols=names, strategy="median"), VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    out = None
    for name, last in (("logistic", LogisticRegression(weightCol="weight", regParam=0.01)), ("forest", RandomForestClassifier(weightCol="weight", numTrees=20, maxDepth=6, seed=1))):
        fitted = Pipeline(stages=[*head, last]).fit(rows.where(~test))
        scored = fitted.transform(rows.where(test)).select(F.col("label").cast("int").alias("y"), F.round(vector_to_array("probability")[1], 4).alias("p"))
        one = metrics.average_precision(scored).crossJoin(metrics.roc_auc(scored)).select(F.lit(name).alias("model"), "pr_auc", "roc_auc")
        out = one if out is None else out.unionByName(one)
    return out


def _choice(spark, d):
    rows = stored(_document_features(spark, d), "features")
    return rows, selection.Choice(rows, "source", DOC_FEATURES)


@query("nested_choice")
def nested_choice(spark, d):
    """Per outer fold of sources: the C chosen on validation sources, its threshold, and scores of the test sources."""
    return _choice(spark, d)[1].tested(spark)


@query("nested_coefficients")
def nested_coefficients(spark, d):
    return _choice(spark, d)[1].coefficients(spark)


@query("nested_nulls")
def nested_nulls(spark, d):
    """The trained models on features dealt anew within sources, and on features of which two are missing."""
    rows, choice = _choice(spark, d)
    dealt = features.permuted_block(rows, DOC_FEATURES, ["source"], "doc_id", 1)
    return choice.nulls({"permuted": dealt, "partial": rows.drop("n_lines", "n_signs")})


MANIFEST_SQL = f"""WITH RECURSIVE rowz AS (SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL
), sizes AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM rowz GROUP BY source
), deal(k, load, source, f) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range(least(5, (SELECT count(*) FROM sizes))), lambda x: CAST(0 AS BIGINT)), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) UNION ALL
  SELECT s.k, list_transform(d.load, lambda x, i: CASE WHEN i = d.low THEN x + s.n ELSE x END), s.source, d.low
  FROM (SELECT k, load, list_position(load, list_min(load)) AS low FROM deal) d JOIN sizes s ON s.k = d.k + 1
), outer_ AS MATERIALIZED (SELECT source, f - 1 AS fold FROM deal WHERE source IS NOT NULL),
rest AS MATERIALIZED (
  SELECT o.fold, s.source, s.n, row_number() OVER (PARTITION BY o.fold ORDER BY s.n DESC, s.source) AS k
  FROM (SELECT DISTINCT fold FROM outer_) o JOIN (SELECT sizes.*, fold AS own FROM sizes JOIN outer_ USING (source)) s ON s.own <> o.fold
), inner_(fold, k, load, source, f) AS (
  SELECT fold, CAST(0 AS BIGINT), list_transform(range(least(5, count(*))), lambda x: CAST(0 AS BIGINT)), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM rest GROUP BY fold UNION ALL
  SELECT d.fold, s.k, list_transform(d.load, lambda x, i: CASE WHEN i = d.low THEN x + s.n ELSE x END), s.source, d.low
  FROM (SELECT fold, k, load, list_position(load, list_min(load)) AS low FROM inner_) d JOIN rest s ON s.fold = d.fold AND s.k = d.k + 1
), roles AS (
  SELECT fold, source, CASE WHEN f = 1 THEN 'val' ELSE 'train' END AS role FROM inner_ WHERE source IS NOT NULL UNION ALL SELECT fold, source, 'test' FROM outer_)
SELECT CAST(fold AS INT) AS fold, role, doc_id FROM roles JOIN rowz USING (source)"""


@query("split_manifest", MANIFEST_SQL)
def split_manifest(spark, d):
    """Which documents train, validate and test in each outer fold; a source is never on two sides."""
    rows = T.read(spark, d, "documents").select("doc_id", "source").join(T.read(spark, d, "labels").where("quality IS NOT NULL").select("doc_id"), "doc_id")
    return rows.join(F.broadcast(selection.roles(rows, "source")), "source").select("fold", "role", "doc_id")


@query("stream_bins", "SELECT CAST(time_bucket(INTERVAL '6 hours', ts) AS TIMESTAMP) AS start, event_type, count(*) AS c FROM events GROUP BY 1, 2")
def stream_bins(spark, d):
    """Tumbling counts over the event stream, read to the end in one go; the whole result is kept (complete mode)."""
    source = spark.readStream.schema(T.read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    counted = streams.binned(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "6 hours", "1 hour").drop("end")
    return streams.run_available(counted, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))
