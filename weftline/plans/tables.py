"""The analytics domain on the star-schema tables, in Spark and as SQL.

units: ``user_id % 8``; bins: hours since 2024-01-01, 720 of them; windows: 100
bins every 50. Series: the first eight embedding dimensions over ``vec_id``.
Predictions: labelled documents with a score from text length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.numeric import exact_moments_sql, probit_sql
from weftline.operators import copula, raster

UNITS, BINS, WIDTH, STEP, BIN_MS = 8, 720, 100, 50, 3_600_000
WINDOWS = len(raster.window_starts(BINS, WIDTH, STEP))
ROIS = 8


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir: str) -> DataFrame:
    """``(unit, t_ms, event_type)``; only the needed columns reach the scan."""
    rows = read(spark, sf_dir, "events").where("ts IS NOT NULL AND user_id IS NOT NULL")
    since = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return rows.select((F.col("user_id") % UNITS).cast("int").alias("unit"), since.alias("t_ms"), "event_type")


def cells(spark, sf_dir: str) -> DataFrame:
    return raster.counts(events(spark, sf_dir), BIN_MS, BINS)


def full(spark, sf_dir: str) -> DataFrame:
    return raster.dense(cells(spark, sf_dir), spark, BINS, WIDTH, STEP)


def scores(spark, sf_dir: str, ties: str = "ordinal") -> DataFrame:
    return copula.normal_scores(full(spark, sf_dir), ["win_id", "unit"], ties=ties)


def series(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("t"), F.posexplode(F.slice("embedding", 1, ROIS)).alias("roi", "v")).select("roi", "t", F.col("v").cast("double").alias("v"))


def predictions(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, source, y, p)``: labelled documents and a logistic score of their length, in steps of 0.01."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    p = F.floor(100 / (1 + F.exp(-(F.log1p(F.col("n_chars").cast("double")) - 7.0)))) / 100
    return labels.join(docs, "doc_id").select("doc_id", "source", F.col("quality").alias("y"), p.alias("p"))


EVENTS = f"""ev AS (
  SELECT CAST(user_id % {UNITS} AS INT) AS unit, date_diff('millisecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS t_ms, event_type
  FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)"""
CELLS = EVENTS + f""", cells AS (
  SELECT unit, CAST(least(greatest(floor(t_ms / CAST({BIN_MS} AS DOUBLE)), 0), {BINS - 1}) AS INT) AS bin, count(*) AS c FROM ev GROUP BY 1, 2)"""
FULL = CELLS + f""", grid AS (
  SELECT w.i AS win_id, u.unit, t.i AS t FROM range({WINDOWS}) w(i), (SELECT DISTINCT unit FROM cells) u, range({WIDTH}) t(i)), dense AS (
  SELECT CAST(g.win_id AS INT) AS win_id, g.unit, CAST(g.t AS INT) AS t, coalesce(c.c, 0) AS c FROM grid g LEFT JOIN cells c ON c.unit = g.unit AND c.bin = g.win_id * {STEP} + g.t)"""
ORDINAL = FULL + f""", scores AS (
  SELECT win_id, unit, t, c, {probit_sql("p")} AS z FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY win_id, unit ORDER BY c, t) AS DOUBLE) / {WIDTH + 1} AS p FROM dense))"""
MIDRANK = FULL + f""", scores AS (
  SELECT win_id, unit, t, c, {probit_sql("p")} AS z FROM (
    SELECT *, (rank() OVER (PARTITION BY win_id, unit ORDER BY c) + (count(*) OVER (PARTITION BY win_id, unit, c) - 1) / 2) / {WIDTH + 1} AS p FROM dense))"""
PAIRS = """, pairs AS (
  SELECT x.win_id, x.unit AS i, y.unit AS j, count(*) AS n, corr(x.z, y.z) AS r
  FROM scores x JOIN scores y ON x.win_id = y.win_id AND x.t = y.t AND x.unit < y.unit GROUP BY 1, 2, 3)"""
TRIPLETS = """, triplets AS (
  SELECT p.win_id, p.i, p.j, q.j AS k, p.r AS a, q.r AS b, s.r AS c
  FROM pairs p JOIN pairs q ON p.win_id = q.win_id AND p.i = q.i AND p.j < q.j JOIN pairs s ON s.win_id = p.win_id AND s.i = p.j AND s.j = q.j)"""
CORE = "(0.5 * ln((1 + 2*a*b*c - a*a - b*b - c*c) / ((1 - a*a) * (1 - b*b) * (1 - c*c))))"
SERIES = f"""raw AS (
  SELECT vec_id AS t, unnest(range({ROIS})) AS roi, unnest(embedding[1:{ROIS}]) AS v FROM embeddings), std AS (
  SELECT CAST(roi AS INT) AS roi, t, (CAST(v AS DOUBLE) - avg(CAST(v AS DOUBLE)) OVER (PARTITION BY roi)) / stddev_pop(CAST(v AS DOUBLE)) OVER (PARTITION BY roi) AS v FROM raw)"""
EDGES = SERIES + """, ep AS (
  SELECT x.t, x.roi AS i, y.roi AS j, x.v AS vi, y.v AS vj, x.v * y.v AS p FROM std x JOIN std y ON x.t = y.t AND x.roi < y.roi), edges AS (
  SELECT t, i, j, z, CASE WHEN abs(sign(vi) + sign(vj)) = 2 THEN abs(z) ELSE -abs(z) END AS w FROM (
    SELECT *, (p - avg(p) OVER (PARTITION BY i, j)) / stddev_pop(p) OVER (PARTITION BY i, j) AS z FROM ep))"""
TRIANGLES = EDGES + """, tp AS (
  SELECT ep.t, ep.i, ep.j, s.roi AS k, vi, vj, s.v AS vk, ep.p * s.v AS p FROM ep JOIN std s ON s.t = ep.t AND s.roi > ep.j), tri AS (
  SELECT t, i, j, k, z, CASE WHEN abs(sign(vi) + sign(vj) + sign(vk)) = 3 THEN abs(z) ELSE -abs(z) END AS w FROM (
    SELECT *, (p - avg(p) OVER (PARTITION BY i, j, k)) / stddev_pop(p) OVER (PARTITION BY i, j, k) AS z FROM tp))"""
ADMITTED = TRIANGLES + """, adm AS (
  SELECT r.t, r.i, r.j, r.k, r.w, CAST((a.w < r.w) AS INT) + CAST((b.w < r.w) AS INT) + CAST((c.w < r.w) AS INT) AS missing
  FROM tri r JOIN edges a ON a.t = r.t AND a.i = r.i AND a.j = r.j JOIN edges b ON b.t = r.t AND b.i = r.i AND b.j = r.k JOIN edges c ON c.t = r.t AND c.i = r.j AND c.j = r.k)"""
ARRIVALS = ADMITTED + """, simp AS (
  SELECT t, 1 AS dim, i, j, -1 AS k, w, TRUE AS kept FROM edges UNION ALL SELECT t, 2, i, j, k, w, missing = 0 FROM adm), ord AS (
  SELECT *, lag(w) OVER o AS last, row_number() OVER o AS ord FROM simp WINDOW o AS (PARTITION BY t ORDER BY w DESC, dim, i, j, k)), arr AS (
  SELECT *, sum(CASE WHEN kept AND (last IS NULL OR w <> last) THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY ord) AS arrival FROM ord)"""
#: One more column of a boundary matrix over Z2 a step, in each frame: a column is a number with a bit for each row,
#: and loses to the held columns of its own highest bit, from the highest row down.
_REDUCED = """{name}(t, c, held, v) AS (
  SELECT t, CAST(-1 AS BIGINT), list_transform(range({rows}), lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM (SELECT DISTINCT t FROM {columns})
  UNION ALL
  SELECT t, c, CASE WHEN v = 0 THEN held ELSE list_transform(held, lambda x, n: CASE WHEN n = 1 + CAST(floor(log2(v)) AS INT) THEN v ELSE x END) END, v FROM (
    SELECT r.t, m.c, r.held, list_reduce(list_prepend(m.mask, list_reverse(r.held)), lambda a, b: CASE WHEN xor(a, b) < least(a, b) THEN xor(a, b) ELSE a END) AS v
    FROM {name} r JOIN {columns} m ON m.t = r.t AND m.c = r.c + 1))"""
REDUCED = ARRIVALS + """, eo AS MATERIALIZED (
  SELECT t, i, j, w, arrival, row_number() OVER (PARTITION BY t ORDER BY arrival, i, j) - 1 AS c, (1::BIGINT << i) | (1::BIGINT << j) AS mask FROM arr WHERE dim = 1), tord AS (
  SELECT t, i, j, k, w, arrival, row_number() OVER (PARTITION BY t ORDER BY arrival, i, j, k) - 1 AS c FROM arr WHERE dim = 2 AND kept), tri2 AS MATERIALIZED (
  SELECT r.t, r.c, r.w, r.arrival, (1::BIGINT << x.c) | (1::BIGINT << y.c) | (1::BIGINT << z.c) AS mask FROM tord r
  JOIN eo x ON x.t = r.t AND x.i = r.i AND x.j = r.j JOIN eo y ON y.t = r.t AND y.i = r.i AND y.j = r.k JOIN eo z ON z.t = r.t AND z.i = r.j AND z.j = r.k), """ + _REDUCED.format(
    name="ered", rows=ROIS, columns="eo") + ", " + _REDUCED.format(name="tred", rows=ROIS * (ROIS - 1) // 2, columns="tri2") + """, died AS MATERIALIZED (
  SELECT r.t, r.v, CAST(floor(log2(r.v)) AS BIGINT) AS c, x.w, x.arrival FROM tred r JOIN tri2 x ON x.t = r.t AND x.c = r.c WHERE r.v <> 0), born AS (
  SELECT e.t, e.c, e.w, e.arrival FROM eo e JOIN ered r ON r.t = e.t AND r.c = e.c WHERE r.v = 0), diagram AS MATERIALIZED (
  SELECT b.t, 1 AS dim, -b.w AS birth, coalesce(-d.w, 'infinity'::DOUBLE) AS death, CAST(b.arrival AS BIGINT) AS birth_arrival, CAST(coalesce(d.arrival, -1) AS BIGINT) AS death_arrival
  FROM born b LEFT JOIN died d ON d.t = b.t AND d.c = b.c WHERE d.c IS NULL OR d.arrival <> b.arrival)"""
#: ``TRIANGLES`` with means and deviations from exact sums: sums of doubles leave it to chance which of two equal weights comes
#: first, and to which side a weight is rounded. A constant has no score, and a vector has as many nodes as components.
EXACT_TRIANGLES = f"""raw AS (
  SELECT vec_id AS t, CAST(unnest(range(len(embedding[1:{ROIS}]))) AS INT) AS roi, CAST(unnest(embedding[1:{ROIS}]) AS DOUBLE) AS v FROM embeddings), based AS (
  SELECT roi, t, v - min(v) OVER (PARTITION BY roi) AS v FROM raw), {exact_moments_sql("sm", "based", "roi", "v")}, std AS (
  SELECT roi, t, (v - m) / nullif(s, 0) AS v FROM based JOIN sm USING (roi)), ep AS (
  SELECT x.t, x.roi AS i, y.roi AS j, x.v AS vi, y.v AS vj, x.v * y.v AS p FROM std x JOIN std y ON x.t = y.t AND x.roi < y.roi), {exact_moments_sql("em", "ep", "i, j", "p")}, edges AS (
  SELECT t, i, j, z, CASE WHEN abs(sign(vi) + sign(vj)) = 2 THEN abs(z) ELSE -abs(z) END AS w FROM (SELECT *, (p - m) / nullif(s, 0) AS z FROM ep JOIN em USING (i, j))), tp AS (
  SELECT ep.t, ep.i, ep.j, s.roi AS k, vi, vj, s.v AS vk, ep.p * s.v AS p FROM ep JOIN std s ON s.t = ep.t AND s.roi > ep.j), {exact_moments_sql("tm", "tp", "i, j, k", "p")}, tri AS (
  SELECT t, i, j, k, z, CASE WHEN abs(sign(vi) + sign(vj) + sign(vk)) = 3 THEN abs(z) ELSE -abs(z) END AS w FROM (SELECT *, (p - m) / nullif(s, 0) AS z FROM tp JOIN tm USING (i, j, k)))"""
EXACT_REDUCED = EXACT_TRIANGLES + REDUCED.removeprefix(TRIANGLES)
PREDICTIONS = """preds AS (
  SELECT l.doc_id, d.source, l.quality AS y, floor(100 / (1 + exp(-(ln(1 + CAST(d.n_chars AS DOUBLE)) - 7.0)))) / 100 AS p FROM labels l JOIN documents d USING (doc_id))"""
