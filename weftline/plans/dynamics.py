"""Registered queries: dynamic interactions, conditional information, searches among groups."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from weftline.functions.numeric import digamma_sql, probit_sql
from weftline.functions.numeric import rounded as r6
from weftline.operators import copula, interaction, lagged, multivariate, raster, search

from weftline.sources.stored import stored

from . import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R6 = "round({}, 6) + 0.0"
N = T.WIDTH
#: Length of a moving block (50 ms in bins of 10 ms), and replicates.
BLOCK, REPS = 5, 100


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _left_of_two(vy: str, ya: str, yb: str, aa: str, bb: str, ab: str) -> str:
    return f"({vy} - ({ya} * {ya} * {bb} - 2 * {ya} * {yb} * {ab} + {yb} * {yb} * {aa}) / nullif({aa} * {bb} - {ab} * {ab}, 0))"


def _bits_sql(vy: str, rest: str, n: int, sources: int) -> str:
    return f"(0.5 * ln({vy} / nullif({rest}, 0)) / ln(2) - CAST({lagged.bias(n, sources)!r} AS DOUBLE))"


def _given_last_sql(by: str) -> str:
    """From ``now(by.., u, v, s)`` (all ordered pairs), ``led(by.., y, v, s)`` and ``sq(by.., y, yy)``: products with y0 taken out."""
    return f"""self AS MATERIALIZED (SELECT {by}, u AS y, s AS s00 FROM now WHERE u = v),
own AS MATERIALIZED (SELECT {by}, y, s AS sy0, yy, s00 FROM (SELECT * FROM led WHERE v = y) JOIN sq USING ({by}, y) JOIN self USING ({by}, y)),
last0 AS MATERIALIZED (SELECT {by}, y, v, s AS s0, sy0, yy, s00 FROM own JOIN (SELECT {by}, u AS y, v, s FROM now WHERE u <> v) USING ({by}, y)),
outr AS MATERIALIZED (SELECT {by}, y, v, s - s0 * sy0 / s00 AS c, yy - sy0 * sy0 / s00 AS vy FROM last0 JOIN led USING ({by}, y, v)),
half AS MATERIALIZED (SELECT {by}, y, u, v, s, s0 / s00 AS share FROM now JOIN (SELECT {by}, y, v AS u, s0, s00 FROM last0) USING ({by}, u)),
innr AS MATERIALIZED (SELECT {by}, y, u, v, s - share * s0 AS c FROM half JOIN last0 USING ({by}, y, v))"""


PAIRS_SQL = f"""WITH {T.MIDRANK}, now AS MATERIALIZED (
  SELECT a.win_id, a.unit AS u, b.unit AS v, sum(a.z * b.z) AS s FROM scores a JOIN scores b USING (win_id, t) WHERE a.t < {N - 1} GROUP BY 1, 2, 3
), led AS MATERIALIZED (
  SELECT a.win_id, a.unit AS y, b.unit AS v, sum(a.z * b.z) AS s FROM scores a JOIN scores b ON b.win_id = a.win_id AND b.t = a.t - 1 GROUP BY 1, 2, 3
), sq AS (SELECT win_id, unit AS y, sum(z * z) AS yy FROM scores WHERE t > 0 GROUP BY 1, 2), {_given_last_sql('win_id')}
SELECT ij.win_id, ij.y AS target, ij.u AS i, ij.v AS j, {R6.format(
    _bits_sql('a.vy', '(a.vy - a.c * a.c / nullif(ii.c, 0))', N - 1, 1) + ' + ' + _bits_sql('a.vy', '(a.vy - b.c * b.c / nullif(jj.c, 0))', N - 1, 1)
    + ' - ' + _bits_sql('a.vy', _left_of_two('a.vy', 'a.c', 'b.c', 'ii.c', 'jj.c', 'ij.c'), N - 1, 2))} AS domega
FROM innr ij JOIN innr ii ON ii.win_id = ij.win_id AND ii.y = ij.y AND ii.u = ij.u AND ii.v = ij.u JOIN innr jj ON jj.win_id = ij.win_id AND jj.y = ij.y AND jj.u = ij.v AND jj.v = ij.v
JOIN outr a ON a.win_id = ij.win_id AND a.y = ij.y AND a.v = ij.u JOIN outr b ON b.win_id = ij.win_id AND b.y = ij.y AND b.v = ij.v WHERE ij.u < ij.v"""


def _midrank(spark, d):
    return T.scores(spark, d, "average").select("win_id", "unit", "t", "z")


@query("domega", PAIRS_SQL)
def domega(spark, d):
    """Each unit from each pair of the others, one step ahead."""
    return lagged.dynamic(_midrank(spark, d), N).withColumn("domega", r6(F.col("domega")))


def _with_population(spark, d):
    """Scores of the units, and as the target those of the count of all events in each bin."""
    full = T.full(spark, d)
    whole = copula.normal_scores(full.groupBy("win_id", "t").agg(F.sum("c").alias("c")), ["win_id"], ties="average")
    whole = whole.select("win_id", F.lit(lagged.TARGET).alias("unit"), "t", "z")
    return copula.normal_scores(full, ["win_id", "unit"], ties="average").select("win_id", "unit", "t", "z").unionByName(whole)


_K = ("win_id", "rep", "y")


def _side(table: str, name: str, u: str, v: str | None = None) -> str:
    on = " AND ".join(f"{name}.{c} = ij.{c}" for c in _K)
    return f"JOIN {table} {name} ON {on} AND " + (f"{name}.u = {u} AND {name}.v = {v}" if v else f"{name}.v = {u}")


_TWO = [_bits_sql("a.vy", _left_of_two("a.vy", f"{x}.c", f"{y}.c", f"{x}{x}.c", f"{y}{y}.c", xy), N - 1, 2) for x, y, xy in (("a", "b", "ij.c"), ("a", "e", "ik.c"), ("b", "e", "jk.c"))]
_THREE = _bits_sql("a.vy", _left_of_two(
    "(a.vy - a.c * a.c / aa.c)", "(b.c - a.c * ij.c / aa.c)", "(e.c - a.c * ik.c / aa.c)", "(bb.c - ij.c * ij.c / aa.c)", "(ee.c - ik.c * ik.c / aa.c)", "(jk.c - ij.c * ik.c / aa.c)"), N - 1, 3)
MOVING_SQL = f"""WITH {T.MIDRANK}, whole AS (SELECT win_id, t, sum(c) AS c FROM dense GROUP BY 1, 2), every AS MATERIALIZED (
  SELECT win_id, unit, t, z FROM scores UNION ALL
  SELECT win_id, {lagged.TARGET}, t, {probit_sql("p")} FROM (SELECT win_id, t, (rank() OVER (PARTITION BY win_id ORDER BY c) + (count(*) OVER (PARTITION BY win_id, c) - 1) / 2) / {N + 1} AS p FROM whole)
), draws AS (
  SELECT w.i AS win_id, b.i AS rep, d.i AS d, ((w.i * 7919 + b.i * 104729 + d.i * 1299709 + b.i * d.i * d.i) % 2147483647) % {N - BLOCK + 1} AS start
  FROM range({T.WINDOWS}) w(i), range({REPS}) b(i), range({N // BLOCK}) d(i)
), chain AS MATERIALIZED (
  SELECT x.win_id, x.rep, x.d * {BLOCK} + o.i AS q, e.unit, e.z FROM draws x, range({BLOCK}) o(i) JOIN every e ON e.win_id = x.win_id AND e.t = x.start + o.i
), now AS MATERIALIZED (
  SELECT a.win_id, a.rep, a.unit AS u, b.unit AS v, sum(a.z * b.z) AS s FROM chain a JOIN chain b USING (win_id, rep, q) WHERE q < {N // BLOCK * BLOCK - 1} GROUP BY 1, 2, 3, 4
), led AS MATERIALIZED (
  SELECT a.win_id, a.rep, a.unit AS y, b.unit AS v, sum(a.z * b.z) AS s FROM chain a JOIN chain b ON b.win_id = a.win_id AND b.rep = a.rep AND b.q = a.q - 1 WHERE a.unit = {lagged.TARGET} GROUP BY 1, 2, 3, 4
), sq AS (SELECT win_id, rep, unit AS y, sum(z * z) AS yy FROM chain WHERE q > 0 AND unit = {lagged.TARGET} GROUP BY 1, 2, 3),
{_given_last_sql('win_id, rep')}, values_ AS (
  SELECT ij.win_id, ij.rep, ij.u AS i, ij.v AS j, ik.v AS k, {_TWO[0]} + {_TWO[1]} + {_TWO[2]} - 2 * {_THREE} AS o
  FROM innr ij {_side('innr', 'ik', 'ij.u', 'ik.v')} AND ik.v > ij.v {_side('innr', 'jk', 'ij.v', 'ik.v')}
  {_side('innr', 'aa', 'ij.u', 'ij.u')} {_side('innr', 'bb', 'ij.v', 'ij.v')} {_side('innr', 'ee', 'ik.v', 'ik.v')}
  {_side('outr', 'a', 'ij.u')} {_side('outr', 'b', 'ij.v')} {_side('outr', 'e', 'ik.v')} WHERE ij.u < ij.v)
SELECT CAST(win_id AS INT) AS win_id, i, j, k, {R6.format('avg(o)')} AS domega, {R6.format('stddev_samp(o)')} AS se FROM values_ GROUP BY 1, 2, 3, 4"""


@query("moving_domega", MOVING_SQL)
def moving_domega(spark, d):
    """What triplets of active units tell of the population's next count: mean and standard error over moving blocks."""
    drawn = lagged.draws(spark, T.WINDOWS, N, BLOCK, REPS)
    values = lagged.moving_blocks(_with_population(spark, d), drawn, N, BLOCK)
    silent = T.full(spark, d).groupBy("win_id", "unit").agg(F.sum("c").alias("n")).where("n = 0")
    out = lagged.without_silent(values, silent).groupBy("win_id", "i", "j", "k")
    return out.agg(r6(F.avg("domega")).alias("domega"), r6(F.stddev_samp("domega")).alias("se"))


SHORT, STRIDE = 6, 3
ACTIVE_SQL = f"""WITH {T.EVENTS}, cells AS (
  SELECT unit, CAST(least(greatest(floor(t_ms / CAST({T.BIN_MS} AS DOUBLE)), 0), {T.BINS - 1}) AS INT) AS bin FROM ev WHERE event_type = 'error' GROUP BY 1, 2
), act AS (SELECT DISTINCT w.i AS win_id, c.unit FROM range({(T.BINS - SHORT) // STRIDE + 1}) w(i) JOIN cells c ON c.bin >= w.i * {STRIDE} AND c.bin < w.i * {STRIDE} + {SHORT})
SELECT CAST(a.win_id AS INT) AS win_id, a.unit AS i, b.unit AS j, c.unit AS k FROM act a JOIN act b ON b.win_id = a.win_id AND b.unit > a.unit JOIN act c ON c.win_id = a.win_id AND c.unit > b.unit"""


@query("active_triplets", ACTIVE_SQL)
def active_triplets(spark, d):
    """Candidate triplets of six-hour windows of errors, without those that touch a silent unit."""
    cells = raster.counts(T.events(spark, d).where("event_type = 'error'"), T.BIN_MS, T.BINS)
    totals = raster.dense(cells, spark, T.BINS, SHORT, STRIDE).groupBy("win_id", "unit").agg(F.sum("c").alias("n"))
    unit = lambda name: totals.select("win_id", F.col("unit").alias(name))
    every = unit("i").join(unit("j"), "win_id").where("i < j").join(unit("k"), "win_id").where("j < k")
    return lagged.without_silent(every, totals.where("n = 0")).select("win_id", "i", "j", "k")


CMI_SQL = f"""WITH {T.ORDINAL}{T.PAIRS}{T.TRIPLETS}
SELECT win_id, i, j, k, {', '.join(f"{R6.format(f'-0.5 * ln(1 - ({x} - {y} * {z}) * ({x} - {y} * {z}) / ((1 - {y} * {y}) * (1 - {z} * {z}))) / ln(2) - CAST({lagged.bias(N, 1)!r} AS DOUBLE)')} AS {name}" for x, y, z, name in (("a", "b", "c", "ij"), ("b", "a", "c", "ik"), ("c", "a", "b", "jk")))}
FROM triplets"""


@query("triplet_cmi", CMI_SQL)
def triplet_cmi(spark, d):
    """Information between two units of a triplet given the third, from partial correlations."""
    rows = interaction.triplets(copula.pair_correlations(T.scores(spark, d)))
    x = {c: F.col(c) for c in "abc"}
    part = lambda r, s, t: F.try_divide((x[r] - x[s] * x[t]) * (x[r] - x[s] * x[t]), (1 - x[s] * x[s]) * (1 - x[t] * x[t]))
    value = lambda p: r6(-0.5 * F.log(F.when(p < 1, 1 - p)) / math.log(2) - lagged.bias(N, 1))
    return rows.select("win_id", "i", "j", "k", value(part("a", "b", "c")).alias("ij"), value(part("b", "a", "c")).alias("ik"), value(part("c", "a", "b")).alias("jk"))


_PSI = "(" + digamma_sql("((n - 2) / CAST(2 AS DOUBLE))") + " - " + digamma_sql("((n - 1) / CAST(2 AS DOUBLE))") + ") / 2 / ln(2)"
CLASS_SQL = f"""WITH raw AS (
  SELECT vec_id, label, unnest(range({T.ROIS})) AS dim, unnest(embedding[1:{T.ROIS}]) AS v FROM embeddings
), z AS MATERIALIZED (
  SELECT vec_id, label, dim, {probit_sql("p")} AS z
  FROM (SELECT *, row_number() OVER (PARTITION BY label, dim ORDER BY v, vec_id) / CAST(count(*) OVER (PARTITION BY label, dim) + 1 AS DOUBLE) AS p FROM raw)
), own AS (
  SELECT a.label, a.dim AS i, b.dim AS j, count(*) AS n, sum(a.z * b.z) AS sxy, sum(a.z * a.z) AS sxx, sum(b.z * b.z) AS syy
  FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY 1, 2, 3
), within AS (
  SELECT i, j, sum(n * (-0.5 * ln(1 - sxy * sxy / (sxx * syy)) / ln(2) + {_PSI})) / sum(n) AS cmi FROM own GROUP BY 1, 2
), pooled AS (
  SELECT i, j, -0.5 * ln(1 - r * r) / ln(2) + {_PSI} AS mi
  FROM (SELECT a.dim AS i, b.dim AS j, corr(a.z, b.z) AS r, count(*) AS n FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY 1, 2)
)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {R6.format("cmi")} AS cmi, {R6.format("mi")} AS mi FROM within JOIN pooled USING (i, j)"""


@query("class_cmi", CLASS_SQL)
def class_cmi(spark, d):
    """Information between dimensions given the class, and of the scores of all classes together."""
    rows = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "label", F.posexplode(F.slice("embedding", 1, T.ROIS)).alias("dim", "v"))
    out = multivariate.class_conditional(multivariate.class_products(multivariate.class_scores(rows)))
    return out.select("i", "j", r6(F.col("cmi")).alias("cmi"), r6(F.col("mi")).alias("mi"))


LARGEST, BEST = 5, 5


def _levels_sql(tag: str, pairs: str, by: str) -> str:
    """Determinants of all groups of up to ``LARGEST`` units: ``{tag}sets(by.., members, ld)``."""
    out = [f"""{tag}l0 AS MATERIALIZED (
  SELECT {by}, CAST([] AS INT[]) AS s, i AS a, j AS b, r AS p, 0.0::DOUBLE AS ld FROM {pairs} UNION ALL
  SELECT DISTINCT {by}, CAST([] AS INT[]), u, u, 1.0::DOUBLE, 0.0::DOUBLE FROM (SELECT {by}, i AS u FROM {pairs} UNION ALL SELECT {by}, j FROM {pairs}))"""]
    for k in range(1, LARGEST):
        last = f"{tag}l{k - 1}"
        out.append(f"""{tag}l{k} AS MATERIALIZED (
  SELECT {by}, list_append(s, c) AS s, a, b, p - pa * pb / pc AS p, ld + ln(pc) AS ld
  FROM (SELECT {by}, s, a AS c, b AS a, p AS pa FROM {last} WHERE a < b) JOIN (SELECT {by}, s, a AS c, b, p AS pb FROM {last} WHERE a < b) USING ({by}, s, c)
  JOIN (SELECT {by}, s, a AS c, p AS pc FROM {last} WHERE a = b) USING ({by}, s, c) JOIN {last} USING ({by}, s, a, b) WHERE a <= b)""")
    sets = " UNION ALL ".join(f"SELECT {by}, list_append(s, a) AS members, ld + ln(p) AS ld FROM {tag}l{k} WHERE a = b" for k in range(LARGEST))
    return ", ".join(out) + f", {tag}sets AS MATERIALIZED ({sets})"


def _groups_sql(tag: str, by: str) -> str:
    bias = " ".join(f"WHEN {k} THEN CAST({search.bias(k, N)!r} AS DOUBLE)" for k in range(3, LARGEST + 1))
    return f"""{tag}groups AS MATERIALIZED (
  SELECT {by}, members, len(members) AS size, ((len(members) - 2) * any_value(own) - sum(ld)) / (2 * ln(2)) + CASE len(members) {bias} END AS omega
  FROM (SELECT {by}, members, ld AS own, unnest(list_transform(members, lambda x: list_filter(members, lambda y: y <> x))) AS face FROM {tag}sets WHERE len(members) >= 3) f
  JOIN (SELECT {by}, members AS face, ld FROM {tag}sets) USING ({by}, face) GROUP BY {by}, members)"""


SEARCH_SQL = f"""WITH {T.ORDINAL}{T.PAIRS}, {_levels_sql('o', 'pairs', 'win_id')}, {_groups_sql('o', 'win_id')}, top AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY win_id, size, sign ORDER BY abs(omega) DESC, members) AS rank
    FROM (SELECT *, CASE WHEN omega > 0 THEN 1 WHEN omega < 0 THEN -1 END AS sign FROM ogroups) WHERE sign IS NOT NULL) WHERE rank <= {BEST}
), draws AS (
  SELECT w.i AS win_id, b.i AS rep, ((w.i * 7919 + b.i * 104729 + d.i * 1299709 + b.i * d.i * d.i) % 2147483647) % {N} AS t
  FROM range({T.WINDOWS}) w(i), range({REPS}) b(i), range({N}) d(i)
), drawn AS MATERIALIZED (
  SELECT x.win_id, w.rep, x.unit AS i, y.unit AS j, corr(x.z, y.z) AS r FROM draws w JOIN scores x ON x.win_id = w.win_id AND x.t = w.t
  JOIN scores y ON y.win_id = x.win_id AND y.t = x.t AND y.unit > x.unit GROUP BY 1, 2, 3, 4
), {_levels_sql('b', 'drawn', 'win_id, rep')}, {_groups_sql('b', 'win_id, rep')}, intervals AS (
  SELECT win_id, members, quantile_cont(g.omega, 0.025) AS low, quantile_cont(g.omega, 0.975) AS high FROM bgroups g JOIN top USING (win_id, members) GROUP BY 1, 2)
SELECT win_id, CAST(size AS INT) AS size, array_to_string(members, ' ') AS members, sign, CAST(rank AS INT) AS rank, {R6.format("omega")} AS omega,
  {R6.format("low")} AS low, {R6.format("high")} AS high, NOT (low <= 0 AND high >= 0) AS significant
FROM top LEFT JOIN intervals USING (win_id, members)"""


@query("omega_nplets", SEARCH_SQL)
def omega_nplets(spark, d):
    """Groups of three to five units: the strongest of each size and sign, with their bootstrap intervals."""
    scores = stored(T.scores(spark, d), "scores")
    out = search.strongest_groups(spark, scores, copula.pair_correlations(scores), N, T.WINDOWS, LARGEST, BEST, REPS)
    text = F.array_join(F.transform("members", lambda x: x.cast("string")), " ")
    return out.select("win_id", "size", text.alias("members"), "sign", "rank", *[r6(F.col(c)).alias(c) for c in ("omega", "low", "high")], "significant")
