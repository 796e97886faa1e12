"""Registered queries: rasters, windows, copula and interaction measures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from weftline.functions.numeric import digamma, rounded
from weftline.operators import copula, interaction, raster

from . import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
N = T.WIDTH


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


r6 = rounded
R6 = "round({}, 6) + 0.0"


@query("spike_raster", f"WITH {T.CELLS} SELECT unit, bin, c FROM cells")
def spike_raster(spark, d):
    return T.cells(spark, d)


@query("dense_raster", f"WITH {T.FULL} SELECT win_id, unit, t, c FROM dense")
def dense_raster(spark, d):
    return T.full(spark, d)


@query("windows_all", f"SELECT CAST(i AS INT) AS win_id, CAST(i * {T.STEP} AS INT) AS start_bin, CAST(i * {T.STEP} + {T.WIDTH} AS INT) AS end_bin, count(e.ts) AS n_events FROM range({T.WINDOWS}) w(i) LEFT JOIN events e ON e.user_id IS NOT NULL AND least(greatest(floor(date_diff('millisecond', TIMESTAMP '2024-01-01', e.ts) / CAST({T.BIN_MS} AS DOUBLE)), 0), {T.BINS - 1}) >= i * {T.STEP} AND least(greatest(floor(date_diff('millisecond', TIMESTAMP '2024-01-01', e.ts) / CAST({T.BIN_MS} AS DOUBLE)), 0), {T.BINS - 1}) < i * {T.STEP} + {T.WIDTH} GROUP BY 1, 2, 3")
def windows_all(spark, d):
    n = raster.in_windows(T.cells(spark, d), T.BINS, T.WIDTH, T.STEP).groupBy("win_id").agg(F.sum("c").alias("n_events"))
    spans = raster.windows(spark, T.BINS, T.WIDTH, T.STEP, T.BIN_MS).select("win_id", "start_bin", "end_bin")
    return spans.join(n, "win_id", "left").fillna(0, ["n_events"])


DRIFT = T.FULL + f""", halves AS (SELECT win_id, CAST(sum(CASE WHEN t < {N // 2} THEN c ELSE 0 END) AS DOUBLE) / (count(DISTINCT unit) * {N // 2}) AS fr1,
  CAST(sum(CASE WHEN t >= {N // 2} THEN c ELSE 0 END) AS DOUBLE) / (count(DISTINCT unit) * {N - N // 2}) AS fr2 FROM dense GROUP BY win_id), drift AS (
  SELECT *, CASE WHEN fr1 + fr2 > 0 THEN abs(fr2 - fr1) / ((fr1 + fr2) / 2) * 100 END AS drift_pct FROM halves)"""


def _drift(spark, d):
    return raster.drift(T.cells(spark, d), spark, T.BINS, T.WIDTH, T.STEP)


@query("window_drift", f"WITH {DRIFT} SELECT win_id, {R6.format('fr1')} AS fr1, {R6.format('fr2')} AS fr2, {R6.format('drift_pct')} AS drift_pct FROM drift")
def window_drift(spark, d):
    return _drift(spark, d).select("win_id", r6(F.col("fr1")).alias("fr1"), r6(F.col("fr2")).alias("fr2"), r6(F.col("drift_pct")).alias("drift_pct"))


@query("windows_kept", f"WITH {DRIFT} SELECT win_id FROM drift WHERE drift_pct IS NULL OR drift_pct <= 15")
def windows_kept(spark, d):
    return _drift(spark, d).where("keep").select("win_id")


@query("qc_summary", f"WITH {DRIFT} SELECT count(*) AS windows, count(*) FILTER (drift_pct IS NULL OR drift_pct <= 15) AS kept, {R6.format('median(drift_pct)')} AS median_drift FROM drift")
def qc_summary(spark, d):
    return _drift(spark, d).agg(F.count(F.lit(1)).alias("windows"), F.count_if("keep").alias("kept"), r6(F.median("drift_pct")).alias("median_drift"))


@query("spins", f"WITH {T.FULL} SELECT win_id, unit, t, CASE WHEN c > 0 THEN 1 ELSE -1 END AS s FROM dense")
def spins(spark, d):
    return raster.spins(T.full(spark, d))


@query("silent_units", f"WITH {T.FULL} SELECT win_id, unit FROM dense GROUP BY 1, 2 HAVING sum(c) = 0")
def silent_units(spark, d):
    return T.full(spark, d).groupBy("win_id", "unit").agg(F.sum("c").alias("n")).where("n = 0").select("win_id", "unit")


@query("moments", f"WITH {T.FULL}, sp AS (SELECT win_id, unit, t, CASE WHEN c > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM dense) SELECT x.win_id, x.unit AS i, y.unit AS j, {R6.format('avg(x.s)')} AS m_i, {R6.format('avg(y.s)')} AS m_j, {R6.format('avg(x.s * y.s) - avg(x.s) * avg(y.s)')} AS cov FROM sp x JOIN sp y ON x.win_id = y.win_id AND x.t = y.t AND x.unit <= y.unit GROUP BY 1, 2, 3")
def moments(spark, d):
    return raster.moments(T.full(spark, d)).select("win_id", "i", "j", *[r6(F.col(c)).alias(c) for c in ("m_i", "m_j", "cov")])


@query("copnorm_ordinal", f"WITH {T.ORDINAL} SELECT win_id, unit, t, {R6.format('z')} AS z FROM scores")
def copnorm_ordinal(spark, d):
    return T.scores(spark, d).select("win_id", "unit", "t", r6(F.col("z")).alias("z"))


@query("copnorm_midrank", f"WITH {T.MIDRANK} SELECT win_id, unit, t, {R6.format('z')} AS z FROM scores")
def copnorm_midrank(spark, d):
    return T.scores(spark, d, "average").select("win_id", "unit", "t", r6(F.col("z")).alias("z"))


def _pairs(spark, d):
    return copula.pair_correlations(T.scores(spark, d))


@query("pair_corr", f"WITH {T.ORDINAL}{T.PAIRS} SELECT win_id, i, j, n, {R6.format('r')} AS r FROM pairs")
def pair_corr(spark, d):
    return _pairs(spark, d).select("win_id", "i", "j", "n", r6(F.col("r")).alias("r"))



MI_BIAS = (2 * (math.log(2 / (N - 1)) + digamma((N - 1) / 2)) / 2 - (2 * math.log(2 / (N - 1)) + digamma((N - 1) / 2) + digamma((N - 2) / 2)) / 2) / math.log(2)


@query("gcmi_cc_pairs", f"WITH {T.ORDINAL}{T.PAIRS} SELECT win_id, i, j, {R6.format(f'-0.5 * ln(1 - r * r) / ln(2) - CAST({MI_BIAS!r} AS DOUBLE)')} AS mi FROM pairs")
def gcmi_cc_pairs(spark, d):
    mi = -0.5 * F.log(1 - F.col("r") * F.col("r")) / math.log(2) - F.lit(MI_BIAS)
    return _pairs(spark, d).select("win_id", "i", "j", r6(mi).alias("mi"))


GC = f"({T.CORE} + CAST({-interaction.bias_correction(N)!r} AS DOUBLE)) / ln(2)"
OMEGA = T.ORDINAL + T.PAIRS + T.TRIPLETS + f", om AS (SELECT win_id, i, j, k, {GC} AS omega FROM triplets)"


def _omega(spark, d, estimator="gcmi"):
    return interaction.omega(_pairs(spark, d), N, estimator)


@query("omega_gcmi", f"WITH {OMEGA} SELECT win_id, i, j, k, {R6.format('omega')} AS omega FROM om")
def omega_gcmi(spark, d):
    return _omega(spark, d).select("win_id", "i", "j", "k", r6(F.col("omega")).alias("omega"))


@query("omega_lin", f"WITH {T.ORDINAL}{T.PAIRS}{T.TRIPLETS} SELECT win_id, i, j, k, {R6.format(f'{T.CORE} + CAST({1.5 * math.log((N - 1) / N)!r} AS DOUBLE)')} AS omega FROM triplets")
def omega_lin(spark, d):
    return _omega(spark, d, "lin_est").select("win_id", "i", "j", "k", r6(F.col("omega")).alias("omega"))


@query("omega_topk", f"WITH {OMEGA}, s AS (SELECT *, CASE WHEN omega > 0 THEN 1 WHEN omega < 0 THEN -1 END AS sign FROM om), r AS (SELECT *, row_number() OVER (PARTITION BY win_id, sign ORDER BY abs(omega) DESC, i, j, k) AS rank FROM s WHERE sign IS NOT NULL) SELECT win_id, sign, CAST(rank AS INT) AS rank, i, j, k, {R6.format('omega')} AS omega FROM r WHERE rank <= 10")
def omega_topk(spark, d):
    return interaction.strongest(_omega(spark, d), 10).select("win_id", "sign", "rank", "i", "j", "k", r6(F.col("omega")).alias("omega"))


SURROGATE = T.FULL + f""", moved AS (SELECT win_id, unit, CAST((t + 10 + (win_id * 31 + unit * 1009) % {N - 10}) % {N} AS INT) AS t, c FROM dense), sscores AS (
  SELECT win_id, unit, t, {T.probit_sql("p")} AS z FROM (SELECT *, CAST(row_number() OVER (PARTITION BY win_id, unit ORDER BY c, t) AS DOUBLE) / {N + 1} AS p FROM moved)), spairs AS (
  SELECT x.win_id, x.unit AS i, y.unit AS j, corr(x.z, y.z) AS r FROM sscores x JOIN sscores y ON x.win_id = y.win_id AND x.t = y.t AND x.unit < y.unit GROUP BY 1, 2, 3), som AS (
  SELECT p.win_id, p.i, p.j, q.j AS k, {T.CORE.replace('a*', 'p.r*').replace('*a', '*p.r').replace('b*', 'q.r*').replace('*b', '*q.r').replace('c*', 's.r*').replace('*c', '*s.r')} AS core
  FROM spairs p JOIN spairs q ON p.win_id = q.win_id AND p.i = q.i AND p.j < q.j JOIN spairs s ON s.win_id = p.win_id AND s.i = p.j AND s.j = q.j)"""
DELTA = SURROGATE + OMEGA[len(T.FULL) :] + f", de AS (SELECT om.*, omega - (core + CAST({-interaction.bias_correction(N)!r} AS DOUBLE)) / ln(2) AS delta FROM om JOIN som USING (win_id, i, j, k))"


def _delta(spark, d):
    """Real against a shifted surrogate, joined on the triplet."""
    moved = interaction.shifted(T.full(spark, d), 1, N, 10).select("win_id", "unit", "t", "c")
    null = interaction.omega(copula.pair_correlations(copula.normal_scores(moved, ["win_id", "unit"])), N).withColumnRenamed("omega", "surrogate")
    return _omega(spark, d).join(null, ["win_id", "i", "j", "k"]).withColumn("delta", F.col("omega") - F.col("surrogate"))


@query("delta_omega", f"WITH {DELTA} SELECT win_id, i, j, k, {R6.format('omega')} AS omega, {R6.format('delta')} AS delta FROM de")
def delta_omega(spark, d):
    return _delta(spark, d).select("win_id", "i", "j", "k", r6(F.col("omega")).alias("omega"), r6(F.col("delta")).alias("delta"))


#: Replicates, permutations and false discovery rate that the method takes by default.
BLOCKS, REPS, PERMS, Q = N // 10, 100, 50, 0.1
#: Values that differ by less are equal: a roll of all units by one amount gives the observed value up to rounding.
SAME = 1e-9


def _boot_sql(scores: str, tag: str) -> str:
    return f"""{tag}pairs AS (
  SELECT w.win_id, w.rep, x.unit AS i, y.unit AS j, corr(x.z, y.z) AS r
  FROM draws w JOIN {scores} x ON x.win_id = w.win_id AND x.t // 10 = w.block JOIN {scores} y ON y.win_id = x.win_id AND y.t = x.t AND x.unit < y.unit
  GROUP BY 1, 2, 3, 4), {tag}t AS (
  SELECT p.win_id, p.rep, p.i, p.j, q.j AS k, p.r AS a, q.r AS b, s.r AS c
  FROM {tag}pairs p JOIN {tag}pairs q ON p.win_id = q.win_id AND p.rep = q.rep AND p.i = q.i AND p.j < q.j
  JOIN {tag}pairs s ON s.win_id = p.win_id AND s.rep = p.rep AND s.i = p.j AND s.j = q.j)"""


DRAWS = f"""draws AS (
  SELECT w.i AS win_id, b.i AS rep, ((w.i * 7919 + b.i * 104729 + d.i * 1299709 + b.i * d.i * d.i) % 2147483647) % {BLOCKS} AS block
  FROM range({T.WINDOWS}) w(i), range({REPS}) b(i), range({BLOCKS}) d(i))"""
BOOT = f"{T.ORDINAL}, {DRAWS}, {_boot_sql('scores', 'b')}"


def _bootstrapped(spark, scores):
    """``omega`` of each replicate; the same blocks are drawn for all scores of a window."""
    drawn = interaction.bootstrap_pairs(interaction.block_sums(scores, 10), interaction.picks(spark, T.WINDOWS, BLOCKS, REPS))
    return interaction.omega(drawn, N, by=["win_id", "rep"])


@query("block_boot_se", f"WITH {BOOT} SELECT CAST(win_id AS INT) AS win_id, i, j, k, {R6.format(f'stddev_samp({GC})')} AS se FROM bt GROUP BY 1, 2, 3, 4")
def block_boot_se(spark, d):
    return _bootstrapped(spark, T.scores(spark, d)).groupBy("win_id", "i", "j", "k").agg(r6(F.stddev_samp("omega")).alias("se"))


PSQL = OMEGA + f""", mv AS (SELECT d.win_id, p.i AS perm, d.unit, CAST((d.t + 10 + (d.win_id * 31 + p.i * 131 + d.unit * 1009 + p.i * d.unit * d.unit) % {N - 10}) % {N} AS INT) AS t, d.z FROM scores d, range({PERMS}) p(i)), np AS (
  SELECT x.win_id, x.perm, x.unit AS i, y.unit AS j, corr(x.z, y.z) AS r FROM mv x JOIN mv y ON x.win_id = y.win_id AND x.perm = y.perm AND x.t = y.t AND x.unit < y.unit GROUP BY 1, 2, 3, 4), nt AS (
  SELECT p.win_id, p.i, p.j, q.j AS k, p.r AS a, q.r AS b, s.r AS c FROM np p JOIN np q ON p.win_id = q.win_id AND p.perm = q.perm AND p.i = q.i AND p.j < q.j JOIN np s ON s.win_id = p.win_id AND s.perm = p.perm AND s.i = p.j AND s.j = q.j), nom AS (
  SELECT win_id, i, j, k, {GC} AS null_omega FROM nt), pv AS (
  SELECT win_id, i, j, k, any_value(omega) AS omega, (1 + count(*) FILTER (null_omega >= omega - {SAME})) / CAST({PERMS + 1} AS DOUBLE) AS p FROM nom JOIN om USING (win_id, i, j, k) GROUP BY 1, 2, 3, 4), bh AS (
  SELECT *, CAST(row_number() OVER o AS INT) AS rank, count(*) OVER (PARTITION BY win_id) AS m FROM pv WINDOW o AS (PARTITION BY win_id ORDER BY p, i, j, k)), cut AS (
  SELECT *, max(CASE WHEN p <= {Q} * rank / m THEN p END) OVER (PARTITION BY win_id) AS cutoff FROM bh)"""


def _tested(spark, d):
    """Scores are ranked once and rolled after: a roll keeps ranks, and ties keep their order."""
    z = T.scores(spark, d).select("win_id", "unit", "t", "z")
    null = interaction.omega(copula.pair_correlations(interaction.shifted(z, PERMS, N, 10), by=["win_id", "perm"]), N, by=["win_id", "perm"])
    return interaction.permutation_p(_omega(spark, d), null, PERMS, same=SAME)


@query("shift_null_pvalue", f"WITH {PSQL} SELECT win_id, i, j, k, {R6.format('omega')} AS omega, {R6.format('p')} AS p FROM pv")
def shift_null_pvalue(spark, d):
    return _tested(spark, d).select("win_id", "i", "j", "k", r6(F.col("omega")).alias("omega"), r6(F.col("p")).alias("p"))


def _fdr(spark, d):
    return interaction.benjamini_hochberg(_tested(spark, d), ["win_id"], q=Q, order=["i", "j", "k"])


@query("bh_fdr", f"WITH {PSQL} SELECT win_id, i, j, k, rank, {R6.format('p')} AS p, coalesce(p <= cutoff, FALSE) AS discovery FROM cut")
def bh_fdr(spark, d):
    return _fdr(spark, d).select("win_id", "i", "j", "k", "rank", r6(F.col("p")).alias("p"), "discovery")


# The p-values of delta are those of omega: both sides lose the same surrogate value. The threshold is one of delta.
TAU = f"""WITH {DELTA}, {PSQL[len(OMEGA) + 2 :]}, tt AS (
  SELECT cut.win_id, delta, coalesce(p <= cutoff, FALSE) AS hit, row_number() OVER (PARTITION BY cut.win_id ORDER BY delta DESC) AS place,
    sum(CAST(coalesce(p <= cutoff, FALSE) AS INT)) OVER (PARTITION BY cut.win_id) AS found
  FROM cut JOIN (SELECT win_id, i, j, k, delta FROM de) USING (win_id, i, j, k))
SELECT win_id, CAST(max(found) AS BIGINT) AS n_discoveries, {R6.format('min(CASE WHEN place <= found THEN delta END)')} AS tau, {R6.format('min(CASE WHEN hit THEN delta END)')} AS tau_mask
FROM tt GROUP BY 1"""


@query("fdr_tau", TAU)
def fdr_tau(spark, d):
    tested = _fdr(spark, d).join(_delta(spark, d).select("win_id", "i", "j", "k", "delta"), ["win_id", "i", "j", "k"])
    out = interaction.thresholds(tested, ["win_id"], "delta")
    return out.select("win_id", "n_discoveries", r6(F.col("tau")).alias("tau"), r6(F.col("tau_mask")).alias("tau_mask"))


DELTA_SE = f"""WITH {SURROGATE}, scores AS (
  SELECT win_id, unit, t, c, {T.probit_sql("p")} AS z
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY win_id, unit ORDER BY c, t) AS DOUBLE) / {N + 1} AS p FROM dense)), {DRAWS},
  {_boot_sql('scores', 'b')}, {_boot_sql('sscores', 'sb')}, bo AS (SELECT win_id, rep, i, j, k, {GC} AS o FROM bt), so AS (SELECT win_id, rep, i, j, k, {GC} AS o FROM sbt)
SELECT CAST(bo.win_id AS INT) AS win_id, i, j, k, {R6.format('stddev_samp(bo.o)')} AS se_omega, {R6.format('stddev_samp(bo.o - so.o)')} AS se_delta
FROM bo JOIN so USING (win_id, rep, i, j, k) GROUP BY 1, 2, 3, 4"""


@query("delta_omega_se", DELTA_SE)
def delta_omega_se(spark, d):
    """Standard errors over the same resampled blocks of the recording and its surrogate."""
    moved = interaction.shifted(T.full(spark, d), 1, N, 10).select("win_id", "unit", "t", "c")
    null = _bootstrapped(spark, copula.normal_scores(moved, ["win_id", "unit"])).withColumnRenamed("omega", "surrogate")
    both = _bootstrapped(spark, T.scores(spark, d)).join(null, ["win_id", "rep", "i", "j", "k"])
    return both.groupBy("win_id", "i", "j", "k").agg(r6(F.stddev_samp("omega")).alias("se_omega"), r6(F.stddev_samp(F.col("omega") - F.col("surrogate"))).alias("se_delta"))


