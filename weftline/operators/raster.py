"""Rasters of point events, overlapping windows, and their statistics.

Counts are sparse: a (unit, bin) without events has no row. Sums need the
nonzero cells only, with the number of bins known from the window; zeros are
filled in just where values are ranked or paired by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.numeric import spin
from weftline.operators.ranking import ranked


def quantized(seconds: Column) -> Column:
    """Seconds as whole milliseconds, halves to even."""
    return F.rint(seconds * 1000).cast("int")


def pooled_units(events: DataFrame, original: str = "orig_id") -> DataFrame:
    """``unit_id`` 0..N-1 in the order of the original ids; the distinct ids are ranked, by ranges, not the events."""
    ids = ranked(events.select(original).where(F.col(original).isNotNull()).distinct(), [], [F.col(original)], "unit_id")
    return events.join(ids.withColumn("unit_id", (F.col("unit_id") - 1).cast("int")), original)


def bin_of(t_ms: Column, bin_ms: float, n_bins: int) -> Column:
    return F.least(F.greatest(F.floor(t_ms / bin_ms), F.lit(0)), F.lit(n_bins - 1)).cast("int")


def counts(events: DataFrame, bin_ms: float, n_bins: int) -> DataFrame:
    """``(unit, bin, c)`` of events ``(unit, t_ms)``; partial sums combine before the shuffle."""
    return events.groupBy("unit", bin_of(F.col("t_ms"), bin_ms, n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))


def window_starts(n_bins: int, width: int, step: int) -> list[int]:
    """First bins of the full windows only."""
    width, step = max(1, width), max(1, step)
    return list(range(0, n_bins - width + 1, step))


def windows(spark, n_bins: int, width: int, step: int, bin_ms: float) -> DataFrame:
    """``(win_id, start_bin, end_bin, start_s, end_s)``, half-open."""
    n = len(window_starts(n_bins, width, step))
    at = F.col("win_id") * max(1, step)
    return spark.range(n).select(F.col("id").cast("int").alias("win_id")).select(
        "win_id", at.alias("start_bin"), (at + width).alias("end_bin"), (at * bin_ms / 1000).alias("start_s"), ((at + width) * bin_ms / 1000).alias("end_s")
    )


def in_windows(cells: DataFrame, n_bins: int, width: int, step: int) -> DataFrame:
    """Each cell once for every window that has it, with ``t`` its bin in the window: no range join."""
    last = (n_bins - width) // step
    first = F.greatest(F.lit(0), F.ceil((F.col("bin") - (width - 1)) / step).cast("int"))
    until = F.least(F.lit(last), F.floor(F.col("bin") / step).cast("int"))
    spread = cells.where(first <= until).withColumn("win_id", F.explode(F.sequence(first, until)))
    return spread.withColumn("t", F.col("bin") - F.col("win_id") * step)


def dense(cells: DataFrame, spark, n_bins: int, width: int, step: int) -> DataFrame:
    """``(win_id, unit, t, c)`` with zeros for the units that occur anywhere."""
    n = len(window_starts(n_bins, width, step))
    units = cells.select("unit").where(F.col("unit").isNotNull()).distinct()
    grid = units.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("win_id"), "unit").select("win_id", "unit", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("t"))
    return grid.join(in_windows(cells, n_bins, width, step).select("win_id", "unit", "t", "c"), ["win_id", "unit", "t"], "left").fillna(0, ["c"])


def drift(cells: DataFrame, spark, n_bins: int, width: int, step: int, keep_pct: float = 15.0) -> DataFrame:
    """Population rates of both halves, their drift in percent, and whether the window is kept."""
    half = width // 2
    n = len(window_starts(n_bins, width, step))
    units = cells.agg(F.countDistinct("unit").alias("units"))
    sums = in_windows(cells, n_bins, width, step).groupBy("win_id").agg(
        F.sum(F.when(F.col("t") < half, F.col("c")).otherwise(0)).alias("s1"), F.sum(F.when(F.col("t") >= half, F.col("c")).otherwise(0)).alias("s2")
    )
    every = spark.range(n).select(F.col("id").cast("int").alias("win_id")).join(sums, "win_id", "left").fillna(0, ["s1", "s2"]).crossJoin(F.broadcast(units))
    r1, r2 = F.col("s1") / (F.col("units") * half), F.col("s2") / (F.col("units") * (width - half))
    out = every.select("win_id", r1.alias("fr1"), r2.alias("fr2"))
    pct = F.when(F.col("fr1") + F.col("fr2") > 0, F.abs(F.col("fr2") - F.col("fr1")) / ((F.col("fr1") + F.col("fr2")) / 2) * 100)
    return out.withColumn("drift_pct", pct).withColumn("keep", F.col("drift_pct").isNull() | (F.col("drift_pct") <= keep_pct))


def check_spec(bin_ms: float, window_s: float, overlap: float, width: int, n_windows: int) -> list[str]:
    """What of the recording specification a setting breaks; empty if nothing."""
    out = []
    if bin_ms != 10:
        out.append(f"bins must be 10 ms, not {bin_ms:g}")
    if window_s not in (1, 2):
        out.append(f"windows must be 1 or 2 s, not {window_s:g}")
    if overlap != 0.5:
        out.append(f"overlap must be 0.5, not {overlap:g}")
    if width < 100:
        out.append(f"a window needs 100 bins, not {width}")
    if n_windows < 20:
        out.append(f"20 windows are needed, not {n_windows}")
    return out


def spins(full: DataFrame) -> DataFrame:
    return full.select("win_id", "unit", "t", spin(F.col("c")).alias("s"))


def moments(full: DataFrame) -> DataFrame:
    """Means and covariances of spins from the active cells: ``(win_id, i, j, m_i, m_j, cov)``, i <= j.

    Only cells with events are paired by time; with p the active share,
    ``E s = 2p - 1`` and ``E s s' = 4 p12 - 2 p1 - 2 p2 + 1``.
    """
    base = full.groupBy("win_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c") > 0).cast("int")).alias("a"))
    active = full.where("c > 0").select("win_id", "unit", "t")
    x, y = active.select("win_id", "t", F.col("unit").alias("i")), active.select("win_id", "t", F.col("unit").alias("j"))
    both = x.join(y, ["win_id", "t"]).where("i <= j").groupBy("win_id", "i", "j").agg(F.count(F.lit(1)).alias("b"))
    left, right = base.select("win_id", F.col("unit").alias("i"), "n", F.col("a").alias("ai")), base.select("win_id", F.col("unit").alias("j"), F.col("a").alias("aj"))
    out = left.join(right, "win_id").where("i <= j").join(both, ["win_id", "i", "j"], "left").fillna(0, ["b"])
    mi, mj = 2 * F.col("ai") / F.col("n") - 1, 2 * F.col("aj") / F.col("n") - 1
    joint = 4 * F.col("b") / F.col("n") - 2 * F.col("ai") / F.col("n") - 2 * F.col("aj") / F.col("n") + 1
    return out.select("win_id", "i", "j", mi.alias("m_i"), mj.alias("m_j"), (joint - mi * mj).alias("cov"))
