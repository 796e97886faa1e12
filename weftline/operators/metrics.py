"""Scores of probabilistic predictions ``(y 0/1, p)``, all as aggregates over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of [0, 1] that a running sum over all scores is cut in; scores outside belong to the first or last.
RANGES = 4096


def by_score(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per distinct score, from the highest: true and false positives so far, and the totals.

    Rows are first summed to distinct scores. Running sums are then taken within
    ranges of scores, each on top of the sums of the ranges above it, so no task
    gets all scores; only the few sums of ranges are ordered as a whole.
    """
    by = by or []
    sums = df.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    sums = sums.withColumn("_range", F.least(F.greatest(F.floor(F.col("p") * RANGES), F.lit(0)), F.lit(RANGES - 1)).cast("int"))
    whole, above = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.groupBy(*by, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    ranges = ranges.select(
        *by, "_range", F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_fp"),
        F.sum("_pos").over(whole).alias("all_pos"), F.sum("_neg").over(whole).alias("all_neg"),
    )
    same = F.col("s._range") == F.col("r._range")
    for c in by:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
    down = Window.partitionBy(*by, "_range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    both = sums.alias("s").join(ranges.alias("r"), same).select(*[F.col(f"s.{c}").alias(c) for c in (*by, "_range", "p", "pos", "neg")], "_tp", "_fp", "all_pos", "all_neg")
    return both.select(*by, "p", "pos", "neg", (F.col("_tp") + F.sum("pos").over(down)).alias("tp"), (F.col("_fp") + F.sum("neg").over(down)).alias("fp"), "all_pos", "all_neg")


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum over thresholds of recall gained times precision; null without positives."""
    gain = F.try_divide(F.col("pos"), F.col("all_pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    scored = by_score(df, by).withColumn("_g", gain)
    return scored.groupBy(*by).agg(F.sum("_g").alias("pr_auc")) if by else scored.agg(F.sum("_g").alias("pr_auc"))


def roc_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null with one class."""
    pairs = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    scored = by_score(df, by).withColumn("_g", pairs)
    value = F.try_divide(F.sum("_g"), F.max("all_pos") * F.max("all_neg")).alias("roc_auc")
    return scored.groupBy(*by).agg(value) if by else scored.agg(value)


def calibration_bins(df: DataFrame, bins: int = 10, top: str = "last") -> DataFrame:
    """``(bin, n, mean_y, mean_p)``; p = 1 is in the last bin, or with ``top='none'`` in no bin."""
    cut = F.floor(F.col("p") * bins).cast("int")
    rows = df.where("p < 1") if top == "none" else df
    return rows.groupBy(F.least(cut, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"), F.avg("p").alias("mean_p"))


def expected_calibration_error(df: DataFrame, bins: int = 10, top: str = "last") -> DataFrame:
    cells = calibration_bins(df, bins, top).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))))
    return cells.agg(F.sum(F.col("n") / F.col("_all") * F.abs(F.col("mean_y") - F.col("mean_p"))).alias("ece"))


def brier() -> Column:
    return F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))


def log_loss(floor: float = 1e-9) -> Column:
    p = F.least(F.greatest(F.col("p"), F.lit(floor)), F.lit(1 - floor))
    return F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))


def best_f1(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold (p at or above it) with the largest F1, the lowest of equals, and its precision and recall."""
    by = by or []
    at = by_score(df, by).withColumn("f1", F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")))
    at = at.select(*by, "p", "f1", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("all_pos")).alias("recall"))
    best = F.max_by(F.struct("p", "f1", "precision", "recall"), F.struct(F.round("f1", 12), -F.col("p"))).alias("b")
    return (at.groupBy(*by).agg(best) if by else at.agg(best)).select(*by, F.col("b.p").alias("threshold"), "b.f1", "b.precision", "b.recall")


#: Groups that may be dealt to folds, each of which is one row on the driver.
MAX_GROUPS = 1_000_000


def group_sizes(df: DataFrame, group: str) -> list[tuple]:
    """``(group, rows)``, largest first; an error beyond ``MAX_GROUPS``."""
    sizes = df.groupBy(group).count().orderBy(F.desc("count"), group).limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups to deal")
    return [(row[group], row["count"]) for row in sizes]


def dealt(sizes: list[tuple], folds: int) -> dict:
    """Fold of each group of ``(group, rows)``, in order: each to the lightest fold, the first of equals."""
    load, out = [0] * min(folds, max(1, len(sizes))), {}
    for group, rows in sizes:
        k = load.index(min(load))
        out[group] = k
        load[k] += rows
    return out


def group_folds(df: DataFrame, group: str, folds: int) -> dict:
    """Fold of each group: groups by size, largest first, each to the lightest fold; an error beyond ``MAX_GROUPS``."""
    return dealt(group_sizes(df, group), folds)


def contiguous_fold(index: Column, n: int, folds: int, remainder: str = "first") -> Column:
    """Fold of a position: contiguous ranges, the remainder to the first folds, or bounds at ``floor(k n / folds)``."""
    if remainder == "first":
        small, extra = divmod(n, folds)
        edge = extra * (small + 1)
        late = F.floor((index - edge) / max(small, 1)) + extra
        return F.when(index < edge, F.floor(index / (small + 1))).otherwise(late).cast("int")
    bounds = [k * n // folds for k in range(1, folds)]
    return sum(((index >= b).cast("int") for b in bounds), F.lit(0))
