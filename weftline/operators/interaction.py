"""O-information of triplets and larger groups, nulls and significance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numeric import digamma


def bias_correction(n: int) -> float:
    """What small-sample bias takes from a triplet's O-information (nats), for ``n`` samples."""
    p1, p2, p3 = (digamma((n - i) / 2) / 2 for i in (1, 2, 3))
    return p1 - 2 * p2 + p3


def triplet_core(a: Column, b: Column, c: Column) -> Column:
    """O-information (nats, no bias term) of three standard normals from their correlations; null if singular."""
    det = 1 + 2 * a * b * c - a * a - b * b - c * c
    pairs = (1 - a * a) * (1 - b * b) * (1 - c * c)
    ok = (det > 1e-12) & (pairs > 1e-12)
    return F.when(ok, 0.5 * F.log(F.when(ok, det / F.when(ok, pairs))))


def triplets(pairs: DataFrame, by: list[str] | None = None, r: str = "r") -> DataFrame:
    """``(by.., i, j, k, a, b, c)``: all i < j < k from the pair table, by equi-joins on shared members."""
    by = by or ["win_id"]
    ij = pairs.select(*by, "i", "j", F.col(r).alias("a"))
    ik = pairs.select(*by, "i", F.col("j").alias("k"), F.col(r).alias("b"))
    jk = pairs.select(*by, F.col("i").alias("j"), F.col("j").alias("k"), F.col(r).alias("c"))
    return ij.join(ik, [*by, "i"]).where("j < k").join(jk, [*by, "j", "k"])


def omega(pairs: DataFrame, n: int, estimator: str = "gcmi", by: list[str] | None = None) -> DataFrame:
    """Triplet O-information per window: ``gcmi`` in bits with bias correction, ``lin_est`` in nats."""
    by = by or ["win_id"]
    core = triplet_core(F.col("a"), F.col("b"), F.col("c"))
    if estimator == "gcmi":
        value = (core - F.lit(bias_correction(n))) / math.log(2)
    elif estimator == "lin_est":
        value = core + F.lit(1.5 * math.log((n - 1) / n))
    else:
        raise ValueError(f"estimator must be gcmi or lin_est, not {estimator}")
    return triplets(pairs, by).select(*by, "i", "j", "k", value.alias("omega"))


def strongest(values: DataFrame, n: int, by: list[str] | None = None, value: str = "omega") -> DataFrame:
    """The ``n`` most positive and ``n`` most negative rows of each group, with their rank; never padding."""
    by = by or ["win_id"]
    sign = F.when(F.col(value) > 0, 1).when(F.col(value) < 0, -1)
    signed = values.withColumn("sign", sign).where("sign IS NOT NULL")
    order = Window.partitionBy(*by, "sign").orderBy(F.desc(F.abs(F.col(value))), "i", "j", "k")
    return signed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def block_sums(scores: DataFrame, block: int) -> DataFrame:
    """Sufficient statistics of each pair in each block of time: what a bootstrap needs of the data."""
    x = scores.select("win_id", "t", F.col("unit").alias("i"), F.col("z").alias("x"))
    y = scores.select("win_id", "t", F.col("unit").alias("j"), F.col("z").alias("y"))
    both = x.join(y, ["win_id", "t"]).where("i < j").withColumn("block", F.floor(F.col("t") / block).cast("int"))
    return both.groupBy("win_id", "i", "j", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy")
    )


def picks(spark, windows: int, blocks: int, reps: int) -> DataFrame:
    """``(win_id, rep, block, times)``: which blocks each replicate draws, with replacement.

    Draw d of replicate b in window w takes block ``(7919 w + 104729 b + 1299709 d + b d d) mod 2147483647 mod blocks``,
    so every engine and every partitioning draws the same.
    """
    draw = (F.col("w") * 7919 + F.col("b") * 104729 + F.col("d") * 1299709 + F.col("b") * F.col("d") * F.col("d")) % 2147483647 % blocks
    grid = spark.range(windows * reps * blocks).select(
        F.floor(F.col("id") / (reps * blocks)).alias("w"), (F.floor(F.col("id") / blocks) % reps).alias("b"), (F.col("id") % blocks).alias("d")
    )
    return grid.select(F.col("w").cast("int").alias("win_id"), F.col("b").cast("int").alias("rep"), draw.cast("int").alias("block")).groupBy("win_id", "rep", "block").agg(F.count(F.lit(1)).alias("times"))


def bootstrap_pairs(sums: DataFrame, drawn: DataFrame) -> DataFrame:
    """``(win_id, rep, i, j, r)``: correlations of the resampled blocks, from weighted block sums."""
    w = F.col("times")
    total = sums.join(drawn, ["win_id", "block"]).groupBy("win_id", "rep", "i", "j").agg(
        *[F.sum(w * F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    n = F.col("n")
    cov, vx, vy = F.col("sxy") - F.col("sx") * F.col("sy") / n, F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    return total.select("win_id", "rep", "i", "j", F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(F.when((vx > 1e-12) & (vy > 1e-12), vx * vy))).alias("r"))


def shifted(full: DataFrame, perms: int, width: int, least: int) -> DataFrame:
    """``full`` once for each permutation, every unit rolled in time by its own amount of at least ``least`` bins.

    The amount is ``least + (31 win + 131 perm + 1009 unit + perm unit unit) mod (width - least)``.
    """
    if not 0 < least < width:
        raise ValueError(f"shifts of at least {least} bins don't fit windows of {width}")
    amount = least + (F.col("win_id") * 31 + F.col("perm") * 131 + F.col("unit") * 1009 + F.col("perm") * F.col("unit") * F.col("unit")) % (width - least)
    spread = full.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    return spread.withColumn("t", ((F.col("t") + amount) % width).cast("int"))


def permutation_p(observed: DataFrame, null: DataFrame, perms: int, value: str = "omega", same: float = 0.0) -> DataFrame:
    """``(1 + #{null >= observed}) / (perms + 1)``, upper tail, per triplet; values less than ``same`` apart are equal."""
    keys = ["win_id", "i", "j", "k"]
    joined = null.select(*keys, F.col(value).alias("_null")).join(observed.select(*keys, value), keys)
    return joined.groupBy(*keys).agg(F.first(value).alias(value), ((F.count_if(F.col("_null") >= F.col(value) - same) + 1) / (perms + 1)).alias("p"))


def benjamini_hochberg(values: DataFrame, by: list[str], q: float = 0.05, p: str = "p", order: list[str] | None = None) -> DataFrame:
    """``values`` with ``rank``, ``cutoff`` (the largest p with p <= q rank / m; null if none) and ``discovery``."""
    group = Window.partitionBy(*by)
    ranked = values.withColumn("rank", F.row_number().over(group.orderBy(p, *(order or [])))).withColumn("_m", F.count(F.lit(1)).over(group))
    passing = F.max(F.when(F.col(p) <= q * F.col("rank") / F.col("_m"), F.col(p))).over(group)
    return ranked.withColumn("cutoff", passing).withColumn("discovery", F.coalesce(F.col(p) <= F.col("cutoff"), F.lit(False))).drop("_m")


def thresholds(tested: DataFrame, by: list[str], value: str = "delta") -> DataFrame:
    """Per group: discoveries; ``tau``, the least of as many largest values; ``tau_mask``, the least accepted value."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value)))
    found = F.sum(F.col("discovery").cast("int")).over(Window.partitionBy(*by))
    marked = tested.withColumn("_place", place).withColumn("_found", found)
    return marked.groupBy(*by).agg(
        F.max("_found").alias("n_discoveries"), F.min(F.when(F.col("_place") <= F.col("_found"), F.col(value))).alias("tau"), F.min(F.when(F.col("discovery"), F.col(value))).alias("tau_mask")
    )


def top_groups(values: DataFrame, n: int) -> DataFrame:
    """The ``n`` most positive and ``n`` most negative groups of each window and size."""
    sign = F.when(F.col("omega") > 0, 1).when(F.col("omega") < 0, -1)
    order = Window.partitionBy("win_id", "size", "sign").orderBy(F.desc(F.abs("omega")), "members")
    return values.withColumn("sign", sign).where("sign IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def percentile_interval(replicates: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Exact percentile interval of bootstrap replicates, and whether it leaves out zero."""
    low, high = F.percentile(value, F.lit(alpha / 2)), F.percentile(value, F.lit(1 - alpha / 2))
    return replicates.groupBy(*by).agg(low.alias("low"), high.alias("high")).withColumn("significant", ~((F.col("low") <= 0) & (F.col("high") >= 0)))
