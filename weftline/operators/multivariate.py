"""Information measures of several variables from covariance matrices.

Covariances are ordinary aggregates; only the determinants of small matrices
are numpy. Functions here take matrices, so any grouping can feed them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numeric import digamma, digamma_sql, probit_sql
from weftline.operators.ranking import ranked
from weftline.sources.stored import stored


def gaussian_entropy(cov: np.ndarray, n: int, bias: bool = True) -> float:
    """Entropy in bits of a Gaussian with this sample covariance; bias-corrected for ``n`` samples."""
    d = len(cov)
    h = np.linalg.slogdet(cov)[1] / 2 + d / 2 * math.log(2 * math.pi * math.e)
    if bias:
        h -= d / 2 * math.log(2 / (n - 1)) + sum(digamma((n - i) / 2) for i in range(1, d + 1)) / 2
    return h / math.log(2)


def _part(cov: np.ndarray, *groups: list[int]) -> np.ndarray:
    keep = [i for g in groups for i in g]
    return cov[np.ix_(keep, keep)]


def mutual_information(cov: np.ndarray, n: int, x: list[int], y: list[int], bias: bool = True) -> float:
    h = lambda *g: gaussian_entropy(_part(cov, *g), n, bias)
    return h(x) + h(y) - h(x, y)


def conditional_information(cov: np.ndarray, n: int, x: list[int], y: list[int], z: list[int], bias: bool = True) -> float:
    h = lambda *g: gaussian_entropy(_part(cov, *g), n, bias)
    return h(x, z) + h(y, z) - h(x, y, z) - h(z)


def o_information(cov: np.ndarray, n: int, bias: bool = True) -> float:
    """``(m - 2) H(X) + sum_j (H(X_j) - H(X without j))`` in bits."""
    m = len(cov)
    h = lambda g: gaussian_entropy(_part(cov, g), n, bias)
    return (m - 2) * h(list(range(m))) + sum(h([j]) - h([k for k in range(m) if k != j]) for j in range(m))


def linear_conditional(y: np.ndarray, x: np.ndarray, z: np.ndarray) -> float:
    """``ln`` ratio of residual covariances of y on z and on (x, z), in nats, without intercepts; halved."""

    def rest(a):
        r = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        c = np.atleast_2d(np.cov(r.T))
        return np.linalg.slogdet(c)[1]

    return 0.5 * (rest(z) - rest(np.column_stack([x, z])))


def class_information(x: np.ndarray, classes: np.ndarray, bias: bool = True) -> float:
    """Information (bits) between Gaussian columns and a discrete class: entropy less the weighted class entropies."""
    n = len(x)
    total = gaussian_entropy(np.atleast_2d(np.cov(x.T)), n, bias)
    parts = 0.0
    for c in np.unique(classes):
        own = x[classes == c]
        parts += len(own) / n * gaussian_entropy(np.atleast_2d(np.cov(own.T)), len(own), bias)
    return total - parts


def mixture_information(x: np.ndarray, classes: np.ndarray) -> float:
    """As ``class_information`` with the mixture's entropy by sigma points of the unscented transform, in bits."""
    d = x.shape[1]
    kinds = np.unique(classes)
    w = np.array([(classes == c).mean() for c in kinds])
    mean = [x[classes == c].mean(axis=0) for c in kinds]
    root = [np.linalg.cholesky(np.atleast_2d(np.cov(x[classes == c].T))) for c in kinds]
    own = np.array([np.log(np.diag(r)).sum() + d / 2 * math.log(2 * math.pi * math.e) for r in root])
    mixed = 0.0
    for k in range(len(kinds)):
        points = np.concatenate([mean[k] + math.sqrt(d) * root[k].T, mean[k] - math.sqrt(d) * root[k].T])
        logs = []
        for q in range(len(kinds)):
            z = np.linalg.solve(root[q], (points - mean[q]).T)
            logs.append(math.log(w[q]) - (z * z).sum(axis=0) / 2 - np.log(np.diag(root[q])).sum() - d / 2 * math.log(2 * math.pi))
        top = np.max(logs, axis=0)
        mixed -= w[k] * float((top + np.log(np.exp(np.array(logs) - top).sum(axis=0))).mean())
    return float((mixed - (w * own).sum()) / math.log(2))


#: Fixed value: median absolute deviation to standard deviation of a normal.
MAD_SCALE = 1.482602218505602


def copula_mixture_information(x: np.ndarray, classes: np.ndarray) -> float:
    """Mixture information after each class is rank-normalised and put back to its median and scaled deviation."""
    from statistics import NormalDist

    out = np.zeros_like(x, dtype=float)
    inverse = NormalDist().inv_cdf
    for c in np.unique(classes):
        rows = np.flatnonzero(classes == c)
        for k in range(x.shape[1]):
            v = x[rows, k]
            rank = np.argsort(np.argsort(v, kind="stable"), kind="stable") + 1
            z = np.array([inverse(r / (len(v) + 1)) for r in rank])
            middle = np.median(v)
            out[rows, k] = z * MAD_SCALE * np.median(np.abs(v - middle)) + middle
    return mixture_information(out, classes)


def lagged_o_information(z: np.ndarray, target: int, sources: list[int], order: int) -> float:
    """``-(M-1) I(y; X | Y0) + sum_k I(y; X without k | Y0)`` in bits; X and Y0 are the last ``order`` samples of normal scores, centred on zero."""
    t = len(z)
    past = lambda k: [z[order - m : t - m, k] for m in range(1, order + 1)]
    rows = np.array([z[order:, target], *past(target), *(c for k in sources for c in past(k))])
    n = t - order
    cov = rows @ rows.T / (n - 1)
    own = list(range(1, 1 + order))
    where = {k: list(range(1 + order * (1 + i), 1 + order * (2 + i))) for i, k in enumerate(sources)}
    info = lambda ks: conditional_information(cov, n, [0], [c for k in ks for c in where[k]], own)
    return -(len(sources) - 1) * info(sources) + sum(info([k for k in sources if k != x]) for x in sources)


def class_scores(rows: DataFrame, cls: str = "label") -> DataFrame:
    """``(row, cls, dim, z)`` of ``(row, cls, dim, v)``: normal scores by rank within each class and dimension, ties by row."""
    own = Window.partitionBy(cls, "dim")
    p = F.row_number().over(own.orderBy("v", "row")) / (F.count(F.lit(1)).over(own) + 1)
    return rows.withColumn("_p", p).select("row", cls, "dim", F.expr(probit_sql("_p")).alias("z"))


def class_products(scores: DataFrame, cls: str = "label") -> DataFrame:
    """``(cls, i, j, n, sx, sy, sxx, syy, sxy)`` for all dimensions i <= j: what conditional information needs of the data."""
    x = scores.select("row", cls, F.col("dim").alias("i"), F.col("z").alias("x"))
    y = scores.select("row", F.col("dim").alias("j"), F.col("z").alias("y"))
    sums = [F.sum(F.expr(e)).alias(name) for name, e in (("sx", "x"), ("sy", "y"), ("sxx", "x * x"), ("syy", "y * y"), ("sxy", "x * y"))]
    return x.join(y, "row").where("i <= j").groupBy(cls, "i", "j").agg(F.count(F.lit(1)).alias("n"), *sums)


def class_conditional(products: DataFrame, cls: str = "label") -> DataFrame:
    """``(i, j, cmi, mi)`` in bits for dimensions i < j: information within classes, weighted by their sizes, and of all scores pooled.

    Scores are centred in each class, so products are about zero there; pooled ones are about their mean.
    """
    part = F.col("n") / F.sum("n").over(Window.partitionBy("i", "j"))
    psi = lambda k: F.expr(digamma_sql(f"((n - {k}) / CAST(2 AS DOUBLE))")) / 2
    gain = psi(2) - psi(1)
    bits = lambda r2: -0.5 * F.log(F.when(r2 < 1 - 1e-12, 1 - r2)) / math.log(2)
    pairs = products.where("i < j")
    own = pairs.select("i", "j", (part * (bits(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))) + F.when(F.col("n") > 2, gain) / math.log(2))).alias("cmi"))
    within = own.groupBy("i", "j").agg(F.sum("cmi").alias("cmi"))
    whole = pairs.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    cov, vx, vy = (F.expr(e) for e in ("sxy - sx * sy / n", "sxx - sx * sx / n", "syy - sy * sy / n"))
    return within.join(whole.select("i", "j", (bits(F.try_divide(cov * cov, vx * vy)) + gain / math.log(2)).alias("mi")), ["i", "j"])


def class_conditional_groups(products: DataFrame, x: list[int], y: list[int], cls: str = "label") -> DataFrame:
    """``(cmi)``: the same between two groups of dimensions; a class's matrix has as many rows as there are pairs of dimensions."""
    every = sorted({*x, *y})
    place = {d: k for k, d in enumerate(every)}

    def one(pdf):
        import pandas as pd

        m = np.zeros((len(every), len(every)))
        for r in pdf.itertuples():
            m[place[r.i], place[r.j]] = m[place[r.j], place[r.i]] = r.sxy
        n = int(pdf["n"].iloc[0])
        value = mutual_information(m / (n - 1), n, [place[d] for d in x], [place[d] for d in y])
        return pd.DataFrame({"n": [n], "mi": [value]})

    own = products.where(F.col("i").isin(every) & F.col("j").isin(every)).groupBy(cls).applyInPandas(one, "n long, mi double")
    return own.agg((F.sum(F.col("n") * F.col("mi")) / F.sum("n")).alias("cmi"))


def model_information(rows: DataFrame, dim: str = "roi", cls: str = "label") -> DataFrame:
    """``(dim, mi)`` in bits, without bias terms, between each dimension's normal scores and the class; rows ``(row, dim, cls, v)``.

    Ranks are taken by ranges, so no task holds a dimension. Classes of one row are left out.
    """
    placed = ranked(rows, [dim], [F.col("v"), F.col("row")])
    z = F.expr(probit_sql("_p"))
    whole = rows.groupBy(dim).agg(F.count(F.lit(1)).alias("_all"))
    scores = placed.join(whole, dim).withColumn("_p", F.col("rank") / (F.col("_all") + 1)).select(dim, cls, z.alias("z"))
    own = stored(scores.groupBy(dim, cls).agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("ss")), "moments")
    spread = lambda n, s, ss: (ss - s * s / n) / (n - 1)
    total = own.groupBy(dim).agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("ss").alias("tss")).where("tn > 1")
    total = total.select(dim, "tn", spread(F.col("tn"), F.col("ts"), F.col("tss")).alias("tv"))
    part = own.where("n > 1").join(total, dim).withColumn("h", F.col("n") / F.col("tn") * 0.5 * F.log(spread(F.col("n"), F.col("s"), F.col("ss"))))
    return part.groupBy(dim).agg(((0.5 * F.log(F.first("tv")) - F.sum("h")) / math.log(2)).alias("mi"))


def _middle(placed: DataFrame, sizes: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``(keys.., name)``: the exact median of ``value``, from its one or two middle ranks."""
    at = placed.join(sizes, keys).where((F.col("rank") == F.floor((F.col("n") + 1) / 2)) | (F.col("rank") == F.floor((F.col("n") + 2) / 2)))
    return at.groupBy(*keys).agg(F.avg(value).alias(name))


def class_shapes(rows: DataFrame, dim: str = "roi", cls: str = "label") -> DataFrame:
    """``(dim, cls, n, mean, sd)`` of each class's normal scores put back to its median and scaled median deviation.

    Medians are values at their ranks and ranks are taken by ranges, so a class of any size is spread over tasks.
    """
    keys = [dim, cls]
    sizes = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
    placed = stored(ranked(rows.select(*keys, "row", F.col("v").cast("double").alias("v")), keys, [F.col("v"), F.col("row")]), "placed")
    median = stored(_middle(placed, sizes, keys, "v", "median"), "medians")
    away = placed.join(median, keys).select(*keys, "row", F.abs(F.col("v") - F.col("median")).alias("a"))
    deviation = _middle(ranked(away, keys, [F.col("a"), F.col("row")]), sizes, keys, "a", "mad")
    z = placed.join(sizes, keys).withColumn("_p", F.col("rank") / (F.col("n") + 1)).select(*keys, F.expr(probit_sql("_p")).alias("z"))
    moments = z.groupBy(*keys).agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    width = F.col("mad") * MAD_SCALE
    return sizes.join(median, keys).join(deviation, keys).join(moments, keys).select(*keys, "n", (F.col("median") + width * F.col("m")).alias("mean"), (width * F.col("s")).alias("sd"))


def mixture_of_shapes(shapes: DataFrame, dim: str = "roi", cls: str = "label") -> DataFrame:
    """``(dim, mi)`` in bits: the mixture's entropy at the sigma points of each class (one deviation to both sides) less the classes' own.

    Null where a class has no spread.
    """
    whole = shapes.groupBy(dim).agg(F.sum("n").alias("_all"))
    own = stored(shapes.join(whole, dim).withColumn("w", F.col("n") / F.col("_all")).select(dim, cls, "w", "mean", F.when(F.col("sd") > 0, F.col("sd")).alias("sd")), "shapes")
    points = own.select(dim, F.col(cls).alias("k"), F.col("w").alias("wk"), F.explode(F.array(F.col("mean") - F.col("sd"), F.col("mean") + F.col("sd"))).alias("x"))
    part = points.join(own, dim).withColumn("l", F.log("w") - F.pow((F.col("x") - F.col("mean")) / F.col("sd"), 2) / 2 - F.log("sd") - 0.5 * math.log(2 * math.pi))
    top = part.groupBy(dim, "k", "wk", "x").agg(F.max("l").alias("top"), F.collect_list("l").alias("ls"))  # one value a class
    density = F.col("top") + F.log(F.aggregate("ls", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top"))))
    mixed = top.groupBy(dim).agg((-F.sum(F.col("wk") * density) / 2).alias("mixed"))
    alone = own.groupBy(dim).agg(F.sum(F.col("w") * (F.log("sd") + 0.5 * math.log(2 * math.pi * math.e))).alias("alone"), F.count_if(F.col("sd").isNull()).alias("flat"))
    return alone.join(mixed, dim, "left").select(dim, F.when(F.col("flat") == 0, (F.col("mixed") - F.col("alone")) / math.log(2)).alias("mi"))
