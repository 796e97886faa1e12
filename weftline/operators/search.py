"""Exhaustive search for interacting groups, from partial correlations joined level by level.

What is left of a pair (a, b) once a set S is known, ``p(S; a, b)``, gives the next level:
``p(S + c; a, b) = p(S; a, b) - p(S; a, c) p(S; b, c) / p(S; c, c)``, and the determinant of a set
is the product of what was left of each member given those before it. With members in order each set
is reached once, by equi-joins on the smaller set; no task holds the groups of a window. Only the
strongest groups are tested: the correlations of their members in resampled data come from the sums
of each time, weighted by how often it is drawn.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.numeric import digamma
from weftline.operators import interaction
from weftline.sources.stored import stored


def bias(size: int, n: int) -> float:
    """What small-sample bias adds to the O-information (bits) of ``size`` variables, from ``n`` samples."""
    psi = lambda k: sum(digamma((n - i) / 2) for i in range(1, k + 1)) / 2
    return (size * psi(size - 1) - (size - 2) * psi(size) - size * psi(1)) / math.log(2)


def determinants(pairs: DataFrame, largest: int, by: list[str]) -> DataFrame:
    """``(by.., members, logdet)`` of all groups of up to ``largest`` units of a correlation table ``(by.., i, j, r)``; null if singular."""
    units = pairs.select(*by, F.col("i").alias("a")).unionByName(pairs.select(*by, F.col("j").alias("a"))).distinct()
    own = units.select(*by, "a", F.col("a").alias("b"), F.lit(1.0).alias("p"))
    level = pairs.select(*by, F.col("i").alias("a"), F.col("j").alias("b"), F.col("r").alias("p")).unionByName(own)
    level = stored(level.select(*by, F.array().cast("array<int>").alias("s"), "a", "b", "p", F.lit(0.0).alias("logdet")), "level")
    log = lambda x: F.when(x > 1e-12, F.log(F.when(x > 1e-12, x)))
    sets = []
    for size in range(1, largest + 1):
        found = level.where("a = b")
        sets.append(found.select(*by, F.concat("s", F.array(F.col("a").cast("int"))).alias("members"), (F.col("logdet") + log(F.col("p"))).alias("logdet")))
        if size < largest:
            first = found.select(*by, "s", F.col("a").alias("c"), F.col("p").alias("pc"))
            side = lambda x, p: level.where("a < b").select(*by, "s", F.col("a").alias("c"), F.col("b").alias(x), F.col("p").alias(p))
            both = side("a", "pa").join(side("b", "pb"), [*by, "s", "c"]).where("a <= b").join(first, [*by, "s", "c"]).join(level, [*by, "s", "a", "b"])
            rest = F.col("p") - F.when(F.col("pc") > 1e-12, F.col("pa") * F.col("pb") / F.when(F.col("pc") > 1e-12, F.col("pc")))
            level = stored(both.select(*by, F.concat("s", F.array(F.col("c").cast("int"))).alias("s"), "a", "b", rest.alias("p"), (F.col("logdet") + log(F.col("pc"))).alias("logdet")), "level")
    return reduce(DataFrame.unionByName, sets)


def group_omega(sets: DataFrame, n: int, by: list[str]) -> DataFrame:
    """``(by.., size, members, omega)`` in bits of all groups of three or more, from the determinants of them and of their faces."""
    groups = sets.where("size(members) >= 3")
    faces = groups.select(*by, "members", F.col("logdet").alias("own"), F.explode(F.transform("members", lambda x: F.filter("members", lambda y: y != x))).alias("face"))
    joined = faces.join(sets.select(*by, F.col("members").alias("face"), "logdet"), [*by, "face"])
    # A null among the faces makes the whole null.
    total = joined.groupBy(*by, "members").agg(F.first("own").alias("own"), F.sum("logdet").alias("sum"), F.count("logdet").alias("k"))
    size = F.size("members")
    sizes = F.map_from_arrays(F.array(*[F.lit(k) for k in range(3, 17)]), F.array(*[F.lit(bias(k, n) if n > k else None).cast("double") for k in range(3, 17)]))
    value = ((size - 2) * F.col("own") - F.col("sum")) / (2 * math.log(2)) + F.element_at(sizes, size)
    return total.where(F.col("k") == size).select(*by, size.alias("size"), "members", value.alias("omega"))


def resampled_omega(best: DataFrame, drawn: DataFrame, n: int) -> DataFrame:
    """``(win_id, members, rep, omega)`` of the groups ``best(win_id, members)`` in every replicate of ``drawn(win_id, rep, i, j, r)``."""
    from itertools import combinations

    import numpy as np

    member = F.posexplode("members")
    a = best.select("win_id", "members", member.alias("x", "i"))
    b = best.select("win_id", "members", member.alias("y", "j"))
    wanted = a.join(b, ["win_id", "members"]).where("i < j")
    rows = wanted.join(drawn, ["win_id", "i", "j"]).groupBy("win_id", "members", "rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "r"))), lambda z: z["r"]).alias("r"))

    def omega(batches):
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            size = pdf["members"].map(len).to_numpy()
            for m in np.unique(size):
                at = np.flatnonzero(size == m)
                r = np.zeros((len(at), m, m))
                upper = np.triu_indices(m, 1)
                r[:, upper[0], upper[1]] = np.stack(pdf["r"].iloc[at].map(lambda x: np.array(x, float)).to_list())
                r += r.transpose(0, 2, 1) + np.eye(m)
                log = lambda keep: np.linalg.slogdet(r[np.ix_(range(len(at)), keep, keep)])[1]  # noqa: B023, E731
                out[at] = ((m - 2) * log(list(range(m))) - sum(log(list(k)) for k in combinations(range(m), m - 1))) / (2 * math.log(2)) + bias(int(m), n)
            yield pd.DataFrame({"win_id": pdf["win_id"], "members": pdf["members"], "rep": pdf["rep"], "omega": out})

    return rows.mapInPandas(omega, "win_id int, members array<int>, rep int, omega double").where(~F.isnan("omega"))


def strongest_groups(spark, scores: DataFrame, pairs: DataFrame, width: int, windows: int, largest: int = 5, best: int = 5, reps: int = 100) -> DataFrame:
    """``(win_id, size, members, omega, sign, rank, low, high, significant)``: the ``best`` groups of each size and sign.

    Percentile intervals are over ``reps`` samples of single times with replacement; a group is significant if its interval leaves out zero.
    """
    values = group_omega(stored(determinants(pairs, largest, ["win_id"]), "sets"), width, ["win_id"])
    top = stored(interaction.top_groups(values, best), "best")
    drawn = stored(interaction.bootstrap_pairs(interaction.block_sums(scores, 1), interaction.picks(spark, windows, width, reps)), "drawn")
    intervals = interaction.percentile_interval(resampled_omega(top.select("win_id", "members"), drawn, width), ["win_id", "members"], "omega")
    return top.join(intervals, ["win_id", "members"], "left")
