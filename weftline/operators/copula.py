"""Gaussian copula normalisation and pairwise correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numeric import probit_sql


def normal_scores(values: DataFrame, keys: list[str], value: str = "c", time: str = "t", ties: str = "ordinal") -> DataFrame:
    """``values`` with ``z``, the normal quantile of rank / (n + 1) within ``keys``.

    ``ordinal`` ranks equal values by time; ``average`` gives them their mean rank.
    """
    group = Window.partitionBy(*keys)
    if ties == "ordinal":
        rank = F.row_number().over(group.orderBy(value, time)).cast("double")
    elif ties == "average":
        rank = F.rank().over(group.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2
    else:
        raise ValueError(f"ties must be ordinal or average, not {ties}")
    ranked = values.withColumn("_rank", rank).withColumn("_n", F.count(F.lit(1)).over(group))
    return ranked.withColumn("_p", F.col("_rank") / (F.col("_n") + 1)).withColumn("z", F.expr(probit_sql("_p"))).drop("_rank", "_n", "_p")


def pair_correlations(scores: DataFrame, value: str = "z", by: list[str] | None = None) -> DataFrame:
    """``(by.., i, j, n, r)`` for i < j: one equi-join on window and time, then partial sums; r is null where a unit doesn't vary."""
    by = by or ["win_id"]
    x = scores.select(*by, "t", F.col("unit").alias("i"), F.col(value).alias("x"))
    y = scores.select(*by, "t", F.col("unit").alias("j"), F.col(value).alias("y"))
    r = F.try_divide(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y")))
    return x.join(y, [*by, "t"]).where("i < j").groupBy(*by, "i", "j").agg(F.count(F.lit(1)).alias("n"), r.alias("r"))
