"""Ranks of rows that are too many for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.stored import stored


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``, their places from 1 on within ``by`` in ``order``.

    Rows are dealt to ranges of (by, order); a place is that in its range on top of the rows of
    the ranges before, so no task holds a whole group. Columns of ``by`` must not be null.
    """
    placed = stored(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return placed.withColumn("_own", own).join(sizes, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
