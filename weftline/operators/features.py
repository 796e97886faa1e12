"""Feature assembly: joins, lags, missingness and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_present(df: DataFrame, names: list[str], alias: str) -> DataFrame:
    """``df`` with the first of ``names`` that it has as ``alias``; a null column if it has none."""
    found = next((n for n in names if n in df.columns), None)
    return df.withColumn(alias, F.col(f"`{found}`") if found else F.lit(None).cast("double"))


def left_features(base: DataFrame, block: DataFrame | None, on: str = "window_id", one_row: bool = False) -> DataFrame:
    """Left join of a feature block; its columns that ``base`` has are dropped; no block leaves ``base``."""
    if block is None:
        return base
    fresh = [c for c in block.columns if c == on or c not in base.columns]
    block = block.select(*fresh)
    return base.join(block.dropDuplicates([on]) if one_row else block, on, "left")


def lagged(df: DataFrame, columns: list[str], by: list[str], order: str, most: int = 2) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{c}_lag{n}": F.lag(c, n).over(w) for c in columns for n in range(1, most + 1)})


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    return df.withColumns({f"{c}_isna": gone(c).cast("int") for c in columns})


def horizon_labels(spans: DataFrame, onsets: DataFrame, horizon: float, key: str = "recording_id") -> DataFrame:
    """``spans(window_id, key, t1)`` with ``y``: whether an onset lies in ``[t1, t1 + horizon)``.

    Onsets are cut into buckets of one horizon, so a span looks into two
    buckets: an equi-join, pre-aggregated to a span before it is joined back.
    """
    bucket = lambda c: F.floor(F.col(c) / horizon)
    near = spans.select("window_id", key, "t1", F.explode(F.array(bucket("t1"), bucket("t1") + 1)).alias("_b"))
    at = onsets.select(key, "onset", bucket("onset").alias("_b")).distinct()
    hit = near.join(at, [key, "_b"]).where((F.col("onset") >= F.col("t1")) & (F.col("onset") < F.col("t1") + horizon)).select("window_id", F.lit(1).alias("y")).distinct()
    return spans.join(hit, "window_id", "left").fillna(0, ["y"])


def block_columns(columns: list[str], prefixes: dict[str, list[str]]) -> dict[str, list[str]]:
    """Columns of each block by their prefixes; a lag or flag column belongs to the block of its source."""
    return {name: [c for c in columns if any(c.startswith(p) for p in heads)] for name, heads in prefixes.items()}


def ablations(blocks: dict[str, list[str]], compat: bool = False, extra: list[str] | None = None) -> dict[str, list[str]]:
    """Cumulated blocks A0, A1, ... and ALL; ``compat`` adds ``extra`` (all lag and flag columns) to each."""
    out, held = {}, []
    for n, columns in enumerate(blocks.values()):
        held = held + [c for c in columns if c not in held]
        out[f"A{n}"] = held + [c for c in (extra or []) if compat and c not in held]
    return out | {"ALL": held + [c for c in (extra or []) if c not in held]}


def evenly_spaced(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """``k`` rows of each group at positions ``floor(i (n - 1) / (k - 1))``; all rows of a shorter group."""
    group = Window.partitionBy(*by)
    placed = df.withColumn("_i", F.row_number().over(group.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    # Row i is taken if some step lands on it: the first step at or after it is the only one that can.
    step = F.ceil(F.col("_i") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = (F.col("_n") <= k) | ((step <= k - 1) & (F.floor(step * (F.col("_n") - 1) / (k - 1)) == F.col("_i")))
    return placed.where(hit).drop("_i", "_n")


def permuted_block(df: DataFrame, columns: list[str], by: list[str], key: str, seed: int = 0) -> DataFrame:
    """``df`` with the rows of ``columns`` dealt anew within each group, together, in an order given by a hash of the key."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    dealt = df.select(*by, *columns, F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key)).alias("_n"))
    return rows.drop(*columns).join(dealt, [*by, "_n"]).drop("_n").select(*df.columns)
