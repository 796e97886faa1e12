"""Persistence of complexes that are larger than a task should hold: chunk reduction.

The columns of a filtration are cut into blocks of consecutive ones. A column whose
pivot lies in its own block can only lose it to columns of that block, so each block is
reduced by itself, in a task of its own, and what gets a pivot there is final: local
pairs. The other columns keep only entries that can still be pivots. An entry that is the
death of a local pair is left out, as no pivot is ever one; an entry that is the birth
of a local pair is replaced by the rest of the column that kills it, which lies in
earlier blocks or is global. This is a join of entries with local pairs and a count of
what is left modulo 2, repeated at most once a block. What remains are global columns
with global entries, few beside the complex, and only these are reduced as a whole.

Everything is keyed by frame and block, so many frames and one large frame use the
cluster alike.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.stored import dropped, stored

#: Columns of a block.
BLOCK = 4096


def boundary(kept: DataFrame) -> DataFrame:
    """``(t, col, dim, rows, w, arrival)`` of a filtration ``(t, dim, i, j, k, w, arrival)`` of edges and triangles: nodes first, then by arrival.

    Faces are found by joins; a simplex whose faces are missing isn't in a filtration and is left out.
    """
    ends = kept.where("dim = 1").select("t", F.explode(F.array("i", "j")).alias("i")).distinct()
    none = F.lit(-1)
    nodes = ends.select("t", F.lit(0).alias("dim"), "i", none.alias("j"), none.alias("k"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("arrival"))
    every = nodes.unionByName(kept.select("t", "dim", "i", "j", "k", "w", F.col("arrival").cast("long").alias("arrival")))
    order = Window.partitionBy("t").orderBy("arrival", "dim", "i", "j", "k")
    placed = stored(every.withColumn("col", F.row_number().over(order).cast("long") - 1), "columns")
    node = placed.where("dim = 0").select("t", F.col("i").alias("a"), F.col("col").alias("f"))
    edge = placed.where("dim = 1").select("t", F.col("i").alias("a"), F.col("j").alias("b"), F.col("col").alias("f"))
    face = lambda df, names, to: df.withColumnsRenamed({**dict(zip(("a", "b"), names)), "f": to})
    edges = placed.where("dim = 1").join(face(node, ["i"], "f1"), ["t", "i"]).join(face(node, ["j"], "f2"), ["t", "j"])
    triangles = placed.where("dim = 2").join(face(edge, ["i", "j"], "f1"), ["t", "i", "j"]).join(face(edge, ["i", "k"], "f2"), ["t", "i", "k"]).join(face(edge, ["j", "k"], "f3"), ["t", "j", "k"])
    columns = ["t", "col", "dim", "rows", "w", "arrival"]
    out = placed.where("dim = 0").withColumn("rows", F.array().cast("array<bigint>")).select(*columns)
    out = out.unionByName(edges.withColumn("rows", F.array_sort(F.array("f1", "f2"))).select(*columns))
    return out.unionByName(triangles.withColumn("rows", F.array_sort(F.array("f1", "f2", "f3"))).select(*columns))


def reduce_block(columns: dict[int, tuple[int, list[int]]], start: int) -> tuple[dict[int, tuple[int, set[int]]], dict[int, set[int]]]:
    """``(local, rest)`` of a block's columns ``{col: (dim, rows)}`` from column ``start`` on.

    ``local`` has for each birth its death and the other entries of the column that kills it; ``rest`` the columns without a
    pivot in the block. Entries that local pairs decide within the block are gone from both.
    """
    local: dict[int, tuple[int, set[int]]] = {}
    held: dict[int, set[int]] = {}
    deaths: set[int] = set()
    rest: dict[int, set[int]] = {}
    for col in sorted(columns, key=lambda c: (-columns[c][0], c)):
        if col in local:
            continue
        work = set(columns[col][1])
        while work and (pivot := max(work)) >= start and pivot in held:
            work ^= held[pivot]
        if not work:
            continue
        if max(work) >= start:
            held[max(work)] = work
            local[max(work)] = (col, work)
            deaths.add(col)
        else:
            rest[col] = work

    def cleaned(work: set[int], pivot: int | None) -> set[int]:
        work, out = set(work), set()
        while work:
            row = max(work)
            if row != pivot and row in local:
                work ^= local[row][1]
                continue
            work.discard(row)
            if row < start or row not in deaths and row != pivot:
                out.add(row)
        return out

    return {b: (d, cleaned(work, b)) for b, (d, work) in local.items()}, {c: cleaned(work, None) for c, work in rest.items()}


def reduced(columns: list[int]) -> list[tuple[int, int]]:
    """``(pivot, column)`` of columns over Z2, from left to right; a column is a whole number with a bit for each row."""
    held: dict[int, int] = {}
    out = []
    for c, work in enumerate(columns):
        while work:
            pivot = work.bit_length() - 1
            if pivot not in held:
                held[pivot] = work
                out.append((pivot, c))
                break
            work ^= held[pivot]
    return out


def pairs(columns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(t, birth, death)``: the persistence pairs of boundary columns ``(t, col, dim, rows)`` in filtration order."""

    def local(key, table):
        t, number = key
        own = {c: (d, r) for c, d, r in zip(table["col"].to_pylist(), table["dim"].to_pylist(), table["rows"].to_pylist())}
        found, rest = reduce_block(own, number.as_py() * block)
        rows = [(b, d, sorted(work)) for b, (d, work) in found.items()] + [(None, c, sorted(work)) for c, work in rest.items() if work]
        return pa.Table.from_arrays(
            [pa.array([t.as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["t", "birth", "death", "rows"]
        )

    def last(key, table):
        cols, rows = table["col"].to_pylist(), table["rows"].to_pylist()
        order = sorted(range(len(cols)), key=cols.__getitem__)
        names = sorted({r for own in rows for r in own})
        bit = {r: 1 << n for n, r in enumerate(names)}
        found = reduced([sum(bit[r] for r in rows[i]) for i in order])
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array([names[p] for p, _ in found], pa.int64()), pa.array([cols[order[c]] for _, c in found], pa.int64())], names=["t", "birth", "death"]
        )

    blocks = columns.select(F.col("t").cast("long").alias("t"), "col", "dim", "rows", F.floor(F.col("col") / block).alias("block"))
    done = stored(blocks.groupBy("t", "block").applyInArrow(local, "t long, birth long, death long, rows array<long>"), "blocks")
    settled = done.where("birth IS NOT NULL")
    deaths, kills = settled.select("t", F.col("death").alias("row")), settled.select("t", F.col("birth").alias("row"), F.col("rows").alias("more"))
    entries = done.where("birth IS NULL").select("t", F.col("death").alias("col"), F.explode("rows").alias("row")).join(deaths, ["t", "row"], "left_anti").select("t", "col", "row")
    entries = stored(entries, "entries")
    while entries.join(kills, ["t", "row"], "left_semi").limit(1).count():
        met = entries.join(kills, ["t", "row"], "left").select("t", "col", F.explode(F.coalesce("more", F.array("row"))).alias("row"))
        odd = met.groupBy("t", "col", "row").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1").drop("odd")
        following = stored(odd.join(deaths, ["t", "row"], "left_anti").select("t", "col", "row"), "entries")
        dropped(entries)
        entries = following
    whole = entries.groupBy("t", "col").agg(F.collect_list("row").alias("rows"))
    return settled.select("t", "birth", "death").unionByName(whole.groupBy("t").applyInArrow(last, "t long, birth long, death long"))


def persistence(kept: DataFrame, dim: int = 1, block: int = BLOCK) -> DataFrame:
    """``(t, dim, birth, death, birth_arrival, death_arrival)``, as ``topology.persistence`` gives it, by chunk reduction."""
    columns = stored(boundary(kept), "boundary")
    found = stored(pairs(columns, block), "pairs")
    side = lambda name: columns.select("t", F.col("col").alias(name), F.col("w").alias(f"{name}_w"), F.col("arrival").alias(f"{name}_arrival"))
    born = columns.where(F.col("dim") == dim).select("t", F.col("col").alias("birth"), (-F.col("w")).alias("birth_w"), F.col("arrival").alias("birth_arrival"))
    born = born.join(found.select("t", F.col("death").alias("birth")), ["t", "birth"], "left_anti")
    ended = born.join(found, ["t", "birth"], "left").join(side("death"), ["t", "death"], "left")
    ended = ended.where(F.col("death").isNull() | (F.col("death_arrival") != F.col("birth_arrival")))
    endless = F.col("death").isNull()
    return ended.select(
        "t", F.lit(dim).alias("dim"), F.col("birth_w").alias("birth"), F.when(endless, float("inf")).otherwise(-F.col("death_w")).alias("death"),
        "birth_arrival", F.when(endless, -1).otherwise(F.col("death_arrival")).cast("long").alias("death_arrival"),
    )
