"""Simplicial structure of multivariate time series, as joins, and persistence.

Frames are independent: every operator is keyed by the frame time ``t``, and
only the reduction of one frame's boundary matrix runs as a Python function of
that frame's simplices (C(n, 3) rows at most).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numeric import coherence_sign, exact_moments
from weftline.operators import rips
from weftline.operators.ranking import ranked
from weftline.sources.stored import stored


def _scored(rows: DataFrame, keys: list[str], x: str, top: str | None = None) -> DataFrame:
    """``rows`` with ``z``: ``x`` less its group's mean, by the population deviation (null if constant).

    Both are exact sums in units of the group's largest absolute value (``top``, where rows have it): groups of the same values
    have the same scores, and neither ties nor rounded digits hang on the order of rows. What is known of the groups is written
    once, or plans that join scores with scores would repeat it many times.
    """
    m, s = exact_moments(F.col(x), F.col(top or "_top"))
    known = rows if top else rows.join(stored(rows.groupBy(*keys).agg(F.max(F.abs(x)).alias("_top")), "largest"), keys)
    stats = stored(known.groupBy(*keys).agg(m.alias("_m"), s.alias("_s")), "moments")
    return rows.join(stats, keys).withColumn("z", (F.col(x) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))


def standardized(series: DataFrame) -> DataFrame:
    """``(roi, t, v)`` with each roi's mean taken off and divided by its population deviation (null if constant)."""
    ends = stored(series.groupBy("roi").agg(F.min("v").alias("_low"), (F.max("v") - F.min("v")).alias("_range")), "ends")
    rows = series.join(ends, "roi").withColumn("v", F.col("v") - F.col("_low"))
    return _scored(rows, ["roi"], "v", "_range").select("roi", "t", F.col("z").alias("v"))


def shuffled(series: DataFrame, seed: int = 0) -> DataFrame:
    """Each roi's values dealt to its times in an order given by a hash: one null series whatever the partitioning."""
    by = Window.partitionBy("roi")
    order = (F.col("t") * 7919 + F.col("roi") * 104729 + seed * 1299709) % 1000003
    values = series.withColumn("_n", F.row_number().over(by.orderBy(order, "t"))).select("roi", "_n", "v")
    times = series.withColumn("_n", F.row_number().over(by.orderBy("t"))).select("roi", "_n", "t")
    return times.join(values, ["roi", "_n"]).select("roi", "t", "v")


def _side(series: DataFrame, key: str) -> DataFrame:
    return series.select("t", F.col("roi").alias(key), F.col("v").alias(f"v{key}"))


def edges(series: DataFrame) -> DataFrame:
    """``(t, i, j, z, w)``: z-scored products of pairs over time; w is +|z| for coherent signs, else -|z|."""
    both = _side(series, "i").join(_side(series, "j"), "t").where("i < j").withColumn("p", F.col("vi") * F.col("vj"))
    return _scored(both, ["i", "j"], "p").select("t", "i", "j", "z", (coherence_sign(F.col("vi"), F.col("vj")) * F.abs("z")).alias("w"))


def triangles(series: DataFrame) -> DataFrame:
    """``(t, i, j, k, z, w)`` of triplets, likewise."""
    all3 = _side(series, "i").join(_side(series, "j"), "t").where("i < j").join(_side(series, "k"), "t").where("j < k")
    all3 = all3.withColumn("p", F.col("vi") * F.col("vj") * F.col("vk"))
    signed = coherence_sign(F.col("vi"), F.col("vj"), F.col("vk")) * F.abs("z")
    return _scored(all3, ["i", "j", "k"], "p").select("t", "i", "j", "k", "z", signed.alias("w"))


def with_faces(edge: DataFrame, triangle: DataFrame) -> DataFrame:
    """Triangles with the weights of their three edges: three equi-joins."""
    e = lambda a, b, w: edge.select("t", F.col("i").alias(a), F.col("j").alias(b), F.col("w").alias(w))
    return triangle.join(e("i", "j", "w_ij"), ["t", "i", "j"]).join(e("i", "k", "w_ik"), ["t", "i", "k"]).join(e("j", "k", "w_jk"), ["t", "j", "k"])


def admissions(edge: DataFrame, triangle: DataFrame) -> DataFrame:
    """Triangles with ``admitted`` (no edge is lighter) and ``missing``, how many of their edges are lighter."""
    lighter = sum((F.col(c) < F.col("w")).cast("int") for c in ("w_ij", "w_ik", "w_jk"))
    return with_faces(edge, triangle).withColumn("missing", lighter).withColumn("admitted", F.col("missing") == 0).select("t", "i", "j", "k", "w", "missing", "admitted")


def hyper_coherence(admitted: DataFrame) -> DataFrame:
    """Per frame: violating share of the triangles of weight 0 or more, and the mean number of lighter edges of violations."""
    up = F.col("w") >= 0
    return admitted.groupBy("t").agg(
        F.try_divide(F.count_if(up & ~F.col("admitted")), F.count_if(up)).alias("hyper_coherence"), F.avg(F.when(up & ~F.col("admitted"), F.col("missing"))).alias("edge_violation")
    )


def edge_projection(admitted: DataFrame) -> DataFrame:
    """Per frame and edge: summed weight and number of the violating triangles on it."""
    sides = F.explode(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a, b in (("i", "j"), ("i", "k"), ("j", "k"))])).alias("e")
    bad = admitted.where("NOT admitted AND w >= 0").select("t", "w", sides)
    return bad.groupBy("t", F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n"))


def filtration(edge: DataFrame, admitted: DataFrame) -> DataFrame:
    """``(t, ord, dim, i, j, k, w, arrival)`` of the kept simplices, heaviest first; nodes come at arrival 0.

    The arrival index grows with each kept simplex whose weight differs from the
    one before it in the full order (violating triangles included in that order).
    """
    e = edge.select("t", F.lit(1).alias("dim"), "i", "j", F.lit(-1).alias("k"), "w", F.lit(True).alias("kept"))
    tri = admitted.select("t", F.lit(2).alias("dim"), "i", "j", "k", "w", F.col("admitted").alias("kept"))
    order = Window.partitionBy("t").orderBy(F.desc("w"), "dim", "i", "j", "k")
    ranked = e.unionByName(tri).withColumn("_last", F.lag("w").over(order))
    fresh = F.when(F.col("kept") & (F.col("_last").isNull() | (F.col("w") != F.col("_last"))), 1).otherwise(0)
    ranked = ranked.withColumn("arrival", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("ord", F.row_number().over(order))
    return ranked.where("kept").select("t", "ord", "dim", "i", "j", "k", "w", "arrival")


def reduce_columns(columns: list[list[int]], dims: list[int], method: str = "twist", basis: bool = False):
    """Persistence pairs of a boundary matrix over Z2; with ``basis`` also the reducing chains.

    ``twist`` reduces from the highest dimension down and clears the births it
    finds; ``standard`` goes from left to right. Both give the same pairs.
    """
    order = range(len(columns)) if method == "standard" else sorted(range(len(columns)), key=lambda c: (-dims[c], c))
    low_of: dict[int, int] = {}
    reduced: dict[int, set[int]] = {}
    chains: dict[int, set[int]] = {}
    pairs = []
    for c in order:
        if method != "standard" and c in low_of:  # a birth: its column reduces to zero
            continue
        work, chain = set(columns[c]), {c}
        while work and (low := max(work)) in low_of:
            work ^= reduced[low_of[low]]
            chain ^= chains.get(low_of[low], set())
        if work:
            low_of[max(work)] = c
            reduced[c] = work
            pairs.append((max(work), c))
        if basis:
            chains[c] = chain
    pairs.sort()
    return (pairs, reduced, chains) if basis else pairs


def dual_pairs(columns: list[list[int]], dims: list[int], method: str = "twist") -> list[tuple[int, int]]:
    """Pairs through the anti-transposed matrix (cohomology), mapped back."""
    n = len(columns)
    flipped: list[list[int]] = [[] for _ in range(n)]
    for c, rows in enumerate(columns):
        for r in rows:
            flipped[n - 1 - r].append(n - 1 - c)
    top = max(dims, default=0)
    found = reduce_columns(flipped, [top - dims[n - 1 - c] for c in range(n)], method)
    return sorted((n - 1 - d, n - 1 - b) for b, d in found)


def boundary_of(simplices: list[tuple[int, ...]]) -> tuple[list[list[int]], list[int]]:
    """Boundary columns and dimensions of simplices in an order that has faces first."""
    place = {s: i for i, s in enumerate(simplices)}
    columns = [sorted(place[s[:x] + s[x + 1 :]] for x in range(len(s))) if len(s) > 1 else [] for s in simplices]
    return columns, [len(s) - 1 for s in simplices]


class Frame:
    """The simplices of one frame in filtration order: edges as columns over nodes, triangles as columns over edges, one bit a row."""

    def __init__(self, table):
        i, j, k, w, arrival = (table[c].to_numpy() for c in ("i", "j", "k", "w", "arrival"))
        order = np.lexsort((k, j, i, k >= 0, arrival))
        i, j, k, w, arrival = i[order], j[order], k[order], w[order], arrival[order]
        self.t, edge, tri = table["t"][0].as_py(), k < 0, k >= 0
        self.nodes = np.unique(np.concatenate([i, j, k[tri]]))
        at = lambda x: np.searchsorted(self.nodes, x)
        self.edges = list(zip(i[edge].tolist(), j[edge].tolist()))
        self.edge_w, self.edge_arrival, self.tri_w, self.tri_arrival = w[edge], arrival[edge], w[tri], arrival[tri]
        weightless = table["w"].is_null().to_numpy()[order][edge]
        self.edge_value = [None if none else -x for x, none in zip(self.edge_w.tolist(), weightless.tolist())]
        self.top = float(table["node_weight"][0].as_py()) if "node_weight" in table.column_names else 0.0
        self.ends = [(1 << a) | (1 << b) for a, b in zip(at(i[edge]).tolist(), at(j[edge]).tolist())]
        bit = {e: 1 << n for n, e in enumerate(self.edges)}
        self.sides = [bit[a, b] | bit[a, c] | bit[b, c] for a, b, c in zip(i[tri].tolist(), j[tri].tolist(), k[tri].tolist())]


def reduce_bits(columns: list[int], clear: dict | None = None) -> dict[int, tuple[int, int]]:
    """``{pivot: (column, reduced column)}`` over Z2, from left to right; columns of ``clear`` are known to vanish."""
    held: dict[int, tuple[int, int]] = {}
    for c, work in enumerate(columns):
        if clear and c in clear:
            continue
        while work:
            pivot = work.bit_length() - 1
            if pivot not in held:
                held[pivot] = (c, work)
                break
            work ^= held[pivot][1]
    return held


PAIRS = "t long, dim int, birth double, death double, birth_arrival long, death_arrival long"


def persistence(kept: DataFrame, dim: int | tuple[int, ...] = 1, weights: DataFrame | None = None) -> DataFrame:
    """``(t, dim, birth, death, birth_arrival, death_arrival)`` of each frame; an unpaired class has no death (infinity).

    Births and deaths are weights with their sign turned, so that they grow along the filtration. Triangles are reduced
    before edges, whose births they make known. Nodes enter with the ``node_weight`` of ``weights``, or 0. A frame is one task;
    ``chunks`` has the way for frames that are larger than that.
    """
    dims = (dim,) if isinstance(dim, int) else tuple(dim)
    rows = kept if weights is None else kept.join(weights.select("t", "node_weight"), "t")

    def one(table):
        frame = Frame(table)
        killed = reduce_bits(frame.sides)
        joined = reduce_bits(frame.ends, killed) if 0 in dims or 1 in dims else {}
        out = []
        if 0 in dims:
            for n in range(len(frame.nodes)):
                c = joined[n][0] if n in joined else None
                out.append((0, -frame.top + 0.0, float("inf") if c is None else frame.edge_value[c], 0, -1 if c is None else frame.edge_arrival[c]))
        if 1 in dims:
            negative = {c for c, _ in joined.values()}
            for e in range(len(frame.edges)):
                c = killed[e][0] if e in killed else None
                if e not in negative and (c is None or frame.tri_arrival[c] != frame.edge_arrival[e]):
                    out.append((1, frame.edge_value[e], float("inf") if c is None else -frame.tri_w[c], frame.edge_arrival[e], -1 if c is None else frame.tri_arrival[c]))
        columns = [[frame.t] * len(out), *([r[n] for r in out] for n in range(5))]
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["t", "dim", "birth", "death", "birth_arrival", "death_arrival"])

    return rows.groupBy("t").applyInArrow(one, PAIRS)


def scaffold(kept: DataFrame) -> DataFrame:
    """``(t, i, j, n, persistence)``: edges of the cycles that generate the finite classes of dimension 1."""

    def one(table):
        frame = Frame(table)
        total: dict[int, list] = {}
        for birth, (c, cycle) in reduce_bits(frame.sides).items():
            lasted = frame.tri_arrival[c] - frame.edge_arrival[birth]
            while lasted > 0 and cycle:
                e = cycle.bit_length() - 1
                slot = total.setdefault(e, [0, 0])
                slot[0] += 1
                slot[1] += int(lasted)
                cycle ^= 1 << e
        rows = [(frame.t, *frame.edges[e], n, float(p)) for e, (n, p) in total.items()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["t", "i", "j", "n", "persistence"])

    return kept.groupBy("t").applyInArrow(one, "t long, i int, j int, n long, persistence double")


def betti_curve(intervals: DataFrame, length: int) -> DataFrame:
    """Active intervals at each index, ``[birth, death)``; an endless one (death -1) runs to ``length``. Sums of +1 and -1, no expansion."""
    end = F.when(F.col("death_arrival") < 0, length).otherwise(F.col("death_arrival"))
    steps = intervals.select("t", "dim", F.explode(F.array(F.struct(F.col("birth_arrival").alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d")))).alias("s"))
    changes = steps.groupBy("t", "dim", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    order = Window.partitionBy("t", "dim").orderBy("at")
    return changes.select("t", "dim", "at", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("betti"))


def node_weights(edge: DataFrame, triangle: DataFrame) -> DataFrame:
    """``(t, max_weight, node_weight)``: a frame's largest absolute weight, and the weight that all its nodes enter with, rounded up."""
    every = edge.select("t", "w").unionByName(triangle.select("t", "w")).groupBy("t").agg(F.max(F.abs("w")).alias("max_weight"))
    return every.withColumn("node_weight", F.ceil("max_weight").cast("double"))


def cleaned(diagram: DataFrame, weights: DataFrame) -> DataFrame:
    """``diagram`` with the frame's largest weight in place of an endless death."""
    death = F.when(F.col("death") == float("inf"), F.col("max_weight")).otherwise(F.col("death"))
    return diagram.join(weights.select("t", "max_weight"), "t").withColumn("death", death).drop("max_weight")


def betti_numbers(kept: DataFrame) -> DataFrame:
    """``(t, dim, betti)``: classes of dimension 0 and 1 of each frame's whole complex that never end, from one reduction."""
    return persistence(kept, (0, 1)).groupBy("t", "dim").agg(F.count_if(F.col("death_arrival") < 0).alias("betti"))


def diagram_indicators(diagram: DataFrame, directions: int = 50) -> DataFrame:
    """Sliced Wasserstein distance of each frame's diagram to its projection on the diagonal, in total and by quadrant.

    Fully coherent points have birth and death below zero (weights above it),
    transitions change sign, fully decoherent points lie above zero; a birth of
    zero is in none. Endless deaths are to be ``cleaned`` first. Points are gathered
    once a frame and projected in its row, so no row is made for a direction.
    """
    finite = diagram.where(F.col("death") != float("inf"))
    kind = F.when((F.col("birth") < 0) & (F.col("death") <= 0), "fc").when((F.col("birth") < 0) & (F.col("death") > 0), "ct").when(F.col("birth") > 0, "fd")
    kinds = F.explode(F.array_compact(F.array(F.lit("all"), kind))).alias("kind")
    points = finite.select("t", kinds, F.struct("birth", "death").alias("p")).groupBy("t", "kind").agg(F.collect_list("p").alias("points"))

    def gap(d):
        angle = d * F.lit(3.141592653589793) / directions - F.lit(3.141592653589793 / 2)
        mid = lambda p: (p["birth"] + p["death"]) / 2
        on = F.array_sort(F.transform("points", lambda p: p["birth"] * F.cos(angle) + p["death"] * F.sin(angle)))
        off = F.array_sort(F.transform("points", lambda p: mid(p) * F.cos(angle) + mid(p) * F.sin(angle)))
        return F.aggregate(F.zip_with(on, off, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)

    gaps = F.transform(F.sequence(F.lit(0), F.lit(directions - 1)), gap)
    return points.select("t", "kind", (F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / directions).alias("distance"))


#: Coordinates that the grid of ``rips_edges`` is laid over; a cell has 3 ** GRID neighbours.
GRID = 3


def rips_edges(points: DataFrame, limit: float, grid: int = GRID) -> DataFrame:
    """``(a, b, d)``: pairs of points ``(id, v array)`` within ``limit``.

    A grid of that width is laid over the ``grid`` coordinates that spread most; each point meets those of its cell and
    of the cells around it, and half of the cells around suffice, as a pair needs to be met once.
    """
    from itertools import product

    if limit <= 0:
        raise ValueError("the limit must be positive")
    flat = points.select(F.posexplode("v").alias("c", "x"))
    wide = [r["c"] for r in flat.groupBy("c").agg((F.max("x") - F.min("x")).alias("s")).orderBy(F.desc("s"), "c").limit(grid).collect()]
    cell = lambda c: F.floor(F.element_at("v", c + 1) / limit).cast("long")
    keyed = points.select(F.col("id"), "v", *[cell(c).alias(f"_c{n}") for n, c in enumerate(wide)])
    steps = [s for s in product((-1, 0, 1), repeat=len(wide)) if s >= (0,) * len(wide)]
    around = F.explode(F.array(*[F.struct(F.lit(all(x == 0 for x in s)).alias("own"), *[(F.col(f"_c{n}") + x).alias(f"_c{n}") for n, x in enumerate(s)]) for s in steps])).alias("_s")
    left = keyed.select(F.col("id").alias("x"), F.col("v").alias("vx"), around).select("x", "vx", "_s.*")
    right = keyed.select(F.col("id").alias("y"), F.col("v").alias("vy"), *[f"_c{n}" for n in range(len(wide))])
    gap = F.sqrt(F.aggregate(F.zip_with("vx", "vy", lambda p, q: ((p - q) * (p - q)).cast("double")), F.lit(0.0), lambda s, v: s + v))
    met = left.join(right, [f"_c{n}" for n in range(len(wide))]).where("NOT own AND x <> y OR own AND x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), gap.alias("d")).where(F.col("d") <= limit)


def rips_complex(points: DataFrame, limit: float, top: int = 2) -> DataFrame:
    """``(dim, members, d)``: all simplices up to dimension ``top`` of points within ``limit`` of each other; d is their diameter.

    Cliques are listed in the grid cell of their member of the smallest id (``rips``), so neither pairs nor triangles are shuffled.
    """
    out = points.select(F.lit(0).alias("dim"), F.array("id").alias("members"), F.lit(0.0).alias("d"))
    return out.unionByName(rips.cliques(points, limit, top)) if top else out


def clique_filtration(complex_: DataFrame) -> DataFrame:
    """The edges and triangles of a Rips complex as one frame of ``filtration``'s columns; heavier is nearer, so weights are minus the diameters."""
    flat = complex_.where("dim BETWEEN 1 AND 2").select(
        F.lit(0).cast("long").alias("t"), "dim", F.element_at("members", 1).cast("int").alias("i"), F.element_at("members", 2).cast("int").alias("j"),
        F.when(F.col("dim") == 2, F.try_element_at("members", F.lit(3))).otherwise(-1).cast("int").alias("k"), (-F.col("d")).alias("w"),
    )
    arrival = ranked(flat.select("w").distinct(), [], [F.desc("w")], "arrival")
    return flat.join(arrival, "w").select("t", "dim", "i", "j", "k", "w", "arrival")


def matrix_info(boundary: DataFrame) -> DataFrame:
    """Size figures of a boundary matrix ``(col, dim, rows array)``."""
    flat = boundary.select("col", "dim", F.explode_outer("rows").alias("row"))
    rows = flat.where("row IS NOT NULL").groupBy("row").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_row_entries"))
    own = boundary.agg(F.count(F.lit(1)).alias("num_cols"), F.max("dim").alias("max_dim"), F.max(F.size("rows")).cast("long").alias("max_col_entries"), F.sum(F.size("rows")).alias("entries"))
    return own.crossJoin(rows)
