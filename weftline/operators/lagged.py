"""Dynamic O-information from lagged products, and its moving-block bootstrap.

A target's next value y is explained by the last values x of some sources beyond its own last
value y0. All that is needed of the data are sums of products at lag 0 and 1, so there is
a table of pairs, not a table of embedded vectors: conditional variances follow from it
by Schur complements, as column expressions. Moments are taken about zero, as normal
scores are centred.

For the bootstrap the products are summed along time once. The sum over a block of any start
is the difference of two running sums, and a replicate is a count of starts; only what
crosses from the end of one block into the next one, a product a block, is looked up itself.
Tables that several joins read are written once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numeric import digamma
from weftline.sources.stored import stored

#: The unit number of a target series that isn't a unit.
TARGET = -1


def bias(n: int, sources: int) -> float:
    """Small-sample bias (bits) of the information between y and ``sources`` values given y0, from ``n`` samples."""
    psi = lambda k: sum(digamma((n - i) / 2) for i in range(1, k + 1)) / 2
    return (psi(2) + psi(sources + 1) - psi(sources + 2) - psi(1)) / math.log(2)


def pair_moments(z: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(now, ahead)`` of normal scores ``(win_id, unit, t, z)``.

    ``now`` is ``(win_id, u, v, s)``, u <= v: sums of products at the same time, without the last time; ``ahead``
    ``(win_id, y, v, s, yy)``: y one step later than v, and y's own squares without the first time. Only ``targets(y)`` lead.
    """
    x = z.select("win_id", "t", F.col("unit").alias("u"), F.col("z").alias("x"))
    v = z.select("win_id", "t", F.col("unit").alias("v"), F.col("z").alias("w"))
    last = z.groupBy("win_id").agg(F.max("t").alias("last"))
    now = x.join(last, "win_id").where("t < last").join(v, ["win_id", "t"]).where("u <= v").groupBy("win_id", "u", "v").agg(F.sum(F.col("x") * F.col("w")).alias("s"))
    lead = z.where("t > 0").select("win_id", (F.col("t") - 1).alias("t"), F.col("unit").alias("y"), F.col("z").alias("x"))
    lead = lead if targets is None else lead.join(targets, "y")
    ahead = lead.join(v, ["win_id", "t"]).groupBy("win_id", "y", "v").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.sum(F.col("x") * F.col("x")).alias("yy"))
    return now, ahead


def given_last(now: DataFrame, ahead: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(inner, outer)``: products with y0 taken out: ``(by.., y, u, v, c)`` of sources u <= v and ``(by.., y, v, c, vy)`` with y; ``vy`` is y's own."""
    own = now.where("u = v").select(*by, F.col("u").alias("y"), F.col("s").alias("s00"))
    lead = ahead.where("y = v").select(*by, "y", F.col("s").alias("sy0"), "yy").join(own, [*by, "y"])
    both = now.where("u <> v").select(*by, F.col("u").alias("y"), "v", "s").unionByName(now.where("u <> v").select(*by, F.col("v").alias("y"), F.col("u").alias("v"), "s"))
    with_last = both.withColumnRenamed("s", "s0")
    outer = ahead.where("y <> v").select(*by, "y", "v", "s").join(with_last, [*by, "y", "v"]).join(lead, [*by, "y"])
    outer = outer.select(*by, "y", "v", (F.col("s") - F.try_divide(F.col("s0") * F.col("sy0"), F.col("s00"))).alias("c"), (F.col("yy") - F.try_divide(F.col("sy0") * F.col("sy0"), F.col("s00"))).alias("vy"))
    targets = lead.select(*by, "y", "s00")
    left, right = with_last.select(*by, "y", F.col("v").alias("u"), F.col("s0").alias("su")), with_last.select(*by, "y", "v", F.col("s0").alias("sv"))
    inner = now.join(left, [*by, "u"]).join(right, [*by, "y", "v"]).join(targets, [*by, "y"])
    return inner.select(*by, "y", "u", "v", (F.col("s") - F.try_divide(F.col("su") * F.col("sv"), F.col("s00"))).alias("c")), outer


def left_of_two(vy: Column, ya: Column, yb: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """What two sources leave of the variance ``vy``; null if they can't be told apart."""
    det = aa * bb - ab * ab
    return vy - F.when(det > 1e-12, (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / F.when(det > 1e-12, det))


def _bits(vy: Column, rest: Column) -> Column:
    ok = (vy > 1e-12) & (rest > 1e-12)
    return F.when(ok, 0.5 * F.log(F.when(ok, vy) / F.when(ok, rest))) / math.log(2)


def pairs_of_sources(inner: DataFrame, outer: DataFrame, n: int, by: list[str]) -> DataFrame:
    """``(by.., target, i, j, domega)`` for all sources i < j: what both tell apart less what they tell together, in bits."""
    one = lambda a, names: outer.select(*by, "y", F.col("v").alias(a), F.col("c").alias(names), "vy")
    own = lambda a, name: inner.where("u = v").select(*by, "y", F.col("u").alias(a), F.col("c").alias(name))
    rows = inner.where("u < v").select(*by, "y", F.col("u").alias("i"), F.col("v").alias("j"), F.col("c").alias("ij"))
    rows = rows.join(one("i", "yi"), [*by, "y", "i"]).join(one("j", "yj").drop("vy"), [*by, "y", "j"]).join(own("i", "ii"), [*by, "y", "i"]).join(own("j", "jj"), [*by, "y", "j"])
    c = {k: F.col(k) for k in ("vy", "yi", "yj", "ii", "jj", "ij")}
    alone = [_bits(c["vy"], c["vy"] - F.try_divide(c[a] * c[a], c[b])) - bias(n, 1) for a, b in (("yi", "ii"), ("yj", "jj"))]
    both = _bits(c["vy"], left_of_two(c["vy"], c["yi"], c["yj"], c["ii"], c["jj"], c["ij"])) - bias(n, 2)
    return rows.select(*by, F.col("y").alias("target"), "i", "j", (alone[0] + alone[1] - both).alias("domega"))


def triplets_of_sources(inner: DataFrame, outer: DataFrame, n: int, by: list[str]) -> DataFrame:
    """``(by.., target, i, j, k, domega)`` for sources i < j < k: the information of the three pairs less twice that of all, in bits."""
    pair = lambda a, b, name: inner.where("u < v").select(*by, "y", F.col("u").alias(a), F.col("v").alias(b), F.col("c").alias(name))
    one = lambda a: outer.select(*by, "y", F.col("v").alias(a), F.col("c").alias(f"y{a}"), "vy").join(
        inner.where("u = v").select(*by, "y", F.col("u").alias(a), F.col("c").alias(f"{a}{a}")), [*by, "y", a]
    )
    rows = pair("i", "j", "ij").join(pair("i", "k", "ik"), [*by, "y", "i"]).where("j < k").join(pair("j", "k", "jk"), [*by, "y", "j", "k"])
    for a in "ijk":
        rows = rows.join(one(a) if a == "i" else one(a).drop("vy"), [*by, "y", a])
    c = {k: F.col(k) for k in ("vy", "yi", "yj", "yk", "ii", "jj", "kk", "ij", "ik", "jk")}
    two = [_bits(c["vy"], left_of_two(c["vy"], c[f"y{a}"], c[f"y{b}"], c[a + a], c[b + b], c[a + b])) - bias(n, 2) for a, b in ("ij", "ik", "jk")]
    # i is taken out of the others, then two sources are left.
    by_i = lambda a, b: F.try_divide(a * b, c["ii"])
    rest = left_of_two(
        c["vy"] - by_i(c["yi"], c["yi"]), c["yj"] - by_i(c["yi"], c["ij"]), c["yk"] - by_i(c["yi"], c["ik"]),
        c["jj"] - by_i(c["ij"], c["ij"]), c["kk"] - by_i(c["ik"], c["ik"]), c["jk"] - by_i(c["ij"], c["ik"]),
    )
    every = _bits(c["vy"], rest) - bias(n, 3)
    return rows.select(*by, F.col("y").alias("target"), "i", "j", "k", (two[0] + two[1] + two[2] - 2 * every).alias("domega"))


def dynamic(z: DataFrame, width: int, sources: int = 2) -> DataFrame:
    """Dynamic O-information of every unit from all pairs (``sources`` 2) or triplets (3) of the others, per window of ``width`` times."""
    now, ahead = pair_moments(stored(z, "scores"))
    inner, outer = given_last(stored(now, "now"), stored(ahead, "ahead"), ["win_id"])
    inner, outer = stored(inner, "inner"), stored(outer, "outer")
    return (pairs_of_sources if sources == 2 else triplets_of_sources)(inner, outer, width - 1, ["win_id"])


def without_silent(triplets: DataFrame, silent: DataFrame, members: tuple[str, ...] = ("i", "j", "k")) -> DataFrame:
    """``triplets`` of a window without those that have a unit of ``silent(win_id, unit)`` among their members."""
    for m in members:
        triplets = triplets.join(silent.select("win_id", F.col("unit").alias(m)), ["win_id", m], "left_anti")
    return triplets


def draws(spark, windows: int, width: int, block: int, reps: int) -> DataFrame:
    """``(win_id, rep, d, start)``: as many block starts as fit in a window, drawn with replacement from all that there are.

    Draw d of replicate b in window w starts at ``(7919 w + 104729 b + 1299709 d + b d d) mod 2147483647 mod (width - block + 1)``.
    """
    n = width // block
    start = (F.col("w") * 7919 + F.col("b") * 104729 + F.col("d") * 1299709 + F.col("b") * F.col("d") * F.col("d")) % 2147483647 % (width - block + 1)
    grid = spark.range(windows * reps * n).select(F.floor(F.col("id") / (reps * n)).alias("w"), (F.floor(F.col("id") / n) % reps).alias("b"), (F.col("id") % n).alias("d"))
    return grid.select(F.col("w").cast("int").alias("win_id"), F.col("b").cast("int").alias("rep"), F.col("d").cast("int").alias("d"), start.cast("int").alias("start"))


def drawn_moments(z: DataFrame, drawn: DataFrame, width: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``pair_moments`` of every replicate's blocks in a row, keyed by ``(win_id, rep)``; only ``TARGET`` leads."""
    x = z.select("win_id", "t", F.col("unit").alias("u"), F.col("z").alias("x"))
    v = z.select("win_id", "t", F.col("unit").alias("v"), F.col("z").alias("w"))
    lead = z.where(F.col("unit") == TARGET).select("win_id", "t", F.col("z").alias("x"))
    product = F.col("x") * F.col("w")
    at = x.join(v, ["win_id", "t"]).where("u <= v").select("win_id", "u", "v", "t", product.alias("p"))
    step = lead.join(v.withColumn("t", F.col("t") + 1), ["win_id", "t"], "right").where(F.col("t") < width).select("win_id", "v", "t", F.coalesce(product, F.lit(0.0)).alias("p"))
    along = lambda *keys: Window.partitionBy("win_id", *keys).orderBy("t")
    run = lambda df, *keys: df.withColumn("run", F.sum("p").over(along(*keys).rowsBetween(Window.unboundedPreceding, 0)))
    now = run(at, "u", "v").withColumn("s", F.col("run") - F.coalesce(F.lag("run", block).over(along("u", "v")), F.lit(0.0)))
    now = now.where(F.col("t") >= block - 1).select("win_id", "u", "v", (F.col("t") - (block - 1)).alias("start"), "s")
    ahead = run(step, "v").withColumn("s", F.col("run") - F.lag("run", block - 1).over(along("v")) if block > 1 else F.lit(0.0))
    # Times of ``step`` begin at 1, so a block that starts at 0 has no row before it.
    ahead = ahead.where(F.col("t") >= block - 1).select("win_id", "v", (F.col("t") - (block - 1)).alias("start"), F.coalesce("s", "run").alias("s"))
    times = drawn.groupBy("win_id", "rep", "start").agg(F.count(F.lit(1)).alias("n"))
    blocks = times.join(now, ["win_id", "start"]).select("win_id", "rep", "u", "v", (F.col("n") * F.col("s")).alias("s"))
    count = width // block
    end = drawn.where(F.col("d") == count - 1).select("win_id", "rep", (F.col("start") + block - 1).alias("t"))
    ends = end.join(at, ["win_id", "t"]).select("win_id", "rep", "u", "v", (-F.col("p")).alias("s"))
    total = blocks.unionByName(ends).groupBy("win_id", "rep", "u", "v").agg(F.sum("s").alias("s"))
    # The target's own squares run from the second time to the last one.
    first = drawn.where("d = 0").select("win_id", "rep", F.col("start").alias("t"))
    square = at.where((F.col("u") == TARGET) & (F.col("v") == TARGET)).select("win_id", "t", "p")
    swap = first.join(square, ["win_id", "t"]).select("win_id", "rep", (-F.col("p")).alias("yy")).unionByName(end.join(square, ["win_id", "t"]).select("win_id", "rep", F.col("p").alias("yy")))
    squares = total.where((F.col("u") == TARGET) & (F.col("v") == TARGET)).select("win_id", "rep", F.col("s").alias("yy")).unionByName(swap).groupBy("win_id", "rep").agg(F.sum("yy").alias("yy"))
    inside = times.join(ahead, ["win_id", "start"]).select("win_id", "rep", "v", (F.col("n") * F.col("s")).alias("s"))
    before = drawn.select("win_id", "rep", (F.col("d") + 1).alias("d"), (F.col("start") + block - 1).alias("t"))
    seams = drawn.join(before, ["win_id", "rep", "d"]).join(v, ["win_id", "t"]).join(lead.withColumnRenamed("t", "start"), ["win_id", "start"]).select("win_id", "rep", "v", product.alias("s"))
    leading = inside.unionByName(seams).groupBy("win_id", "rep", "v").agg(F.sum("s").alias("s")).join(squares, ["win_id", "rep"])
    return total, leading.select("win_id", "rep", F.lit(TARGET).alias("y"), "v", "s", "yy")


def moving_blocks(z: DataFrame, drawn: DataFrame, width: int, block: int) -> DataFrame:
    """``(win_id, rep, i, j, k, domega)`` of the series ``TARGET`` from all triplets of units, in every replicate."""
    by = ["win_id", "rep"]
    now, ahead = drawn_moments(stored(z, "scores"), stored(drawn, "draws"), width, block)
    inner, outer = given_last(stored(now, "now"), stored(ahead, "ahead"), by)
    inner, outer = stored(inner, "inner"), stored(outer, "outer")
    return triplets_of_sources(inner, outer, width // block * block - 1, by).drop("target")
