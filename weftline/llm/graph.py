"""Connected components of a distributed edge list, as written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The links ``(a, b)`` between different labels that ``edges(a, b)`` are; each is in it once, however many edges it stands for.

    A node without a label is its own.
    """
    of = lambda end, name: labels.select(F.col("node").alias(end), F.col("label").alias(name))
    ends = edges.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    return ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``, as a written table; label: the smallest node reachable.

    Each node first goes to the smallest one among its neighbours' and its own,
    and to that one's; only the links between the nodes that are left are labelled in rounds,
    so rounds don't read the many edges within a crowded group again.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("low"))
    hop = written(low.join(low.select(F.col("node").alias("low"), F.col("low").alias("label")), "low").select("node", "label"), "hop")
    between = written(_between(both, hop), "edges")
    discard(both)
    if not between.limit(1).count():
        discard(between)
        return hop
    labels = _rounds(between)
    out = _renamed(hop, labels)
    discard(labels)
    return out


def _rounds(both: DataFrame) -> DataFrame:
    """``components`` of a written table that has each edge both ways, in place of it.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, so long chains close in few rounds. Rounds
    are written tables in the shared folder, and a round's tables are deleted when
    the next one is written; only a count comes to the driver.
    Minima combine before the shuffle, and the jump is an inner join of two
    plain tables, which adaptive execution splits where one label is frequent.
    """
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(False).alias("own"))
        own = labels.select("node", "label", F.lit(True).alias("own"))
        step = (
            near.unionByName(own)
            .groupBy("node")
            .agg(F.min("label").alias("label"), F.max(F.when(F.col("own"), F.col("label"))).alias("was"))
        )
        step = written(step, "labels")
        discard(labels)
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label"), "was")
        labels = written(jump, "labels")
        discard(step)
        if not labels.where("label <> was").limit(1).count():
            discard(both)
            found = labels.select("node", "label")
            found._written_at = labels._written_at
            return found


def _named(labels: DataFrame, hop: DataFrame) -> DataFrame:
    """``labels`` with the label that ``hop`` has for each label, or their own."""
    named = labels.join(hop.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
    return named.select("node", F.coalesce("next", "label").alias("label"))


def _renamed(labels: DataFrame, hop: DataFrame) -> DataFrame:
    """``_named`` as a written table in place of ``labels``."""
    out = written(_named(labels, hop), "labels")
    discard(labels)
    return out


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` of ``components`` after ``edges(a, b)`` are added, as a written table in place of ``labels``; nodes may be new.

    Only the links between labels are read, not the edges that ``labels`` are of.
    """
    hop = components(_between(edges, labels))
    new = hop.join(labels.select("node"), "node", "left_anti")
    known = written(labels.unionByName(new.select("node", F.col("node").alias("label"))), "known")
    discard(labels)
    out = _renamed(known, hop)
    discard(hop)
    return out
