"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sign(pairs: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and two sums of hashes."""
    code = F.xxhash64("a", "b")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(code), F.sum(code.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b); root is the component's smallest node.

    Alternates large-star and small-star rounds until no edge changes: each round links nodes to smaller ones, so the
    number of rounds grows with the logarithm of a component's size. Minima are pre-aggregated and written before they
    are joined: the joins are then plain ones over written tables, of which AQE splits a node with many neighbours, and
    a node that has no smaller neighbour, as a large component's root, has no row on the other side. `cut` ends the
    lineage after a step (a checkpoint or a written table; DataFrame.checkpoint by default).
    """
    cut = cut or (lambda df: df.checkpoint())
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    sign = _sign(pairs)
    while sign[0]:
        # large star: a node's larger neighbours are linked to the least of its neighbours, to itself if none is smaller
        least = cut(pairs.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")))
        large = pairs.join(least, pairs.b == least.c, "left").select("a", F.coalesce("m", "b").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct()
        # small star: a node's smaller neighbours and itself are linked to the least of them
        least = cut(large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")))
        small = large.join(least, large.a == least.c).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        pairs = cut(small)
        last, sign = sign, _sign(pairs)
        if last == sign:
            break
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
