"""Choosing sheets for a question: routes between sheets, rings around them, what fits a text budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .traverse import closure, layered, paths


def sheet_route(routes: DataFrame, sources: DataFrame, targets: DataFrame) -> list[str] | None:
    """Sheets of the shortest route from any source to any target (columns sheet), ties to the smaller names."""
    spark = routes.sparkSession
    both = routes.select(F.col("sheet_a").alias("src"), F.col("sheet_b").alias("dst")).unionByName(routes.select(F.col("sheet_b").alias("src"), F.col("sheet_a").alias("dst")))
    edges = both.unionByName(sources.select(F.lit("").alias("src"), F.col("sheet").alias("dst")))
    names = edges.select(F.col("dst").alias("node")).unionByName(edges.select("src")).distinct()
    goal = targets.select(F.lit("").alias("start"), F.col("sheet").alias("node"))
    tree = layered(edges, spark.createDataFrame([("",)], "start string"), F.col("node"), names, targets=goal)
    hit = tree.join(goal, ["start", "node"], "left_semi").orderBy("hops", "rank").limit(1)
    found = paths(tree, hit.select("start", "node")).first()
    return found["path"][1:] if found else None


def rings(routes: DataFrame, core: DataFrame, hops: int) -> DataFrame:
    """(sheet, ring) of sheets within so many hops of the core, ring 0 the core itself."""
    spark = routes.sparkSession
    both = routes.select(F.col("sheet_a").alias("src"), F.col("sheet_b").alias("dst")).unionByName(routes.select(F.col("sheet_b").alias("src"), F.col("sheet_a").alias("dst")))
    edges = both.unionByName(core.select(F.lit("").alias("src"), F.col("sheet").alias("dst")))
    reached = closure(edges, spark.createDataFrame([("",)], "start string"), "down", max_hops=hops + 1)
    return reached.where("node <> ''").select(F.col("node").alias("sheet"), (F.col("hops") - 1).alias("ring"))


def zero_one_edges(edges: DataFrame, free: list[str]) -> DataFrame:
    """(src, dst, relation) with what costs nothing drawn together: nodes joined by free relations are one node, named by
    its smallest member, so that a plain breadth-first walk counts only the hops that cost."""
    from ..lineage import stash
    from .components import connected_components

    joined = connected_components(edges.where(F.col("relation").isin(*free)).select(F.col("src").alias("a"), F.col("dst").alias("b")), lambda df: stash(df, "free"))
    name = lambda c, to: joined.select(F.col("node").alias(c), F.col("root").alias(to))
    paid = edges.where(~F.col("relation").isin(*free)).join(name("src", "a"), "src", "left").join(name("dst", "b"), "dst", "left")
    return paid.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "relation").where("src <> dst").distinct()


def fit_budget(parts: DataFrame, by: list[str], order: list, length: str, limit: int) -> DataFrame:
    """The parts of each text that fit a limit of characters, in order, the first too long one and all after it left out."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("upto", F.sum(length).over(w)).where(F.col("upto") <= limit)


def relation_rows(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(src, dst, relations): edges that touch a selected node, relations of a pair joined."""
    s = selected.select("node")
    touching = edges.join(s.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(s.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)).distinct()
    return touching.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("relation")), "|").alias("relations"))
