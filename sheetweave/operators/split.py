"""Cutting a plant into sheets: orders, budgets, strategies, duplicates, packing of groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import stash
from .components import connected_components
from .traverse import nearest_owners, oriented


def condensed(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, dst): owners joined by an edge between their nodes."""
    of = owners.select("node", "owner")
    both = edges.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst")
    return both.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def hubs(edges: DataFrame) -> DataFrame:
    """(node, degree) of nodes with a degree over mean plus population deviation."""
    degree = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    limit = degree.agg((F.avg("degree") + F.stddev_pop("degree")).alias("limit"))  # one row
    return degree.join(F.broadcast(limit)).where("degree > limit").select("node", "degree")


def flow_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, node, position): depth-first preorder of each connected part, from its smallest unvisited node.

    A part is walked in one task: depth-first order is sequential by nature. Parts are independent tasks.
    """
    roots = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), lambda df: stash(df, "order"))
    placed = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("next"))
    table = placed.join(out, "node", "left").select("component", "node", F.coalesce("next", F.array().cast("array<string>")).alias("next"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        follow = dict(zip(rows["node"], rows["next"], strict=True))
        fed = {t for n in follow.values() for t in n}
        seen: dict[str, None] = {}
        for first in sorted(follow, key=lambda n: (n in fed, n)):
            stack = [first]
            while stack:
                node = stack.pop()
                if node not in seen:
                    seen[node] = None
                    stack += [t for t in reversed(list(follow.get(node, ()))) if t not in seen]
        return pd.DataFrame({"component": rows["component"].iloc[0], "node": list(seen), "position": range(len(seen))})

    return table.groupBy("component").applyInPandas(walk, "component string, node string, position int")


def chunk_by_budget(order: DataFrame, by: list[str], position: str, counted: str, budget: int) -> DataFrame:
    """Rows with the number of their chunk: a new one begins when `budget` counted rows are full; others ride along."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col(counted).cast("int")).over(w)
    return order.withColumn("chunk", F.floor(F.greatest(upto - 1, F.lit(0)) / budget).cast("long"))


def balanced_sizes(n: int, budget: int) -> list[int]:
    """Sizes of as few chunks as the budget allows, as equal as can be."""
    if n <= 0:
        return []
    chunks = -(-n // budget)
    return [n // chunks + (i < n % chunks) for i in range(chunks)]


def by_unit(nodes: DataFrame, equipment: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """(node, sheet): units in chunks of `budget` equipment items; a node follows its nearest equipment of its unit."""
    marked = nodes.join(equipment.select("node", F.lit(True).alias("counted")), "node", "left").where("counted")
    placed = chunk_by_budget(marked, ["unit"], "node", "counted", budget).select(F.col("node").alias("owner"), F.concat_ws("-", "unit", F.col("chunk").cast("string")).alias("sheet"))
    owners = nearest_owners(edges, nodes, equipment, "unit")
    return owners.join(placed, "owner", "left").join(nodes.select("node", "unit"), "node").select("node", F.coalesce("sheet", F.concat_ws("-", "unit", F.lit("0"))).alias("sheet"))


def drawn(seed: int, c: str):
    """A number below 2**32 drawn by the value and a seed, the same on every run and in any engine: the first digits of
    an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(c))), 1, 8), 16, 10).cast("long")


def at_random(nodes: DataFrame, sheets: int, seed: int) -> DataFrame:
    """(node, sheet): a sheet drawn for each node, the same on every run."""
    return nodes.select("node", F.concat(F.lit("S"), (drawn(seed, "node") % sheets).cast("string")).alias("sheet"))


def flow_greedy(nodes: DataFrame, equipment: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """(node, sheet): equipment in the order of flow, `budget` items a sheet; a node follows its nearest equipment."""
    owners = stash(nearest_owners(edges, nodes, equipment).select("node", "owner"), "greedy-owners")
    heads = owners.select(F.col("owner").alias("node")).distinct()
    order = flow_order(condensed(edges, owners), heads).join(equipment.select("node", F.lit(True).alias("counted")), "node", "left")
    placed = chunk_by_budget(order.withColumn("counted", F.coalesce("counted", F.lit(False))), ["component"], "position", "counted", budget)
    placed = placed.select(F.col("node").alias("owner"), F.concat_ws("-", "component", F.col("chunk").cast("string")).alias("sheet"))
    return owners.join(placed, "owner").select("node", "sheet")


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, sheet) by label propagation: each node takes the label most of its neighbours have, the smallest among equals.

    A stand-in for modularity clustering, whose result depends on visiting nodes one by one.
    """
    along = stash(oriented(edges, "both"), "community-edges")
    labels = stash(nodes.select("node", F.col("node").alias("sheet")), "community")
    for _ in range(rounds):
        votes = along.join(labels.select(F.col("node").alias("dst"), "sheet"), "dst").groupBy(F.col("src").alias("node"), "sheet").agg(F.count("*").alias("n"))
        chosen = votes.groupBy("node").agg(F.min_by("sheet", F.struct(-F.col("n"), F.col("sheet"))).alias("s"))
        new = stash(labels.join(chosen, "node", "left").select("node", F.coalesce("s", "sheet").alias("sheet")), "community")
        if new.exceptAll(labels).isEmpty():
            break
        labels = new
    return labels


def duplicate_on_neighbours(home: DataFrame, edges: DataFrame, equipment: DataFrame, rate: float, seed: int) -> DataFrame:
    """(node, sheet, role): homes, and for a seeded share of equipment a reference on every sheet it has an edge to."""
    chosen = equipment.select("node").where(drawn(seed, "node") % 1_000_000 < int(rate * 1_000_000))
    along = oriented(edges, "both")
    other = along.join(chosen, along.src == chosen.node, "left_semi").join(home.toDF("dst", "sheet"), "dst").select(F.col("src").alias("node"), "sheet").distinct()
    refs = other.join(home, ["node", "sheet"], "left_anti").withColumn("role", F.lit("reference"))
    return home.select("node", "sheet").withColumn("role", F.lit("home")).unionByName(refs.select("node", "sheet", "role"))


def merge_groups(groups: DataFrame, by: str, order: str, sizes: list[str], caps: list[int], pinned: str) -> DataFrame:
    """Consecutive groups share a sheet while every size stays within its cap; pinned groups stand alone.

    A unit's groups are one short list and are folded in one task; units are independent.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        sheet, used, sheets, alone = 0, None, [], False
        for _, row in rows.iterrows():
            own = [row[s] for s in sizes]
            fits = used is not None and not alone and not row[pinned] and all(u + o <= c for u, o, c in zip(used, own, caps, strict=True))
            if fits:
                used = [u + o for u, o in zip(used, own, strict=True)]
            else:
                sheet += used is not None
                used, alone = own, bool(row[pinned])
            sheets.append(sheet)
        return rows.assign(merged=sheets)[[by, order, "merged"]]

    kinds = dict(groups.dtypes)
    return groups.select(by, order, *sizes, pinned).groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {order} {kinds[order]}, merged int")
