"""Grouping drawings by links that may not put two drawings of one sheet together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import stash
from .components import connected_components


def group_with_links(drawings: DataFrame, links: DataFrame) -> DataFrame:
    """(key, home, refused): drawings (key, sheet, n_properties) joined by links (a, b, score) from the best score on.

    A link that would put two drawings of a sheet into one group is refused; refused counts those of the group's
    part. Connected parts are found first and are independent tasks; within one, links are taken one by one, as what
    is refused depends on what was joined before. The home has most properties, then the lowest sheet.
    """
    roots = connected_components(links.select("a", "b"), lambda df: stash(df, "grouping"))
    members = roots.join(drawings, roots.node == drawings.key).select("root", "key", "sheet", "n_properties", F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("score"))
    chosen = links.join(roots, links.a == roots.node).select("root", F.col("a").alias("key"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("long").alias("n_properties"), F.col("b").alias("other"), "score")

    def join_part(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows[rows["other"].isna()]
        parent = {k: k for k in nodes["key"]}
        sheets = {k: {s} for k, s in zip(nodes["key"], nodes["sheet"], strict=True)}
        size = dict(zip(nodes["key"], zip(-nodes["n_properties"], nodes["sheet"], nodes["key"], strict=True), strict=True))

        def top(k):
            while parent[k] != k:
                k = parent[k]
            return k

        refused = 0
        for link in rows[rows["other"].notna()].sort_values(["score", "key", "other"], ascending=[False, True, True]).itertuples():
            x, y = top(link.key), top(link.other)
            if x == y:
                continue
            if sheets[x] & sheets[y]:
                refused += 1
                continue
            parent[y] = x
            sheets[x] |= sheets.pop(y)
        groups: dict[str, list[str]] = {}
        for k in parent:
            groups.setdefault(top(k), []).append(k)
        out = [(k, min(g, key=size.get), refused) for g in groups.values() for k in g]
        return pd.DataFrame(out, columns=["key", "home", "refused"])

    return members.unionByName(chosen).groupBy("root").applyInPandas(join_part, "key string, home string, refused int")
