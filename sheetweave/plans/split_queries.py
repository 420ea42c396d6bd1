"""Queries that cut the plant into sheets and choose among them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import routing, split, traverse
from . import projection as P
from .catalog import query
from .projection import with_sql
from .run_queries import CUT, homes, split_flow


@query("gr25_condensed_owners", with_sql("nodes", "flow") + """, own AS (SELECT node, 'p' || CAST(CAST(node[2:] AS BIGINT) // 8 * 8 AS VARCHAR) AS owner FROM nodes WHERE kind IN ('equipment', 'valve', 'inline'))
SELECT DISTINCT a.owner AS src, b.owner AS dst FROM flow JOIN own a ON a.node = src JOIN own b ON b.node = dst WHERE a.owner <> b.owner""")
def condensed_owners(spark, sf_dir):
    k = F.substring("node", 2, 20).cast("long")
    own = P.nodes(spark, sf_dir).where("kind in ('equipment', 'valve', 'inline')").select("node", F.concat(F.lit("p"), (F.floor(k / 8) * 8).cast("string")).alias("owner"))
    return split.condensed(P.flow(spark, sf_dir), own)


@query("gr26_flow_order")
def flow_order(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir).where("kind = 'equipment'")
    ends = nodes.select("node")
    flow = P.flow(spark, sf_dir).join(ends.toDF("src"), "src", "left_semi").join(ends.toDF("dst"), "dst", "left_semi").select("src", "dst")
    return split.flow_order(flow, nodes)


@query("gr28_communities")
def communities(spark, sf_dir):
    return split.communities(P.flow(spark, sf_dir), P.nodes(spark, sf_dir).where("kind in ('equipment', 'valve', 'inline')"), 4)


@query("gr30_random_partition", with_sql("nodes") + "SELECT node, 'S' || (CAST('0x' || md5('3:' || node)[1:8] AS BIGINT) % 12) AS sheet FROM nodes")
def random_partition(spark, sf_dir):
    return split.at_random(P.nodes(spark, sf_dir), 12, 3)


@query("gr30_by_unit", None)
def by_unit(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir).where("kind in ('equipment', 'valve', 'inline')")
    return split.by_unit(nodes, nodes.where("kind = 'equipment'"), P.flow(spark, sf_dir), 4)


@query("gr30_flow_greedy")
def flow_greedy(spark, sf_dir, budget=4):
    nodes = P.nodes(spark, sf_dir).where("kind in ('equipment', 'valve', 'inline')")
    return split.flow_greedy(nodes, nodes.where("kind = 'equipment'"), P.flow(spark, sf_dir), budget)


@query("gr31_duplicates", with_sql("nodes", "flow", "drawings") + """, home AS (SELECT node, min(sheet) AS sheet FROM drawings GROUP BY 1), c AS (SELECT node FROM nodes WHERE kind = 'equipment' AND CAST('0x' || md5('5:' || node)[1:8] AS BIGINT) % 1000000 < 300000), t AS (SELECT src, dst FROM flow UNION SELECT dst, src FROM flow)
SELECT node, sheet, 'home' AS role FROM home UNION ALL SELECT * FROM (SELECT DISTINCT t.src, h.sheet, 'reference' FROM t JOIN home h ON h.node = t.dst WHERE t.src IN (SELECT node FROM c) AND NOT EXISTS (SELECT 1 FROM home o WHERE o.node = t.src AND o.sheet = h.sheet)) x""")
def duplicates(spark, sf_dir):
    equipment = P.nodes(spark, sf_dir).where("kind = 'equipment'")
    return split.duplicate_on_neighbours(homes(spark, sf_dir).select("node", "sheet"), P.flow(spark, sf_dir), equipment, 0.3, 5)


@query("gr40_merge_groups", None)
def merge_groups(spark, sf_dir):
    groups = P.nodes(spark, sf_dir).where("unit is not null").groupBy("unit", "node_class").agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "equipment").alias("equipment"))
    pinned = groups.withColumn("pinned", F.col("node_class") == "Tank")
    return split.merge_groups(pinned, "unit", "node_class", ["equipment", "symbols"], [30, 40], "pinned")


ROUTES = CUT + ", route AS (SELECT DISTINCT ss AS a, ds AS b FROM cut UNION SELECT DISTINCT ds, ss FROM cut)"


@query("gr15_sheet_rings", with_sql("flow", "drawings", recursive=ROUTES + ", core AS (SELECT min(sheet) AS sheet FROM drawings), ring(sheet, hops) AS (SELECT sheet, 0 FROM core UNION SELECT r.b, g.hops + 1 FROM ring g JOIN route r ON r.a = g.sheet WHERE g.hops < 2)") + "SELECT sheet, min(hops) AS ring FROM ring GROUP BY 1")
def sheet_rings(spark, sf_dir):
    pairs = split_flow(spark, sf_dir)[2]
    sheet = lambda c: F.substring_index(c, ":", 1)
    routes = pairs.select(sheet("from_key").alias("sheet_a"), sheet("to_key").alias("sheet_b")).distinct()
    core = P.drawings(spark, sf_dir).agg(F.min("sheet").alias("sheet"))
    return routing.rings(routes, core, 2)


@query("gr13_zero_one_distance", with_sql("nodes", "flow", recursive="""z(node, root) AS (SELECT node, 'p' || (CAST(node[2:] AS BIGINT) - CAST(node[2:] AS BIGINT) % 2) FROM nodes WHERE kind IN ('equipment', 'valve', 'inline')),
e AS (SELECT DISTINCT a.root AS src, b.root AS dst FROM flow JOIN z a ON a.node = flow.src JOIN z b ON b.node = flow.dst WHERE a.root <> b.root),
w(node, hops) AS (SELECT 'p0', 0 UNION SELECT e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.node WHERE w.hops < 20)""") + "SELECT node, min(hops) AS hops FROM w WHERE node <> 'p0' GROUP BY 1")
def zero_one_distance(spark, sf_dir):
    """Each odd part costs nothing from the even one before it; hops count the edges between such pairs."""
    k = F.substring("node", 2, 20).cast("long")
    parts = P.nodes(spark, sf_dir).where("kind in ('equipment', 'valve', 'inline')").select("node", k.alias("k"))
    free = parts.where("k % 2 = 1").select(F.concat(F.lit("p"), (F.col("k") - 1).cast("string")).alias("src"), F.col("node").alias("dst"), F.lit("same_tagged_item_as").alias("relation"))
    edges = P.flow(spark, sf_dir).withColumn("relation", F.lit("send_to")).unionByName(free)
    # the smallest name of a pair stands for it; the even part is what the answer names
    drawn = routing.zero_one_edges(edges, ["same_tagged_item_as"])
    even = lambda c: F.concat(F.lit("p"), (F.floor(F.substring(c, 2, 20).cast("long") / 2) * 2).cast("string"))
    drawn = drawn.select(even("src").alias("src"), even("dst").alias("dst"))
    reached = traverse.closure(drawn, spark.createDataFrame([("p0",)], "start string"), "down")
    return reached.where("node <> 'p0'").select("node", "hops")


@query("gr38_fit_budget", with_sql("nodes") + "SELECT unit, node FROM (SELECT unit, node, sum(length(coalesce(tag, node))) OVER (PARTITION BY unit ORDER BY node ROWS UNBOUNDED PRECEDING) AS upto FROM nodes WHERE unit IS NOT NULL) x WHERE upto <= 60")
def fit_budget(spark, sf_dir):
    parts = P.nodes(spark, sf_dir).where("unit is not null").withColumn("chars", F.length(F.coalesce("tag", "node")))
    return routing.fit_budget(parts, ["unit"], ["node"], "chars", 60).select("unit", "node")


@query("gr39_relation_rows", with_sql("nodes", "flow", "edges") + """, s AS (SELECT node FROM nodes WHERE unit = 'U04' OR loop_tag = 'L-1')
SELECT src, dst, string_agg(DISTINCT relation, '|' ORDER BY relation) AS relations FROM edges WHERE src IN (SELECT node FROM s) OR dst IN (SELECT node FROM s) GROUP BY ALL""")
def relation_rows(spark, sf_dir):
    selected = P.nodes(spark, sf_dir).where("unit = 'U04' or loop_tag = 'L-1'")
    return routing.relation_rows(P.edges(spark, sf_dir), selected)


@query("wn6_sheet_triples", "SELECT user_id, event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def sheet_triples(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return P.read(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query("gr37_loop_tags", with_sql("nodes", "flow", "edges") + "SELECT n.node, max(l.loop_tag) AS loop_tag FROM nodes n JOIN edges e ON e.src = n.node OR e.dst = n.node JOIN nodes l ON l.node = CASE WHEN e.src = n.node THEN e.dst ELSE e.src END WHERE n.loop_tag IS NULL AND l.loop_tag IS NOT NULL GROUP BY 1")
def loop_tags(spark, sf_dir):
    nodes, edges = P.nodes(spark, sf_dir), P.edges(spark, sf_dir)
    tagged = nodes.where("loop_tag is not null").select("node", "loop_tag")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.join(tagged.toDF("dst", "loop_tag"), "dst").join(nodes.where("loop_tag is null").select(F.col("node").alias("src")), "src", "left_semi")
    return near.groupBy(F.col("src").alias("node")).agg(F.max("loop_tag").alias("loop_tag"))
