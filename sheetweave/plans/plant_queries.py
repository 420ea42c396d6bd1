"""Queries over the plant that the driver tables project to: scans, filters, lookups, walks, question families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import class_plural, fold_tag, fold_unit, k_bin, tag_parts
from ..operators import filters, traverse
from ..schema import EQUIPMENT, LINE_ITEMS, OPERATED, class_dim
from . import projection as P
from .catalog import query
from .projection import with_sql

ITEMS = "(SELECT node FROM nodes WHERE kind IN ('equipment', 'valve'))"


def joined(column, separator=","):
    """A set of strings as one sorted string."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


# --- scans and lookups


@query("src1_scan_items", with_sql("nodes") + "SELECT node, node_class, tag, unit, kind FROM nodes")
def scan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nodes(spark, sf_dir).select("node", "node_class", "tag", "unit", "kind")


@query("src2_scan_edges", with_sql("flow", "edges") + "SELECT src, dst, relation FROM edges")
def scan_edges(spark, sf_dir):
    return P.edges(spark, sf_dir)


@query("src3_find_by_tag", with_sql("nodes") + "SELECT node, tag FROM nodes WHERE regexp_replace(upper(trim(tag)), '\\s+', ' ', 'g') = 'GV-04-4'")
def find_by_tag(spark, sf_dir):
    return P.nodes(spark, sf_dir).where(fold_tag("tag") == fold_tag(F.lit("  gv-04-4 "))).select("node", "tag")


@query("src4_units_and_sheets", with_sql("nodes", "drawings") + "SELECT DISTINCT unit, sheet FROM nodes JOIN drawings USING (node) WHERE unit IS NOT NULL")
def units_and_sheets(spark, sf_dir):
    return P.nodes(spark, sf_dir).join(P.drawings(spark, sf_dir), "node").where("unit is not null").select("unit", "sheet").distinct()


@query("src6_subgraph_of_sheets", with_sql("flow", "drawings") + """, k AS (SELECT DISTINCT node FROM drawings WHERE sheet IN ('199601', '199702', '199803'))
SELECT src, dst FROM flow WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)""")
def subgraph_of_sheets(spark, sf_dir):
    kept = P.drawings(spark, sf_dir).where(F.col("sheet").isin("199601", "199702", "199803")).select("node").distinct()
    flow = P.flow(spark, sf_dir)
    return flow.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


@query("src9_parallel_edge_collapse", """
WITH c AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE l_returnflag WHEN 'R' THEN 'send_to' WHEN 'A' THEN 'control' ELSE 'related_to' END AS relation,
  CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS priority FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY priority) AS n, count(*) OVER (PARTITION BY src, dst) - 1 AS dropped FROM c)
SELECT src, dst, relation, dropped FROM r WHERE n = 1""")
def parallel_edge_collapse(spark, sf_dir):
    flag = F.col("l_returnflag")
    rank = F.when(flag == "R", 0).when(flag == "A", 1).otherwise(2)
    relation = F.when(rank == 0, "send_to").when(rank == 1, "control").otherwise("related_to")
    edges = P.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), relation.alias("relation"), rank.alias("rank"))
    return edges.groupBy("src", "dst").agg(F.min_by("relation", "rank").alias("relation"), (F.count("*") - 1).alias("dropped"))


@query("src10_lost_edges", with_sql("nodes", "flow", "edges") + """SELECT s.node_class AS src_class, d.node_class AS dst_class, count(*) AS n FROM edges e JOIN nodes s ON s.node = e.src JOIN nodes d ON d.node = e.dst
WHERE s.kind NOT IN ('equipment', 'valve') OR d.kind NOT IN ('equipment', 'valve') GROUP BY ALL""")
def lost_edges(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir).select("node", "node_class", F.col("kind").isin("equipment", "valve").alias("mapped"))
    e = P.edges(spark, sf_dir).join(nodes.toDF("src", "src_class", "ms"), "src").join(nodes.toDF("dst", "dst_class", "md"), "dst")
    return e.where("not (ms and md)").groupBy("src_class", "dst_class").agg(F.count("*").alias("n"))


# --- filters and rules


@query("flt1_item_filter", with_sql("nodes") + "SELECT node, tag, unit FROM nodes WHERE kind = 'valve' AND node_class IN ('GlobeValve', 'BallValve') AND NOT coalesce(unit = 'U03', false)")
def item_filter(spark, sf_dir):
    items = P.nodes(spark, sf_dir).join(F.broadcast(class_dim(spark).select("node_class", "labels")), "node_class")
    return items.where(filters.item_filter(label="operatedVALVE", not_unit="unit 03")).select("node", "tag", "unit")


@query("flt3_umbrella_valve", with_sql("nodes") + "SELECT node_class, count(*) AS n FROM nodes WHERE kind = 'valve' GROUP BY 1")
def umbrella_valve(spark, sf_dir):
    items = P.nodes(spark, sf_dir).join(F.broadcast(class_dim(spark).select("node_class", "labels")), "node_class")
    return items.where(filters.item_filter(label="Valve")).groupBy("node_class").agg(F.count("*").alias("n"))


@query("flt4_visible_properties", with_sql("nodes") + "SELECT node, concat_ws(';', 'tag=' || tag, 'unit=' || unit) AS properties FROM nodes")
def visible_properties(spark, sf_dir):
    props = F.create_map(*(x for c in ("tag", "unit", "kind", "node") for x in (F.lit(c), F.col(c))))
    shown = filters.visible(props, ("tag", "unit"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(shown), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return P.nodes(spark, sf_dir).select("node", text.alias("properties"))


@query("flt6_labels_for", with_sql("nodes") + """SELECT node, node_class || CASE WHEN node_class = 'CentrifugalPump' THEN '|Pump|Equipment|TaggedPlantItem' WHEN node_class IN ('Tank', 'PressureVessel') THEN '|Vessel|Equipment|TaggedPlantItem'
  WHEN node_class = 'HeatExchanger' THEN '|Equipment|TaggedPlantItem' WHEN node_class IN ('GlobeValve', 'BallValve') THEN '|OperatedValve|PipingComponent' WHEN node_class = 'CheckValve' THEN '|PipingComponent'
  WHEN node_class = 'PipeTee' THEN '|PipeFitting|PipingComponent' WHEN node_class = 'ProcessControlFunction' THEN '|ProcessInstrumentationFunction' ELSE '' END AS labels FROM nodes""")
def labels_for(spark, sf_dir):
    return P.nodes(spark, sf_dir).join(F.broadcast(class_dim(spark).select("node_class", "labels")), "node_class").select("node", F.array_join("labels", "|").alias("labels"))


@query("flt7_plant_violations", with_sql("nodes", "flow", "edges") + """SELECT e.src || '->' || e.dst AS subject, 'endpoint class' AS rule, s.node_class || ' ' || e.relation || ' ' || d.node_class AS detail
FROM edges e JOIN nodes s ON s.node = e.src JOIN nodes d ON d.node = e.dst WHERE e.relation = 'control' AND d.node_class NOT IN ('GlobeValve', 'BallValve') AND d.kind <> 'equipment'
UNION ALL SELECT src || '->' || dst, 'missing end', relation FROM edges WHERE src NOT IN (SELECT node FROM nodes) OR dst NOT IN (SELECT node FROM nodes)
UNION ALL SELECT n.node, 'duplicate tag', n.tag || ' also on ' || f.first FROM nodes n JOIN (SELECT tag, min(node) AS first FROM nodes WHERE tag IS NOT NULL GROUP BY 1 HAVING count(*) > 1) f USING (tag) WHERE n.node <> f.first""")
def plant_violations(spark, sf_dir):
    return filters.plant_violations(P.nodes(spark, sf_dir), P.edges(spark, sf_dir), class_dim(spark))


@query("flt9_contract_violations", with_sql("drawings") + "SELECT 'node on two sheets' AS rule, node AS subject FROM drawings GROUP BY node HAVING count(DISTINCT sheet) > 1")
def contract_violations(spark, sf_dir):
    return filters.contract_violations(P.drawings(spark, sf_dir))


# Query texts, and the writing clause that the guard finds in each.
TEXTS = (
    ("SELECT * FROM items WHERE tag = 'DROP TABLE x'", None), ("select 1 -- delete from items", None), ("DELETE FROM items", "DELETE"), ("WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", "INSERT"),
    ("SELECT `update` FROM items /* merge */", None), ("create table t (a int)", "CREATE"), ('SELECT "set" FROM items', None), ("MATCH (n) SET n.x = 1", "SET"),
)


@query("flt10_writing_clause", "SELECT item_id, CASE item_id % 8 WHEN 2 THEN 'DELETE' WHEN 3 THEN 'INSERT' WHEN 5 THEN 'CREATE' WHEN 7 THEN 'SET' END AS clause FROM benchmark")
def writing_clause(spark, sf_dir):
    """What the guard says of eight query texts, one for each item of the benchmark."""
    known = spark.createDataFrame([(i, filters.writing_clause(text)) for i, (text, _) in enumerate(TEXTS)], "i long, clause string")
    return P.read(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % len(TEXTS)).alias("i")).join(F.broadcast(known), "i").select("item_id", "clause")


@query("flt13_canonical_lines", """SELECT '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def canonical_lines(spark, sf_dir):
    return filters.canonical_lines(P.read(spark, sf_dir, "nation").select("n_name", "n_regionkey"))


# --- joins


@query("jn8_edge_units", with_sql("nodes", "flow") + "SELECT s.unit AS src_unit, d.unit AS dst_unit, count(*) AS n FROM flow JOIN nodes s ON s.node = src JOIN nodes d ON d.node = dst GROUP BY ALL")
def edge_units(spark, sf_dir):
    units = P.nodes(spark, sf_dir).select("node", "unit")
    e = P.flow(spark, sf_dir).join(units.toDF("src", "src_unit"), "src").join(units.toDF("dst", "dst_unit"), "dst")
    return e.groupBy("src_unit", "dst_unit").agg(F.count("*").alias("n"))


@query("jn19_tag_prefix", with_sql("nodes") + "SELECT tag FROM nodes WHERE starts_with(tag, 'GV-0') ORDER BY tag LIMIT 10")
def tag_prefix(spark, sf_dir):
    return P.nodes(spark, sf_dir).where(F.col("tag").startswith("GV-0")).select("tag").orderBy("tag").limit(10)


@query("jn20_found_missing_tags", with_sql("nodes") + """, asked AS (SELECT 'P-' || lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0') || '-' || p_partkey AS tag FROM part WHERE p_partkey % 3 = 0)
SELECT a.tag, n.node IS NOT NULL AS found FROM asked a LEFT JOIN nodes n USING (tag)""")
def found_missing_tags(spark, sf_dir):
    k = F.col("p_partkey")
    asked = P.read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat_ws("-", F.lit("P"), F.lpad((k % 25).cast("string"), 2, "0"), k.cast("string")).alias("tag"))
    return asked.join(P.nodes(spark, sf_dir).select("tag", "node"), "tag", "left").select("tag", F.col("node").isNotNull().alias("found"))


# --- walks

WALK = """walk(start, node, hops) AS (
  SELECT node, node, 0 FROM starts UNION SELECT w.start, {to}, w.hops + 1 FROM walk w JOIN {edges} e ON {at} = w.node WHERE w.hops < {depth}{more})"""
DOWN = {"edges": "flow", "at": "e.src", "to": "e.dst"}
UP = {"edges": "flow", "at": "e.dst", "to": "e.src"}


def _starts(nodes: DataFrame, condition: str) -> DataFrame:
    return nodes.where(condition).select(F.col("node").alias("start"))


@query("gr1_closure_down", with_sql("nodes", "flow", recursive="starts AS (SELECT node FROM nodes WHERE node IN ('p5', 'p40', 'p97')), " + WALK.format(**DOWN, depth=30, more="")) + "SELECT start, node, min(hops) AS hops FROM walk WHERE start <> node GROUP BY ALL")
def closure_down(spark, sf_dir, items=("p5", "p40", "p97")):
    """All that some items reach."""
    nodes = P.nodes(spark, sf_dir)
    starts = nodes.where(F.col("node").isin(*items)).select(F.col("node").alias("start"))
    return traverse.closure(P.flow(spark, sf_dir), starts, "down").select("start", "node", "hops")


@query("gr1_closure_stops", with_sql("nodes", "flow", recursive="starts AS (SELECT node FROM nodes WHERE kind = 'equipment'), " + WALK.format(**DOWN, depth=30, more=" AND (w.node = w.start OR w.node NOT IN (SELECT node FROM nodes WHERE kind = 'valve'))")) + """SELECT start, count(DISTINCT node) AS n, count(DISTINCT CASE WHEN node IN (SELECT node FROM nodes WHERE kind = 'valve') THEN node END) AS n_stopped FROM walk WHERE start <> node GROUP BY 1""")
def closure_stops(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir)
    reached = traverse.closure(P.flow(spark, sf_dir), _starts(nodes, "kind = 'equipment'"), "down", stop=nodes.where("kind = 'valve'"))
    return reached.groupBy("start").agg(F.count("*").alias("n"), F.count_if("stopped").alias("n_stopped"))


@query("gr1_closure_in_unit", with_sql("nodes", "flow", recursive="starts AS (SELECT node FROM nodes WHERE kind = 'equipment'), inside AS (SELECT src, dst FROM flow JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.unit IN ('U00', 'U01', 'U02', 'U03', 'U04') AND b.unit IN ('U00', 'U01', 'U02', 'U03', 'U04')), " + WALK.format(edges="inside", at="e.src", to="e.dst", depth=30, more="")) + "SELECT start, node, min(hops) AS hops FROM walk WHERE start <> node GROUP BY ALL")
def closure_in_unit(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir)
    inside = nodes.where(F.col("unit").isin("U00", "U01", "U02", "U03", "U04"))
    starts = inside.where("kind = 'equipment'").select(F.col("node").alias("start"))
    return traverse.closure(P.flow(spark, sf_dir), starts, "down", walk=inside).select("start", "node", "hops")


@query("gr1_ends_and_cuts", with_sql("nodes", "flow", recursive="starts AS (SELECT node FROM nodes WHERE node IN ('p1', 'p2')), " + WALK.format(**DOWN, depth=4, more="")) + """, r AS (SELECT start, node, min(hops) AS hops FROM walk WHERE start <> node GROUP BY ALL)
SELECT start, node, 'end' AS mark FROM r WHERE node NOT IN (SELECT src FROM flow)
UNION ALL SELECT DISTINCT r.start, r.node, 'cut' FROM r JOIN flow f ON f.src = r.node WHERE r.hops = 4 AND f.dst <> r.start AND NOT EXISTS (SELECT 1 FROM r x WHERE x.start = r.start AND x.node = f.dst)""")
def ends_and_cuts(spark, sf_dir, items=("p1", "p2")):
    """Where walks of 4 hops from some items end, and where they are cut."""
    flow = P.flow(spark, sf_dir)
    starts = P.nodes(spark, sf_dir).where(F.col("node").isin(*items)).select(F.col("node").alias("start"))
    reached = traverse.closure(flow, starts, "down", max_hops=4)
    ends = traverse.boundary(reached, flow, "down").select("start", "node", F.lit("end").alias("mark"))
    return ends.unionByName(traverse.cut_by_hops(reached, flow, "down", 4).withColumn("mark", F.lit("cut")))


@query("gr2_steps", with_sql("nodes", "flow", "edges") + """SELECT n.node AS start, CASE WHEN e.src = n.node THEN e.dst ELSE e.src END AS node, e.src, e.dst, e.relation FROM nodes n JOIN edges e ON e.src = n.node OR e.dst = n.node WHERE n.kind = 'valve'""")
def steps(spark, sf_dir):
    return traverse.steps(P.edges(spark, sf_dir), _starts(P.nodes(spark, sf_dir), "kind = 'valve'"), "both")


RANKED = """tree(node, hops, tags, path) AS (
  SELECT node, 0, [coalesce(tag, node)], [node] FROM nodes WHERE node = '{start}'
  UNION ALL SELECT f.dst, t.hops + 1, list_append(t.tags, coalesce(n.tag, n.node)), list_append(t.path, f.dst) FROM tree t JOIN flow f ON f.src = t.node JOIN nodes n ON n.node = f.dst WHERE t.hops < 20 AND NOT list_contains(t.path, f.dst)),
shortest AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, tags, path) AS n FROM tree)"""


@query("gr3_shortest_path", with_sql("nodes", "flow", recursive=RANKED.format(start="p3")) + "SELECT 'p3' AS start, node, array_to_string(path, '>') AS path, hops FROM shortest WHERE n = 1 AND node IN (SELECT node FROM nodes WHERE unit = 'U07' AND kind = 'equipment') AND node <> 'p3'")
def shortest_path(spark, sf_dir, start="p3", unit="U07"):
    """Routes from an item to all equipment of a unit."""
    nodes = P.nodes(spark, sf_dir)
    asked = nodes.where((F.col("unit") == unit) & (F.col("kind") == "equipment") & (F.col("node") != start)).select(F.lit(start).alias("start"), "node")
    found = traverse.routes(P.flow(spark, sf_dir), asked, F.coalesce("tag", "node"), nodes)
    return found.select("start", "node", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))


@query("gr4_reach_with_crossings", with_sql("nodes", "flow", recursive=RANKED.format(start="p1")) + """, c AS (SELECT node, hops, list_sum(list_transform(range(1, len(path)), lambda i: CASE WHEN CAST(path[i][2:] AS BIGINT) % 25 <> CAST(path[i + 1][2:] AS BIGINT) % 25 THEN 1 ELSE 0 END)) AS k FROM shortest WHERE n = 1 AND hops > 0)
SELECT 'p1' AS start, node, hops, CAST(k AS BIGINT) AS k FROM c""")
def reach_with_crossings(spark, sf_dir, start="p1"):
    """The tree of shortest routes from an item, with the changes of unit on the way."""
    nodes, flow = P.nodes(spark, sf_dir), P.flow(spark, sf_dir)
    units = nodes.select("node", "unit")
    weight = flow.join(units.toDF("src", "us"), "src").join(units.toDF("dst", "ud"), "dst").select("src", "dst", (F.col("us") != F.col("ud")).cast("int").alias("w"))
    tree = traverse.layered(flow, spark.createDataFrame([(start,)], "start string"), F.coalesce("tag", "node"), nodes, weight=weight)
    return tree.where("hops > 0").select("start", "node", "hops", F.col("weight").cast("long").alias("k"))


FOLD = """fold(source, spot, route, tags, depth) AS (
  SELECT node, node, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0 FROM nodes WHERE kind IN ('equipment', 'valve')
  UNION ALL SELECT f.source, e.dst, list_append(f.route, e.dst), CASE WHEN n.tag IS NULL THEN f.tags ELSE list_append(f.tags, n.tag) END, f.depth + 1
  FROM fold f JOIN flow e ON e.src = f.spot JOIN nodes n ON n.node = e.dst WHERE n.kind NOT IN ('equipment', 'valve') AND NOT list_contains(f.route, e.dst) AND f.depth < 12),
line AS (
  SELECT source, target, via_tags, n_fittings FROM (
    SELECT f.source, e.dst AS target, array_to_string(f.tags, ',') AS via_tags, len(f.route) - len(f.tags) AS n_fittings,
      row_number() OVER (PARTITION BY f.source, e.dst ORDER BY f.depth, f.route) AS n FROM fold f JOIN flow e ON e.src = f.spot WHERE e.dst IN """ + ITEMS + """ AND e.dst <> f.source) x WHERE n = 1)"""


def lines(spark, sf_dir) -> DataFrame:
    nodes = P.nodes(spark, sf_dir)
    return traverse.fold_lines(P.flow(spark, sf_dir), nodes, nodes.where(F.col("node_class").isin(*LINE_ITEMS)))


@query("gr6_line_fold", with_sql("nodes", "flow", recursive=FOLD) + "SELECT source, target, via_tags, n_fittings FROM line")
def line_fold(spark, sf_dir):
    return lines(spark, sf_dir).select("source", "target", F.array_join("via_tags", ",").alias("via_tags"), F.col("n_fittings").cast("long").alias("n_fittings"))


@query("gr7_line_ends", with_sql("nodes", "flow", recursive=FOLD) + """SELECT node, node NOT IN (SELECT target FROM line) AS no_inflow, node NOT IN (SELECT source FROM line) AS no_outflow FROM nodes
WHERE kind IN ('equipment', 'valve') AND (node NOT IN (SELECT target FROM line) OR node NOT IN (SELECT source FROM line))""")
def line_ends(spark, sf_dir):
    items = P.nodes(spark, sf_dir).where(F.col("node_class").isin(*LINE_ITEMS))
    return traverse.line_ends(items, lines(spark, sf_dir))


ISOLATE = """starts AS (SELECT node FROM nodes WHERE kind = 'equipment'), operated AS (SELECT node FROM nodes WHERE node_class IN ('GlobeValve', 'BallValve')),
walk(start, node) AS (SELECT node, node FROM starts UNION SELECT w.start, {to} FROM walk w JOIN flow e ON {at} = w.node WHERE w.node = w.start OR w.node NOT IN (SELECT node FROM operated)),
dead AS (SELECT DISTINCT start FROM walk WHERE (node = start OR node NOT IN (SELECT node FROM operated)) AND node NOT IN (SELECT {from_} FROM flow e))
SELECT start AS item, string_agg(DISTINCT node, ',' ORDER BY node) AS valves FROM walk WHERE node <> start AND node IN (SELECT node FROM operated) AND start NOT IN (SELECT start FROM dead) GROUP BY 1"""


def _isolation(spark, sf_dir, direction):
    nodes = P.nodes(spark, sf_dir)
    found = traverse.isolation(P.flow(spark, sf_dir), nodes.where(F.col("node_class").isin(*EQUIPMENT)), nodes.where(F.col("node_class").isin(*OPERATED)), direction)
    return found.groupBy(F.col("start").alias("item")).agg(joined("node").alias("valves"))


@query("q07_upstream_isolation", with_sql("nodes", "flow", recursive=ISOLATE.format(to="e.src", at="e.dst", from_="e.dst")))
def upstream_isolation(spark, sf_dir):
    return _isolation(spark, sf_dir, "up")


@query("q20_downstream_isolation", with_sql("nodes", "flow", recursive=ISOLATE.format(to="e.dst", at="e.src", from_="e.src")))
def downstream_isolation(spark, sf_dir):
    return _isolation(spark, sf_dir, "down")



ALL_DOWN = "starts AS (SELECT node FROM nodes WHERE kind = 'equipment'), reach(start, node) AS (SELECT node, node FROM starts UNION SELECT r.start, e.dst FROM reach r JOIN flow e ON e.src = r.node)"
ALL_UP = "starts AS (SELECT node FROM nodes WHERE kind = 'equipment'), reach(start, node) AS (SELECT node, node FROM starts UNION SELECT r.start, e.src FROM reach r JOIN flow e ON e.dst = r.node)"


@query("gr23_unreachable", with_sql("nodes", "flow", recursive=ALL_DOWN) + "SELECT s.node AS start, (SELECT count(*) FROM starts) - 1 - (SELECT count(*) FROM reach r WHERE r.start = s.node AND r.node <> s.node AND r.node IN (SELECT node FROM starts)) AS n_unreachable FROM starts s")
def unreachable(spark, sf_dir):
    """How many equipment items each equipment item does not reach: all there are, less what it reaches."""
    items = P.nodes(spark, sf_dir).where("kind = 'equipment'").select("node")
    n = items.count()
    reached = traverse.reached_values(P.flow(spark, sf_dir), items.select(F.col("node").alias("start")), items.withColumn("value", F.lit("")))
    return reached.select("start", (F.lit(n - 1) - F.col("n")).alias("n_unreachable"))


@query("gr24_nearest_owner", with_sql("nodes", "flow", recursive="""twoway AS (SELECT src, dst FROM flow UNION SELECT dst, src FROM flow),
own(node, hops) AS (SELECT node, 0 FROM nodes WHERE node_class = 'Tank' UNION SELECT b.dst, o.hops + 1 FROM own o JOIN twoway b ON b.src = o.node WHERE o.hops < 16)""") + "SELECT n.node, min(o.hops) AS hops FROM nodes n LEFT JOIN own o USING (node) GROUP BY 1")
def nearest_owner(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir)
    return traverse.nearest_owners(P.flow(spark, sf_dir), nodes, nodes.where("node_class = 'Tank'")).select("node", "hops")


@query("gr20_valve_ranges", with_sql("nodes", "flow", recursive="""walk(node, hops, n) AS (
  SELECT 'p1', 0, 0 UNION SELECT f.dst, w.hops + 1, w.n + CASE WHEN w.node <> 'p1' AND w.node IN (SELECT node FROM nodes WHERE kind = 'valve') THEN 1 ELSE 0 END FROM walk w JOIN flow f ON f.src = w.node WHERE w.hops < 20),
least AS (SELECT node, min(hops) AS hops FROM walk GROUP BY 1)""") + "SELECT node, min(n) AS low, max(n) AS high FROM walk JOIN least USING (node, hops) WHERE node <> 'p1' GROUP BY 1")
def valve_ranges(spark, sf_dir, start="p1"):
    """How many valves lie on the shortest routes from an item, at least and at most."""
    valves = P.nodes(spark, sf_dir).where("kind = 'valve'")
    return traverse.valve_ranges(P.flow(spark, sf_dir), spark.createDataFrame([(start,)], "start string"), valves).select("node", "low", "high")


@query("gr21_route_avoiding", with_sql("nodes", "flow", recursive="""cut AS (SELECT node FROM nodes WHERE kind = 'valve' AND node <> 'p0'),
walk(removed, node) AS (SELECT node, 'p0' FROM cut UNION SELECT w.removed, f.dst FROM walk w JOIN flow f ON f.src = w.node WHERE f.dst <> w.removed)""") + "SELECT removed, count(*) - 1 AS n_reached FROM walk GROUP BY 1")
def route_avoiding(spark, sf_dir, source="p0"):
    """What an item still reaches without each valve there is."""
    nodes, flow = P.nodes(spark, sf_dir), P.flow(spark, sf_dir)
    asked = nodes.where((F.col("kind") == "valve") & (F.col("node") != source)).select(F.col("node").alias("removed"), F.array().cast("array<string>").alias("targets"))
    return traverse.routes_without(flow, asked, source).select("removed", "n_reached")


@query("q19_first_meeting_points", with_sql("nodes", "flow", recursive="starts AS (SELECT node FROM nodes WHERE node_class IN ('Tank', 'PressureVessel')), every(start, node) AS (SELECT node, node FROM nodes WHERE node LIKE 'p%' UNION SELECT r.start, e.dst FROM every r JOIN flow e ON e.src = r.node)") + """,
size AS (SELECT start AS node, count(*) AS n FROM every GROUP BY 1), reach AS (SELECT start, node FROM every WHERE start IN (SELECT node FROM starts) AND start <> node),
common AS (SELECT a.start AS first, b.start AS second, count(*) AS n FROM reach a JOIN reach b USING (node) WHERE a.start < b.start GROUP BY ALL),
apart AS (SELECT * FROM common c WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.start = c.first AND r.node = c.second) AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.start = c.second AND r.node = c.first)),
able AS (SELECT p.first, p.second, s.node FROM apart p JOIN size s ON s.n = p.n JOIN reach a ON a.start = p.first AND a.node = s.node JOIN reach b ON b.start = p.second AND b.node = s.node WHERE s.node IN (SELECT node FROM nodes WHERE kind IN ('equipment', 'valve')))
SELECT first, second, max(node) AS meeting FROM able GROUP BY ALL HAVING count(*) = 1""")
def first_meeting_points(spark, sf_dir):
    """What two items both reach is closed under reach: a member reaches all of it if it reaches as many nodes (SQL)."""
    nodes, flow = P.nodes(spark, sf_dir), P.flow(spark, sf_dir)
    starts = nodes.where("node_class in ('Tank', 'PressureVessel')").select(F.col("node").alias("start"))
    return traverse.meeting_points(flow, starts, nodes.where(F.col("node_class").isin(*LINE_ITEMS)).select("node"))


@query("gr36_unit_inheritance", with_sql("nodes", "flow", recursive="""single AS (SELECT dst, min(src) AS src FROM flow GROUP BY dst HAVING count(*) = 1),
up(valve, node, depth) AS (SELECT node, node, 0 FROM nodes WHERE kind = 'valve' UNION ALL SELECT u.valve, s.src, u.depth + 1 FROM up u JOIN single s ON s.dst = u.node WHERE u.depth < 30 AND (u.depth = 0 OR u.node NOT IN (SELECT node FROM nodes WHERE kind = 'equipment')))""") + "SELECT valve, owner, unit FROM (SELECT u.valve, u.node AS owner, n.unit, row_number() OVER (PARTITION BY valve ORDER BY depth) AS r FROM up u JOIN nodes n USING (node) WHERE n.kind = 'equipment') x WHERE r = 1")
def unit_inheritance(spark, sf_dir):
    nodes, flow = P.nodes(spark, sf_dir), P.flow(spark, sf_dir)
    single = flow.groupBy("dst").agg(F.min("src").alias("src"), F.count("*").alias("n")).where("n = 1").select("src", "dst")
    equipment = nodes.where("kind = 'equipment'")
    reached = traverse.closure(single, _starts(nodes, "kind = 'valve'"), "up", stop=equipment)
    return reached.where("stopped").join(nodes.select("node", "unit"), "node").select(F.col("start").alias("valve"), F.col("node").alias("owner"), "unit")


# --- question families


@query("q01_lookup_type", with_sql("nodes") + "SELECT tag, node_class FROM nodes WHERE tag IS NOT NULL")
def lookup_type(spark, sf_dir):
    return P.nodes(spark, sf_dir).where("tag is not null").select("tag", "node_class")


@query("q02_lookup_unit", with_sql("nodes") + "SELECT tag, unit FROM nodes WHERE tag IS NOT NULL AND unit IS NOT NULL")
def lookup_unit(spark, sf_dir):
    return P.nodes(spark, sf_dir).where("tag is not null and unit is not null").select("tag", "unit")


@query("q03_neighbours_downstream", with_sql("nodes", "flow", recursive=FOLD) + "SELECT s.tag, string_agg(DISTINCT t.tag, ',' ORDER BY t.tag) AS answer FROM line l JOIN nodes s ON s.node = l.source JOIN nodes t ON t.node = l.target GROUP BY 1")
def neighbours_downstream(spark, sf_dir):
    tags = P.nodes(spark, sf_dir).select("node", "tag")
    e = lines(spark, sf_dir).join(tags.toDF("source", "tag"), "source").join(tags.toDF("target", "t"), "target")
    return e.groupBy("tag").agg(joined("t").alias("answer"))


LOOP = """loop AS (SELECT c.node, c.tag, v.tag AS valve FROM nodes c JOIN edges s ON s.src = c.node AND s.relation = 'send_signal_to' JOIN edges d ON d.src = s.dst AND d.relation = 'control' JOIN nodes v ON v.node = d.dst WHERE c.node_class = 'ProcessControlFunction')"""


@query("q04_loop_actuated_valve", with_sql("nodes", "flow", "edges", recursive=LOOP) + "SELECT tag, max(valve) AS answer FROM loop GROUP BY node, tag HAVING count(*) = 1 AND max(valve) IS NOT NULL")
def loop_actuated_valve(spark, sf_dir):
    nodes, edges = P.nodes(spark, sf_dir), P.edges(spark, sf_dir)
    signal = edges.where("relation = 'send_signal_to'").select(F.col("src").alias("node"), F.col("dst").alias("actuator"))
    drives = edges.where("relation = 'control'").select(F.col("src").alias("actuator"), F.col("dst").alias("valve"))
    valve = nodes.select(F.col("node").alias("valve"), F.col("tag").alias("answer"))
    found = nodes.where("node_class = 'ProcessControlFunction'").join(signal, "node").join(drives, "actuator").join(valve, "valve")
    return found.groupBy("node", "tag").agg(F.count("*").alias("n"), F.max("answer").alias("answer")).where("n = 1 and answer is not null").select("tag", "answer")


@query("q05_loop_measured_equipment", with_sql("nodes", "flow", "edges") + """SELECT c.tag, max(m.tag) AS answer FROM nodes c JOIN edges s ON s.dst = c.node AND s.relation = 'send_signal_to' JOIN edges d ON d.dst = s.src AND d.relation = 'measured_by' JOIN nodes m ON m.node = d.src
WHERE c.node_class = 'ProcessControlFunction' AND m.kind = 'equipment' GROUP BY c.node, c.tag HAVING count(*) = 1""")
def loop_measured_equipment(spark, sf_dir):
    nodes, edges = P.nodes(spark, sf_dir), P.edges(spark, sf_dir)
    signal = edges.where("relation = 'send_signal_to'").select(F.col("dst").alias("node"), F.col("src").alias("sensor"))
    sensed = edges.where("relation = 'measured_by'").select(F.col("dst").alias("sensor"), F.col("src").alias("item"))
    item = nodes.where("kind = 'equipment'").select(F.col("node").alias("item"), F.col("tag").alias("answer"))
    found = nodes.where("node_class = 'ProcessControlFunction'").join(signal, "node").join(sensed, "sensor").join(item, "item")
    return found.groupBy("node", "tag").agg(F.count("*").alias("n"), F.max("answer").alias("answer")).where("n = 1").select("tag", "answer")


@query("q08_cross_unit", with_sql("nodes", "flow") + "SELECT s.unit, string_agg(DISTINCT d.unit, ',' ORDER BY d.unit) AS answer FROM flow JOIN nodes s ON s.node = src JOIN nodes d ON d.node = dst WHERE s.unit <> d.unit GROUP BY 1")
def cross_unit(spark, sf_dir):
    units = P.nodes(spark, sf_dir).select("node", "unit")
    e = P.flow(spark, sf_dir).join(units.toDF("src", "unit"), "src").join(units.toDF("dst", "d"), "dst").where("unit <> d")
    return e.groupBy("unit").agg(joined("d").alias("answer"))


@query("q22_feeding_units", with_sql("nodes", "flow") + "SELECT d.unit, string_agg(DISTINCT s.unit, ',' ORDER BY s.unit) AS answer FROM flow JOIN nodes s ON s.node = src JOIN nodes d ON d.node = dst WHERE s.unit <> d.unit GROUP BY 1")
def feeding_units(spark, sf_dir):
    units = P.nodes(spark, sf_dir).select("node", "unit")
    e = P.flow(spark, sf_dir).join(units.toDF("src", "s"), "src").join(units.toDF("dst", "unit"), "dst").where("unit <> s")
    return e.groupBy("unit").agg(joined("s").alias("answer"))


@query("q09_count_in_unit", with_sql("nodes") + "SELECT unit, node_class, lower(regexp_replace(node_class, '([a-z])([A-Z])', '\\1 \\2', 'g')) || 's' AS plural, count(*) AS answer FROM nodes WHERE kind IN ('equipment', 'valve') GROUP BY ALL")
def count_in_unit(spark, sf_dir):
    return P.nodes(spark, sf_dir).where("kind in ('equipment', 'valve')").groupBy("unit", "node_class").agg(F.count("*").alias("answer")).select("unit", "node_class", class_plural("node_class").alias("plural"), "answer")


@query("q10_unanswerable_tags", with_sql("nodes") + """, parts AS (SELECT tag, regexp_extract(tag, '^([A-Z]+)-', 1) AS prefix, regexp_extract(tag, '-([0-9]+)-', 1) AS unit, CAST(regexp_extract(tag, '-([0-9]+)$', 1) AS BIGINT) AS number FROM nodes WHERE regexp_matches(tag, '^[A-Z]+-[0-9]+-[0-9]+$')),
top AS (SELECT prefix, unit, max(number) AS highest FROM parts GROUP BY ALL)
SELECT prefix || '-' || unit || '-' || (highest + 7) AS tag FROM top WHERE prefix || '-' || unit || '-' || (highest + 7) NOT IN (SELECT tag FROM nodes WHERE tag IS NOT NULL)""")
def unanswerable_tags(spark, sf_dir):
    tags = P.nodes(spark, sf_dir).where("tag is not null").select("tag")
    top = tags.select(tag_parts("tag").alias("p")).where("p is not null").groupBy("p.prefix", "p.unit").agg(F.max("p.number").alias("highest"))
    made = top.select(F.concat_ws("-", "prefix", "unit", (F.col("highest") + 7).cast("string")).alias("tag"))
    return made.join(tags, "tag", "left_anti")


@query("q12_sheets_of_tag", with_sql("nodes", "drawings") + "SELECT tag, string_agg(DISTINCT sheet, ',' ORDER BY sheet) AS answer FROM nodes JOIN drawings USING (node) WHERE kind = 'equipment' GROUP BY 1")
def sheets_of_tag(spark, sf_dir):
    return P.nodes(spark, sf_dir).where("kind = 'equipment'").join(P.drawings(spark, sf_dir), "node").groupBy("tag").agg(joined("sheet").alias("answer"))


@query("q13_connected", with_sql("nodes", "flow", recursive=ALL_DOWN) + "SELECT a.tag AS source, b.tag AS target, EXISTS (SELECT 1 FROM reach r WHERE r.start = a.node AND r.node = b.node) AS answer FROM nodes a JOIN nodes b ON CAST(b.node[2:] AS BIGINT) = CAST(a.node[2:] AS BIGINT) * 3 + 8 WHERE a.kind = 'equipment' AND b.kind = 'equipment'")
def connected(spark, sf_dir):
    items = P.nodes(spark, sf_dir).where("kind = 'equipment'").select("node", "tag", F.substring("node", 2, 20).cast("long").alias("k"))
    pairs = items.select(F.col("node").alias("start"), F.col("tag").alias("source"), (F.col("k") * 3 + 8).alias("k")).join(items.select("node", F.col("tag").alias("target"), "k"), "k")
    reached = traverse.reached_pairs(P.flow(spark, sf_dir), pairs)
    return pairs.join(reached, ["start", "node"]).select("source", "target", F.col("reached").alias("answer"))


@query("q14_downstream_in_unit", with_sql("nodes", "flow", recursive=ALL_DOWN) + "SELECT s.tag, string_agg(DISTINCT t.tag, ',' ORDER BY t.tag) AS answer FROM reach r JOIN nodes s ON s.node = r.start JOIN nodes t ON t.node = r.node WHERE r.start <> r.node AND t.unit = s.unit AND t.kind = 'equipment' GROUP BY 1")
def downstream_in_unit(spark, sf_dir):
    items = P.nodes(spark, sf_dir).where("kind = 'equipment'").select("node", "tag", "unit")
    found = traverse.reached_values(P.flow(spark, sf_dir), items.select(F.col("node").alias("start")), items.select("node", F.col("tag").alias("value"), F.col("unit").alias("group")), same=True)
    return found.where("size(values) > 0").join(items.select(F.col("node").alias("start"), "tag"), "start").select("tag", F.array_join("values", ",").alias("answer"))


@query("q15_instruments_of_item", with_sql("nodes", "flow", "edges") + "SELECT m.tag, string_agg(DISTINCT i.tag, ',' ORDER BY i.tag) AS answer FROM edges e JOIN nodes m ON m.node = e.src JOIN nodes i ON i.node = e.dst WHERE e.relation = 'measured_by' AND m.tag IS NOT NULL GROUP BY 1")
def instruments_of_item(spark, sf_dir):
    tags = P.nodes(spark, sf_dir).where("tag is not null").select("node", "tag")
    e = P.edges(spark, sf_dir).where("relation = 'measured_by'").join(tags.toDF("src", "tag"), "src").join(tags.toDF("dst", "i"), "dst")
    return e.groupBy("tag").agg(joined("i").alias("answer"))


@query("q16_upstream_sources", with_sql("nodes", "flow", recursive=ALL_UP) + "SELECT s.tag, string_agg(DISTINCT r.node, ',' ORDER BY r.node) AS answer FROM reach r JOIN nodes s ON s.node = r.start WHERE r.node <> r.start AND r.node NOT IN (SELECT dst FROM flow WHERE src <> dst) GROUP BY 1")
def upstream_sources(spark, sf_dir):
    flow, nodes = P.flow(spark, sf_dir), P.nodes(spark, sf_dir)
    fed = flow.where("src <> dst").select(F.col("dst").alias("node")).distinct()
    first = nodes.select("node").join(fed, "node", "left_anti").select("node", F.col("node").alias("value"))
    items = nodes.where("kind = 'equipment'").select(F.col("node").alias("start"), "tag")
    found = traverse.reached_values(flow, items, first, "up")
    return found.where("n > 0").join(items, "start").select("tag", F.array_join("values", ",").alias("answer"))


@query("q18_loops_near_item", with_sql("nodes", "flow", "edges", recursive=FOLD) + """, near AS (SELECT source AS item, target AS valve FROM line UNION SELECT target, source FROM line)
SELECT m.tag, string_agg(DISTINCT c.tag, ',' ORDER BY c.tag) AS answer FROM near n JOIN nodes m ON m.node = n.item JOIN edges d ON d.dst = n.valve AND d.relation = 'control' JOIN edges s ON s.dst = d.src AND s.relation = 'send_signal_to' JOIN nodes c ON c.node = s.src WHERE m.kind = 'equipment' GROUP BY 1""")
def loops_near_item(spark, sf_dir):
    nodes, edges, line = P.nodes(spark, sf_dir), P.edges(spark, sf_dir), lines(spark, sf_dir)
    near = line.select(F.col("source").alias("item"), F.col("target").alias("valve")).unionByName(line.select(F.col("target").alias("item"), F.col("source").alias("valve"))).distinct()
    drives = edges.where("relation = 'control'").select(F.col("src").alias("actuator"), F.col("dst").alias("valve"))
    signal = edges.where("relation = 'send_signal_to'").select(F.col("src").alias("c"), F.col("dst").alias("actuator"))
    found = near.join(drives, "valve").join(signal, "actuator").join(nodes.select(F.col("node").alias("c"), F.col("tag").alias("loop")), "c").join(nodes.where("kind = 'equipment'").select(F.col("node").alias("item"), "tag"), "item")
    return found.groupBy("tag").agg(joined("loop").alias("answer"))


@query("q21_valves_on_path", with_sql("nodes", "flow", recursive="""starts AS (SELECT node FROM nodes WHERE kind = 'equipment'),
walk(start, node, hops, n) AS (SELECT node, node, 0, 0 FROM starts UNION SELECT w.start, f.dst, w.hops + 1, w.n + CASE WHEN w.node <> w.start AND w.node IN (SELECT node FROM nodes WHERE kind = 'valve') THEN 1 ELSE 0 END FROM walk w JOIN flow f ON f.src = w.node WHERE w.hops < 40),
least AS (SELECT start, node, min(hops) AS hops FROM walk GROUP BY ALL)""") + "SELECT start, node, min(n) AS answer FROM walk JOIN least USING (start, node, hops) JOIN nodes t USING (node) WHERE node <> start AND t.kind = 'equipment' GROUP BY ALL HAVING min(n) = max(n)")
def valves_on_path(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir)
    equipment = nodes.where("kind = 'equipment'").select("node")
    ranges = traverse.valve_ranges(P.flow(spark, sf_dir), equipment.select(F.col("node").alias("start")), nodes.where("kind = 'valve'")).where("low = high")
    return ranges.join(equipment, "node", "left_semi").select("start", "node", F.col("low").alias("answer"))


@query("q23_units_reached", with_sql("nodes", "flow", recursive=ALL_DOWN) + "SELECT s.tag, count(DISTINCT t.unit) AS answer FROM reach r JOIN nodes s ON s.node = r.start JOIN nodes t ON t.node = r.node WHERE t.unit IS NOT NULL AND t.unit <> s.unit GROUP BY 1")
def units_reached(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir)
    items = nodes.where("kind = 'equipment'").select(F.col("node").alias("start"), "tag", "unit")
    found = traverse.reached_values(P.flow(spark, sf_dir), items, nodes.select("node", F.col("unit").alias("value")))
    others = found.join(items, "start").select("tag", F.size(F.array_except("values", F.array("unit"))).cast("long").alias("answer"))
    return others.where("answer > 0")


@query("q25_crossings", with_sql("nodes", "flow", "drawings") + """, home AS (SELECT node, min(sheet) AS sheet FROM drawings GROUP BY 1)
SELECT s.unit, count(*) AS edges, sum(CASE WHEN a.sheet <> b.sheet THEN 1 ELSE 0 END) AS k, sum(CASE WHEN s.unit <> d.unit THEN 1 ELSE 0 END) AS u
FROM flow JOIN home a ON a.node = src JOIN home b ON b.node = dst JOIN nodes s ON s.node = src JOIN nodes d ON d.node = dst GROUP BY 1""")
def crossings(spark, sf_dir):
    home = P.drawings(spark, sf_dir).groupBy("node").agg(F.min("sheet").alias("sheet")).join(P.nodes(spark, sf_dir).select("node", "unit"), "node")
    e = P.flow(spark, sf_dir).join(home.toDF("src", "sa", "unit"), "src").join(home.toDF("dst", "sb", "ub"), "dst")
    return e.groupBy("unit").agg(F.count("*").alias("edges"), F.count_if(F.col("sa") != F.col("sb")).alias("k"), F.count_if(F.col("unit") != F.col("ub")).alias("u"))


BINS = "CASE WHEN k IS NULL THEN 'unanswerable' WHEN k < 3 THEN CAST(k AS VARCHAR) WHEN k <= 4 THEN '3-4' WHEN k <= 8 THEN '5-8' WHEN k <= 16 THEN '9-16' WHEN k <= 32 THEN '17-32' ELSE '33+' END"


@query("q28_availability", with_sql("runs") + f""", f AS (SELECT DISTINCT family FROM runs), b AS (SELECT unnest(['0', '1', '2', '3-4', '5-8', '9-16', '17-32', '33+', 'unanswerable']) AS k_bin),
c AS (SELECT family, {BINS} AS k_bin, count(*) AS n FROM runs GROUP BY ALL)
SELECT family, k_bin, coalesce(n, 0) AS n, coalesce(n, 0) >= 97 AS powered FROM f CROSS JOIN b LEFT JOIN c USING (family, k_bin)""")
def availability(spark, sf_dir):
    counted = P.runs(spark, sf_dir).groupBy("family", k_bin("k").alias("k_bin")).agg(F.count("*").alias("n"))
    bins = ["0", "1", "2", "3-4", "5-8", "9-16", "17-32", "33+", "unanswerable"]
    cells = counted.select("family").distinct().withColumn("k_bin", F.explode(F.array(*map(F.lit, bins))))
    n = F.coalesce("n", F.lit(0))
    return cells.join(counted, ["family", "k_bin"], "left").select("family", "k_bin", n.alias("n"), (n >= 97).alias("powered"))


def plant_api(spark, sf_dir):
    """The query surface over the driver's plant; an item is on the sheets it is drawn on."""
    from ..api import PlantApi

    sheets = P.drawings(spark, sf_dir).groupBy("node").agg(F.array_sort(F.collect_set("sheet")).alias("sheets"))
    none = F.array().cast("array<string>")
    items = P.nodes(spark, sf_dir).join(F.broadcast(class_dim(spark).select("node_class", "labels")), "node_class").join(sheets, "node", "left")
    return PlantApi(items.select(F.col("node").alias("item"), "tag", "node_class", "labels", "unit", F.coalesce("sheets", none).alias("sheets"), "kind"), P.edges(spark, sf_dir))


@query("api1_find", with_sql("nodes") + "SELECT node, tag, (SELECT count(*) FROM nodes WHERE node_class = 'Tank') AS total FROM nodes WHERE node_class = 'Tank' ORDER BY coalesce(tag, ''), node LIMIT 50")
def find(spark, sf_dir, node_class="tank"):
    """The first items of a class as the query surface lists them, and how many there are."""
    _, listed, total = plant_api(spark, sf_dir).find(node_class=node_class)
    return spark.createDataFrame([(r["item"], r["tag"], total) for r in listed], "node string, tag string, total long")


@query("api6_aggregate_by_sheet", with_sql("nodes", "drawings") + """SELECT sheet AS grp, count(*) AS n, array_to_string(list_slice(list(coalesce(tag, '') ORDER BY coalesce(tag, ''), node), 1, 5), ',') AS first_tags
FROM nodes JOIN drawings USING (node) WHERE kind = 'equipment' GROUP BY 1 ORDER BY n DESC, grp LIMIT 50""")
def aggregate_by_sheet(spark, sf_dir):
    """The sheets with most equipment, as the query surface groups them."""
    api = plant_api(spark, sf_dir)
    found, _, _ = api.find(label="Equipment")
    return spark.createDataFrame([(r["grp"], r["n"], ",".join(r["first_tags"])) for r in api.aggregate(found, "sheet")], "grp string, n long, first_tags string")


@query("api6_aggregate_by_unit", with_sql("nodes") + "SELECT coalesce(unit, '(no unit)') AS grp, count(*) AS n FROM nodes WHERE kind = 'equipment' GROUP BY 1")
def aggregate_by_unit(spark, sf_dir):
    api = plant_api(spark, sf_dir)
    found, _, _ = api.find(label="Equipment")
    return spark.createDataFrame([(r["grp"], r["n"]) for r in api.aggregate(found, "unit")], "grp string, n long")


@query("api15_path_counts", with_sql("nodes", "flow", recursive="walk(node, hops, n) AS (SELECT 'p1', 0, 1::HUGEINT UNION ALL SELECT dst, hops, sum(n) FROM (SELECT f.dst, w.hops + 1 AS hops, w.n FROM walk w JOIN flow f ON f.src = w.node WHERE w.hops < 6) x GROUP BY dst, hops)") + "SELECT node, hops, CAST(sum(n) AS BIGINT) AS n_paths FROM walk WHERE hops > 0 GROUP BY ALL")
def path_counts(spark, sf_dir):
    return traverse.count_walks(P.flow(spark, sf_dir), spark.createDataFrame([("p1",)], "node string"), 6)


@query("wn2_consecutive_turns", "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def consecutive_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return P.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"))


@query("sc1_fold_unit", with_sql("nodes") + "SELECT DISTINCT unit, regexp_replace(upper(trim(unit)), '^(UNIT|U)\\s*', '') AS folded FROM nodes WHERE unit IS NOT NULL")
def fold_units(spark, sf_dir):
    return P.nodes(spark, sf_dir).where("unit is not null").select("unit", fold_unit("unit").alias("folded")).distinct()
