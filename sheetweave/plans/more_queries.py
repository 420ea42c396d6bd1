"""Further queries: joins of drawings and answers, merge, invariants, sampling, scoring, decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, stats
from ..operators import blocks, resolve, runs, traverse
from ..schema import EQUIPMENT, class_dim
from . import projection as P
from .catalog import query
from .plant_queries import ALL_DOWN, joined
from .projection import with_sql
from .run_queries import BINS, CUT, TAGGED, equipment_drawings, homes, split_flow, stub_labels

# --- sources, sinks, rules


@query("src5_sheet_adjacency", with_sql("flow", "drawings", recursive=CUT) + "SELECT DISTINCT ss AS sheet, ds AS neighbour FROM cut UNION SELECT DISTINCT ds, ss FROM cut")
def sheet_adjacency(spark, sf_dir):
    sheet = lambda c: F.substring_index(c, ":", 1)
    pairs = split_flow(spark, sf_dir)[2].select(sheet("from_key").alias("a"), sheet("to_key").alias("b"))
    return pairs.select(F.col("a").alias("sheet"), F.col("b").alias("neighbour")).unionByName(pairs.select(F.col("b").alias("sheet"), F.col("a").alias("neighbour"))).distinct()


@query("src8_relabel_unknown", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'Tank' ELSE 'GenericItem' END AS node_class, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS original_class FROM part")
def relabel_unknown(spark, sf_dir):
    from ..sources.files import relabel_unknown as relabel

    named = P.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 == 0, "Tank").otherwise(F.col("p_type")).alias("node_class"))
    return relabel(named, class_dim(spark)).select("k", "node_class", "original_class")


@query("src12_row_keys", with_sql("runs") + "SELECT question, strategy, repeat, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) > 1")
def row_keys(spark, sf_dir):
    return P.runs(spark, sf_dir).groupBy("question", "strategy", "repeat").agg(F.count("*").alias("n")).where("n > 1")


@query("src13_question_digests", "SELECT item_id, sha256(CAST(item_id AS VARCHAR) || chr(10) || text) AS digest FROM benchmark")
def question_digests(spark, sf_dir):
    return P.read(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.concat_ws("\n", F.col("item_id").cast("string"), "text"), 256).alias("digest"))


@query("snk5_graphml_lines", with_sql("flow") + "SELECT '<edge source=\"' || src || '\" target=\"' || dst || '\"><data key=\"relation\">send_to</data></edge>' AS line FROM flow")
def graphml_lines(spark, sf_dir):
    from ..sources.sinks import graphml_lines as render

    none = F.create_map().cast("map<string,string>")
    nodes = spark.createDataFrame([], "node string").withColumn("properties", none)
    edges = P.flow(spark, sf_dir).withColumn("properties", F.create_map(F.lit("relation"), F.lit("send_to"), F.lit("hidden"), F.lit("x")))
    return render(nodes, edges, ("relation",)).where("line like '<edge%'")


@query("snk8_footprint", with_sql("nodes", "flow", "edges") + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS relationships, (SELECT count(tag) + count(unit) FROM nodes) AS properties")
def footprint(spark, sf_dir):
    from ..sources.sinks import footprint as measure

    props = F.map_filter(F.create_map(F.lit("tag"), F.col("tag"), F.lit("unit"), F.col("unit")), lambda k, v: v.isNotNull())
    return measure(P.nodes(spark, sf_dir).withColumn("properties", props), P.edges(spark, sf_dir))


@query("flt5_kind_of", with_sql("nodes") + "SELECT kind, count(*) AS n FROM nodes GROUP BY 1")
def kind_of(spark, sf_dir):
    return P.nodes(spark, sf_dir).select("node_class").join(F.broadcast(class_dim(spark).select("node_class", "kind")), "node_class").groupBy("kind").agg(F.count("*").alias("n"))


@query("flt8_sheet_violations", with_sql("nodes", "drawings") + """, d AS (SELECT sheet || ':' || node AS node, sheet, 'dup-' || CAST(CAST(node[2:] AS BIGINT) // 40 AS VARCHAR) AS tag FROM drawings), f AS (SELECT sheet, tag, min(node) AS first, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1)
SELECT d.node AS subject, d.tag || ' also on ' || f.first AS detail FROM d JOIN f USING (sheet, tag) WHERE d.node <> f.first""")
def sheet_violations(spark, sf_dir):
    from ..operators.filters import plant_violations

    k = F.floor(F.substring("node", 2, 20).cast("long") / 40)
    drawn = P.drawings(spark, sf_dir).select(F.concat_ws(":", "sheet", "node").alias("node"), "sheet", F.concat(F.lit("dup-"), k.cast("string")).alias("tag"), F.lit("Tank").alias("node_class"))
    return plant_violations(drawn, P.edges(spark, sf_dir).where("false"), class_dim(spark), per=("sheet",)).where("rule = 'duplicate tag'").select("subject", "detail")


@query("flt12_row_cap", "SELECT 1000 < (SELECT count(*) FROM lineitem) AS truncated, least(1000, (SELECT count(*) FROM lineitem)) AS n")
def row_cap(spark, sf_dir):
    from ..operators.filters import capped

    rows, more = capped(P.read(spark, sf_dir, "lineitem").select("l_orderkey"), 1000)
    return rows.agg(F.lit(more).alias("truncated"), F.count("*").alias("n"))


# --- joins


@query("jn4_stub_edges", with_sql("flow", "drawings", recursive=CUT) + "SELECT out_stub AS stub, src AS neighbour FROM cut UNION ALL SELECT in_stub, dst FROM cut")
def stub_edges(spark, sf_dir):
    """Each stub with the one node it is joined to."""
    on_sheets, stubs, _ = split_flow(spark, sf_dir)
    ends = on_sheets.select(F.col("src").alias("stub"), F.col("dst").alias("neighbour")).unionByName(on_sheets.select(F.col("dst").alias("stub"), F.col("src").alias("neighbour")))
    one = ends.join(stubs.select(F.col("key").alias("stub")), "stub", "left_semi").groupBy("stub").agg(F.count("*").alias("n"), F.max("neighbour").alias("neighbour"))
    return one.where("n = 1").select("stub", "neighbour")


@query("jn2_shared_labels", with_sql("flow", "drawings", recursive=CUT) + """, l AS (SELECT least(ss, ds) || '|' || greatest(ss, ds) AS pair, out_stub, in_stub FROM cut)
SELECT min(out_stub) AS from_key, min(in_stub) AS to_key FROM l GROUP BY pair HAVING count(*) = 1""")
def shared_labels(spark, sf_dir):
    """Without partner numbers only the pair of sheets tells stubs apart: it pairs where one edge crosses between them."""
    labels = stub_labels(spark, sf_dir).withColumn("ref_number", F.lit(None).cast("string")).withColumn("connector_number", F.lit("1"))
    return resolve.pair_connectors(labels, homes(spark, sf_dir))[0].select("from_key", "to_key")


@query("jn7_final_homes", "WITH RECURSIVE w AS (SELECT event_id AS node FROM events WHERE event_id > 0) SELECT 'e' || node AS node, 'e0' AS home FROM w")
def final_homes(spark, sf_dir):
    """Chains of references to a third of the number end at 0."""
    name = lambda c: F.concat(F.lit("e"), c.cast("long").cast("string"))
    links = P.read(spark, sf_dir, "events").where("event_id > 0").select(name(F.col("event_id")).alias("reference"), name(F.floor(F.col("event_id") / 3)).alias("home"))
    return traverse.final_homes(links)


@query("jn12_stem_pairs", "SELECT a.n_name AS high, b.n_name AS low FROM nation a JOIN nation b ON substr(a.n_name, 1, 8) = substr(b.n_name, 1, 8) AND a.n_nationkey > b.n_nationkey")
def stem_pairs(spark, sf_dir):
    n = P.read(spark, sf_dir, "nation").select("n_name", "n_nationkey", F.substring("n_name", 1, 8).alias("stem"))
    b = n.select(F.col("n_name").alias("low"), F.col("n_nationkey").alias("k"), "stem")
    return n.join(b, "stem").where("n_nationkey > k").select(F.col("n_name").alias("high"), "low")


@query("jn14_gold_membership", with_sql("nodes", "drawings", recursive=TAGGED) + """, g AS (SELECT doc_id % 7 AS block, quality = 1 AS said, toxic = 0 AS gold FROM labels)
SELECT block, count(*) FILTER (said AND gold) AS tp, count(*) FILTER (said AND NOT gold) AS fp, count(*) FILTER (NOT said AND gold) AS fn, round(count(*) FILTER (said AND gold) / nullif(count(*) FILTER (said), 0), 6) AS p,
  round(count(*) FILTER (said AND gold) / nullif(count(*) FILTER (gold), 0), 6) AS r FROM g GROUP BY 1""")
def gold_membership(spark, sf_dir):
    said, gold = F.col("quality") == 1, F.col("toxic") == 0
    c = P.read(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 7).alias("block")).agg(F.count_if(said & gold).alias("tp"), F.count_if(said & ~gold).alias("fp"), F.count_if(~said & gold).alias("fn"))
    p, r, _ = resolve.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("block", "tp", "fp", "fn", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"))


@query("jn16_original_keys", with_sql("drawings") + "SELECT sheet || ':' || sha1('s' || sheet || ':' || node)[1:12] AS local_key, key FROM drawings")
def original_keys(spark, sf_dir):
    drawn = P.drawings(spark, sf_dir)
    local = resolve.localize(drawn, "s")
    return local.join(drawn.select("sheet", "node", "key"), ["sheet", "node"]).select("local_key", "key")


@query("jn17_evidence_recall", """
WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS words FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS words FROM benchmark)
SELECT w.doc_id, e.item_id, round(len(list_intersect(w.words, e.words)) / len(e.words), 6) AS recall FROM w JOIN e ON w.doc_id % 40 = e.item_id""")
def evidence_recall(spark, sf_dir):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    d = P.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), words("text").alias("d"))
    e = P.read(spark, sf_dir, "benchmark").select("item_id", words("text").alias("e"))
    return d.join(e, "item_id").select("doc_id", "item_id", F.round(F.size(F.array_intersect("d", "e")) / F.size("e"), 6).alias("recall"))


# --- merge and layers


@query("gr10_merge", with_sql("flow", "drawings", recursive=CUT) + """, h AS (SELECT src, dst FROM placed UNION SELECT src, dst FROM placed)
SELECT src, dst, 'send_to' AS relation, 1 AS n_relations FROM h""")
def merge(spark, sf_dir):
    on_sheets, stubs, pairs = split_flow(spark, sf_dir)
    contracted = resolve.contract(on_sheets.select("src", "dst", "relation"), pairs)
    names = stubs.select(F.col("key").alias("k"))
    inner = on_sheets.join(names, on_sheets.src == names.k, "left_anti").join(names, on_sheets.dst == names.k, "left_anti")
    none = spark.createDataFrame([], "node string, home string")
    return resolve.merge_edges(inner, none, contracted.where(F.size("via") > 0))


@query("gr9_edge_dedupe", with_sql("flow", "drawings", recursive=CUT) + "SELECT src, dst, 'send_to' AS relation, CASE WHEN ss <> ds THEN out_stub || '|' || in_stub ELSE '' END AS via FROM placed LEFT JOIN cut USING (src, dst, ss, ds)")
def edge_dedupe(spark, sf_dir):
    """Every edge twice on its sheet: one of each stays, over the fewest stubs."""
    on_sheets, _, pairs = split_flow(spark, sf_dir)
    twice = on_sheets.select("src", "dst", "relation")
    return resolve.contract(twice.unionByName(twice), pairs).select("src", "dst", "relation", F.array_join("via", "|").alias("via"))


@query("ag1_resolution_report", with_sql("nodes", "flow", "drawings", recursive=CUT + ", " + TAGGED) + """SELECT 'pairs' AS what, count(*) AS n FROM cut UNION ALL SELECT 'groups', count(*) FROM (SELECT tag FROM tagged GROUP BY tag, node_class HAVING count(DISTINCT sheet) >= 2) x""")
def resolution_report(spark, sf_dir):
    pairs, _ = resolve.pair_connectors(stub_labels(spark, sf_dir), homes(spark, sf_dir))
    groups = resolve.group_identities(equipment_drawings(spark, sf_dir))
    return pairs.agg(F.lit("pairs").alias("what"), F.count("*").alias("n")).unionByName(groups.agg(F.lit("groups").alias("what"), F.count("*").alias("n")))


@query("ag24_resolution_score", with_sql("nodes", "drawings", recursive=TAGGED) + """, t AS (SELECT d.node, d.sheet, n.node_class, n.tag || CASE WHEN CAST(d.sheet AS BIGINT) % 5 = 0 THEN 'X' ELSE '' END AS tag FROM drawings d JOIN nodes n USING (node) WHERE n.kind = 'equipment'),
s AS (SELECT tag, count(*) AS n FROM t GROUP BY tag, node_class HAVING count(DISTINCT sheet) >= 2), g AS (SELECT count(*) AS n FROM t GROUP BY node), c AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM s) AS said, (SELECT sum(n * (n - 1) // 2) FROM g) AS gold)
SELECT CAST(said AS BIGINT) AS links, CAST(gold AS BIGINT) AS gold_links, 1.0 AS precision, round(said / gold, 6) AS recall, round(2.0 * said / (said + gold), 6) AS f1 FROM c""")
def resolution_score(spark, sf_dir):
    """Links between drawings of one item by groups of exact tags, some tags varied, against those by item. Links are
    counted from sizes; those said and true are within (group, item)."""
    d = equipment_drawings(spark, sf_dir).withColumn("tag", F.concat("tag", F.when(F.col("sheet").cast("long") % 5 == 0, "X").otherwise("")))
    groups = resolve.group_identities(d)
    members = groups.select("home", F.explode(F.concat(F.array("home"), "references")).alias("key")).join(d.select("key", "node"), "key")
    links = lambda rows, by, name: rows.groupBy(*by).agg(F.count("*").alias("c")).agg(F.sum(F.expr("c * (c - 1) div 2")).alias(name))
    one = links(members, ["home"], "said").join(links(members, ["home", "node"], "tp")).join(links(d, ["node"], "gold"))  # one row each
    p, r, f1 = resolve.prf(F.col("tp"), F.col("said") - F.col("tp"), F.col("gold") - F.col("tp"))
    return one.select(F.col("said").alias("links"), F.col("gold").alias("gold_links"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query("ag25_edge_fidelity", with_sql("nodes", "flow", "drawings", recursive=CUT) + """, f AS (SELECT min(sheet) AS first FROM drawings), x AS (SELECT p.*, first FROM placed p, f WHERE ss <> ds OR ss <> first),
found AS (SELECT * FROM x WHERE ss <> first AND ds <> first) SELECT (SELECT count(*) FROM found) AS found, (SELECT count(*) FROM placed) AS expected, 1.0 AS precision, round((SELECT count(*) FROM found) / (SELECT count(*) FROM placed), 6) AS recall""")
def edge_fidelity(spark, sf_dir):
    """Edges by their ends, joined again from all sheets but the first, against the plant's."""
    on_sheets, stubs, pairs = split_flow(spark, sf_dir)
    first = on_sheets.agg(F.min("sheet").alias("sheet"))
    lost = stubs.join(first, "sheet", "left_semi").select("key")
    kept = pairs.join(lost.toDF("from_key"), "from_key", "left_anti").join(lost.toDF("to_key"), "to_key", "left_anti")
    again = resolve.contract(on_sheets.join(first, "sheet", "left_anti").select("src", "dst", "relation"), kept).select("src", "dst")
    real = P.nodes(spark, sf_dir).select("node")
    again = again.join(real.toDF("src"), "src", "left_semi").join(real.toDF("dst"), "dst", "left_semi").distinct()
    home = homes(spark, sf_dir)
    gold = P.flow(spark, sf_dir).join(home.select(F.col("node").alias("src")), "src", "left_semi").join(home.select(F.col("node").alias("dst")), "dst", "left_semi")
    n = again.withColumn("a", F.lit(1)).join(gold.withColumn("g", F.lit(1)), ["src", "dst"], "full").agg(F.count(F.when(F.col("a") + F.col("g") == 2, 1)).alias("tp"), F.count("a").alias("found"), F.count("g").alias("expected"))
    return n.select("found", "expected", F.round(F.try_divide("tp", "found"), 6).alias("precision"), F.round(F.try_divide("tp", "expected"), 6).alias("recall"))


@query("ag28_store_invariants", with_sql("nodes", "flow", "edges", "drawings") + """SELECT 'drawing without item' AS invariant, count(*) AS violations FROM drawings WHERE node NOT IN (SELECT node FROM nodes)
UNION ALL SELECT 'edge without end', count(*) FROM edges WHERE src NOT IN (SELECT node FROM nodes) OR dst NOT IN (SELECT node FROM nodes)
UNION ALL SELECT 'item id twice', count(*) FROM (SELECT node FROM nodes GROUP BY 1 HAVING count(*) > 1) x
UNION ALL SELECT 'self edge', count(*) FROM edges WHERE src = dst
UNION ALL SELECT 'part never drawn', count(*) FROM nodes WHERE kind IN ('equipment', 'valve', 'inline') AND node NOT IN (SELECT node FROM drawings)
UNION ALL SELECT 'tag without unit', count(*) FROM nodes WHERE tag IS NOT NULL AND unit IS NULL""")
def store_invariants(spark, sf_dir):
    nodes, edges, drawn = P.nodes(spark, sf_dir), P.edges(spark, sf_dir), P.drawings(spark, sf_dir)
    ids = nodes.select("node")
    lost = edges.join(ids.toDF("src"), "src", "left_anti").select("src", "dst", "relation").unionByName(edges.join(ids.toDF("dst"), "dst", "left_anti").select("src", "dst", "relation")).distinct()
    found = {
        "drawing without item": drawn.join(ids, "node", "left_anti"), "edge without end": lost, "item id twice": nodes.groupBy("node").count().where("count > 1"), "self edge": edges.where("src = dst"),
        "part never drawn": nodes.where("kind in ('equipment', 'valve', 'inline')").join(drawn.select("node").distinct(), "node", "left_anti"), "tag without unit": nodes.where("tag is not null and unit is null"),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.lit(name).alias("invariant"), F.count("*").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


# --- families and sampling


@query("q06_flow_paths")
def flow_paths(spark, sf_dir):
    """From every equipment item the tags on the way to each equipment item 2 to 5 hops away."""
    nodes, flow = P.nodes(spark, sf_dir), P.flow(spark, sf_dir)
    equipment, name = nodes.where(F.col("node_class").isin(*EQUIPMENT)).select("node"), F.coalesce("tag", "node")
    found = traverse.routes_within(flow, equipment.select(F.col("node").alias("start")), equipment, name, nodes, name, 2, 5)
    return found.select("start", "node", F.array_join("path", ">").alias("answer"))


@query("q11_no_path", with_sql("nodes", "flow", recursive=ALL_DOWN) + """SELECT s.node AS source, t.node AS target FROM starts s JOIN nodes t ON CAST(t.node[2:] AS BIGINT) = CAST(s.node[2:] AS BIGINT) // 2 + 1 AND t.kind = 'equipment' WHERE s.node <> t.node AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.start = s.node AND r.node = t.node)""")
def no_path(spark, sf_dir):
    items = P.nodes(spark, sf_dir).where("kind = 'equipment'").select("node", F.substring("node", 2, 20).cast("long").alias("k"))
    pairs = items.select(F.col("node").alias("source"), (F.floor(F.col("k") / 2) + 1).alias("k")).join(items.select(F.col("node").alias("target"), "k"), "k").where("source <> target")
    reached = traverse.reached_pairs(P.flow(spark, sf_dir), pairs.select(F.col("source").alias("start"), F.col("target").alias("node")))
    return reached.where("not reached").select(F.col("start").alias("source"), F.col("node").alias("target"))


@query("q24_route_avoiding_answers", with_sql("nodes", "flow", recursive="""cut AS (SELECT node FROM nodes WHERE node_class = 'GlobeValve'), walk(removed, node) AS (SELECT node, 'p0' FROM cut UNION SELECT w.removed, f.dst FROM walk w JOIN flow f ON f.src = w.node WHERE f.dst <> w.removed)""") + """SELECT c.node AS avoiding, t.node AS target, EXISTS (SELECT 1 FROM walk w WHERE w.removed = c.node AND w.node = t.node) AS answer FROM cut c JOIN nodes t ON CAST(t.node[2:] AS BIGINT) BETWEEN CAST(c.node[2:] AS BIGINT) * 2 + 1 AND CAST(c.node[2:] AS BIGINT) * 2 + 2 AND t.node LIKE 'p%'""")
def route_avoiding_answers(spark, sf_dir, source="p0"):
    """Whether what a globe valve feeds is still reached from an item without that valve."""
    nodes, flow = P.nodes(spark, sf_dir), P.flow(spark, sf_dir)
    k = F.substring("removed", 2, 20).cast("long")
    fed = F.array(*(F.concat(F.lit("p"), (k * 2 + i).cast("string")) for i in (1, 2)))
    asked = nodes.where("node_class = 'GlobeValve'").select(F.col("node").alias("removed")).withColumn("target", F.explode(fed)).join(nodes.where("node like 'p%'").select(F.col("node").alias("target")), "target", "left_semi")
    asked = asked.groupBy("removed").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    found = traverse.routes_without(flow, asked, source)
    return found.select(F.col("removed").alias("avoiding"), F.explode(F.arrays_zip("targets", "reached")).alias("x")).select("avoiding", F.col("x.targets").alias("target"), F.col("x.reached").alias("answer"))


@query("q26_evidence_sheets", with_sql("flow", "drawings") + ", home AS (SELECT node, min(sheet) AS sheet FROM drawings GROUP BY 1) SELECT src AS item, string_agg(DISTINCT sheet, ',' ORDER BY sheet) AS sheets FROM (SELECT f.src, h.sheet FROM flow f JOIN home h ON h.node = f.src UNION ALL SELECT f.src, h.sheet FROM flow f JOIN home h ON h.node = f.dst) x GROUP BY 1")
def evidence_sheets(spark, sf_dir):
    flow, home = P.flow(spark, sf_dir), homes(spark, sf_dir)
    ends = flow.select("src", F.explode(F.array("src", "dst")).alias("node"))
    return ends.join(home, "node").groupBy(F.col("src").alias("item")).agg(joined("sheet").alias("sheets"))


@query("q29_stratified_sample", with_sql("runs") + f""", b AS (SELECT event_id, family, {BINS} AS k_bin, row_number() OVER (PARTITION BY {BINS}, family ORDER BY event_id * 7919 % 10007, event_id) AS turn FROM runs),
d AS (SELECT *, row_number() OVER (PARTITION BY k_bin ORDER BY turn, family) AS n FROM b) SELECT event_id, family, k_bin FROM d WHERE n <= 20""")
def stratified_sample(spark, sf_dir):
    """Families take turns within each bin; the order in a family comes from its rows' numbers, the same on every run."""
    drawn = P.runs(spark, sf_dir).select("event_id", "family", scalars.k_bin("k").alias("k_bin"))
    turn = F.row_number().over(Window.partitionBy("k_bin", "family").orderBy(F.col("event_id") * 7919 % 10007, "event_id"))
    n = F.row_number().over(Window.partitionBy("k_bin").orderBy("turn", "family"))
    return drawn.withColumn("turn", turn).withColumn("n", n).where("n <= 20").select("event_id", "family", "k_bin")


# --- decisions and statistics


@query("ca2_accept_rules", with_sql("runs") + "SELECT event_id, CASE WHEN outcome <> 'ANSWERED' THEN 'answered' WHEN k = 0 THEN 'rows' WHEN latency > 100 THEN 'complete' END AS failed FROM runs")
def accept_rules(spark, sf_dir):
    failed = F.when(F.col("outcome") != "ANSWERED", "answered").when(F.col("k") == 0, "rows").when(F.col("latency") > 100, "complete")
    return P.runs(spark, sf_dir).select("event_id", failed.alias("failed"))


@query("ca6_runaway_tally", with_sql("runs") + "SELECT strategy, count(*) FILTER (latency > 150) AS runaways, count(*) FILTER (latency > 150 AND correct) AS right_anyway FROM runs GROUP BY 1")
def runaway_tally(spark, sf_dir):
    far = F.col("latency") > 150
    return P.runs(spark, sf_dir).groupBy("strategy").agg(F.count_if(far).alias("runaways"), F.count_if(far & F.col("correct")).alias("right_anyway"))


@query("ag12_first_tier_acceptance", with_sql("runs") + f"SELECT {BINS} AS k_bin, round(count(*) FILTER (latency > 20 AND correct) / nullif(count(*) FILTER (latency > 20), 0), 6) AS p, round(count(*) FILTER (latency > 20 AND correct) / nullif(count(*) FILTER (correct), 0), 6) AS r FROM runs GROUP BY 1")
def first_tier_acceptance(spark, sf_dir):
    taken = F.col("latency") > 20
    hit = F.count_if(taken & F.col("correct"))
    return P.runs(spark, sf_dir).groupBy(scalars.k_bin("k").alias("k_bin")).agg(F.round(F.try_divide(hit, F.count_if(taken)), 6).alias("p"), F.round(F.try_divide(hit, F.count_if("correct")), 6).alias("r"))


@query("ag18_family_means", with_sql("runs") + "SELECT family, round(avg(cost), 9) AS cost FROM runs GROUP BY 1")
def family_means(spark, sf_dir):
    return P.runs(spark, sf_dir).groupBy("family").agg(F.round(F.avg("cost"), 9).alias("cost"))


@query("ag6_bands", with_sql("nodes") + "SELECT unit, n, CASE WHEN n < 8 THEN 'below' WHEN n > 80 THEN 'above' ELSE 'within' END AS verdict FROM (SELECT unit, count(*) AS n FROM nodes WHERE unit IS NOT NULL GROUP BY 1) x")
def bands(spark, sf_dir):
    n = P.nodes(spark, sf_dir).where("unit is not null").groupBy("unit").agg(F.count("*").alias("n"))
    return n.withColumn("verdict", F.when(F.col("n") < 8, "below").when(F.col("n") > 80, "above").otherwise("within"))


@query("ag7_degree_shares", with_sql("flow") + "SELECT round(avg(CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END), 6) AS share_of_ends, max(d) AS largest FROM (SELECT count(*) AS d FROM (SELECT src AS n FROM flow UNION ALL SELECT dst FROM flow) x GROUP BY n) y")
def degree_shares(spark, sf_dir):
    flow = P.flow(spark, sf_dir)
    d = flow.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    return d.agg(F.round(F.avg((F.col("d") == 1).cast("double")), 6).alias("share_of_ends"), F.max("d").alias("largest"))


@query("st1_percentiles", with_sql("runs") + "SELECT strategy, quantile_disc(latency, 0.9) AS nearest, round(quantile_cont(latency, 0.9), 6) AS linear, round(median(latency), 6) AS middle FROM runs GROUP BY 1")
def percentiles(spark, sf_dir):
    return P.runs(spark, sf_dir).groupBy("strategy").agg(stats.nearest_rank("latency", 0.9).alias("nearest"), F.round(stats.linear_rank("latency", 0.9), 6).alias("linear"), F.round(F.median("latency"), 6).alias("middle"))


@query("st14_claim_verdicts", with_sql("runs") + "SELECT family, CASE WHEN count(cost) < 2 THEN 'INCOMPLETE' WHEN avg(latency) <= 12 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM runs GROUP BY 1")
def claim_verdicts(spark, sf_dir):
    s = P.runs(spark, sf_dir).groupBy("family").agg(F.count("cost").alias("n"), F.avg("latency").alias("m"))
    return s.select("family", stats.verdict(F.col("m") <= 12, F.col("n") >= 2).alias("verdict"))


@query("st13_reference_arms", with_sql("runs") + "SELECT 'best' AS arm, count(*) FILTER (good) AS correct FROM (SELECT question, bool_or(correct) AS good FROM runs GROUP BY 1) x UNION ALL SELECT strategy, count(*) FILTER (correct) FROM runs GROUP BY 1")
def reference_arms(spark, sf_dir):
    rows = P.runs(spark, sf_dir)
    best = rows.groupBy("question").agg(F.bool_or("correct").alias("good")).agg(F.lit("best").alias("arm"), F.count_if("good").alias("correct"))
    return best.unionByName(rows.groupBy(F.col("strategy").alias("arm")).agg(F.count_if("correct").alias("correct")))


@query("wn4_first_flip", with_sql("runs") + "SELECT strategy, min(day) AS day FROM (SELECT strategy, day, n < lag(n) OVER (PARTITION BY strategy ORDER BY day) AS less FROM (SELECT strategy, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM runs GROUP BY ALL) x) y WHERE less GROUP BY 1")
def first_flip(spark, sf_dir):
    daily = P.runs(spark, sf_dir).groupBy("strategy", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    grown = runs.growth(daily, ["strategy"], "day", "n")
    return grown.where("ratio < 1").groupBy("strategy").agg(F.min("day").alias("day"))


@query("wn5_running_budget", with_sql("runs") + "SELECT question, event_id FROM (SELECT question, event_id, sum(coalesce(cost, 0)) OVER (PARTITION BY question ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM runs) x WHERE spent <= 0.1")
def running_budget(spark, sf_dir):
    w = Window.partitionBy("question").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return P.runs(spark, sf_dir).withColumn("spent", F.sum(F.coalesce("cost", F.lit(0.0))).over(w)).where("spent <= 0.1").select("question", "event_id")


@query("sc6_score_answers", with_sql("runs") + "SELECT event_id, CASE WHEN outcome <> 'ANSWERED' THEN false WHEN question % 5 = 0 THEN k = 0 WHEN k = 0 THEN false ELSE correct END AS scored FROM runs")
def score_answers(spark, sf_dir):
    r = P.runs(spark, sf_dir)
    return r.select("event_id", scalars.score_answer(F.col("question") % 5 != 0, "outcome", F.col("k") == 0, F.col("correct")).alias("scored"))


@query("sc9_tags_in_text", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))), ',') AS tags FROM documents")
def tags_in_text(spark, sf_dir):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))))
    return P.read(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("tags"))


@query("sc12_tag_variants", with_sql("nodes") + "SELECT tag, replace(tag, '-', '') AS drop_separator, replace(tag, '-', '/') AS swap_separator, lower(tag) AS lower_case FROM nodes WHERE tag IS NOT NULL")
def tag_variants(spark, sf_dir):
    v = scalars.variants("tag")
    return P.nodes(spark, sf_dir).where("tag is not null").select("tag", v["drop_separator"].alias("drop_separator"), v["swap_separator"].alias("swap_separator"), v["case"].alias("lower_case"))


@query("sc13_string_similarity")
def similar_strings(spark, sf_dir):
    n = P.read(spark, sf_dir, "nation").select("n_name")
    return n.join(n.toDF("other"), F.substring("n_name", 1, 8) == F.substring("other", 1, 8)).select("n_name", "other", resolve.string_similarity("n_name", "other").alias("similarity"))


@query("sc15_pair_cards", with_sql("nodes", "flow") + "SELECT node, array_to_string(list_slice(list(other ORDER BY other), 1, 6), ', ') AS neighbours FROM (SELECT f.src AS node, n.tag AS other FROM flow f JOIN nodes n ON n.node = f.dst WHERE n.tag IS NOT NULL UNION SELECT f.dst, n.tag FROM flow f JOIN nodes n ON n.node = f.src WHERE n.tag IS NOT NULL) x GROUP BY 1")
def pair_cards(spark, sf_dir):
    tags = P.nodes(spark, sf_dir).where("tag is not null").select(F.col("node").alias("dst"), F.col("tag").alias("other"))
    near = traverse.oriented(P.flow(spark, sf_dir), "both").join(tags, "dst").select(F.col("src").alias("node"), "other").distinct()
    return near.groupBy("node").agg(F.array_join(F.slice(F.array_sort(F.collect_list("other")), 1, 6), ", ").alias("neighbours"))


@query("so3_routing_hit", with_sql("nodes", "drawings") + "SELECT unit, bool_and(sheet <= '199912') AS hit FROM nodes JOIN drawings USING (node) WHERE unit IS NOT NULL GROUP BY 1")
def routing_hit(spark, sf_dir):
    d = P.nodes(spark, sf_dir).where("unit is not null").join(P.drawings(spark, sf_dir), "node")
    gold = d.groupBy("unit").agg(F.collect_set("sheet").alias("gold"), F.collect_set(F.when(F.col("sheet") <= "199912", F.col("sheet"))).alias("routed"))
    return gold.select("unit", (F.size(F.array_except("gold", "routed")) == 0).alias("hit"))


@query("gr18_tree_parents", with_sql("nodes", "flow", recursive="walk(node, hops) AS (SELECT 'p2', 0 UNION SELECT f.dst, w.hops + 1 FROM walk w JOIN flow f ON f.src = w.node WHERE w.hops < 20), least AS (SELECT node, min(hops) AS hops FROM walk GROUP BY 1)") + "SELECT l.node, l.hops, min(p.node) AS parent FROM least l JOIN flow f ON f.dst = l.node JOIN least p ON p.node = f.src AND p.hops = l.hops - 1 GROUP BY ALL")
def tree_parents(spark, sf_dir, start="p2"):
    """Each node an item reaches, with its first neighbour on a shortest way back."""
    flow = P.flow(spark, sf_dir)
    reached = traverse.closure(flow, spark.createDataFrame([(start,)], "start string"), "down").where(F.col("node") != start).select("node", "hops")
    above = reached.unionByName(spark.createDataFrame([(start, 0)], "node string, hops int")).select(F.col("node").alias("src"), (F.col("hops") + 1).alias("hops"))
    return reached.join(flow, reached.node == flow.dst).join(above, ["src", "hops"]).groupBy("node", "hops").agg(F.min("src").alias("parent"))


@query("gr22_path_within_sheets", with_sql("nodes", "flow", "drawings", recursive="inside AS (SELECT DISTINCT node FROM drawings WHERE sheet < '199712'), walk(node) AS (SELECT 'p1' UNION SELECT f.dst FROM walk w JOIN flow f ON f.src = w.node WHERE f.dst IN (SELECT node FROM inside))") + "SELECT node FROM walk WHERE node <> 'p1'")
def path_within_sheets(spark, sf_dir, start="p1", before="199712"):
    """What an item reaches over parts drawn on sheets before a month."""
    inside = P.drawings(spark, sf_dir).where(F.col("sheet") < before).select("node").distinct()
    return traverse.closure(P.flow(spark, sf_dir), spark.createDataFrame([(start,)], "start string"), "down", walk=inside).where(F.col("node") != start).select("node")


@query("src16_generated_plant")
def generated_plant(spark, sf_dir):
    from ..sources.generator import GeneratorConfig, generate

    nodes, edges = generate(spark, GeneratorConfig(seed=7, n_units=40))
    return nodes.groupBy(F.lit("node").alias("what"), F.col("node_class").alias("name")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("what"), F.col("relation").alias("name")).agg(F.count("*").alias("n")))


@query("gr34_group_with_links")
def group_with_links(spark, sf_dir):
    d = equipment_drawings(spark, sf_dir)
    d = d.withColumn("tag", F.concat("tag", F.when(F.col("sheet").cast("long") % 2 == 0, "").otherwise("0")))
    return blocks.group_with_links(d)
