"""Queries over answer runs, resolution and sheets, on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import digits_key, k_bin, score_sets, to_boolean, to_count
from ..operators import blocks, resolve, runs, split
from ..schema import class_dim, class_rows
from ..sources import sinks
from . import projection as P
from .catalog import query
from .projection import with_sql

BINS = "CASE WHEN k IS NULL THEN 'unanswerable' WHEN k < 3 THEN CAST(k AS VARCHAR) WHEN k <= 4 THEN '3-4' WHEN k <= 8 THEN '5-8' WHEN k <= 16 THEN '9-16' WHEN k <= 32 THEN '17-32' ELSE '33+' END"


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("ag9_run_summary", with_sql("runs") + f"SELECT strategy, {BINS} AS k_bin, outcome, count(*) AS n, round(avg(cost), 9) AS cost FROM runs GROUP BY ALL")
def run_summary(spark, sf_dir):
    return P.runs(spark, sf_dir).groupBy("strategy", k_bin("k").alias("k_bin"), "outcome").agg(F.count("*").alias("n"), F.round(F.avg("cost"), 9).alias("cost"))


@query("ag10_policy_summary", with_sql("runs") + """SELECT strategy, count(*) AS n, count(*) FILTER (correct AND latency <= 120) AS n_correct, count(*) FILTER (outcome = 'TIMED_OUT') AS n_timed_out, round(sum(cost), 6) AS cost,
  round(median(latency), 6) AS latency_median, quantile_disc(latency, 0.9) AS latency_p90, round(quantile_cont(latency, 0.95), 6) AS latency_p95, max(latency) AS latency_max FROM runs GROUP BY 1""")
def policy_summary(spark, sf_dir):
    out = runs.summarise(P.runs(spark, sf_dir), ["strategy"], 120)
    return out.withColumns({c: F.round(c, 6) for c in ("cost", "latency_median", "latency_p95")})


@query("ag11_breakdown", with_sql("runs") + f"""SELECT 'family' AS dimension, family AS grp, strategy, count(*) AS total, count(*) FILTER (correct) AS n_correct FROM runs GROUP BY ALL
UNION ALL SELECT 'k', {BINS}, strategy, count(*), count(*) FILTER (correct) FROM runs GROUP BY ALL""")
def breakdown(spark, sf_dir):
    groups = F.explode(F.array(F.struct(F.lit("family").alias("dimension"), F.col("family").alias("grp")), F.struct(F.lit("k").alias("dimension"), k_bin("k").alias("grp"))))
    spread = P.runs(spark, sf_dir).select("strategy", "correct", groups.alias("g"))
    return spread.groupBy("g.dimension", "g.grp", "strategy").agg(F.count("*").alias("total"), F.count_if("correct").alias("n_correct"))


@query("ag13_ladder_cells", with_sql("runs") + """SELECT strategy, total, correct, round(greatest((p + 1.96 * 1.96 / (2 * total)) / (1 + 1.96 * 1.96 / total) - 1.96 / (1 + 1.96 * 1.96 / total) * sqrt(p * (1 - p) / total + 1.96 * 1.96 / (4.0 * total * total)), 0), 6) AS low,
  round(least((p + 1.96 * 1.96 / (2 * total)) / (1 + 1.96 * 1.96 / total) + 1.96 / (1 + 1.96 * 1.96 / total) * sqrt(p * (1 - p) / total + 1.96 * 1.96 / (4.0 * total * total)), 1), 6) AS high
FROM (SELECT strategy, count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (correct) / count(*) AS p FROM runs GROUP BY 1) x""")
def ladder_cells(spark, sf_dir):
    cells = runs.accuracy_cells(P.runs(spark, sf_dir), ["strategy"])
    return cells.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("ag13_outcome_counts", with_sql("runs") + "SELECT strategy, count(*) FILTER (outcome = 'ANSWERED') AS answered, count(*) FILTER (outcome = 'TIMED_OUT') AS timed_out, count(*) FILTER (outcome = 'PROVIDER_ERROR') AS provider_error FROM runs GROUP BY 1")
def outcome_counts(spark, sf_dir):
    return runs.outcome_counts(P.runs(spark, sf_dir), ["strategy"])


@query("ag15_growth", with_sql("runs") + "SELECT strategy, day, n, round(n / lag(n) OVER (PARTITION BY strategy ORDER BY day), 6) AS ratio FROM (SELECT strategy, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM runs GROUP BY ALL) x")
def growth(spark, sf_dir):
    daily = P.runs(spark, sf_dir).groupBy("strategy", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return runs.growth(daily, ["strategy"], "day", "n").withColumn("ratio", F.round("ratio", 6))


@query("ag17_usage_tally", with_sql("runs") + "SELECT question, count(*) AS n_calls, CASE WHEN count(*) = count(cost) THEN round(sum(cost), 6) END AS cost FROM runs GROUP BY 1")
def usage_tally(spark, sf_dir):
    cost = F.when(F.count("*") == F.count("cost"), F.round(F.sum("cost"), 6))
    return P.runs(spark, sf_dir).groupBy("question").agg(F.count("*").alias("n_calls"), cost.alias("cost"))


@query("ag19_grouping_sets", with_sql("runs") + f""", g AS (SELECT *, 'overall' AS dimension, 'all' AS grp FROM runs UNION ALL SELECT *, 'family', family FROM runs UNION ALL SELECT *, 'k', {BINS} FROM runs)
SELECT strategy, dimension, grp, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 9) AS accuracy, round(avg(cost), 9) AS cost, quantile_disc(latency, 0.9) AS latency_p90 FROM g GROUP BY ALL""")
def grouping_sets(spark, sf_dir):
    out = runs.grouping_sets(P.runs(spark, sf_dir), ["strategy"], {"family": F.col("family"), "k": k_bin("k")})
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "cost")})


@query("ca3_walk_tiers", with_sql("runs") + """, t AS (SELECT question, (row_number() OVER (PARTITION BY question ORDER BY event_id)) AS pos, outcome, correct, cost, latency FROM runs), f AS (SELECT * FROM t WHERE pos <= 4),
s AS (SELECT question, min(pos) FILTER (outcome = 'ANSWERED' AND latency > 20) AS stop, min(pos) FILTER (outcome = 'ANSWERED') AS fallback, max(pos) AS last FROM f GROUP BY 1)
SELECT question, any_value(coalesce(stop, fallback)) AS tier, bool_and(stop IS NULL) AS fell_back, count(*) AS n_tried, round(sum(cost), 6) AS cost, round(sum(latency), 6) AS latency FROM f JOIN s USING (question) WHERE pos <= coalesce(stop, last) GROUP BY 1""")
def walk_tiers(spark, sf_dir):
    w = Window.partitionBy("question").orderBy("event_id")
    tiers = P.runs(spark, sf_dir).withColumn("pos", F.row_number().over(w)).where("pos <= 4")
    answered = F.col("outcome") == "ANSWERED"
    out = runs.walk_tiers(tiers, ["question"], "pos", answered & (F.col("latency") > 20), answered)
    return out.withColumn("tier", F.col("tier").cast("long")).withColumns({c: F.round(c, 6) for c in ("cost", "latency")})


@query("ca7_constrained_argmax", with_sql("runs") + """, s AS (SELECT strategy, family, count(*) FILTER (correct) AS good, median(latency) AS m, round(sum(cost), 6) AS cost FROM runs GROUP BY ALL)
SELECT strategy, family, good FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY m <= 11 DESC, good DESC, cost, family) AS r FROM s) x WHERE r = 1""")
def constrained_argmax(spark, sf_dir):
    s = P.runs(spark, sf_dir).groupBy("strategy", "family").agg(F.count_if("correct").alias("good"), F.median("latency").alias("m"), F.round(F.sum("cost"), 6).alias("cost"))
    return runs.best(s, ["strategy"], (F.col("m") <= 11).desc(), F.col("good").desc(), F.col("cost"), F.col("family")).select("strategy", "family", "good")


@query("jn9_run_compatibility", with_sql("runs") + """, a AS (SELECT question, count(*) AS na FROM runs WHERE strategy = 'click' AND family <> 'F3' GROUP BY 1), b AS (SELECT question, count(*) AS nb FROM runs WHERE strategy = 'view' GROUP BY 1)
SELECT question, CASE WHEN na IS NULL THEN 'missing in first' WHEN nb IS NULL THEN 'missing in second' ELSE 'repeated' END AS problem FROM a FULL JOIN b USING (question) WHERE na IS NULL OR nb IS NULL OR na > 1 OR nb > 1""")
def run_compatibility(spark, sf_dir):
    rows = P.runs(spark, sf_dir)
    return runs.compatible(rows.where("strategy = 'click' and family <> 'F3'"), rows.where("strategy = 'view'"), ["question"])


@query("jn10_gaps", with_sql("runs") + "SELECT DISTINCT question FROM runs WHERE question NOT IN (SELECT question FROM runs WHERE strategy = 'click')")
def gaps(spark, sf_dir):
    rows = P.runs(spark, sf_dir)
    return rows.select("question").distinct().join(rows.where("strategy = 'click'"), "question", "left_anti")


@query("jn21_pending", with_sql("runs") + "SELECT s.strategy, q.question, CAST(r.range AS INTEGER) AS repeat FROM (SELECT DISTINCT strategy FROM runs) s CROSS JOIN (SELECT DISTINCT question FROM runs) q CROSS JOIN range(3) r WHERE (s.strategy, q.question, r.range) NOT IN (SELECT (strategy, question, repeat % 3) FROM runs)")
def pending(spark, sf_dir):
    rows = P.runs(spark, sf_dir).withColumn("repeat", (F.col("repeat") % 3).cast("int"))
    return runs.pending(rows, rows.select("question").distinct(), 3, rows)


@query("jn11_paired_difference", with_sql("runs") + """, a AS (SELECT question, max(CAST(correct AS INTEGER)) AS x FROM runs WHERE strategy = 'click' GROUP BY 1), b AS (SELECT question, max(CAST(correct AS INTEGER)) AS y FROM runs WHERE strategy = 'view' GROUP BY 1)
SELECT count(*) AS n, round(avg(x - y), 6) AS mean_diff FROM a JOIN b USING (question)""")
def paired_difference(spark, sf_dir):
    one = lambda s, n: P.runs(spark, sf_dir).where(F.col("strategy") == s).groupBy("question").agg(F.max(F.col("correct").cast("int")).alias(n))
    return one("click", "x").join(one("view", "y"), "question").agg(F.count("*").alias("n"), r6(F.avg(F.col("x") - F.col("y")), "mean_diff"))


@query("st3_rounded_rank", with_sql("runs") + """, r AS (SELECT strategy, latency, row_number() OVER (PARTITION BY strategy ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM runs)
SELECT strategy, max(latency) FILTER (i = round_even(0.025 * (n - 1), 0)) AS low, max(latency) FILTER (i = n - 1 - round_even(0.025 * (n - 1), 0)) AS high FROM r GROUP BY 1""")
def rounded_rank(spark, sf_dir):
    return stats.rounded_rank(P.runs(spark, sf_dir), ["strategy"], "latency", 0.025)


@query("st10_slope", with_sql("runs") + "SELECT strategy, round(regr_slope(latency, k), 6) AS slope, round(stddev_pop(latency), 6) AS deviation FROM runs GROUP BY 1")
def slopes(spark, sf_dir):
    return P.runs(spark, sf_dir).groupBy("strategy").agg(r6(stats.slope("k", "latency"), "slope"), r6(F.stddev_pop("latency"), "deviation"))


@query("st11_elasticity", with_sql("runs") + """, s AS (SELECT family, avg(cost) FILTER (k < 20) AS a, avg(cost) FILTER (k >= 20) AS b, count(*) FILTER (k < 20) AS m, sum(k) FILTER (k >= 20) AS n FROM runs GROUP BY 1)
SELECT family, round(ln(b / a) / ln(n / m), 6) AS elasticity FROM s WHERE a > 0 AND b > 0""")
def elasticities(spark, sf_dir):
    low = F.col("k") < 20
    s = P.runs(spark, sf_dir).groupBy("family").agg(F.avg(F.when(low, F.col("cost"))).alias("a"), F.avg(F.when(~low, F.col("cost"))).alias("b"), F.count_if(low).alias("m"), F.sum(F.when(~low, F.col("k"))).alias("n"))
    return s.where("a > 0 and b > 0").select("family", r6(stats.elasticity("a", "b", "m", "n"), "elasticity"))


@query("st6_paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    rows = P.runs(spark, sf_dir).withColumn("a", F.col("correct").cast("int")).withColumn("b", (F.col("latency") < 50).cast("int"))
    return stats.paired_bootstrap(rows.select("strategy", "a", "b"), ["strategy"], "a", "b")


@query("st7_poisson_bootstrap")
def poisson_bootstrap(spark, sf_dir):
    return stats.poisson_bootstrap(P.runs(spark, sf_dir), ["strategy"], "latency", "event_id", 100)


@query("st9_block_bootstrap")
def block_bootstrap(spark, sf_dir):
    pred = F.col("quality") == 1
    gold = F.col("toxic") == 0
    counts = P.read(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 20).alias("block")).agg(F.count_if(pred & gold).alias("tp"), F.count_if(pred & ~gold).alias("fp"), F.count_if(~pred & gold).alias("fn"))
    return stats.block_bootstrap_f1(counts.withColumn("decider", F.lit("quality")), ["decider"])


@query("ag22_thresholds", """
WITH p AS (SELECT doc_id, (doc_id * 37 % 101) / 100.0 AS score, quality = 1 AS gold FROM labels), a AS (SELECT round(score, 12) AS threshold, count(*) FILTER (gold) AS t, count(*) FILTER (NOT gold) AS f FROM p WHERE score > 0 GROUP BY 1),
c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, sum(t) OVER w AS tp, sum(f) OVER w AS fp FROM a WINDOW w AS (ORDER BY threshold DESC)), g AS (SELECT count(*) FILTER (gold) AS n FROM p)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n - tp AS BIGINT) AS fn, round(2 * tp / (2 * tp + fp + n - tp), 6) AS f1 FROM c, g""")
def tuning(spark, sf_dir):
    pairs = P.read(spark, sf_dir, "labels").select(((F.col("doc_id") * 37 % 101) / 100).alias("score"), (F.col("quality") == 1).alias("gold"))
    return runs.thresholds(pairs, "score", "gold").withColumn("f1", F.round("f1", 6))


@query("sc4_score_sets", """
WITH w AS (SELECT doc_id, list_distinct(list_transform(string_split(lang || ' ' || source || ' ' || lang, ' '), lambda x: upper(x))) AS ref, list_distinct(list_transform(string_split(source || ' x', ' '), lambda x: upper(x))) AS ans FROM documents),
s AS (SELECT doc_id, len(list_intersect(ref, ans)) AS hit, len(ref) AS nr, len(ans) AS na FROM w)
SELECT doc_id, round(hit / na, 6) AS p, round(hit / nr, 6) AS r, round(CASE WHEN hit = 0 THEN 0 ELSE 2.0 * hit / (na + nr) END, 6) AS f1, hit = nr AND hit = na AS exact FROM s""")
def set_scores(spark, sf_dir):
    d = P.read(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws(" ", "lang", "source", "lang"), " ").alias("ref"), F.split(F.concat_ws(" ", "source", F.lit("x")), " ").alias("ans"))
    s = score_sets("ref", "ans")
    return d.select("doc_id", r6(s["precision"], "p"), r6(s["recall"], "r"), r6(s["f1"], "f1"), s["exact"].alias("exact"))


@query("sc2_parse_values", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS as_boolean, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS as_count FROM events")
def parse_values(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, (" Yes", "NO", "1", "false ", "perhaps"))), (F.col("event_id") % 5 + 1).cast("int"))
    return P.read(spark, sf_dir, "events").select("event_id", to_boolean(said).alias("as_boolean"), to_count(F.get_json_object("props", "$.k")).alias("as_count"))


# --- resolution

TAGGED = """tagged AS (SELECT d.key, d.sheet, n.tag, n.node_class, d.n_properties FROM drawings d JOIN nodes n USING (node) WHERE n.kind = 'equipment')"""


def equipment_drawings(spark, sf_dir):
    return P.drawings(spark, sf_dir).join(P.nodes(spark, sf_dir).where("kind = 'equipment'").select("node", "tag", "node_class", "unit"), "node")


@query("ag2_identity_groups", with_sql("nodes", "drawings", recursive=TAGGED) + """SELECT tag, node_class, home, array_to_string(list_filter(keys, lambda x: x <> home), ',') AS refs, n_sheets FROM (
  SELECT tag, node_class, count(DISTINCT sheet) AS n_sheets, count(*) AS n, list(key ORDER BY key) AS keys, first(key ORDER BY n_properties DESC, sheet) AS home FROM tagged WHERE tag IS NOT NULL GROUP BY ALL) x WHERE n = n_sheets AND n_sheets >= 2""")
def identity_groups(spark, sf_dir):
    return resolve.group_identities(equipment_drawings(spark, sf_dir)).select("tag", "node_class", "home", F.array_join("references", ",").alias("refs"), "n_sheets")


HOME = "home AS (SELECT node, min(sheet) AS sheet FROM drawings GROUP BY 1)"


def homes(spark, sf_dir):
    return P.drawings(spark, sf_dir).groupBy("node").agg(F.min("sheet").alias("sheet"))


def split_flow(spark, sf_dir):
    flow = P.flow(spark, sf_dir).withColumn("relation", F.lit("send_to"))
    return resolve.cut_edges(flow, homes(spark, sf_dir))


CUT = HOME + """, placed AS (SELECT src, dst, a.sheet AS ss, b.sheet AS ds FROM flow JOIN home a ON a.node = src JOIN home b ON b.node = dst),
cut AS (SELECT src, dst, ss, ds, ss || ':out' || row_number() OVER (PARTITION BY ss ORDER BY src, dst) AS out_stub, ds || ':in' || row_number() OVER (PARTITION BY ds ORDER BY src, dst) AS in_stub FROM placed WHERE ss <> ds)"""


@query("gr31_split_stubs", with_sql("flow", "drawings", recursive=CUT) + "SELECT out_stub AS from_key, in_stub AS to_key FROM cut")
def split_stubs(spark, sf_dir):
    return split_flow(spark, sf_dir)[2].select("from_key", "to_key")


@query("gr8_contract_round_trip", with_sql("flow", "drawings", recursive=CUT) + "SELECT src, dst, CASE WHEN ss <> ds THEN 2 ELSE 0 END AS n_via FROM placed")
def contract_round_trip(spark, sf_dir):
    """Sheets cut apart and contracted again are the plant they came from."""
    on_sheets, _, pairs = split_flow(spark, sf_dir)
    return resolve.contract(on_sheets.select("src", "dst", "relation"), pairs).select("src", "dst", F.size("via").alias("n_via"))


def stub_labels(spark, sf_dir):
    pairs = split_flow(spark, sf_dir)[2]
    number, sheet = lambda c: F.regexp_extract(c, r"(\d+)$", 1), lambda c: F.substring_index(c, ":", 1)
    none = F.lit(None).cast("string")
    both = pairs.select(F.struct(F.col("from_key").alias("key"), sheet("from_key").alias("sheet"), F.lit("outgoing").alias("direction"), number("from_key").alias("connector_number"), sheet("to_key").alias("ref_sheet"), F.concat(F.lit("i"), number("to_key")).alias("ref_number")).alias("o"), F.struct(F.col("to_key").alias("key"), sheet("to_key").alias("sheet"), F.lit("incoming").alias("direction"), F.concat(F.lit("i"), number("to_key")).alias("connector_number"), sheet("from_key").alias("ref_sheet"), number("from_key").alias("ref_number")).alias("i"))
    labels = both.select(F.explode(F.array("o", "i")).alias("x")).select("x.*")
    return labels.withColumns({c: none for c in ("line_number", "fluid_code", "loop_tag")}).withColumn("kind", F.lit("pipe")).withColumn("relation", F.lit("send_to"))


@query("jn1_connector_pairing", with_sql("flow", "drawings", recursive=CUT) + "SELECT out_stub AS from_key, in_stub AS to_key, 'connector_number' AS rule FROM cut")
def connector_pairing(spark, sf_dir):
    return resolve.pair_connectors(stub_labels(spark, sf_dir), homes(spark, sf_dir))[0]


@query("jn3_unresolved_connectors", with_sql("flow", "drawings", recursive=CUT) + """, f AS (SELECT min(sheet) AS first FROM drawings), l AS (SELECT out_stub AS key, ds AS ref FROM cut UNION ALL SELECT in_stub, ss FROM cut)
SELECT key, 'referenced drawing not in corpus' AS reason FROM l, f WHERE ref = first""")
def unresolved_connectors(spark, sf_dir):
    """Without the first sheet its neighbours' stubs refer to a drawing that is not there."""
    sheets = homes(spark, sf_dir).select("sheet").distinct()
    first = sheets.agg(F.min("sheet").alias("sheet"))
    labels = stub_labels(spark, sf_dir)
    return resolve.pair_connectors(labels, sheets.join(first, "sheet", "left_anti"))[1].where(F.col("reason") == resolve.ABSENT)


@query("gr12_sheet_routes", with_sql("flow", "drawings", recursive=CUT) + "SELECT least(ss, ds) AS sheet_a, greatest(ss, ds) AS sheet_b, string_agg(out_stub || '~' || in_stub, ',' ORDER BY out_stub || '~' || in_stub) AS pairs FROM cut GROUP BY ALL")
def sheet_routes(spark, sf_dir):
    return resolve.sheet_routes(split_flow(spark, sf_dir)[2]).select("sheet_a", "sheet_b", F.array_join("pairs", ",").alias("pairs"))


@query("gr11_item_graph", with_sql("nodes", "drawings", recursive=TAGGED) + """, g AS (SELECT tag, node_class, count(*) AS n, count(DISTINCT sheet) AS s, first(key ORDER BY n_properties DESC, sheet) AS home, string_agg(DISTINCT sheet, ',' ORDER BY sheet) AS sheets FROM tagged GROUP BY ALL)
SELECT home AS item, tag, node_class, sheets, n AS n_keys FROM g""")
def item_graph(spark, sf_dir):
    d = equipment_drawings(spark, sf_dir)
    groups = resolve.group_identities(d)
    links = groups.select(F.explode("references").alias("node"), "home")
    return resolve.item_graph(d, links, class_dim(spark)).select("item", "tag", "node_class", F.array_join("sheets", ",").alias("sheets"), F.size("keys").cast("long").alias("n_keys"))


@query("gr33_localize", with_sql("drawings") + "SELECT sheet || ':' || sha1('salt' || sheet || ':' || node)[1:12] AS local_key, sheet, node FROM drawings")
def localize(spark, sf_dir):
    return resolve.localize(P.drawings(spark, sf_dir), "salt")


@query("gr32_differences", with_sql("nodes") + "SELECT node, CASE WHEN unit = 'U03' THEN 'missing' ELSE 'mismatch' END AS difference FROM nodes WHERE unit = 'U03' OR node_class = 'Tank'")
def differences(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir).select("node", "node_class", "unit")
    changed = nodes.where("unit is null or unit <> 'U03'").withColumn("node_class", F.regexp_replace("node_class", "^Tank$", "Vessel"))
    return resolve.differences(changed, nodes, ["node"], ["node_class"])


@query("jn13_block_candidates", with_sql("nodes", "drawings") + """, d AS (SELECT key, sheet, node_class, tag || CASE WHEN CAST(sheet AS BIGINT) % 2 = 0 THEN '' ELSE '0' END AS tag FROM drawings JOIN nodes USING (node) WHERE kind = 'equipment'),
b AS (SELECT *, regexp_replace(tag, '[^1-9]', '', 'g') AS digits FROM d)
SELECT x.key AS a, y.key AS b FROM b x JOIN b y USING (node_class, digits) WHERE x.key < y.key AND x.sheet <> y.sheet AND x.tag <> y.tag AND digits <> ''""")
def block_candidates(spark, sf_dir):
    d = equipment_drawings(spark, sf_dir)
    d = d.withColumn("tag", F.concat("tag", F.when(F.col("sheet").cast("long") % 2 == 0, "").otherwise("0")))
    return resolve.block_candidates(d).select("a", "b")


@query("gr35_one_to_one", None)
def one_to_one(spark, sf_dir):
    d = equipment_drawings(spark, sf_dir)
    d = d.withColumn("tag", F.concat("tag", F.when(F.col("sheet").cast("long") % 2 == 0, "").otherwise("0")))
    return blocks.one_to_one(d)


@query("ag3_plant_summary", with_sql("nodes", "flow", "edges") + "SELECT 'class' AS what, node_class AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY ALL")
def plant_summary(spark, sf_dir):
    per_class = P.nodes(spark, sf_dir).groupBy(F.col("node_class").alias("name")).agg(F.count("*").alias("n")).select(F.lit("class").alias("what"), "name", "n")
    return per_class.unionByName(P.edges(spark, sf_dir).groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), "name", "n"))


@query("ag5_sheet_statistics", with_sql("nodes", "drawings") + "SELECT sheet, count(*) FILTER (kind = 'equipment') AS equipment, count(*) FILTER (kind = 'valve') AS valve, count(*) FILTER (kind = 'inline') AS inline FROM drawings JOIN nodes USING (node) GROUP BY 1")
def sheet_statistics(spark, sf_dir):
    return P.drawings(spark, sf_dir).join(P.nodes(spark, sf_dir).select("node", "kind"), "node").groupBy("sheet").pivot("kind", ["equipment", "valve", "inline"]).count().na.fill(0)


DRAWN = ", ".join(f"('{name}')" for name, _, _, _, _, leaf, _ in class_rows() if leaf)


@query("ag8_class_coverage", with_sql("nodes") + f"SELECT c.name AS node_class, count(n.node) AS n FROM (VALUES {DRAWN}) c(name) LEFT JOIN nodes n ON n.node_class = c.name GROUP BY 1")
def class_coverage(spark, sf_dir):
    counts = P.nodes(spark, sf_dir).groupBy("node_class").agg(F.count("*").alias("n"))
    return class_dim(spark).where("leaf").join(counts, "node_class", "left").select("node_class", F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", "node_class")


@query("gr27_hubs", with_sql("nodes", "flow") + """, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM flow UNION ALL SELECT dst FROM flow) x GROUP BY 1), m AS (SELECT avg(degree) + stddev_pop(degree) AS lim FROM deg) SELECT node, degree FROM deg, m WHERE degree > lim""")
def hubs(spark, sf_dir):
    return split.hubs(P.flow(spark, sf_dir))


@query("gr29_chunk_by_budget", with_sql("nodes") + """SELECT node, unit, greatest(sum(CASE WHEN kind = 'equipment' THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY CAST(node[2:] AS BIGINT)) - 1, 0) // 4 AS chunk FROM nodes WHERE kind IN ('equipment', 'valve')""")
def chunk_by_budget(spark, sf_dir):
    """Items of a unit in order, four equipment items a chunk; valves ride along."""
    items = P.nodes(spark, sf_dir).where("kind in ('equipment', 'valve')").select("node", "unit", F.substring("node", 2, 20).cast("long").alias("at"), (F.col("kind") == "equipment").alias("counted"))
    return split.chunk_by_budget(items, ["unit"], "at", "counted", 4).select("node", "unit", "chunk")


@query("snk2_expected_counts", with_sql("nodes") + "SELECT label, count(*) AS n FROM (SELECT CASE kind WHEN 'equipment' THEN 'Equipment' WHEN 'valve' THEN 'PipingComponent' END AS label FROM nodes WHERE kind IN ('equipment', 'valve')) x GROUP BY 1")
def expected_counts(spark, sf_dir):
    labelled = P.nodes(spark, sf_dir).where("kind in ('equipment', 'valve')").join(F.broadcast(class_dim(spark).select("node_class", "labels")), "node_class")
    return labelled.select(F.explode("labels").alias("label")).where("label in ('Equipment', 'PipingComponent')").groupBy("label").agg(F.count("*").alias("n"))


@query("snk1_load_batches", with_sql("nodes") + "SELECT node, node_class, (row_number() OVER (PARTITION BY node_class ORDER BY node) - 1) // 100 AS batch FROM nodes")
def load_batches(spark, sf_dir):
    return sinks.load_batches(P.nodes(spark, sf_dir).select("node", "node_class"), ["node_class"], "node", 100)


@query("ag23_blocking_quality", with_sql("nodes", "drawings") + """, d AS (SELECT node, regexp_replace(tag, '[^1-9]', '', 'g') AS digits, count(*) AS c FROM drawings JOIN nodes USING (node) WHERE kind = 'equipment' GROUP BY ALL),
n AS (SELECT (SELECT sum(c * (c - 1)) FROM d) AS gold_both, (SELECT sum(c * (c - 1)) FROM (SELECT sum(c) AS c FROM d GROUP BY node) x) AS gold, (SELECT sum(c * (c - 1)) FROM (SELECT sum(c) AS c FROM d GROUP BY digits) x) AS inside, (SELECT sum(c) * (sum(c) - 1) FROM d) AS whole)
SELECT round(gold_both / gold, 6) AS completeness, round(1 - inside / whole, 6) AS reduction FROM n""")
def blocking_quality(spark, sf_dir):
    """Pairs within a block are counted from its size, never made."""
    d = equipment_drawings(spark, sf_dir).groupBy("node", digits_key("tag").alias("digits")).agg(F.count("*").alias("c"))
    pairs = lambda by, name: d.groupBy(*by).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias(name))
    one = pairs(["digits"], "inside").join(pairs(["node"], "gold")).join(pairs(["node", "digits"], "both")).join(d.agg((F.sum("c") * (F.sum("c") - 1)).alias("whole")))  # one row each
    return one.select(F.round(F.try_divide("both", "gold"), 6).alias("completeness"), F.round(1 - F.try_divide("inside", "whole"), 6).alias("reduction"))
