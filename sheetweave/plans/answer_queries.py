"""Queries over answers in text, stores, families and reference arms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers, scalars, stats
from ..lineage import stash
from ..operators import resolve, runs, traverse
from ..schema import LINE_ITEMS, class_dim
from . import projection as P
from .catalog import query
from .plant_queries import FOLD, lines
from .projection import with_sql
from .run_queries import BINS, CUT, TAGGED, equipment_drawings, homes, split_flow

# --- answers in text


@query("sc7_parse_answers", """
SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'PARSE_FAILURE' ELSE 'ANSWERED' END AS outcome, CASE WHEN event_id % 6 < 5 THEN event_id % 6 = 4 END AS not_present,
  CASE event_id % 6 WHEN 0 THEN 'T-' || event_id WHEN 3 THEN 'yes' END AS text, CASE WHEN event_id % 6 = 2 THEN event_id END AS number, CASE WHEN event_id % 6 = 1 THEN 'a' || event_id || ',}' END AS items FROM events""")
def parse_answers(spark, sf_dir):
    """Replies in six shapes, one cut off, read back."""
    e = F.col("event_id").cast("string")
    shape = F.col("event_id") % 6
    reply = (
        F.when(shape == 0, F.concat(F.lit('{"answer": "T-'), e, F.lit('", "not_present": false}'))).when(shape == 1, F.concat(F.lit('Sure: {"answer": ["a'), e, F.lit('", "}"], "not_present": false} as asked {"x": 1}')))
        .when(shape == 2, F.concat(F.lit('{"answer": '), e, F.lit(', "not_present": false}'))).when(shape == 3, F.lit('```json\n{"answer": true, "not_present": false}\n```'))
        .when(shape == 4, F.lit('{"answer": null, "not_present": true}')).otherwise(F.concat(F.lit('{"answer": "cut '), e))
    )
    kind = F.element_at(F.array(*map(F.lit, ("TAG", "TAG_SET", "COUNT", "BOOLEAN", "TAG_PATH", "TAG"))), (shape + 1).cast("int"))
    read = P.read(spark, sf_dir, "events").select("event_id", answers.parse_answer(reply, kind).alias("a")).select("event_id", "a.*")
    return read.withColumn("items", F.array_join("items", ","))


@query("sc3_scalar_scores", with_sql("nodes") + """SELECT node, tag IS NOT NULL AND CAST(node[2:] AS BIGINT) % 2 = 0 AS scalar, CAST(node[2:] AS BIGINT) % 3 <> 0 AS unit_id, CAST(node[2:] AS BIGINT) % 5 <> 0 AS counted, CAST(node[2:] AS BIGINT) % 4 = 1 AS yes_no FROM nodes WHERE node LIKE 'p%' AND tag IS NOT NULL""")
def scalar_scores(spark, sf_dir):
    """Answers written another way, and some that are wrong, against what was asked for."""
    k = F.substring("node", 2, 20).cast("long")
    rows = P.nodes(spark, sf_dir).where("node like 'p%' and tag is not null")
    tag = F.when(k % 2 == 0, F.concat(F.lit("  "), F.lower("tag"))).otherwise(F.concat("tag", F.lit("x")))
    unit = F.when(k % 3 != 0, F.concat(F.lit("unit "), F.substring("unit", 2, 9))).otherwise(F.lit("99"))
    count = F.when(k % 5 != 0, F.concat(F.lit(" "), k.cast("string"))).otherwise(F.lit("none"))
    yes = F.element_at(F.array(*map(F.lit, ("no", "TRUE", "maybe", "0"))), (k % 4 + 1).cast("int"))
    return rows.select("node", answers.score_scalar("tag", tag).alias("scalar"), answers.score_unit("unit", unit).alias("unit_id"), answers.score_count(k, count).alias("counted"), answers.score_boolean(F.lit("yes"), yes).alias("yes_no"))


@query("sc5_path_scores", with_sql("nodes", "flow") + """SELECT src, dst, CAST(src[2:] AS BIGINT) % 3 <> 0 AS correct, CASE WHEN CAST(src[2:] AS BIGINT) % 3 <> 0 THEN 1.0 ELSE round(4.0 / 5, 6) END AS f1 FROM flow JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.tag IS NOT NULL AND b.tag IS NOT NULL""")
def path_scores(spark, sf_dir):
    """Every edge as a path over a connector, some with an item that is not on it."""
    tags = P.nodes(spark, sf_dir).where("tag is not null").select("node", "tag")
    e = P.flow(spark, sf_dir).join(tags.toDF("src", "a"), "src").join(tags.toDF("dst", "b"), "dst")
    wrong = F.substring("src", 2, 20).cast("long") % 3 == 0
    said = F.when(wrong, F.array(F.col("a"), F.lit("X-1"), F.lower("b"))).otherwise(F.array(F.lower("a"), F.lit("opc-7"), F.col("b")))
    s = answers.score_path(F.array("a", "b"), said, F.array(F.concat_ws(">", "a", "b")), F.array(F.lit("OPC-7")))
    return e.select("src", "dst", s["correct"].alias("correct"), F.round(s["f1"], 6).alias("f1"))


@query("sc8_anchors", with_sql("nodes") + """SELECT node, lower(tag) AS tags, unit AS units, CASE CAST(node[2:] AS BIGINT) % 3 WHEN 0 THEN 'What is downstream of <TAG> in unit <UNIT>?' WHEN 1 THEN 'Unit <UNIT>: which instruments measure <TAG>, <TAG> or Q9?' ELSE 'On which sheets is <TAG> of unit <UNIT>?' END AS masked,
  CASE CAST(node[2:] AS BIGINT) % 3 WHEN 0 THEN 'DOWNSTREAM_ALL' WHEN 1 THEN 'SIGNAL_CHAIN' ELSE 'ITEM' END AS need FROM nodes WHERE kind = 'equipment'""")
def anchors(spark, sf_dir):
    """What questions about every equipment item name and need."""
    items = P.nodes(spark, sf_dir).where("kind = 'equipment'")
    k, tag = F.substring("node", 2, 20).cast("long") % 3, F.lower("tag")
    text = (
        F.when(k == 0, F.concat(F.lit("What is downstream of "), tag, F.lit(" in unit "), F.col("unit"), F.lit("?"))).when(k == 1, F.concat(F.lit("Unit "), F.col("unit"), F.lit(": which instruments measure "), tag, F.lit(", "), F.col("tag"), F.lit(" or Q9?")))
        .otherwise(F.concat(F.lit("On which sheets is "), tag, F.lit(" of unit "), F.lower("unit"), F.lit("?")))
    )
    found = answers.anchors(items.select(F.col("node").alias("id"), text.alias("text")), items.select("tag"), items.where("unit is not null").select("unit").distinct())
    # a tag is replaced at its first mention
    masked = F.replace("masked", F.upper(F.get("tags", F.lit(0))["text"]), F.lit("<TAG>"))
    need = answers.need_of("masked", F.size("tags"), F.size("units"))
    return found.select(F.col("id").alias("node"), F.array_join(F.transform("tags", lambda t: t["text"]), ",").alias("tags"), F.array_join(F.transform("units", lambda u: u["unit"]), ",").alias("units"), masked.alias("masked"), need.alias("need"))


@query("sc14_deciders", with_sql("nodes", "drawings") + """, p AS (SELECT d.key, n.tag, n.unit, length(regexp_replace(n.tag, '[^A-Z0-9]', '', 'g')) AS w, CAST(d.sheet AS BIGINT) % 3 AS v FROM drawings d JOIN nodes n USING (node) WHERE n.kind = 'equipment'),
s AS (SELECT key, v, unit, CASE v WHEN 0 THEN 1.0 ELSE 2.0 * w / (2 * w + 1) END AS r FROM p)
SELECT key, CASE v WHEN 0 THEN 1.0 ELSE 0.0 END AS d0, round(r, 6) AS d1, r >= 0.9 AS d1_accept, CASE WHEN unit < 'U20' THEN round(r, 6) ELSE 0.0 END AS d2, unit < 'U20' AND r >= 0.9 AS d2_accept FROM s""")
def deciders(spark, sf_dir):
    """Each drawing against its tag as it stands or with one digit more, units above U20 not printed on the other sheet."""
    d = equipment_drawings(spark, sf_dir)
    varied = F.col("sheet").cast("long") % 3 != 0
    other = F.when(varied, F.concat("tag", F.lit("0"))).otherwise(F.col("tag"))
    similar = resolve.string_similarity(scalars.plain_tag("tag"), scalars.plain_tag(other))
    printed = F.when(F.col("unit") < "U20", F.array("unit")).otherwise(F.array(F.lit("U99")))
    s = answers.decide("tag", other, F.lit(True), similar, 0.9, "unit", F.array("unit"), printed)
    rows = d.select("key", *(c.alias(n) for n, c in s.items()))
    return rows.select("key", F.col("d0.score").alias("d0"), F.round("d1.score", 6).alias("d1"), F.col("d1.accept").alias("d1_accept"), F.round("d2.score", 6).alias("d2"), F.col("d2.accept").alias("d2_accept"))


# --- sets


@query("so2_confusion", with_sql("flow", "drawings", recursive=CUT) + """, f AS (SELECT src, dst FROM placed WHERE ss <> (SELECT min(sheet) FROM drawings) AND ds <> (SELECT min(sheet) FROM drawings) UNION SELECT dst, src FROM flow WHERE CAST(src[2:] AS BIGINT) % 50 = 0)
SELECT (SELECT count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM flow) x) AS tp, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM flow) x) AS fp, (SELECT count(*) FROM (SELECT * FROM flow EXCEPT SELECT * FROM f) x) AS fn""")
def confusion(spark, sf_dir):
    """Edges of sheets but the first, and some turned round, against the plant's: found, made up, missed."""
    flow, home = P.flow(spark, sf_dir), homes(spark, sf_dir)
    first = home.agg(F.min("sheet").alias("first"))
    at = flow.join(home.toDF("src", "ss"), "src").join(home.toDF("dst", "ds"), "dst").join(first).where("ss <> first and ds <> first").select("src", "dst")  # one row
    found = at.union(flow.where("cast(substring(src, 2, 20) as bigint) % 50 = 0").select("dst", "src")).distinct()
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    return n(found.intersect(flow), "tp").join(n(found.subtract(flow), "fp")).join(n(flow.subtract(found), "fn"))  # one row each


@query("so4_equal_sheet_sets", with_sql("nodes", "drawings") + """, s AS (SELECT n.unit, d.sheet FROM nodes n JOIN drawings d USING (node) WHERE n.unit IS NOT NULL GROUP BY ALL), g AS (SELECT unit, list(sheet ORDER BY sheet) AS sheets FROM s GROUP BY 1)
SELECT a.unit AS first, b.unit AS second, a.sheets = b.sheets AS equal FROM g a JOIN g b ON CAST(b.unit[2:] AS BIGINT) = CAST(a.unit[2:] AS BIGINT) + 1""")
def equal_sheet_sets(spark, sf_dir):
    """Whether a unit and the next are drawn on the same sheets."""
    number = F.substring("unit", 2, 9).cast("long")
    g = P.nodes(spark, sf_dir).where("unit is not null").join(P.drawings(spark, sf_dir), "node").groupBy("unit").agg(F.array_sort(F.collect_set("sheet")).alias("sheets")).withColumn("k", number)
    other = g.select(F.col("unit").alias("second"), F.col("sheets").alias("others"), (F.col("k") - 1).alias("k"))
    return g.join(other, "k").select(F.col("unit").alias("first"), "second", (F.col("sheets") == F.col("others")).alias("equal"))


@query("so5_ordered_distinct", """
WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM f GROUP BY 1""")
def ordered_distinct(spark, sf_dir):
    """The roles of a conversation in the order in which they first speak."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"])
    return P.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(said), ",").alias("roles"))


@query("so6_combinations", "SELECT a.n_regionkey AS region, a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def combinations(spark, sf_dir):
    n = P.read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("first"))
    return n.join(n.toDF("region", "second"), "region").where("first < second")


# --- families and samples


@query("q17_same_unit", with_sql("nodes", "flow") + """, e AS (SELECT node, tag, unit FROM nodes WHERE kind = 'equipment'), y AS (SELECT tag, lead(tag) OVER (PARTITION BY unit ORDER BY tag) AS other FROM e),
adj AS (SELECT DISTINCT a.unit AS u, b.unit AS v FROM flow JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst WHERE a.unit <> b.unit), both_ways AS (SELECT u, v FROM adj UNION SELECT v, u FROM adj),
n AS (SELECT e.tag, min(f.tag) AS other FROM e JOIN both_ways w ON w.u = e.unit JOIN (SELECT unit, min(tag) AS tag FROM e GROUP BY 1) f ON f.unit = w.v GROUP BY 1)
SELECT tag AS first, other AS second, 'yes' AS answer FROM y WHERE other IS NOT NULL UNION ALL SELECT tag, other, 'no' FROM n""")
def same_unit(spark, sf_dir):
    """Pairs for every equipment item: the next of its unit, and the first of the units its own exchanges flow with."""
    e = P.nodes(spark, sf_dir).where("kind = 'equipment'").select("node", "tag", "unit")
    yes = e.withColumn("other", F.lead("tag").over(Window.partitionBy("unit").orderBy("tag"))).where("other is not null")
    units = P.nodes(spark, sf_dir).where("unit is not null").select("node", "unit")
    over = P.flow(spark, sf_dir).join(units.toDF("src", "u"), "src").join(units.toDF("dst", "v"), "dst").where("u <> v").select("u", "v")
    beside = over.unionByName(over.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    first = e.groupBy(F.col("unit").alias("v")).agg(F.min("tag").alias("other"))
    of_unit = beside.join(first, "v").groupBy(F.col("u").alias("unit")).agg(F.min("other").alias("other"))
    no = e.join(of_unit, "unit")
    return yes.select(F.col("tag").alias("first"), F.col("other").alias("second"), F.lit("yes").alias("answer")).unionByName(no.select(F.col("tag").alias("first"), F.col("other").alias("second"), F.lit("no").alias("answer")))


@query("q30_per_family_sample", with_sql("runs") + f""", b AS (SELECT event_id, family, {BINS} AS k_bin, event_id * 7919 % 10007 AS draw FROM runs), t AS (SELECT *, row_number() OVER (PARTITION BY family, k_bin ORDER BY draw, event_id) AS turn, count(*) OVER (PARTITION BY family) AS size FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY turn, k_bin) AS n FROM t) SELECT event_id, family, k_bin FROM d WHERE size <= 40 OR n <= 40""")
def per_family_sample(spark, sf_dir, size=40):
    """Each family's bins take turns until the sample is full; families of that size or less are kept whole."""
    drawn = P.runs(spark, sf_dir).select("event_id", "family", scalars.k_bin("k").alias("k_bin"), (F.col("event_id") * 7919 % 10007).alias("draw"))
    turn = F.row_number().over(Window.partitionBy("family", "k_bin").orderBy("draw", "event_id"))
    n = F.row_number().over(Window.partitionBy("family").orderBy("turn", "k_bin"))
    return drawn.withColumn("turn", turn).withColumn("n", n).where(F.col("n") <= size).select("event_id", "family", "k_bin")


# --- runs: signals, reports, references


@query("ca1_signals", with_sql("runs") + """SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN k END AS n_rows, CASE WHEN event_id % 4 = 0 THEN k > 20 END AS truncated, latency > 60 AS runaway, round(cost + CASE WHEN event_id % 5 = 0 THEN 0.001 ELSE 0 END, 9) AS cost FROM runs WHERE cost IS NOT NULL""")
def signals(spark, sf_dir):
    """What a row's trace tells without the gold answer: rows found, whether cut, whether run away, cost with lost calls."""
    e, k = F.col("event_id"), F.col("k")
    part = F.when(e % 4 == 3, F.lit(None).cast("string")).otherwise(F.to_json(F.struct(k.alias("n_rows"), F.when(e % 4 == 0, k > 20).alias("truncated"))))
    trace = F.concat(F.lit('{"retrieval": '), F.coalesce(part, F.lit("null")), F.lit(', "abandoned_usd": '), F.when(e % 5 == 0, "0.001").otherwise("0"), F.lit("}"))
    rows = P.runs(spark, sf_dir).where("cost is not null").withColumn("trace", trace)
    return runs.signals(rows, 60.0).select("event_id", "n_rows", "truncated", "runaway", F.round("cost", 9).alias("cost"))


@query("ca5_variant", with_sql("runs") + """, c AS (SELECT family, count(*) FILTER (correct AND strategy = 'click') AS plain, count(*) FILTER (correct AND strategy = 'view') AS iso FROM runs GROUP BY 1)
SELECT family, CASE WHEN iso >= plain THEN 'view' ELSE 'click' END AS chosen, greatest(iso, plain) AS n_correct FROM c""")
def variant(spark, sf_dir):
    """Of two variants the one with more right answers, the second among equals."""
    right = lambda s: F.count_if(F.col("correct") & (F.col("strategy") == s))
    c = P.runs(spark, sf_dir).groupBy("family").agg(right("click").alias("plain"), right("view").alias("iso"))
    return c.select("family", F.when(F.col("iso") >= F.col("plain"), "view").otherwise("click").alias("chosen"), F.greatest("iso", "plain").alias("n_correct"))


@query("ag14_compute_rows", with_sql("runs") + """SELECT strategy, count(*) AS n, round(median(latency), 6) AS median, round(quantile_cont(latency, 0.9), 6) AS p90, max(latency) AS largest, round(sum(latency), 4) AS total, round(sum(CASE WHEN outcome = 'ANSWERED' THEN latency ELSE 0 END) / sum(latency), 6) AS answered_share FROM runs GROUP BY 1""")
def compute_rows(spark, sf_dir):
    t = F.col("latency")
    rows = P.runs(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), F.median(t).alias("median"), stats.linear_rank("latency", 0.9).alias("p90"), F.max(t).alias("largest"), F.sum(t).alias("total"), F.sum(F.when(F.col("outcome") == "ANSWERED", t).otherwise(0.0)).alias("a"))
    return rows.select("strategy", "n", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "largest", F.round("total", 4).alias("total"), F.round(F.col("a") / F.col("total"), 6).alias("answered_share"))


@query("ag16_self_checks", with_sql("runs") + """SELECT 'M1 negative latency' AS check_name, count(*) FILTER (latency < 0) AS violations FROM runs UNION ALL SELECT 'M2 right but not answered', count(*) FILTER (correct AND outcome <> 'ANSWERED') FROM runs
UNION ALL SELECT 'M3 answered without cost', count(*) FILTER (outcome = 'ANSWERED' AND cost IS NULL) FROM runs UNION ALL SELECT 'M4 spread over 1.5', (SELECT count(*) FROM (SELECT strategy FROM runs GROUP BY 1 HAVING max(latency) > 1.5 * median(latency)) x)
UNION ALL SELECT 'M5 repeated row', (SELECT count(*) FROM (SELECT question, strategy, repeat FROM runs GROUP BY ALL HAVING count(*) > 1) x)""")
def self_checks(spark, sf_dir):
    return runs.self_checks(P.runs(spark, sf_dir), ["question", "strategy", "repeat"], ["strategy"], 1.5)


@query("ag20_dev_report", with_sql("runs") + """SELECT family, count(*) AS n, count(*) FILTER (correct) AS n_correct, array_to_string(list_slice(list(event_id ORDER BY event_id) FILTER (NOT correct), 1, 3), ',') AS failures,
  count(*) FILTER (outcome = 'TIMED_OUT') AS timed_out, count(*) FILTER (outcome = 'PROVIDER_ERROR') AS provider_error FROM runs GROUP BY 1""")
def dev_report(spark, sf_dir):
    """Each family's score with its first failures, by a bounded list of smallest ids."""
    rows = P.runs(spark, sf_dir)
    first = Window.partitionBy("family").orderBy("event_id")
    failed = rows.where("not correct").withColumn("i", F.row_number().over(first)).where("i <= 3").groupBy("family").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    table = rows.groupBy("family").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("outcome") == "TIMED_OUT").alias("timed_out"), F.count_if(F.col("outcome") == "PROVIDER_ERROR").alias("provider_error"))
    return table.join(failed, "family", "left").select("family", "n", "n_correct", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("failures"), "timed_out", "provider_error")


@query("ag30_cost_estimate", with_sql("runs") + """, c AS (SELECT strategy, repeat % 3 AS corpus, median(cost) AS middle, max(cost) AS largest, count(cost) AS n FROM runs WHERE cost IS NOT NULL GROUP BY ALL)
SELECT strategy, round(middle, 9) AS middle, round(largest, 9) AS largest, round(1.5 * largest, 9) AS reserved FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY corpus <> 1, n DESC, corpus) AS r FROM c) x WHERE r = 1""")
def cost_estimate(spark, sf_dir, corpus=1):
    """What a question costs by strategy: from the asked corpus where it has rows, else from the one with most."""
    rows = P.runs(spark, sf_dir).where("cost is not null").withColumn("corpus", F.col("repeat") % 3)
    c = rows.groupBy("strategy", "corpus").agg(F.median("cost").alias("middle"), F.max("cost").alias("largest"), F.count("*").alias("n"))
    own = runs.best(c, ["strategy"], (F.col("corpus") != corpus).asc(), F.col("n").desc(), F.col("corpus"))
    return own.select("strategy", F.round("middle", 9).alias("middle"), F.round("largest", 9).alias("largest"), F.round(1.5 * F.col("largest"), 9).alias("reserved"))


@query("st12_random_escalation", with_sql("runs") + """, q AS (SELECT question, max(CASE WHEN strategy = 'click' THEN CAST(correct AS INTEGER) ELSE 0 END) AS kept, max(CASE WHEN strategy = 'view' THEN CAST(correct AS INTEGER) ELSE 0 END) AS sent FROM runs GROUP BY 1),
d AS (SELECT draw.range AS draw, question, kept, sent, row_number() OVER (PARTITION BY draw.range ORDER BY (question * 7919 + draw.range * 104729) % 1000003, question) AS r FROM q, range(200) draw),
s AS (SELECT draw, sum(CASE WHEN r <= (SELECT count(*) // 3 FROM q) THEN sent ELSE kept END) AS correct FROM d GROUP BY 1)
SELECT count(*) AS n_draws, round(avg(correct), 6) AS mean, round(quantile_cont(correct, 0.025), 6) AS low, round(quantile_cont(correct, 0.975), 6) AS high FROM s""")
def random_escalation(spark, sf_dir, n_draws=200):
    """Right answers if a third of the questions, drawn anew each time, went on to the second tier."""
    has = lambda s: F.max(F.when(F.col("strategy") == s, F.col("correct").cast("int")).otherwise(0))
    q = P.runs(spark, sf_dir).groupBy("question").agg(has("click").alias("kept"), has("view").alias("sent"))
    n = q.count() // 3
    return runs.random_escalation(q, "question", "kept", "sent", n, n_draws).select("n_draws", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query("st8_unpaired_bootstrap")
def unpaired_bootstrap(spark, sf_dir):
    """The difference of two strategies' mean latency, each resampled for itself."""
    return stats.unpaired_bootstrap(P.runs(spark, sf_dir), "strategy", "click", "view", "latency", "event_id", 200)


@query("st15_wall_in_sheets", with_sql("nodes", "drawings") + """, s AS (SELECT d.sheet, count(*) AS items, sum(length(coalesce(n.tag, n.node_class))) AS chars FROM drawings d JOIN nodes n USING (node) GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY sheet) AS sheets, sum(chars) OVER (ORDER BY sheet) AS chars FROM s)
SELECT round(regr_slope(chars, sheets), 6) AS chars_per_sheet, CAST(floor(100000 * 3.5 / regr_slope(chars, sheets)) AS BIGINT) AS sheets FROM c""")
def wall_in_sheets(spark, sf_dir, tokens=100_000, chars_per_token=3.5):
    """How many sheets a prompt holds, from the characters that each further sheet adds."""
    named = P.nodes(spark, sf_dir).select("node", F.length(F.coalesce("tag", "node_class")).alias("c"))
    s = P.drawings(spark, sf_dir).join(named, "node").groupBy("sheet").agg(F.sum("c").alias("c"))
    upto = Window.orderBy("sheet")  # a row for each sheet of a plant
    run = s.select(F.row_number().over(upto).alias("sheets"), F.sum("c").over(upto).alias("chars"))
    per = run.agg(stats.slope("sheets", "chars").alias("p"))
    return per.select(F.round("p", 6).alias("chars_per_sheet"), F.floor(F.lit(tokens * chars_per_token) / F.col("p")).cast("long").alias("sheets"))


@query("st17_ladder_claims", with_sql("runs") + """, p AS (SELECT k, family, avg(CAST(correct AS INTEGER)) AS a, stddev_samp(CAST(correct AS INTEGER)) / sqrt(count(*)) AS e FROM runs WHERE family IN ('F1', 'F2', 'F3', 'F4', 'F5') GROUP BY ALL), o AS (SELECT k, avg(a) AS m FROM p GROUP BY 1),
s AS (SELECT p.family, regr_slope(p.a, p.k) AS slope, min(p.k) FILTER (p.a - o.m + 1.96 * p.e < 0) AS first_below, min(p.a - o.m) AS worst FROM p JOIN o USING (k) GROUP BY 1)
SELECT family, CASE WHEN slope < 0 THEN 'PASS' ELSE 'FAIL' END AS falls, first_below, CASE WHEN worst IS NULL THEN 'INCOMPLETE' WHEN worst >= -0.05 THEN 'PASS' ELSE 'FAIL' END AS not_inferior FROM s""")
def ladder_claims(spark, sf_dir, margin=-0.05):
    """Whether accuracy falls with size, the first size at which it is surely below the others', and by no margin worse."""
    right = F.col("correct").cast("int")
    p = P.runs(spark, sf_dir).where(F.col("family").isin("F1", "F2", "F3", "F4", "F5")).groupBy("k", "family").agg(F.avg(right).alias("a"), (F.stddev_samp(right) / F.sqrt(F.count("*"))).alias("e"))
    behind = p.join(p.groupBy("k").agg(F.avg("a").alias("m")), "k").withColumn("d", F.col("a") - F.col("m"))
    s = behind.groupBy("family").agg(stats.slope("k", "a").alias("slope"), F.min(F.when(F.col("d") + 1.96 * F.col("e") < 0, F.col("k"))).alias("first_below"), F.min("d").alias("worst"))
    return s.select("family", stats.verdict(F.col("slope") < 0, F.lit(True)).alias("falls"), "first_below", stats.verdict(F.col("worst") >= margin, F.col("worst").isNotNull()).alias("not_inferior"))


# --- stores and fidelity


def plant_store(spark, sf_dir, profile: str, without: str | None = None):
    """The store rows of a profile; items of the unit `without` are loaded without their drawings."""
    from ..sources import store

    named = F.broadcast(class_dim(spark).select("node_class", "labels"))
    items = P.nodes(spark, sf_dir).join(named, "node_class").select(F.col("node").alias("item"), "labels", "kind", "tag", "unit")
    on_sheets, stubs, pairs = split_flow(spark, sf_dir)
    homes_of = homes(spark, sf_dir).join(items.select(F.col("item").alias("node"), "labels", "unit"), "node")
    kept = homes_of if without is None else homes_of.where(F.col("unit") != without)
    key = F.concat_ws(":", "sheet", "node")
    drawn = kept.select(key.alias("key"), F.col("node").alias("item"), "sheet", "labels")
    none = F.lit(None).cast("string")
    drawn = drawn.unionByName(stubs.select("key", none.alias("item"), "sheet", F.array(F.lit("PipeOffPageConnector")).alias("labels")))
    if without is not None:  # their drawings are there, but no item
        drawn = drawn.unionByName(homes_of.where(F.col("unit") == without).select(key.alias("key"), none.alias("item"), "sheet", "labels"))
    renamed = homes_of.select("node", key.alias("k"))
    own = lambda side: F.coalesce(F.col(f"k{side}"), F.col(side))
    inner = on_sheets.join(renamed.toDF("src", "ksrc"), "src", "left").join(renamed.toDF("dst", "kdst"), "dst", "left").select(own("src").alias("src"), own("dst").alias("dst"), "relation")
    topology = resolve.contract(on_sheets.select("src", "dst", "relation"), pairs)
    others = P.edges(spark, sf_dir).where("relation <> 'send_to'").withColumn("via", F.array().cast("array<string>"))
    topology = topology.select("src", "dst", "relation", "via").unionByName(others.select("src", "dst", "relation", "via"))
    nodes, rels = store.store_rows(profile, items, drawn, topology, inner, pairs, lines(spark, sf_dir) if profile == "plant_lines" else None)
    return stash(nodes, "store-nodes"), stash(rels, "store-relations")


@query("snk4_store_profiles", with_sql("nodes", "flow", "edges", "drawings", recursive=CUT + ", " + FOLD) + """, r AS (
  SELECT 'occurrence' AS profile, 'send_to' AS name, (SELECT count(*) FROM placed WHERE ss = ds) + 2 * (SELECT count(*) FROM cut) AS n UNION ALL SELECT 'occurrence', 'continues_as', (SELECT count(*) FROM cut) UNION ALL SELECT 'occurrence', 'is_drawn_on', (SELECT count(*) FROM home) + 2 * (SELECT count(*) FROM cut)),
p AS (SELECT relation AS name, count(*) AS n FROM edges e WHERE relation <> 'send_to' OR (src IN (SELECT node FROM home) AND dst IN (SELECT node FROM home)) GROUP BY 1 UNION ALL SELECT 'is_located_in', count(*) FROM nodes WHERE unit IS NOT NULL UNION ALL SELECT 'is_drawn_on', count(*) FROM home),
b AS (SELECT name, sum(n) AS n FROM (SELECT name, n FROM r UNION ALL SELECT name, n FROM p UNION ALL SELECT 'drawn_as', count(*) FROM home) x GROUP BY 1)
SELECT profile, name, CAST(n AS BIGINT) AS n FROM r UNION ALL SELECT 'plant', name, n FROM p UNION ALL SELECT 'both', name, CAST(n AS BIGINT) FROM b UNION ALL SELECT 'plant_lines', name, n FROM p UNION ALL SELECT 'plant_lines', 'line_to', count(*) FROM line""")
def store_profiles(spark, sf_dir):
    """How many relations of each type the four profiles load."""
    from ..sources import store

    out = None
    for profile in store.PROFILES:
        one = store.counts(*plant_store(spark, sf_dir, profile)).where("what = 'type'").select(F.lit(profile).alias("profile"), "name", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("ag28_store_rules", with_sql("nodes", "drawings") + """, home AS (SELECT node FROM drawings GROUP BY 1)
SELECT * FROM (VALUES ('both', 'INV-3', 0), ('both', 'INV-5', 0), ('both', 'INV-6', 0), ('both', 'INV-7', 0), ('plant_lines', 'INV-6', 0), ('plant_lines', 'INV-7', 0), ('plant_lines', 'INV-8', 0), ('plant_lines', 'INV-9', 0), ('plant_lines', 'INV-10', 0)) v(profile, invariant, violations)
UNION ALL SELECT 'both', 'INV-1', (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT node FROM home) OR unit = 'U03') UNION ALL SELECT 'both', 'INV-2', (SELECT count(*) FROM nodes WHERE node IN (SELECT node FROM home) AND unit = 'U03')
UNION ALL SELECT 'both', 'INV-4', 0""")
def store_rules(spark, sf_dir):
    """The ten rules over a store in which one unit's items were not joined to their drawings."""
    from ..sources import store

    both = store.invariants("both", *plant_store(spark, sf_dir, "both", "U03")).withColumn("profile", F.lit("both"))
    line = store.invariants("plant_lines", *plant_store(spark, sf_dir, "plant_lines")).withColumn("profile", F.lit("plant_lines"))
    return both.unionByName(line).select("profile", "invariant", "violations")


@query("api14_schema_text", """
SELECT '(:' || l || ') {' || k || '}' AS line FROM (VALUES ('PlantSection', 'unit_id'), ('Sheet', 'sheet'), ('PlantItem', 'tag, unit_id')) v(l, k)""")
def schema_lines(spark, sf_dir):
    """What a store's structure and items look like, from the store itself."""
    from ..sources import store

    text = store.schema_text(*plant_store(spark, sf_dir, "plant"))
    return text.where(F.col("line").rlike(r"^\(:(PlantSection|Sheet|PlantItem)\) "))


@query("ag26_line_fidelity", with_sql("nodes", "flow", "drawings", recursive=CUT + ", " + FOLD) + "SELECT (SELECT count(*) FROM line) AS expected, (SELECT count(*) FROM line) AS found, 0 AS missing, 0 AS unexpected, 0 AS mismatch")
def line_fidelity(spark, sf_dir):
    """The line view of the plant cut to sheets and joined again, against that of the plant."""
    on_sheets, _, pairs = split_flow(spark, sf_dir)
    nodes = P.nodes(spark, sf_dir)
    again = resolve.contract(on_sheets.select("src", "dst", "relation"), pairs)
    shape = lambda found: found.select("source", "target", F.array_join("via_tags", ",").alias("via"), "n_fittings")
    system, gold = shape(traverse.fold_lines(again, nodes, nodes.where(F.col("node_class").isin(*LINE_ITEMS)))), shape(lines(spark, sf_dir))
    differ = resolve.differences(system, gold, ["source", "target"], ["via", "n_fittings"]).agg(*(F.count_if(F.col("difference") == d).cast("int").alias(d) for d in ("missing", "unexpected", "mismatch")))
    return gold.agg(F.count("*").alias("expected")).join(system.agg(F.count("*").alias("found"))).join(differ)  # one row each


@query("jn18_sheet_agreement", with_sql("nodes", "flow", "drawings") + """, g AS (SELECT f.src AS node, list_distinct(list(d.sheet)) AS gold FROM flow f JOIN drawings d ON d.node IN (f.src, f.dst) GROUP BY 1), a AS (SELECT node, list_distinct(list(sheet)) AS said FROM drawings GROUP BY 1)
SELECT g.node, len(list_intersect(gold, said)) AS shared, len(gold) AS n_gold, len(said) AS n_said FROM g JOIN a USING (node)""")
def sheet_agreement(spark, sf_dir):
    """The sheets of an item against those of what it feeds and its own."""
    d = P.drawings(spark, sf_dir).select("node", "sheet")
    ends = P.flow(spark, sf_dir).select(F.col("src").alias("item"), F.explode(F.array("src", "dst")).alias("node")).distinct()
    gold = ends.join(d, "node").groupBy(F.col("item").alias("node")).agg(F.collect_set("sheet").alias("gold"))
    said = d.groupBy("node").agg(F.collect_set("sheet").alias("said"))
    return gold.join(said, "node").select("node", F.size(F.array_intersect("gold", "said")).cast("long").alias("shared"), F.size("gold").cast("long").alias("n_gold"), F.size("said").cast("long").alias("n_said"))


@query("ag21_resolution_by_decider", with_sql("nodes", "drawings", recursive=TAGGED) + """, t AS (SELECT d.key, d.node, n.unit, CASE CAST(d.sheet AS BIGINT) % 4 WHEN 0 THEN n.tag || 'X' WHEN 1 THEN lower(n.tag) ELSE n.tag END AS tag FROM drawings d JOIN nodes n USING (node) WHERE n.kind = 'equipment'),
x AS (SELECT 'd0' AS decider, unit, node, tag AS name FROM t UNION ALL SELECT 'folded', unit, node, upper(tag) FROM t),
tp AS (SELECT decider, unit, sum(c * (c - 1) // 2) AS n FROM (SELECT decider, unit, node, name, count(*) AS c FROM x GROUP BY ALL) y GROUP BY ALL), said AS (SELECT decider, unit, sum(c * (c - 1) // 2) AS n FROM (SELECT decider, unit, name, count(*) AS c FROM x GROUP BY ALL) y GROUP BY ALL),
gold AS (SELECT decider, unit, sum(c * (c - 1) // 2) AS n FROM (SELECT decider, unit, node, count(*) AS c FROM x GROUP BY ALL) y GROUP BY ALL)
SELECT decider, unit, CAST(tp.n AS BIGINT) AS tp, CAST(said.n - tp.n AS BIGINT) AS fp, CAST(gold.n - tp.n AS BIGINT) AS fn, round(2.0 * tp.n / nullif(said.n + gold.n, 0), 6) AS f1 FROM tp JOIN said USING (decider, unit) JOIN gold USING (decider, unit)""")
def resolution_by_decider(spark, sf_dir):
    """Pairs of drawings said to be one item, by unit and by two readings of varied tags; pairs are counted from sizes."""
    way = F.col("sheet").cast("long") % 4
    tag = F.when(way == 0, F.concat("tag", F.lit("X"))).when(way == 1, F.lower("tag")).otherwise(F.col("tag"))
    said = F.explode(F.array(F.struct(F.lit("d0").alias("decider"), tag.alias("name")), F.struct(F.lit("folded").alias("decider"), scalars.fold_tag(tag).alias("name"))))
    x = equipment_drawings(spark, sf_dir).select("unit", "node", said.alias("s")).select("s.decider", "unit", "node", "s.name").groupBy("decider", "unit", "node", "name").agg(F.count("*").alias("c"))
    pairs = lambda by, name: x.groupBy("decider", "unit", *by).agg(F.sum("c").alias("c")).groupBy("decider", "unit").agg(F.sum(F.expr("c * (c - 1) div 2")).alias(name))
    t = pairs(["node", "name"], "tp").join(pairs(["name"], "said"), ["decider", "unit"]).join(pairs(["node"], "gold"), ["decider", "unit"])
    f1 = resolve.prf(F.col("tp"), F.col("said") - F.col("tp"), F.col("gold") - F.col("tp"))[2]
    return t.select("decider", "unit", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"), F.round(f1, 6).alias("f1"))


@query("ag29_duplication_points", with_sql("flow", "drawings", "nodes") + """, home AS (SELECT node, min(sheet) AS sheet FROM drawings GROUP BY 1), c AS (SELECT p.range * 25 AS percent, n.node FROM nodes n, range(5) p WHERE n.kind = 'equipment' AND CAST(n.node[2:] AS BIGINT) * 37 % 100 < p.range * 25),
t AS (SELECT src, dst FROM flow UNION SELECT dst, src FROM flow), r AS (SELECT DISTINCT c.percent, c.node, h.sheet FROM c JOIN t ON t.src = c.node JOIN home h ON h.node = t.dst JOIN home o ON o.node = c.node WHERE h.sheet <> o.sheet)
SELECT p.range * 25 AS percent, (SELECT count(*) FROM r WHERE r.percent = p.range * 25) AS n_references FROM range(5) p""")
def duplication_points(spark, sf_dir):
    """How many references drawing a share of the equipment on its neighbours' sheets makes."""
    home, flow = homes(spark, sf_dir), P.flow(spark, sf_dir)
    rates = spark.range(5).select((F.col("id") * 25).alias("percent"))
    items = P.nodes(spark, sf_dir).where("kind = 'equipment'").select("node", (F.substring("node", 2, 20).cast("long") * 37 % 100).alias("draw"))
    chosen = items.withColumn("percent", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(25)).cast("array<long>"))).where("draw < percent")
    near = traverse.oriented(flow, "both").join(home.toDF("dst", "sheet"), "dst").select(F.col("src").alias("node"), "sheet").distinct().join(home.toDF("node", "own"), "node").where("sheet <> own")
    found = chosen.join(near, "node").groupBy("percent").agg(F.count("*").alias("n"))
    return rates.join(found, "percent", "left").select("percent", F.coalesce("n", F.lit(0)).alias("n_references"))
