"""The driver tables seen as a plant: items, edges, drawings, stubs and answer runs, and the same as SQL.

Parts are items on flow lines (a binary tree with cross links and recycles), suppliers are control loops on them,
the months in which a part is shipped are the sheets it is drawn on, and events are answered questions of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

CLASSES = ("CentrifugalPump", "Tank", "PressureVessel", "HeatExchanger", "GlobeValve", "BallValve", "CheckValve", "PipeTee")
PREFIXES = ("P", "TK", "V", "E", "GV", "BV", "CHV")
N_UNITS = 25


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: tuple, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, node_class, tag, unit, loop_tag, kind) of parts and of the instruments of control loops."""
    k = F.col("p_partkey")
    unit = F.lpad(F.pmod(k, F.lit(N_UNITS)).cast("string"), 2, "0")
    cls = F.pmod(k, F.lit(8))
    kind = F.when(cls < 4, "equipment").when(cls < 7, "valve").otherwise("inline")
    tag = F.when(cls < 7, F.concat_ws("-", _pick(PREFIXES + ("",), cls), unit, k.cast("string")))
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("node"), _pick(CLASSES, cls).alias("node_class"), tag.alias("tag"), F.concat(F.lit("U"), unit).alias("unit"), F.lit(None).cast("string").alias("loop_tag"), kind.alias("kind"))
    s = F.col("s_suppkey")
    loop = F.concat(F.lit("L-"), s.cast("string"))
    kinds = (("s", "ProcessSignalGeneratingFunction", "FT-", "instrument"), ("c", "ProcessControlFunction", "FIC-", "instrument"), ("a", "ActuatingFunction", None, "actuator"))
    loops = None
    for letter, node_class, prefix, of_kind in kinds:
        printed = F.concat(F.lit(prefix), s.cast("string")) if prefix else F.lit(None).cast("string")
        one = read(spark, sf_dir, "supplier").select(F.concat(F.lit(letter), s.cast("string")).alias("node"), F.lit(node_class).alias("node_class"), printed.alias("tag"), F.lit(None).cast("string").alias("unit"), loop.alias("loop_tag"), F.lit(of_kind).alias("kind"))
        loops = one if loops is None else loops.unionByName(one)
    return parts.unionByName(loops)


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): send_to edges among parts."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    ends = [p.select("k", (2 * F.col("k") + 1).alias("t")), p.select("k", (2 * F.col("k") + 2).alias("t")), p.where("k % 7 = 0").select("k", (F.col("k") + 3).alias("t")), p.where("k % 97 = 0 and k > 0").select("k", F.floor(F.col("k") / 4).alias("t"))]
    whole = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).distinct()
    known = whole.join(p.select(F.col("k").alias("t")), "t", "left_semi")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    return known.select(name("k").alias("src"), name("t").alias("dst"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, relation): flow, and measured_by, send_signal_to and control of the loops."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    k = F.col("k")
    rows = [
        (name("p", 7 * k + 2), name("s", k), "measured_by"), (name("s", k), name("c", k), "send_signal_to"), (name("c", k), name("a", k), "send_signal_to"),
        (name("a", k), name("p", 8 * k + 4), "control"),
    ]
    whole = flow(spark, sf_dir).withColumn("relation", F.lit("send_to"))
    for a, b, relation in rows:
        whole = whole.unionByName(s.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation")))
    # every fifth loop drives a second valve
    return whole.unionByName(s.where("k % 5 = 0").select(name("c", k).alias("src"), name("a", k + 1).alias("dst"), F.lit("send_signal_to").alias("relation")).join(s.select(name("a", k).alias("dst")), "dst", "left_semi").select("src", "dst", "relation"))


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, sheet, key, n_properties): a part is drawn on a sheet for each month in which it is shipped."""
    sheet = F.date_format("l_shipdate", "yyyyMM")
    return read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node"), sheet.alias("sheet")).agg(F.count("*").alias("n_properties")).withColumn("key", F.concat_ws(":", "sheet", "node"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question, strategy, repeat, family, k, outcome, correct, cost, latency): an answer for each event."""
    e, v = F.col("event_id"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("int")
    outcome = F.when(e % 50 == 0, "TIMED_OUT").when(e % 41 == 0, "PROVIDER_ERROR").otherwise("ANSWERED")
    return read(spark, sf_dir, "events").select(
        (e % 997).alias("question"), F.col("event_type").alias("strategy"), F.col("user_id").alias("repeat"), F.concat(F.lit("F"), (e % 24).cast("string")).alias("family"), (k % 40).alias("k"),
        outcome.alias("outcome"), ((outcome == "ANSWERED") & (v > 20)).alias("correct"), F.when(e % 13 != 0, v / 1000).alias("cost"), (v / 2).alias("latency"), e.alias("event_id"), "ts",
    )


#: The projections as DuckDB common table expressions.
SQL = {
    "nodes": """nodes AS (
  SELECT 'p' || p_partkey AS node, (['CentrifugalPump', 'Tank', 'PressureVessel', 'HeatExchanger', 'GlobeValve', 'BallValve', 'CheckValve', 'PipeTee'])[p_partkey % 8 + 1] AS node_class,
    CASE WHEN p_partkey % 8 < 7 THEN (['P', 'TK', 'V', 'E', 'GV', 'BV', 'CHV', ''])[p_partkey % 8 + 1] || '-' || lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0') || '-' || p_partkey END AS tag,
    'U' || lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0') AS unit, CAST(NULL AS VARCHAR) AS loop_tag,
    CASE WHEN p_partkey % 8 < 4 THEN 'equipment' WHEN p_partkey % 8 < 7 THEN 'valve' ELSE 'inline' END AS kind FROM part
  UNION ALL SELECT 's' || s_suppkey, 'ProcessSignalGeneratingFunction', 'FT-' || s_suppkey, NULL, 'L-' || s_suppkey, 'instrument' FROM supplier
  UNION ALL SELECT 'c' || s_suppkey, 'ProcessControlFunction', 'FIC-' || s_suppkey, NULL, 'L-' || s_suppkey, 'instrument' FROM supplier
  UNION ALL SELECT 'a' || s_suppkey, 'ActuatingFunction', NULL, NULL, 'L-' || s_suppkey, 'actuator' FROM supplier)""",
    "flow": """flow AS (
  SELECT DISTINCT 'p' || k AS src, 'p' || t AS dst FROM (
    SELECT p_partkey AS k, 2 * p_partkey + 1 AS t FROM part UNION ALL SELECT p_partkey, 2 * p_partkey + 2 FROM part
    UNION ALL SELECT p_partkey, p_partkey + 3 FROM part WHERE p_partkey % 7 = 0
    UNION ALL SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey % 97 = 0 AND p_partkey > 0) x
  WHERE t IN (SELECT p_partkey FROM part))""",
    "edges": """edges AS (
  SELECT src, dst, 'send_to' AS relation FROM flow
  UNION ALL SELECT 'p' || (7 * s_suppkey + 2), 's' || s_suppkey, 'measured_by' FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'c' || s_suppkey, 'send_signal_to' FROM supplier
  UNION ALL SELECT 'c' || s_suppkey, 'a' || s_suppkey, 'send_signal_to' FROM supplier
  UNION ALL SELECT 'a' || s_suppkey, 'p' || (8 * s_suppkey + 4), 'control' FROM supplier
  UNION ALL SELECT 'c' || s_suppkey, 'a' || (s_suppkey + 1), 'send_signal_to' FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier))""",
    "drawings": """drawings AS (
  SELECT 'p' || l_partkey AS node, strftime(l_shipdate, '%Y%m') AS sheet, count(*) AS n_properties, strftime(l_shipdate, '%Y%m') || ':p' || l_partkey AS key FROM lineitem GROUP BY ALL)""",
    "runs": """runs AS (
  SELECT event_id % 997 AS question, event_type AS strategy, user_id AS repeat, 'F' || (event_id % 24) AS family, CAST(json_extract_string(props, '$.k') AS INTEGER) % 40 AS k,
    CASE WHEN event_id % 50 = 0 THEN 'TIMED_OUT' WHEN event_id % 41 = 0 THEN 'PROVIDER_ERROR' ELSE 'ANSWERED' END AS outcome,
    event_id % 50 <> 0 AND event_id % 41 <> 0 AND value > 20 AS correct, CASE WHEN event_id % 13 <> 0 THEN value / 1000 END AS cost, value / 2 AS latency, event_id, ts FROM events)""",
}


def with_sql(*names: str, recursive: str = "") -> str:
    """A WITH clause of the named projections, and of recursive parts."""
    return "WITH RECURSIVE " + ",\n".join([*(SQL[n] for n in names), *([recursive] if recursive else [])]) + "\n"
