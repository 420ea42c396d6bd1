"""Files of runs and drawings as DataFrames, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION = "question_id string, corpus_id string, family string, template_id string, template_version int, text string, answer_type string, answerable boolean, reference string, evidence_tags array<string>, evidence_sheets array<string>, k int, k_connector int, k_identity int, u int, anchors array<string>, generator_seed long"
ANSWER = "run_id string, question_id string, strategy string, repeat int, outcome string, final_answer struct<answer:string,not_present:boolean>, correct boolean, f1 double, prompt_tokens long, completion_tokens long, cost_usd double, latency_s double, context_chars long, trace string, retrieval_usage struct<n_calls:int,prompt_tokens:long,completion_tokens:long,cost_usd:double,n_cost_missing:int,llm_latency_s:double,n_abandoned:int>"
TIMING = "question_id string, strategy string, repeat int, local_compute_s double, spent_usd double, n_cached_retrieval_calls int, clock string, wall_s double, db_client_s double, db_server_s double, n_db_queries int, graph_api_s double, n_graph_api_calls int"
#: What identifies a row of answers or timings.
ROW_KEY = ["question_id", "strategy", "repeat"]


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object per line; a line that is none is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checked(rows: DataFrame, key: list[str] = ROW_KEY) -> DataFrame:
    """The rows, if no key stands twice with different content; a row that is repeated whole counts once."""
    whole = rows.distinct()
    again = whole.groupBy(*key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"key {tuple(again[0])[:-1]} has several rows")
    return whole


def question_digests(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.sha2(F.concat_ws("\n", "question_id", "text"), 256).alias("digest"))


def latest_value(spark: SparkSession, path: str) -> float | None:
    """The value of the last time in a metrics file of columns t, value."""
    row = spark.read.schema("t double, value double").option("header", True).csv(path).agg(F.max_by("value", "t").alias("v")).first()
    return row["v"]


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length")).first()[0] or 0


GRAPHML_NODE = T.StructType([T.StructField("_id", T.StringType()), T.StructField("data", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())])))])
GRAPHML_EDGE = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()), T.StructField("data", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())])))])


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node, properties map) and (src, dst, properties map) of GraphML files."""
    props = F.map_from_entries(F.transform(F.coalesce("data", F.array()), lambda d: F.struct(d["_key"], d["_VALUE"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(GRAPHML_NODE).load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(GRAPHML_EDGE).load(path)
    return nodes.select(F.col("_id").alias("node"), props.alias("properties")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), props.alias("properties"))


def relabel_unknown(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Nodes of classes outside the vocabulary become GenericItem and keep their own class."""
    known = F.broadcast(classes.select("node_class", F.lit(True).alias("_known")))
    joined = nodes.join(known, "node_class", "left")
    return joined.withColumn("original_class", F.when(F.col("_known").isNull(), F.col("node_class"))).withColumn("node_class", F.when(F.col("_known").isNull(), "GenericItem").otherwise(F.col("node_class"))).drop("_known")
