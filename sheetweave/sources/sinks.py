"""Where plants and reports go: the stored layers with their checks, GraphML, CSV and Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.filters import visible


def load_batches(rows: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """Rows with their batch within their group, in order."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def write_layer(nodes: DataFrame, edges: DataFrame, folder: str, corpus: str) -> dict[str, int]:
    """Replace a corpus in the store, once its new tables, read again, hold every label and relation as often as written.

    New tables are written beside the store; the old ones of the corpus give way only after the check, so a failed load
    leaves the store as it was, and nothing of an old version stays.
    """
    spark = nodes.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    counts, moves = {}, []
    stage = f"{folder}/_loading-{uuid.uuid4().hex}"
    system = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for name, table, by in (("nodes", nodes, "node_class"), ("edges", edges, "relation")):
            table.write.partitionBy(by).parquet(f"{stage}/{name}")
            stored = spark.read.schema(table.schema).parquet(f"{stage}/{name}")
            wrong = table.groupBy(by).agg(F.count("*").alias("n")).join(stored.groupBy(by).agg(F.count("*").alias("m")), by, "full").where("not (n <=> m)").limit(1).collect()
            if wrong:
                raise ValueError(f"{name} of {wrong[0][by]}: wrote {wrong[0]['n']}, found {wrong[0]['m']}")
            counts[name] = stored.count()
            moves.append((f"{stage}/{name}", f"{folder}/{name}/corpus={corpus}"))
        for new, place in moves:
            system.delete(hadoop(place), True)
            system.mkdirs(hadoop(place).getParent())
            system.rename(hadoop(new), hadoop(place))
    finally:
        system.delete(hadoop(stage), True)
    return counts


def read_layer(spark: SparkSession, folder: str, corpus: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{n}").where(F.col("corpus") == corpus).drop("corpus") for n in ("nodes", "edges"))


def footprint(nodes: DataFrame, edges: DataFrame, properties: str = "properties") -> DataFrame:
    """(nodes, relationships, properties) in one row."""
    size = F.sum(F.size(F.map_keys(properties)))
    return nodes.agg(F.count("*").alias("nodes"), size.alias("p")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("relationships")))).select("nodes", "relationships", F.col("p").alias("properties"))


def graphml_lines(nodes: DataFrame, edges: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(part, line) of a GraphML text: visible properties only, nodes by id, edges by ends; sorted when written."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = F.array_join(F.transform(F.array_sort(F.map_entries(visible(F.col("properties"), allowed))), lambda e: F.concat(F.lit('<data key="'), escape(e["key"]), F.lit('">'), escape(e["value"]), F.lit("</data>"))), "")
    node = F.concat(F.lit('<node id="'), escape(F.col("node")), F.lit('">'), data, F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), escape(F.col("src")), F.lit('" target="'), escape(F.col("dst")), F.lit('">'), data, F.lit("</edge>"))
    head = '<graphml><graph edgedefault="directed">'
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "", head), (3, "", "</graph></graphml>")], "part int, key string, line string")
    body = nodes.select(F.lit(1).alias("part"), F.col("node").alias("key"), node.alias("line")).unionByName(edges.select(F.lit(2).alias("part"), F.concat_ws("\x00", "src", "dst").alias("key"), edge.alias("line")))
    return ends.unionByName(body).orderBy("part", "key").select("line")


def write_report(rows: DataFrame, path: str) -> None:
    """A report of few rows as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, limit: int = 1_000) -> str:
    """A report of few rows as a table; a last line says if there are more than `limit`."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    found = rows.limit(limit + 1).collect()
    for row in found[:limit]:
        lines.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |")
    return "\n".join([*lines, *(["", f"(more than {limit} rows)"] if len(found) > limit else [])])
