"""Files, sinks and streams on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sheetweave.functions import scalars, stats
from sheetweave.operators import filters, resolve
from sheetweave.schema import class_dim, class_rows
from sheetweave.sources import files, sinks
from sheetweave.streaming import runlog


def test_vocabulary_has_its_rows_once():
    names = [r[0] for r in class_rows()]
    assert len(names) == len(set(names)) == 99


def test_answer_lines_are_read_and_checked(spark, tmp_path):
    rows = [{"question_id": "q1", "strategy": "a", "repeat": 0, "outcome": "ANSWERED", "latency_s": 1.5, "trace": {"n": 1}}] * 2 + [{"question_id": "q2", "strategy": "a", "repeat": 0, "outcome": "TIMED_OUT"}]
    (tmp_path / "answers.jsonl").write_text("\n".join(map(json.dumps, rows)))
    found = files.read_lines(spark, str(tmp_path / "answers.jsonl"), files.ANSWER)
    assert files.checked(found).count() == 2
    with pytest.raises(ValueError):
        files.checked(found.withColumn("latency_s", F.monotonically_increasing_id()))
    assert files.folder_bytes(spark, str(tmp_path)) == (tmp_path / "answers.jsonl").stat().st_size


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("b", {"tag": "P<1>", "secret": "x"}), ("a", {"tag": "T&2"})], "node string, properties map<string,string>")
    edges = spark.createDataFrame([("b", "a", {"relation": "send_to"})], "src string, dst string, properties map<string,string>")
    text = "\n".join(r["line"] for r in sinks.graphml_lines(nodes, edges, ("tag", "relation")).collect())
    assert text.index('id="a"') < text.index('id="b"') and "secret" not in text
    (tmp_path / "g.graphml").write_text(text)
    n, e = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["node"]: r["properties"] for r in n.collect()} == {"a": {"tag": "T&2"}, "b": {"tag": "P<1>"}}
    assert [tuple(r) for r in e.collect()] == [("b", "a", {"relation": "send_to"})]


def test_layer_is_replaced_and_checked(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Tank"), ("b", "Pump")], "node string, node_class string")
    edges = spark.createDataFrame([("a", "b", "send_to")], "src string, dst string, relation string")
    for corpus in ("c1", "c2", "c1"):
        assert sinks.write_layer(nodes, edges, str(tmp_path / "store"), corpus) == {"nodes": 2, "edges": 1}
    assert sinks.read_layer(spark, str(tmp_path / "store"), "c2")[0].count() == 2
    assert sinks.markdown(edges).splitlines()[-1] == "| a | b | send_to |"


def test_relabel_unknown_classes(spark):
    nodes = spark.createDataFrame([("a", "Tank"), ("b", "Gizmo")], "node string, node_class string")
    assert {(r["node"], r["node_class"], r["original_class"]) for r in files.relabel_unknown(nodes, class_dim(spark)).collect()} == {("a", "Tank", None), ("b", "GenericItem", "Gizmo")}


def test_log_is_appended_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = lambda rows: "\n".join(json.dumps({"question_id": q, "strategy": "s", "repeat": 0, "outcome": o}) for q, o in rows)
    for number, rows in enumerate(([("q1", "ANSWERED"), ("q2", "PROVIDER_ERROR")], [("q1", "ANSWERED"), ("q2", "ANSWERED"), ("q3", "TIMED_OUT")])):
        (log / f"{number}.json").write_text(lines(rows))
        runlog.append_once(runlog.read_log(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["question_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["q1", "q2", "q3"]


def test_gap_free_order(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out = []
    stream = spark.readStream.schema("run string, position long, value string").json(str(folder))
    query = runlog.gap_free(stream, "run", "position", "value").writeStream.foreachBatch(lambda b, i: out.extend(r["position"] for r in b.orderBy("position").collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    for number, positions in enumerate(([2, 0], [3], [1, 5])):
        (folder / f"{number}.json").write_text("\n".join(json.dumps({"run": "r", "position": p, "value": str(p)}) for p in positions))
        query.processAllAvailable()
    query.stop()
    assert out == [0, 1, 2, 3]


def test_event_windows_over_a_stream_match_the_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/events*")
    query = runlog.windowed(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    pick = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert pick(spark.table("windows")) == pick(runlog.windowed(batch, "1 day"))
    assert runlog.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_scalars(spark):
    df = spark.createDataFrame([("  gv - 1\t2 ", "UNIT 03", "+1_000", "512m", "GV-07-0012", "Query timed out")], "tag string, unit string, n string, size string, full string, error string")
    row = df.select(scalars.fold_tag("tag").alias("tag"), scalars.fold_unit("unit").alias("unit"), scalars.to_count("n").alias("n"), scalars.size_bytes("size").alias("size"), scalars.tag_parts("full").alias("p"), scalars.failure_kind("error").alias("e"), scalars.size_bytes(F.lit("4.00GiB")).alias("g")).first()
    assert (row["tag"], row["unit"], row["n"], row["size"], row["g"], row["e"]) == ("GV - 1 2", "03", 1000, 512 << 20, 4 << 30, "timeout")
    assert tuple(row["p"]) == ("GV", "07", 12, "")
    need = spark.createDataFrame([("What is the route from A to B?", 2), ("How many pumps?", 0), ("Which valves isolate A?", 1)], "q string, n int")
    assert [r[0] for r in need.select(scalars.need_label("q", "n")).collect()] == ["PATH", "COUNT", "ISOLATION"]


def test_path_and_set_scores(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["A", "x", "C"], ["A>X", "X>C"]), (["a", "c"], ["a", "c"], ["A>B"]), ([], [], [])], "ref array<string>, ans array<string>, ok array<string>")
    assert [r[0] for r in df.select(scalars.score_path("ref", "ans", F.col("ok"))).collect()] == [True, False, False]
    assert [round(r[0], 3) for r in df.select(scalars.score_sets("ref", "ans")["f1"]).collect()] == [0.667, 1.0, 1.0]


def test_percentiles(spark):
    df = spark.range(10).withColumn("g", F.lit(1))
    row = df.agg(stats.nearest_rank("id", 0.9).alias("n"), stats.linear_rank("id", 0.9).alias("l")).first()
    assert (row["n"], round(row["l"], 6)) == (8, 8.1)


@pytest.mark.parametrize("text, clause", [("SELECT 'DROP TABLE x' -- delete", None), ("select 1; drop table x", "DROP"), ("MATCH (n) /* SET */ RETURN n", None), ("merge into x", "MERGE")])
def test_writing_clause(text, clause):
    assert filters.writing_clause(text) == clause


def test_stub_chains_contract_and_rings_fail(spark):
    edges = spark.createDataFrame([("x", "o1", "r"), ("i1", "o2", "r"), ("i2", "y", "r"), ("a", "b", "r")], "src string, dst string, relation string")
    pairs = spark.createDataFrame([("o1", "i1"), ("o2", "i2")], "from_key string, to_key string")
    assert {(r["src"], r["dst"], tuple(r["via"])) for r in resolve.contract(edges, pairs).collect()} == {("x", "y", ("o1", "i1", "o2", "i2")), ("a", "b", ())}
    ring = spark.createDataFrame([("x", "o1", "r"), ("i1", "o1", "r")], "src string, dst string, relation string")
    with pytest.raises(ValueError):
        resolve.contract(ring, spark.createDataFrame([("o1", "i1")], "from_key string, to_key string"))


def test_shared_labels_pair_null_safe_and_ambiguous_ones_stay(spark):
    schema = "key string, sheet string, direction string, connector_number string, ref_sheet string, ref_number string, line_number string, fluid_code string, loop_tag string, kind string, relation string"
    rows = [("S1:o", "S1", "outgoing", "1", "S2", None, "L1", None, None, "pipe", "send_to"), ("S2:i", "S2", "incoming", "1", "S1", None, "L1", None, None, "pipe", "send_to")]
    rows += [(f"S1:o{i}", "S1", "outgoing", "9", "S2", None, "L2", None, None, "pipe", "send_to") for i in (1, 2)] + [("S2:i2", "S2", "incoming", "9", "S1", None, "L2", None, None, "pipe", "send_to")]
    rows += [("S1:x", "S1", "outgoing", "5", "S9", None, None, None, None, "pipe", "send_to"), ("S1:y", "S1", "outgoing", "5", None, None, None, None, None, "pipe", "send_to")]
    pairs, open_ = resolve.pair_connectors(spark.createDataFrame(rows, schema), spark.createDataFrame([("S1",), ("S2",)], "sheet string"))
    assert [tuple(r) for r in pairs.collect()] == [("S1:o", "S2:i", "shared_label")]
    reason = "ambiguous: 2 outgoing, 1 incoming share this label"
    assert {tuple(r) for r in open_.collect()} == {("S1:o1", reason), ("S1:o2", reason), ("S2:i2", reason), ("S1:x", resolve.ABSENT), ("S1:y", resolve.NO_LABEL)}
