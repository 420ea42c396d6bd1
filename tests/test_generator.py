"""Generated plants keep the rules; groups keep one drawing a sheet."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheetweave.operators import filters
from sheetweave.operators.grouping import group_with_links
from sheetweave.schema import class_dim
from sheetweave.sources.generator import GeneratorConfig, generate


@pytest.mark.parametrize("seed", [0, 3])
def test_generated_plant_keeps_the_rules_and_agrees_with_itself(spark, seed):
    config = GeneratorConfig(seed=seed, n_units=30, valves_max=3)
    nodes, edges = generate(spark, config)
    assert filters.plant_violations(nodes, edges, class_dim(spark)).count() == 0
    assert sorted(map(tuple, edges.collect()), key=str) == sorted(map(tuple, generate(spark, config)[1].collect()), key=str)
    per_unit = [r["n"] for r in nodes.where("node like 'u%'").groupBy("unit").agg(F.count("*").alias("n")).collect()]
    assert len(per_unit) == 30 and all(3 <= n <= 8 for n in per_unit)
    fed = edges.where("relation = 'send_to'").select(F.regexp_extract("dst", r"^u(\d+)-eq1$", 1).alias("unit")).where("unit <> ''").distinct().count()
    assert fed >= 29 - 1


def test_groups_never_hold_two_drawings_of_a_sheet(spark):
    drawings = spark.createDataFrame([("1:a", "1", 3), ("2:b", "2", 5), ("1:c", "1", 1), ("3:d", "3", 5)], "key string, sheet string, n_properties long")
    links = spark.createDataFrame([("1:a", "2:b", 0.9), ("1:c", "2:b", 0.8), ("1:c", "3:d", 0.7)], "a string, b string, score double")
    found = {r["key"]: (r["home"], r["refused"]) for r in group_with_links(drawings, links).collect()}
    assert found == {"1:a": ("2:b", 1), "2:b": ("2:b", 1), "1:c": ("3:d", 1), "3:d": ("3:d", 1)}
