"""Links within blocks against the operators that take links pair by pair."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sheetweave import plans
from sheetweave.operators import blocks, grouping, resolve

from .oracle import actual

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def drawings(spark):
    rng = random.Random(3)
    rows = {}
    for _ in range(160):
        sheet, digits = f"S{rng.randrange(9)}", rng.choice(["12", "3", "45", "7"])
        tag = rng.choice(["P-", "PX", "V0-", "p"]) + rng.choice(["", "0", "00"]) + "0".join(digits) + rng.choice(["", "0"])
        rows[f"{sheet}:p{rng.randrange(90)}"] = (sheet, rng.choice(["Tank", "Pump"]), tag, rng.randrange(4))
    odd = [("S1:q1", "S1", "Tank", None, 1), ("S1:q2", "S1", "Tank", "none", 1), ("q3", None, "Tank", "P-12", 1), ("S2:q4", "S2", None, "P-12", 1), ("S3:q5", "S3", "Tower", "P-12", 1)]
    return spark.createDataFrame([(k, *v) for k, v in rows.items()] + odd, "key string, sheet string, node_class string, tag string, n_properties long").repartition(5).cache()


@pytest.fixture(params=[(2_000, 2_000_000), (2_000, 5), (20, 2_000_000), (1, 2_000_000)], ids=["whole", "few at a time", "some by joins", "all by joins"])
def limits(request, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_DRAWINGS", request.param[0])
    monkeypatch.setattr(blocks, "MOST_PAIRS", request.param[1])


def scored(drawings):
    return resolve.block_candidates(drawings).withColumn("score", resolve.string_similarity("tag", "tag_b"))


def test_one_to_one_in_blocks(drawings, limits):
    sheet = lambda c: F.substring_index(c, ":", 1)
    links = scored(drawings).select("a", "b", sheet("a").alias("sheet_a"), sheet("b").alias("sheet_b"), "score")
    assert actual(blocks.one_to_one(drawings)) == actual(resolve.one_to_one(links))
    assert links.count() > 600


def test_groups_in_blocks(drawings, limits):
    found = actual(blocks.group_with_links(drawings))
    assert found == actual(grouping.group_with_links(drawings.select("key", "sheet", "n_properties"), scored(drawings).select("a", "b", "score")))
    assert blocks.group_with_links(drawings).agg(F.max("refused")).first()[0] > 3


@pytest.mark.parametrize("name", ["gr34_group_with_links", "gr35_one_to_one"])
def test_no_pair_is_written(spark, name):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("sheetweave/*"))
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
    written = {p.name.rsplit("-", 1)[0] for p in set(shared.glob("sheetweave/*")) - before}
    assert written == {"block-drawings", "block-large"}
