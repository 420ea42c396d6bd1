"""Strategies, greedy choices and resampling against plain Python."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from sheetweave import plans
from sheetweave.functions import stats
from sheetweave.operators import resolve, split
from sheetweave.plans import projection as P

FOLDER = "/root/testdata/sf0.001"


def test_groups_share_sheets_within_caps(spark):
    rng = np.random.default_rng(1)
    rows = [(u, i, int(rng.integers(1, 9)), int(rng.integers(1, 30)), bool(rng.random() < 0.2)) for u in "ab" for i in range(25)]
    found = {(r["u"], r["i"]): r["merged"] for r in split.merge_groups(spark.createDataFrame(rows, "u string, i int, e int, s int, pinned boolean"), "u", "i", ["e", "s"], [12, 40], "pinned").collect()}
    for unit in "ab":
        sheet, used, alone = 0, None, False
        for u, i, e, s, pinned in rows:
            if u != unit:
                continue
            if used is not None and not alone and not pinned and used[0] + e <= 12 and used[1] + s <= 40:
                used = (used[0] + e, used[1] + s)
            else:
                sheet += used is not None
                used, alone = (e, s), pinned
            assert found[(u, i)] == sheet


def test_links_are_chosen_greedily(spark):
    rng = np.random.default_rng(2)
    links = [(f"k{a}", f"k{b}", f"s{a % 4}", f"s{b % 4}", float(rng.integers(1, 6)) / 5) for a in range(30) for b in range(a + 1, 30) if a % 4 != b % 4 and rng.random() < 0.15]
    found = {(r["a"], r["b"]) for r in resolve.one_to_one(spark.createDataFrame(links, "a string, b string, sheet_a string, sheet_b string, score double")).collect()}
    taken, want = set(), set()
    for a, b, sa, sb, _ in sorted(links, key=lambda x: (-x[4], x[0], x[1])):
        if (a, sb) not in taken and (b, sa) not in taken:
            taken |= {(a, sb), (b, sa)}
            want.add((a, b))
    assert found == want


def test_flow_greedy_fills_sheets_up_to_the_budget(spark):
    kinds = {r["node"]: r["kind"] for r in P.nodes(spark, FOLDER).collect()}
    sheets = defaultdict(list)
    for r in plans.QUERIES["gr30_flow_greedy"](spark, FOLDER).collect():
        sheets[r["sheet"]].append(r["node"])
    placed = [n for own in sheets.values() for n in own]
    assert sorted(placed) == sorted(n for n, k in kinds.items() if k in ("equipment", "valve", "inline"))
    assert max(sum(kinds[n] == "equipment" for n in own) for own in sheets.values()) == 4


@pytest.mark.parametrize("kind", ["paired", "unpaired"])
def test_resampled_intervals_are_as_wide_as_they_should_be(spark, kind):
    rng = np.random.default_rng(3)
    a, b = rng.normal(1.0, 2.0, 900), rng.normal(0.5, 1.0, 900)
    rows = [("x", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    if kind == "paired":
        r = stats.paired_bootstrap(spark.createDataFrame(rows, "g string, i long, a double, b double"), ["g"], "a", "b", 2000).first()
        error = (a - b).std() / 30
    else:
        long = [(g, k, v) for _, i, x, y in rows for g, k, v in (("p", i, x), ("q", i + 1000, y))]
        r = stats.unpaired_bootstrap(spark.createDataFrame(long, "g string, i long, v double"), "g", "p", "q", "v", "i", 600).first()
        error = np.sqrt(a.var() / 900 + b.var() / 900)
    assert r["mean_diff"] == pytest.approx((a - b).mean())
    assert r["mean_diff"] - r["low"] == pytest.approx(1.96 * error, rel=0.15) and r["high"] - r["mean_diff"] == pytest.approx(1.96 * error, rel=0.15)
