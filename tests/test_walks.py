"""Walks over compact graphs give what walks by joins give, and both what a walk in Python gives."""

from __future__ import annotations

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetweave import plans
from sheetweave.operators import compact, traverse
from sheetweave.plans import projection as P

from .oracle import actual

FOLDER = "/root/testdata/sf0.001"
WALKS = [
    "gr1_closure_down", "gr1_closure_stops", "gr1_closure_in_unit", "gr1_ends_and_cuts", "gr3_shortest_path", "gr4_reach_with_crossings", "gr6_line_fold", "gr20_valve_ranges", "gr21_route_avoiding",
    "gr23_unreachable", "q06_flow_paths", "q07_upstream_isolation", "q11_no_path", "q13_connected", "q14_downstream_in_unit", "q16_upstream_sources", "q19_first_meeting_points", "q21_valves_on_path", "q23_units_reached", "q24_route_avoiding_answers",
]


@pytest.mark.parametrize("name", WALKS)
def test_joins_give_what_compact_graphs_give(spark, name, monkeypatch):
    whole = actual(plans.QUERIES[name](spark, FOLDER))
    monkeypatch.setattr(compact, "MOST_EDGES", 0)
    rows = actual(plans.QUERIES[name](spark, FOLDER))
    # an order of ranks may have gaps by joins, but the same order
    assert rows == whole


@pytest.mark.parametrize("most", [compact.MOST_EDGES, 0])
def test_nearest_owners_are_found_first_in_first_out(spark, most, monkeypatch):
    monkeypatch.setattr(compact, "MOST_EDGES", most)
    nodes, flow = P.nodes(spark, FOLDER), P.flow(spark, FOLDER)
    found = {r["node"]: (r["owner"], r["hops"]) for r in traverse.nearest_owners(flow, nodes, nodes.where("node_class = 'Tank'")).collect()}
    beside: dict = {}
    for r in flow.collect():
        beside.setdefault(r["src"], set()).add(r["dst"])
        beside.setdefault(r["dst"], set()).add(r["src"])
    owners = sorted(r["node"] for r in nodes.where("node_class = 'Tank'").collect())
    want, queue = {o: (o, 0) for o in owners}, deque(owners)
    while queue:
        node = queue.popleft()
        for other in sorted(beside.get(node, ())):
            if other not in want:
                want[other] = (want[node][0], want[node][1] + 1)
                queue.append(other)
    assert found == {n: want.get(n, (n, None)) for n in found} and set(want) <= set(found)


def test_flow_paths_are_the_first_shortest_ones(spark):
    nodes = {r["node"]: r for r in P.nodes(spark, FOLDER).collect()}
    after: dict = {}
    for r in P.flow(spark, FOLDER).collect():
        after.setdefault(r["src"], []).append(r["dst"])
    name = lambda n: nodes[n]["tag"] or n
    want = {}
    for start in [n for n, r in nodes.items() if r["kind"] == "equipment"]:
        layer, seen = {start: ((), start)}, {start}
        for hops in range(1, 6):
            offers: dict = {}
            for node, (route, _) in layer.items():
                for other in after.get(node, ()):
                    if other not in seen:
                        offer = ((*route, name(other)), other)
                        offers[other] = min(offers.get(other, offer), offer)
            seen |= set(offers)
            layer = offers
            if hops > 1:
                want |= {(start, n): ">".join([name(start), *route]) for n, (route, _) in offers.items() if nodes[n]["kind"] == "equipment"}
    assert {(r["start"], r["node"]): r["answer"] for r in plans.QUERIES["q06_flow_paths"](spark, FOLDER).collect()} == want


def drawn_graph(spark, pairs):
    return compact.graph_of(spark.createDataFrame([(f"n{a:06d}", f"n{b:06d}") for a, b in pairs], "src string, dst string").distinct())


def test_dominators_tell_what_is_lost_without_a_node(spark):
    rng = np.random.default_rng(5)
    for n, m in ((6, 9), (12, 20), (25, 45), (40, 60), (40, 160)):
        graph = drawn_graph(spark, rng.integers(0, n, (m, 2)).tolist())
        place, size = compact.dominator_spans(graph, 0)
        walker = compact.Walker(graph)
        whole = set(walker.walk(0)[0].tolist())
        assert set(np.flatnonzero(place > 0).tolist()) == whole
        for gone in whole:
            left = set(walker.walk(0, without=gone)[0].tolist())
            assert {v for v in whole if place[gone] <= place[v] < place[gone] + size[gone]} == whole - left


def test_routes_avoiding_every_node_of_a_long_line_end(spark):
    """A walk for each removed node takes some 10^9 layers here."""
    n = 60_000
    k = spark.range(n - 1).selectExpr("printf('n%06d', id) src", "printf('n%06d', id + 1) dst")
    asked = spark.range(1, n).selectExpr("printf('n%06d', id) removed", "array(printf('n%06d', id - 1), printf('n%06d', id + 1)) targets")
    found = traverse.routes_without(k, asked, "n000000").collect()
    assert len(found) == n - 1
    assert all(r["n_reached"] == int(r["removed"][1:]) - 1 and r["reached"] == [r["removed"] != "n000001", False] for r in found)


def test_short_routes_do_not_walk_the_whole_graph(spark):
    """Walks to the end of this line from each of its nodes take some 10^9 layers."""
    n = 60_000
    flow = spark.range(n - 1).selectExpr("printf('n%06d', id) src", "printf('n%06d', id + 1) dst")
    nodes = spark.range(n).selectExpr("printf('n%06d', id) node", "if(id % 2 = 0, upper(printf('n%06d', id)), null) tag")
    name = F.coalesce("tag", "node")
    found = traverse.routes_within(flow, nodes.selectExpr("node start"), nodes.where("tag is not null"), name, nodes, name, 2, 3).collect()
    assert len(found) == n - 3
    spell = lambda k: f"{'N' if k % 2 == 0 else 'n'}{k:06d}"
    for r in found:
        a, b = int(r["start"][1:]), int(r["node"][1:])
        assert b % 2 == 0 and 2 <= b - a <= 3 and r["path"] == [spell(k) for k in range(a, b + 1)]


@pytest.mark.parametrize("most", [compact.MOST_OFFERS, 3])
def test_short_routes_are_the_whole_ones(spark, most, monkeypatch):
    """Also where starts have to be walked one by one."""
    monkeypatch.setattr(compact, "MOST_OFFERS", most)
    rng = np.random.default_rng(6)
    flow = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a, b in set(map(tuple, rng.integers(0, 30, (70, 2)).tolist()))], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i:02d}", None if i % 4 == 0 else f"t{i % 3}") for i in range(30)], "node string, tag string")
    name = F.coalesce("tag", "node")
    asked = nodes.selectExpr("node start").crossJoin(nodes.select("node")).where("start <> node")
    tags = {r["node"]: r["tag"] or r["node"] for r in nodes.collect()}
    whole = {(r["start"], r["node"]): [tags[x] for x in r["path"]] for r in traverse.routes(flow, asked, name, nodes).collect() if 2 <= len(r["path"]) - 1 <= 4}
    found = traverse.routes_within(flow, nodes.selectExpr("node start"), nodes, name, nodes, name, 2, 4).collect()
    assert {(r["start"], r["node"]): r["path"] for r in found} == whole and len(found) == len(whole) > 100


def test_route_avoiding_answers_make_their_pairs_once(spark):
    """What is asked is neither computed again nor joined with what was found."""
    plan = plans.QUERIES["q24_route_avoiding_answers"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set") == 1 and "Join Inner" not in plan.split("MapInArrow")[0]
