"""Programs of families and needs over the query surface, against the queries over the whole plant and walks in Python."""

from __future__ import annotations

import pytest

from sheetweave import plans, programs
from sheetweave.api import PlantApi, guarded
from sheetweave.plans import projection as P
from sheetweave.plans.plant_queries import lines, plant_api
from sheetweave.streaming.runlog import SpendCap

from .test_api import FLOW, ITEMS, beside, walk

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plant(spark):
    """The plant with its line view."""
    api = plant_api(spark, FOLDER)
    view = lines(spark, FOLDER).selectExpr("source as src", "target as dst", "'line_to' as relation")
    return PlantApi(api.items.cache(), api.edges.unionByName(view).cache())


def answer(spark, name, key, value, column="answer"):
    rows = plans.QUERIES[name](spark, FOLDER).where(f"{key} = '{value}'").collect()
    return rows[0][column] if rows else None


def test_families_say_what_the_queries_say(spark, plant):
    run = lambda family, *anchors: programs.run_family(plant, family, *anchors)
    tag = "P-16-16"
    assert run("LOOKUP_TYPE", tag) == answer(spark, "q01_lookup_type", "tag", tag, "node_class")
    assert run("LOOKUP_UNIT", tag) == answer(spark, "q02_lookup_unit", "tag", tag, "unit") == "U16"
    assert ",".join(run("NEIGHBOURS_DOWNSTREAM", tag)) == answer(spark, "q03_neighbours_downstream", "tag", tag)
    loop = plans.QUERIES["q04_loop_actuated_valve"](spark, FOLDER).orderBy("tag").first()
    assert run("LOOP_ACTUATED_VALVE", loop["tag"]) == loop["answer"]
    loop = plans.QUERIES["q05_loop_measured_equipment"](spark, FOLDER).orderBy("tag").first()
    assert run("LOOP_MEASURED_EQUIPMENT", loop["tag"]) == loop["answer"]
    unit = {r["node"]: r["unit"] for r in P.nodes(spark, FOLDER).collect()}
    over = {unit[r["target"]] for r in lines(spark, FOLDER).collect() if unit[r["source"]] == "U03"}
    assert run("CROSS_UNIT", "U03") == sorted(over - {"U03", None})
    counted = plans.QUERIES["q09_count_in_unit"](spark, FOLDER).where("unit = 'U05'").first()
    assert run("COUNT_IN_UNIT", "U05", counted["node_class"]) == counted["answer"]
    absent = plans.QUERIES["q10_unanswerable_tags"](spark, FOLDER).orderBy("tag").first()["tag"]
    assert run("UNANSWERABLE_TAG", absent) is None and run("UNANSWERABLE_TAG", tag) is not None
    assert ",".join(run("SHEETS_OF_TAG", tag)) == answer(spark, "q12_sheets_of_tag", "tag", tag)
    for yes in (True, False):
        pair = plans.QUERIES["q13_connected"](spark, FOLDER).where(f"answer = {yes}").orderBy("source").first()
        if pair:
            assert run("CONNECTED", pair["source"], pair["target"]) == ("yes" if yes else "no")
    for pair in plans.QUERIES["q17_same_unit"](spark, FOLDER).where(f"first = '{tag}'").collect():
        assert run("SAME_UNIT", pair["first"], pair["second"]) == pair["answer"]
    measured = plans.QUERIES["q15_instruments_of_item"](spark, FOLDER).orderBy("tag").first()
    assert ",".join(run("INSTRUMENTS_OF_ITEM", measured["tag"])) == measured["answer"]
    near = plans.QUERIES["q18_loops_near_item"](spark, FOLDER).orderBy("tag").first()
    assert ",".join(run("LOOPS_NEAR_ITEM", near["tag"])) == near["answer"]
    isolated = plans.QUERIES["q07_upstream_isolation"](spark, FOLDER).orderBy("item").first()
    named = {r["node"]: r["tag"] for r in P.nodes(spark, FOLDER).collect()}
    assert run("UPSTREAM_ISOLATION", named[isolated["item"]]) == sorted(named[v] for v in isolated["valves"].split(","))
    with pytest.raises(ValueError):
        run("NO_SUCH_FAMILY", tag)


def test_routes_and_walks_of_families(spark, plant):
    route = programs.run_family(plant, "FLOW_PATH", "P-00-0", "TK-17-17")
    assert route is None or (route[0], route[-1]) == ("P-00-0", "TK-17-17")
    assert (programs.run_family(plant, "NO_PATH", "P-00-0", "TK-17-17") is None) == (route is None)
    sources = programs.run_family(plant, "UPSTREAM_SOURCES", "P-16-16")
    fed = {r["target"] for r in lines(spark, FOLDER).collect()}
    named = {r["tag"]: r["node"] for r in P.nodes(spark, FOLDER).where("tag is not null").collect()}
    assert not {named[t] for t in sources} & fed
    inside = programs.run_family(plant, "DOWNSTREAM_IN_UNIT", "P-16-16", "U16")
    assert set(inside) <= {r["tag"] for r in P.nodes(spark, FOLDER).where("unit = 'U16'").collect()}


@pytest.fixture(scope="module")
def made(spark):
    from .test_api import SIGNALS, class_dim

    items = spark.createDataFrame([(i, *rest) for i, rest in ITEMS.items()], "item string, tag string, node_class string, unit string, sheets array<string>")
    items = items.join(class_dim(spark).select("node_class", "labels", "kind"), "node_class")
    return PlantApi(items, spark.createDataFrame(FLOW + SIGNALS, "src string, dst string, relation string"))


def distances(frame):
    return {r["item"]: r["distance"] for r in frame.collect()}


def test_needs(made):
    run = lambda need, tags, units=(): distances(programs.run_need(made, need, list(tags), list(units)))
    assert run("ITEM", ["n01"]) == {}
    assert run("NEIGHBOURS_DOWNSTREAM", ["n07", "n20"]) == {"n07": 0, "n20": 0} | {i: 1 for t in ("n07", "n20") for i in beside(t, "down", FLOW) - {"n07", "n20"}}
    assert run("DOWNSTREAM_ALL", ["n00"]) == {"n00": 0} | walk(["n00"])
    inside = {i for i, r in ITEMS.items() if r[2] == "1"}
    assert run("DOWNSTREAM_ALL", ["n00"], ["1"]) == {"n00": 0} | walk(["n00"], only=inside)
    assert run("UPSTREAM_ALL", ["n30"]) == {"n30": 0} | walk(["n30"], "up")
    own = {i: 0 for i, r in ITEMS.items() if r[2] == "2"}
    assert run("UNIT_SCOPE", [], ["2"]) == {o: 1 for i in own for o in beside(i, "both", FLOW)} | own
    route = made.path("n00", "n12") or made.path("n12", "n00")
    assert run("PATH", ["n00", "n12"]) == ({i: min(k, len(route) - 1 - k) for k, i in enumerate(route)} if route else {})
    for need, tags, units in (("PATH", ["n00"], []), ("UNIT_SCOPE", [], []), ("GENERIC", ["n00"], [])):
        with pytest.raises(ValueError):
            run(need, tags, units)


def test_results_are_shown_within_bounds(made):
    found = made.find(label="PipingComponent")[0]
    text = made.show(found, most_chars=200)
    assert len(text) <= 200 and "more not shown" in text and text.startswith(found.handle)
    assert made.show(found).count("\n") == found.count()
    assert len(made.aggregate(found, "unit", None)) == len({ITEMS[r["item"]][2] for r in found.rows.collect()})


def test_a_query_over_its_time_is_cancelled(spark):
    slow = lambda: spark.sql("SELECT reflect('java.lang.Thread', 'sleep', 500L) FROM range(60)").collect()
    with pytest.raises(TimeoutError):
        guarded(spark, slow, 1.0)
    assert guarded(spark, lambda: spark.range(5).count(), 30.0) == 5


def test_spending_stops_at_the_cap():
    cap = SpendCap(1.0)
    assert cap.reserve(0.6) and not cap.reserve(0.6)
    cap.settle(0.6, 0.2)
    assert cap.reserve(0.6) and cap.reserve(0.2) and not cap.reserve(0.01)
    cap.settle(0.6, 0.9)
    assert cap.spent == pytest.approx(1.1) and not cap.reserve(0.0001)
