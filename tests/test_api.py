"""The query surface on a plant made by rule, against walks worked out in Python."""

from __future__ import annotations

import random
from collections import Counter, deque

import pytest

from sheetweave.api import PlantApi, call
from sheetweave.schema import class_dim, class_rows

KINDS = ("RotaryPump", "PlateHeatExchanger", "GateValve", "SwingCheckValve", "GasFilter", "NeedleValve", "PipeReducer")
LABELS = {name: labels for name, labels, *_ in class_rows()}
VALVES = {name for name, *_, kind in class_rows() if kind == "valve"}


def made_plant(n: int = 46, seed: int = 11):
    """Items (id, tag, class, unit, sheets) and edges (src, dst, relation): a line with branches, returns and a few loops."""
    rng = random.Random(seed)
    items = {f"n{i:02}": (f"X-{i:02}" if i % 9 else None, KINDS[(i * i + i) % len(KINDS)], f"{1 + i // 16}", [f"D{i // 8}"] + ([f"D{i // 8 + 1}"] if i % 8 == 7 else [])) for i in range(n)}
    names = list(items)
    edges = {(names[i], names[i + 1]) for i in range(n - 1) if i % 15 != 14}
    edges |= {(rng.choice(names), rng.choice(names)) for _ in range(18)}
    flow = sorted((a, b, "send_to") for a, b in edges if a != b)
    signals = [(names[5 * i], names[5 * i + 3], "measured_by") for i in range(6)] + [(names[5 * i + 3], names[5 * i + 1], "control") for i in range(6)]
    return items, flow, signals


ITEMS, FLOW, SIGNALS = made_plant()


@pytest.fixture(scope="module")
def api(spark):
    items = spark.createDataFrame([(i, *rest) for i, rest in ITEMS.items()], "item string, tag string, node_class string, unit string, sheets array<string>")
    items = items.join(class_dim(spark).select("node_class", "labels", "kind"), "node_class")
    return PlantApi(items, spark.createDataFrame(FLOW + SIGNALS, "src string, dst string, relation string"))


def ids(result):
    return sorted(r["item"] for r in result.rows.collect())


def beside(node, direction, edges):
    down, up = {b for a, b, _ in edges if a == node}, {a for a, b, _ in edges if b == node}
    return {"down": down, "up": up, "both": down | up}[direction]


def walk(starts, direction="down", edges=FLOW, stop=(), only=None, most=10**9):
    """Hops to what the starts reach: not beyond a stop that is no start, and only over `only`."""
    hops, queue = dict.fromkeys(starts, 0), deque(starts)
    while queue:
        node = queue.popleft()
        if hops[node] == most or (node in stop and node not in starts):
            continue
        for other in sorted(beside(node, direction, edges)):
            if other not in hops and (only is None or other in only):
                hops[other] = hops[node] + 1
                queue.append(other)
    return {k: v for k, v in hops.items() if k not in starts}


def of(**where):
    tests = {
        "label": lambda r, v: v.lower() in [x.lower() for x in LABELS[r[1]]] or (v.lower() == "valve" and r[1] in VALVES),
        "node_class": lambda r, v: r[1] == v, "unit": lambda r, v: r[2] == v, "not_unit": lambda r, v: r[2] != v, "sheet": lambda r, v: v in r[3], "tag": lambda r, v: (r[0] or "").upper() == v.strip().upper(),
    }
    return sorted(i for i, r in ITEMS.items() if all(tests[k](r, v) for k, v in where.items()))


@pytest.mark.parametrize("where", [{"label": "OperatedValve"}, {"label": "valve"}, {"label": "Equipment"}, {"node_class": "GasFilter"}, {"unit": "2"}, {"not_unit": "3"}, {"sheet": "D2"}, {"tag": " x-07 "}, {"unit": "1", "label": "PipingComponent"}])
def test_find(api, where):
    result, listed, total = api.find(**where)
    want = of(**where)
    assert ids(result) == want and total == len(want) > 0
    assert [r["item"] for r in listed] == sorted(want, key=lambda i: (ITEMS[i][0] or "", i))


@pytest.mark.parametrize("ref", ["n07", "X-20", "n33"])
@pytest.mark.parametrize("direction", ["down", "up", "both"])
def test_neighbours(api, ref, direction):
    node = next(i for i, r in ITEMS.items() if ref in (i, r[0]))
    assert ids(api.neighbours(ref, direction, "flow")) == sorted(beside(node, direction, FLOW) - {node})
    every = beside(node, direction, FLOW + SIGNALS)
    assert ids(api.neighbours(ref, direction, "any")) == sorted(every - {node})
    assert ids(api.neighbours(ref, direction, "flow", label="Valve")) == sorted(beside(node, direction, FLOW) & set(of(label="Valve")) - {node})


def test_neighbours_of_a_handle(api):
    handle, _, _ = api.find(node_class="GateValve")
    own = of(node_class="GateValve")
    assert ids(api.neighbours(handle, "down", "flow")) == sorted(set().union(*(beside(i, "down", FLOW) for i in own)) - set(own))


@pytest.mark.parametrize("options, brute", [
    ({}, {}), ({"direction": "up"}, {"direction": "up"}), ({"max_hops": 3}, {"most": 3}), ({"walk_only": {"unit": "1"}}, {"only": set(of(unit="1"))}), ({"stop_at": {"label": "Valve"}}, {"stop": set(of(label="Valve"))}),
])
@pytest.mark.parametrize("start", ["n00", "n20"])
def test_traverse(api, start, options, brute):
    want = walk([start], **brute)
    found = api.traverse(start, **options)
    assert {r["item"]: r["hops"] for r in found.rows.collect()} == want
    if "max_hops" not in options and "walk_only" not in options:
        direction = options.get("direction", "down")
        marks = {(i, "end") for i in want if not beside(i, direction, FLOW)} | {(i, "stop") for i in want if i in brute.get("stop", ())}
        got = {(r["item"], r["mark"]) for r in found.marks.collect()}
        assert {m for m in got if m[1] == "stop"} == {m for m in marks if m[1] == "stop"}
        assert {m for m in got if m[1] == "end"} >= {m for m in marks if m[1] == "end"} - {(i, "end") for i in brute.get("stop", ())}


@pytest.mark.parametrize("source, target", [("n00", "n12"), ("n02", "n40"), ("n44", "n01"), ("X-16", "n30")])
@pytest.mark.parametrize("directed", [True, False])
def test_path(api, source, target, directed):
    node = lambda ref: next(i for i, r in ITEMS.items() if ref in (i, r[0]))
    a, b = node(source), node(target)
    along = "down" if directed else "both"
    found = api.path(source, target, directed=directed)
    hops = walk([a], along).get(b)
    assert (found is None) == (hops is None)
    if found:
        assert found[0] == a and found[-1] == b and len(found) == hops + 1
        assert all(y in beside(x, along, FLOW) for x, y in zip(found, found[1:], strict=False))


def test_aggregate(api):
    handle, _, _ = api.find(unit="1")
    own = of(unit="1")
    sheets = Counter(s for i in own for s in ITEMS[i][3])
    rows = api.aggregate(handle, "sheet")
    assert [(r["grp"], r["n"]) for r in rows] == sorted(sheets.items(), key=lambda p: (-p[1], p[0]))
    for r in rows:
        assert r["first_tags"] == sorted(ITEMS[i][0] or "" for i in own if r["grp"] in ITEMS[i][3])[:5]
    assert {r["grp"]: r["n"] for r in api.aggregate(handle, "unit")} == {"1": len(own)}


def test_errors(api):
    for bad in (lambda: api.find(label="Nothing"), lambda: api.find(node_class="OperatedValve"), lambda: api.resolve("Q9"), lambda: api.resolve("$r9999"), lambda: call(api, "drop", {}), lambda: api.sql("DELETE FROM items"), lambda: call(api, "path", {"sauce": 1})):
        with pytest.raises(ValueError):
            bad()


def test_sql_reads_with_a_cap(api):
    rows, more = api.sql("SELECT item FROM items WHERE coalesce(tag, '') <> 'DROP TABLE x' ORDER BY item", 3)
    assert rows.count() == 3 and more
