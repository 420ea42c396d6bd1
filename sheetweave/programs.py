"""Programs over the query surface: one for each family of questions, one for each need of a question.

A family's program says in the surface's few operations what its questions ask for; the queries over whole plants are
held against it. A need's program gathers the items that are worth showing to someone who answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import PlantApi, Result

#: Relations that lead from item to item.
FLOW = "flow"
# Labels that programs ask for.
EQUIPMENT, PIPING, OPERATED = "Equipment", "PipingComponent", "OperatedValve"


def _column(api: PlantApi, result: Result, name: str, rows: DataFrame | None = None, **where) -> list:
    """Sorted distinct values, not null, of a column of the result's items."""
    kept = (result.rows if rows is None else rows).select("item").distinct()
    items = api.items.where(api._where(**where)) if where else api.items
    return sorted(r[0] for r in items.join(kept, "item", "left_semi").where(F.col(name).isNotNull()).select(name).distinct().collect())


def tags(api: PlantApi, result: Result, **where) -> list[str]:
    return _column(api, result, "tag", **where)


def _only(found: list):
    return found[0] if len(found) == 1 else None


def _item(api: PlantApi, tag: str) -> dict | None:
    listed = api.find(tag=tag, limit=1)[1]
    return listed[0] if listed else None


def _near(api, tag, direction, relations, hops):
    return api.traverse(tag, direction, relations, max_hops=hops, mark=False)


def lookup_type(api, tag):
    return (_item(api, tag) or {}).get("node_class")


def lookup_unit(api, tag):
    return (_item(api, tag) or {}).get("unit")


def neighbours_downstream(api, tag):
    return tags(api, api.neighbours(tag, "down", _along(api)))


def _along(api) -> str:
    """The line view where the plant has it: what is next to a valve may lie behind a fitting."""
    return FLOW if api.edges.where("relation = 'line_to'").isEmpty() else "line"


def loop_actuated_valve(api, tag):
    return _only(tags(api, _near(api, tag, "down", "signal", 2), label=PIPING))


def loop_measured_equipment(api, tag):
    return _only(tags(api, _near(api, tag, "up", "signal", 2), label=EQUIPMENT))


def flow_path(api, source, target):
    route = api.path(source, target, _along(api))
    if route is None:
        return None
    named = {r["item"]: r["tag"] for r in api.items.where(F.col("item").isin(route)).select("item", "tag").collect()}
    return [named[i] for i in route if named.get(i)]


def upstream_isolation(api, tag):
    walk = api.traverse(tag, "up", _along(api), stop_at={"label": OPERATED})
    return _column(api, walk, "tag", walk.rows.where("stopped"))


def cross_unit(api, unit):
    own = api.find(unit=unit, limit=1)[0]
    return _column(api, api.neighbours(own, "down", _along(api), not_unit=unit), "unit")


def count_in_unit(api, unit, node_class):
    return api.find(unit=unit, node_class=node_class, limit=1)[2]


def unanswerable_tag(api, *named):
    """None where some tag is not there; else words that are no answer."""
    return None if any(_item(api, t) is None for t in named) else "every named tag is present"


def no_path(api, source, target):
    return flow_path(api, source, target)


def sheets_of_tag(api, tag):
    sheets = api.find(tag=tag, limit=1)[0].rows.join(api.items, "item").select(F.explode("sheets").alias("s")).distinct()
    return sorted(r["s"] for r in sheets.collect())


def connected(api, source, target):
    return "no" if api.path(source, target, _along(api)) is None else "yes"


def downstream_in_unit(api, tag, unit):
    walk = api.traverse(tag, "down", _along(api), walk_only={"unit": unit}, mark=False)
    return sorted(set(tags(api, walk, label=EQUIPMENT)) | set(tags(api, walk, label=PIPING)))


def instruments_of_item(api, tag):
    return tags(api, api.neighbours(tag, "down", "signal"))


def upstream_sources(api, tag):
    """All that feeds the item and is fed by nothing itself: an anti join instead of a look at each."""
    along = _along(api)
    fed = api._along(along).select(F.col("dst").alias("item")).distinct()
    walk = api.traverse(tag, "up", along, mark=False)
    return _column(api, walk, "tag", walk.rows.join(fed, "item", "left_anti"))


def same_unit(api, first, second):
    one, other = _item(api, first), _item(api, second)
    return None if one is None or other is None else ("yes" if one["unit"] == other["unit"] else "no")


def loops_near_item(api, tag):
    """Valves beside the item, what drives these, and what commands that."""
    valves = api.neighbours(tag, "both", _along(api), label="Valve")
    if valves.rows.isEmpty():
        return []
    drives = api.neighbours(valves, "up", "signal")
    return [] if drives.rows.isEmpty() else tags(api, api.neighbours(drives, "up", "signal"))


FAMILIES: dict[str, Callable] = {
    f.__name__.upper(): f
    for f in (
        lookup_type, lookup_unit, neighbours_downstream, loop_actuated_valve, loop_measured_equipment, flow_path, upstream_isolation, cross_unit, count_in_unit, unanswerable_tag, no_path, sheets_of_tag,
        connected, downstream_in_unit, instruments_of_item, upstream_sources, same_unit, loops_near_item,
    )
}


def run_family(api: PlantApi, family: str, *anchors: str):
    if family not in FAMILIES:
        raise ValueError(f"family {family!r} has no program")
    return FAMILIES[family](api, *anchors)


# --- needs

#: Hops of signals that are shown around an item.
SIGNAL_HOPS = 3


def _walked(api: PlantApi, starts: list[str], results: list[Result]) -> DataFrame:
    """(item, distance): named items at 0, what walks reached at its hops, each item at its least."""
    rows = None
    for s in starts:
        own = api.resolve(s).select("item", F.lit(0).alias("distance"))
        rows = own if rows is None else rows.unionByName(own)
    for r in results:
        own = r.rows.select("item", F.col("hops").alias("distance"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("item").agg(F.min("distance").alias("distance"))


def _need(n: int):
    """A need's program names so many tags at least."""

    def check(run):
        def checked(api, tags, units):
            if len(tags) < n:
                raise ValueError(f"expected at least {n} tags, found {len(tags)}")
            return run(api, tags, units)

        return checked

    return check


def _beside(direction):
    return _need(1)(lambda api, tags, units: _walked(api, tags, [api.neighbours(t, direction, FLOW) for t in tags]))


def _all(direction):
    return _need(1)(lambda api, tags, units: _walked(api, tags[:1], [api.traverse(tags[0], direction, FLOW, walk_only={"unit": units[0]} if units else None, mark=False)]))


def _to_valve(direction):
    return _need(1)(lambda api, tags, units: _walked(api, tags[:1], [api.traverse(tags[0], direction, FLOW, stop_at={"label": OPERATED})]))


@_need(2)
def _routes(api, tags, units):
    """From the first tag to each other, or back where flow goes that way alone; the middle of a route is farthest."""
    rows = []
    for other in tags[1:]:
        route = api.path(tags[0], other) or api.path(other, tags[0]) or []
        rows += [(item, min(i, len(route) - 1 - i)) for i, item in enumerate(route)]
    return api.spark.createDataFrame(rows, "item string, distance int").groupBy("item").agg(F.min("distance").alias("distance"))


def _scope(api, tags, units):
    """Each unit's own items that flow crosses its border to or from, and those on the other side."""
    if not units:
        raise ValueError("expected at least 1 unit, found 0")
    rows = None
    for unit in units:
        own = api.find(unit=unit, limit=1)[0]
        one = own.rows.select("item", F.lit(0).alias("distance")).unionByName(api.neighbours(own, "both", FLOW).rows.select("item", F.lit(1).alias("distance")))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("item").agg(F.min("distance").alias("distance"))


# The needs with a program.
NEEDS: dict[str, Callable] = {
    "ITEM": lambda api, tags, units: api.spark.createDataFrame([], "item string, distance int"), "NEIGHBOURS_DOWNSTREAM": _beside("down"), "NEIGHBOURS_UPSTREAM": _beside("up"),
    "SIGNAL_CHAIN": _need(1)(lambda api, tags, units: _walked(api, tags, [_near(api, t, "both", "signal", SIGNAL_HOPS) for t in tags])), "PATH": _routes,
    "UPSTREAM_TO_FIRST_VALVE": _to_valve("up"), "DOWNSTREAM_TO_FIRST_VALVE": _to_valve("down"), "UPSTREAM_ALL": _all("up"), "DOWNSTREAM_ALL": _all("down"), "UNIT_SCOPE": _scope,
}


def run_need(api: PlantApi, need: str, tags: list[str], units: list[str]) -> DataFrame:
    """(item, distance) of what a need's question is about; a need without a program, or too few names, is an error."""
    if need not in NEEDS:
        raise ValueError(f"need {need!r} has no program")
    return NEEDS[need](api, tags, units)
