"""Walks over an edge table (src, dst): closures, layered shortest paths, isolation, folding, nearest owners.

All walks run for many starts at once. Over a graph of up to compact.MOST_EDGES edges, which is seen while they are
collected, every task has the whole graph and walks from its own starts. Beyond that a frontier (start, node) is joined
with the edges, layer by layer, and what a start has reached already is removed by an anti join. Each layer is then a
written table, so plans stay short and a lost executor repeats one layer. Layers are as many as the longest shortest
walk, whatever the graph's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import stash, with_rank
from . import compact

KEYS = ["start", "node"]


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) to walk along: down with the edges, up against them, both ways as their union."""
    down = edges.select("src", "dst")
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in ("down", "up", "both"):
        raise ValueError(f"direction {direction!r}: expected down, up or both")
    return {"down": down, "up": up}.get(direction, down.unionByName(up)).distinct()


def steps(edges: DataFrame, starts: DataFrame, direction: str) -> DataFrame:
    """(start, node, src, dst, relation): one hop from each start in a direction, edges as they are drawn."""
    down = starts.join(edges, starts.start == edges.src).select("start", F.col("dst").alias("node"), "src", "dst", "relation")
    up = starts.join(edges, starts.start == edges.dst).select("start", F.col("src").alias("node"), "src", "dst", "relation")
    return {"down": down, "up": up}.get(direction, down.unionByName(up))


def closure(edges: DataFrame, starts: DataFrame, direction: str = "down", stop: DataFrame | None = None, walk: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops, stopped) of every node that a start reaches; starts themselves are left out.

    Nodes of `stop` (column node) are entered but not walked through, though a start among them is; nodes outside
    `walk` are not entered. Cycles end where nothing new is reached.
    """
    along = oriented(edges, direction)
    if walk is not None:
        along = along.join(walk.select(F.col("node").alias("dst")), "dst", "left_semi")
    graph = compact.graph_of(along)
    if graph is not None:
        return compact.closure(graph, starts, compact.marked(graph, stop) if stop is not None else None, max_hops)
    along = stash(along, "walk-edges")
    stops = stop.select("node").distinct().withColumn("stopped", F.lit(True)) if stop is not None else None
    frontier = stash(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(False).alias("stopped")).distinct(), "walk-0")
    seen = frontier
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        grown = frontier.where("not stopped").join(along, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = grown.join(seen, KEYS, "left_anti").withColumn("hops", F.lit(hops))
        new = new.join(stops, "node", "left").withColumn("stopped", F.coalesce("stopped", F.lit(False))) if stops is not None else new.withColumn("stopped", F.lit(False))
        frontier = stash(new.select("start", "node", "hops", "stopped"), f"walk-{hops}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hops % 8 == 0:
            seen = stash(seen, "walk-seen")
    return seen.where("hops > 0")


def boundary(reached: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """Reached nodes that are ends: no edge at all leaves them in the direction of the walk."""
    along = oriented(edges, direction).select(F.col("src").alias("node")).distinct()
    return reached.join(along, "node", "left_anti")


def cut_by_hops(reached: DataFrame, edges: DataFrame, direction: str, max_hops: int) -> DataFrame:
    """(start, node) of the last layer from which an unreached node could be entered."""
    along = oriented(edges, direction)
    last = reached.where((F.col("hops") == max_hops) & ~F.col("stopped"))
    onward = last.select("start", "node").join(along, F.col("node") == F.col("src")).select("start", "node", F.col("dst").alias("next"))
    known = reached.select("start", F.col("node").alias("next"))
    return onward.where("next <> start").join(known, ["start", "next"], "left_anti").select("start", "node").distinct()


def walked_edges(reached: DataFrame, starts: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """(start, src, dst) of every edge between nodes that a walk has entered, out of those it went through; edges back
    to starts and to nodes already seen count."""
    entered = reached.select("start", "node").unionByName(starts.select("start", F.col("start").alias("node"))).distinct()
    through = reached.where("not stopped").select("start", "node").unionByName(starts.select("start", F.col("start").alias("node"))).distinct()
    along = oriented(edges, direction)
    out = through.join(along, F.col("node") == F.col("src")).select("start", "src", "dst")
    out = out.join(entered.select("start", F.col("node").alias("dst")), ["start", "dst"], "left_semi")
    flipped = out if direction == "down" else out.select("start", F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "both":
        flipped = out.unionByName(flipped).join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    return flipped.select("start", "src", "dst").distinct()


def layered(edges: DataFrame, starts: DataFrame, key: Column, names: DataFrame, direction: str = "down", weight: DataFrame | None = None, targets: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops, parent, rank, weight): shortest-path trees with ties to the smallest sequence of keys.

    `key` is computed over `names` (column node and whatever it reads) and orders the nodes of a layer below equally
    ranked parents. `weight` (src, dst, w) is summed along the tree. With `targets` (start, node) a start stops at
    the layer that reaches one of its targets, with `max_hops` at that layer.
    """
    along = oriented(edges, direction)
    labelled = names.select(F.col("node").alias("dst"), key.alias("key"))
    along = along.join(labelled, "dst")
    if weight is not None:
        along = along.join(weight.select("src", "dst", "w"), ["src", "dst"], "left")
    along = stash(along.select("src", "dst", "key", (F.coalesce("w", F.lit(0)) if weight is not None else F.lit(0)).alias("w")), "layer-edges")
    graph = compact.graph_of(along, "w")
    if graph is not None:
        order = compact.order_of_keys(compact.node_values(graph, along.select(F.col("dst").alias("node"), "key").distinct(), "key")["key"])
        starts = starts.select("start").distinct()
        if targets is not None:
            starts = starts.join(targets.groupBy("start").agg(F.collect_list("node").alias("targets")), "start", "left")
        found = compact.shortest_trees(graph, starts, order, graph.values["w"] if weight is not None else None)
        return found if max_hops is None else found.where(F.col("hops") <= max_hops)
    frontier = stash(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("rank"), F.lit(0).alias("weight")).distinct(), "layer-0")
    seen, hops = frontier, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        offers = frontier.join(along, F.col("node") == F.col("src"))
        best = Window.partitionBy("start", "dst").orderBy("rank", "key", "src")
        offers = offers.withColumn("offer", F.row_number().over(best)).where("offer = 1")
        new = offers.select("start", F.col("dst").alias("node"), F.col("src").alias("parent"), F.col("rank").alias("above"), "key", (F.col("weight") + F.col("w")).alias("weight"))
        new = new.join(seen, KEYS, "left_anti")
        # ranks may have gaps: a position in the layer, equal for equal (above, key)
        placed = with_rank(new, [F.col("above"), F.col("key")], "layer-placed", "rank", ["start"])
        first = placed.groupBy(F.col("start").alias("s"), F.col("above").alias("a"), F.col("key").alias("k")).agg(F.min("rank").alias("r"))
        new = placed.drop("rank").join(first, F.col("start").eqNullSafe(F.col("s")) & (F.col("above") == F.col("a")) & F.col("key").eqNullSafe(F.col("k")))
        new = new.withColumn("rank", (F.col("r") + 1).cast("int")).withColumn("hops", F.lit(hops))
        frontier = stash(new.select("start", "node", "hops", "parent", "rank", "weight"), f"layer-{hops}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if targets is not None:
            done = frontier.join(targets, KEYS, "left_semi").select("start").distinct()
            frontier = frontier.join(done, "start", "left_anti")
        if hops % 8 == 0:
            seen = stash(seen, "layer-seen")
    return seen


def paths(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(start, node, path array<string>) from each start to its targets (start, node) along a tree's parents."""
    tree = stash(tree, "path-tree")
    open_ = stash(targets.join(tree, KEYS).select("start", "node", F.array("node").alias("path"), "parent"), "path-open")
    done = None
    while True:
        ready = open_.where("parent is null").select("start", "node", "path")
        done = ready if done is None else done.unionByName(ready)
        rest = open_.where("parent is not null")
        if rest.isEmpty():
            return done
        above = tree.select("start", F.col("node").alias("at"), F.col("parent").alias("next"))
        step = rest.join(above, (rest.start == above.start) & (rest.parent == above["at"])).select(rest.start, "node", F.concat(F.array("parent"), "path").alias("path"), F.col("next").alias("parent"))
        open_ = stash(step, "path-open")


def routes(edges: DataFrame, asked: DataFrame, key: Column, names: DataFrame, direction: str = "down") -> DataFrame:
    """(start, node, path array<string>) of asked pairs (start, node) that a walk joins: the shortest, ties to the smallest
    sequence of keys."""
    along = oriented(edges, direction)
    graph = compact.graph_of(along)
    if graph is not None:
        order = compact.order_of_keys(compact.node_values(graph, names.select("node", key.alias("key")), "key")["key"])
        return compact.shortest_routes(graph, asked.groupBy("start").agg(F.collect_set("node").alias("targets")), order, graph.names.to_pylist())
    return paths(layered(edges, asked.select("start").distinct(), key, names, direction), asked.select("start", "node").distinct())


def routes_within(edges: DataFrame, starts: DataFrame, ends: DataFrame, key: Column, names: DataFrame, label: Column, least: int, most: int) -> DataFrame:
    """(start, node, path array<string>) to every node of `ends` that lies `least` to `most` hops down from a start: routes as
    by routes(), spelled by labels, which like keys are computed over `names`."""
    graph = compact.graph_of(oriented(edges, "down"))
    if graph is not None:
        held = compact.node_values(graph, names.select("node", key.alias("key"), label.alias("label")), "key", "label")
        return compact.routes_within(graph, starts, compact.marked(graph, ends), compact.order_of_keys(held["key"]), held["label"], least, most)
    near = closure(edges, starts, "down", max_hops=most)
    asked = near.where(F.col("hops") >= least).join(ends.select("node").distinct(), "node", "left_semi").select("start", "node")
    steps = paths(layered(edges, starts.select("start").distinct(), key, names, max_hops=most), asked).select("start", "node", F.posexplode("path").alias("at", "step"))
    named = steps.join(names.select(F.col("node").alias("step"), label.alias("label")), "step")
    return named.groupBy("start", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("path"))


def reached_pairs(edges: DataFrame, asked: DataFrame, direction: str = "down") -> DataFrame:
    """(start, node, reached) of asked pairs (start, node)."""
    graph = compact.graph_of(oriented(edges, direction))
    if graph is not None:
        return compact.reaches(graph, asked.select("start", "node").distinct())
    found = closure(edges, asked.select("start").distinct(), direction).select("start", "node", F.lit(True).alias("r"))
    return asked.select("start", "node").distinct().join(found, KEYS, "left").select("start", "node", F.coalesce("r", F.lit(False)).alias("reached"))


def reached_values(edges: DataFrame, starts: DataFrame, values: DataFrame, direction: str = "down", same: bool = False) -> DataFrame:
    """(start, n, values): how many nodes with a value (node, value) each start reaches, and the sorted distinct values. With
    `same`, `values` also has a column group, and only nodes of the start's own group count."""
    graph = compact.graph_of(oriented(edges, direction))
    if graph is not None:
        held = compact.node_values(graph, values, "value", *(["group"] if same else []))
        return compact.reached_values(graph, starts, held["value"], held.get("group"))
    found = closure(edges, starts, direction).where("node <> start").join(values.where("value is not null"), "node")
    if same:
        found = found.join(values.select(F.col("node").alias("start"), F.col("group").alias("own")), "start").where("group <=> own")
    counted = found.groupBy("start").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("value")).alias("values"))
    return starts.select("start").distinct().join(counted, "start", "left").select("start", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def valve_ranges(edges: DataFrame, starts: DataFrame, counted: DataFrame) -> DataFrame:
    """(start, node, low, high) as count_ranges(), from starts and edges alone."""
    graph = compact.graph_of(oriented(edges, "down"))
    if graph is not None:
        return compact.count_ranges(graph, starts, compact.marked(graph, counted))
    own = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    return count_ranges(edges, closure(edges, starts, "down").where("node <> start").select("start", "node", "hops").unionByName(own), counted)


def isolation(edges: DataFrame, items: DataFrame, valves: DataFrame, direction: str) -> DataFrame:
    """(start, node): the first valves on every route from an item; an item with a route that ends before one has no row."""
    along = oriented(edges, direction)
    starts = items.select(F.col("node").alias("start"))
    reached = stash(closure(edges, starts, direction, stop=valves), "isolation")
    continues = along.select(F.col("src").alias("node")).distinct()
    dead = reached.where("not stopped").join(continues, "node", "left_anti").select("start").distinct()
    dead = dead.unionByName(starts.join(continues, starts.start == continues.node, "left_anti").select("start"))
    return reached.where("stopped").join(dead, "start", "left_anti").select("start", "node")


def fold_lines(edges: DataFrame, nodes: DataFrame, items: DataFrame) -> DataFrame:
    """(source, target, via_tags array, n_fittings): line edges from item to item through parts that are no items.

    Of several routes the one through fewest parts counts, then the one whose parts come first, part by part.
    """
    along = edges.select("src", "dst").distinct()
    target = nodes.select(F.col("node").alias("dst"), F.col("tag").alias("dst_tag")).join(items.select(F.col("node").alias("dst"), F.lit(True).alias("item")), "dst", "left")
    graph = compact.graph_of(along)
    if graph is not None:
        return compact.fold_lines(graph, compact.marked(graph, items), compact.node_values(graph, nodes, "tag")["tag"])
    along = stash(along.join(target, "dst").withColumn("item", F.coalesce("item", F.lit(False))), "fold-edges")
    passed = items.select(F.col("node").alias("source"), F.col("node").alias("at"), F.array().cast("array<string>").alias("route"), F.array().cast("array<string>").alias("tags"))
    frontier, seen, found = passed, passed.select("source", F.col("at").alias("part")), None
    layer = 0
    while True:
        layer += 1
        out = stash(frontier.join(along, F.col("at") == F.col("src")).where("dst <> source").select("source", "dst", "dst_tag", "item", "route", "tags"), "fold-out")
        hits = out.where("item").select("source", F.col("dst").alias("target"), F.lit(layer).alias("layer"), "route", "tags")
        found = hits if found is None else found.unionByName(hits)
        first = Window.partitionBy("source", "dst").orderBy("route")
        onward = out.where("not item").join(seen, (out.source == seen.source) & (out.dst == seen.part), "left_anti").withColumn("n", F.row_number().over(first)).where("n = 1")
        onward = onward.select("source", F.col("dst").alias("at"), F.concat("route", F.array("dst")).alias("route"), F.when(F.col("dst_tag").isNull(), F.col("tags")).otherwise(F.concat("tags", F.array("dst_tag"))).alias("tags"))
        frontier = stash(onward, "fold-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("source", F.col("at").alias("part")))
    best = Window.partitionBy("source", "target").orderBy("layer", "route")
    found = found.withColumn("n", F.row_number().over(best)).where("n = 1")
    return found.select("source", "target", F.col("tags").alias("via_tags"), (F.size("route") - F.size("tags")).alias("n_fittings"))


def line_ends(items: DataFrame, line_edges: DataFrame) -> DataFrame:
    """(node, no_inflow, no_outflow) of items at an end of a line."""
    inflow = line_edges.select(F.col("target").alias("node")).distinct().withColumn("i", F.lit(1))
    outflow = line_edges.select(F.col("source").alias("node")).distinct().withColumn("o", F.lit(1))
    marked = items.select("node").join(inflow, "node", "left").join(outflow, "node", "left")
    return marked.select("node", F.col("i").isNull().alias("no_inflow"), F.col("o").isNull().alias("no_outflow")).where("no_inflow or no_outflow")


def nearest_owners(edges: DataFrame, nodes: DataFrame, owners: DataFrame, unit: str | None = None) -> DataFrame:
    """(node, owner, hops): each node's nearest owner without regard to direction; of several the one whose neighbour of
    this node was found first, from owners in order of name, neighbour by neighbour.

    With `unit`, a node takes only owners of its own unit. Nodes that no owner reaches own themselves (hops null).
    """
    along = oriented(edges, "both")
    if unit:
        ends = nodes.select(F.col("node").alias("n"), F.col(unit).alias("u"))
        along = along.join(ends.select(F.col("n").alias("src"), F.col("u").alias("us")), "src").join(ends.select(F.col("n").alias("dst"), F.col("u").alias("ud")), "dst").where("us <=> ud").select("src", "dst")
    graph = compact.graph_of(along)
    if graph is not None:
        marks = compact.marked(graph, owners)
        found, distance = compact.nearest_owners(graph, marks)
        at = np.flatnonzero(found >= 0)
        table = pa.table({"node": graph.names.take(pa.array(at)), "owner": graph.names.take(pa.array(found[at])), "hops": pa.array(distance[at], pa.int32())})
        seen = nodes.sparkSession.createDataFrame(table) if len(at) else nodes.sparkSession.createDataFrame([], "node string, owner string, hops int")
        # owners without any edge own themselves at 0
        lone = owners.select("node").join(seen.select("node"), "node", "left_anti").select("node", F.col("node").alias("owner"), F.lit(0).alias("hops"))
        seen = seen.unionByName(lone)
        return nodes.select("node").join(seen, "node", "left").select("node", F.coalesce("owner", "node").alias("owner"), "hops")
    along = stash(along, "owner-edges")
    first = with_rank(owners.select("node"), [F.col("node")], "owner-ranks", "found")
    frontier = stash(first.select("node", F.col("node").alias("owner"), F.lit(0).alias("hops"), "found"), "owner-0")
    seen, hops = frontier, 0
    while True:
        hops += 1
        offers = frontier.join(along, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min_by("owner", "found").alias("owner"), F.min("found").alias("by"))
        new = offers.join(seen, "node", "left_anti").withColumn("hops", F.lit(hops))
        frontier = stash(with_rank(new, [F.col("by"), F.col("node")], "owner-ranks", "found").drop("by"), "owner")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hops % 8 == 0:
            seen = stash(seen, "owner-seen")
    seen = seen.drop("found")
    return nodes.select("node").join(seen, "node", "left").select("node", F.coalesce("owner", "node").alias("owner"), "hops")


def count_ranges(tree_edges: DataFrame, hops: DataFrame, counted: DataFrame) -> DataFrame:
    """(start, node, low, high): least and most counted nodes strictly between start and node over all shortest paths.

    `hops` is (start, node, hops) with starts at 0; `counted` has column node. Layers are folded one by one.
    """
    hops = stash(hops.select("start", "node", "hops"), "range-hops")
    mark = counted.select("node").distinct().withColumn("c", F.lit(1))
    top = hops.agg(F.max("hops")).first()[0] or 0
    layer = stash(hops.where("hops = 0").select("start", "node", F.lit(0).alias("low"), F.lit(0).alias("high")), "range-0")
    done = None
    for depth in range(1, top + 1):
        # what is added on leaving a node: itself, unless it is the start
        leaving = layer.join(mark, "node", "left").withColumn("add", F.when(F.col("node") == F.col("start"), 0).otherwise(F.coalesce("c", F.lit(0))))
        grown = leaving.join(tree_edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("low") + F.col("add")).alias("low"), (F.col("high") + F.col("add")).alias("high"))
        here = hops.where(F.col("hops") == depth).select("start", "node")
        layer = stash(grown.join(here, KEYS).groupBy("start", "node").agg(F.min("low").alias("low"), F.max("high").alias("high")), "range")
        done = layer if done is None else done.unionByName(layer)
    return done if done is not None else layer.where("false")


def final_homes(links: DataFrame) -> DataFrame:
    """(node, home): the last home of chains of references (reference, home), by pointer jumping; a cycle is an error."""
    table = stash(links.select(F.col("reference").alias("node"), "home"), "homes")
    total = table.count()
    jumps = 0
    while True:
        onward = table.select(F.col("node").alias("n"), F.col("home").alias("h"))
        jumped = stash(table.join(onward, table.home == onward.n, "left").select("node", F.coalesce("h", "home").alias("home"), F.col("h").isNotNull().alias("moved")), "homes")
        if jumped.where("moved").isEmpty():
            return jumped.select("node", "home")
        jumps += 1
        if 1 << jumps > 2 * total + 2:
            raise ValueError("references form a cycle")
        table = jumped.select("node", "home")


def routes_without(edges: DataFrame, asked: DataFrame, source: str) -> DataFrame:
    """(removed, n_reached, targets, reached array<boolean>) of (removed, targets array<string>): what a source reaches when
    a node is taken away, in number and for each target."""
    graph = compact.graph_of(oriented(edges, "down"))
    if graph is not None:
        return compact.reach_without(graph, asked, source)
    found = reach_without(edges, asked.select("removed"), source).groupBy("removed").agg(F.count("*").alias("n"), F.collect_set("node").alias("nodes"))
    hits = F.transform("targets", lambda t: F.coalesce(F.array_contains("nodes", t), F.lit(False)))
    return asked.join(found, "removed", "left").select("removed", F.coalesce("n", F.lit(0)).alias("n_reached"), "targets", hits.alias("reached"))


def reach_without(edges: DataFrame, removed: DataFrame, source: str) -> DataFrame:
    """(removed, node) of what a source reaches when a node is taken away, for every removed node at once."""
    along = stash(oriented(edges, "down"), "without-edges")
    frontier = stash(removed.select("removed", F.lit(source).alias("node")), "without-0")
    seen, rounds = frontier, 0
    while True:
        rounds += 1
        new = frontier.join(along, F.col("node") == F.col("src")).where("dst <> removed").select("removed", F.col("dst").alias("node")).distinct()
        frontier = stash(new.join(seen, ["removed", "node"], "left_anti"), "without")
        if frontier.isEmpty():
            return seen.where(F.col("node") != source)
        seen = seen.unionByName(frontier)
        if rounds % 8 == 0:
            seen = stash(seen, "without-seen")


def meeting_points(edges: DataFrame, starts: DataFrame, items: DataFrame) -> DataFrame:
    """(first, second, meeting): pairs of starts, neither reaching the other, whose common descendants are all reached
    from exactly one of them, an item.

    Common descendants D of a pair are counted; a member whose own reach meets D in all of it qualifies.
    """
    graph = compact.graph_of(oriented(edges, "down"))
    if graph is not None:
        names = [r["start"] for r in starts.select("start").distinct().join(oriented(edges, "down").select(F.col("src").alias("start")).distinct(), "start", "left_semi").collect()]  # nodes of the graph
        found = compact.meeting_points(graph, sorted(graph.index(names).tolist()) if names else [], compact.marked(graph, items))
        if found is not None:
            return found
    down = stash(closure(edges, starts, "down").where("start <> node").select("start", "node"), "meet-reach")
    a, b = down.select(F.col("start").alias("first"), "node"), down.select(F.col("start").alias("second"), "node")
    common = a.join(b, "node").where("first < second")
    linked = down.select(F.col("start").alias("first"), F.col("node").alias("second")).unionByName(down.select(F.col("node").alias("first"), F.col("start").alias("second")))
    common = stash(common.join(linked, ["first", "second"], "left_anti"), "meet-common")
    size = common.groupBy("first", "second").agg(F.count("*").alias("n"))
    members = common.select("node").distinct().join(items, "node", "left_semi")
    inner = closure(edges, members.select(F.col("node").alias("start")), "down").where("start <> node").select("start", "node")
    inner = stash(inner.unionByName(members.select(F.col("node").alias("start"), "node")), "meet-inner")
    covered = common.join(inner.select(F.col("start").alias("member"), "node"), "node")
    own = common.select("first", "second", F.col("node").alias("member"))
    full = covered.join(own, ["first", "second", "member"], "left_semi").groupBy("first", "second", "member").agg(F.count("*").alias("m")).join(size, ["first", "second"]).where("m = n")
    return full.groupBy("first", "second").agg(F.count("*").alias("c"), F.max("member").alias("meeting")).where("c = 1").select("first", "second", "meeting")


def count_walks(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """(node, hops, n_paths): how many walks of each length lead to a node."""
    along = stash(oriented(edges, "down"), "count-edges")
    layer, out = starts.select("node", F.lit(1).cast("long").alias("n_paths")), None
    for hops in range(1, max_hops + 1):
        layer = stash(layer.join(along, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("n_paths").alias("n_paths")), "count")
        here = layer.select("node", F.lit(hops).alias("hops"), "n_paths")
        out = here if out is None else out.unionByName(here)
    return out
