"""Walks over a graph of a checked size: its edges go to every task as compact arrays, the starts are dealt over tasks.

A plant has some hundred thousand edges; walks from all its items then need no join and no job per layer. Whether a
graph has MOST_EDGES at most is seen while it is collected; a larger one is walked by the joins of `traverse`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges up to which a graph is sent to all tasks; rows of an Arrow batch of results.
MOST_EDGES, BATCH_ROWS = 2_000_000, 100_000
#: Bytes of reach sets that a task holds at once.
MOST_BYTES = 500_000_000
#: Starts of short walks that are walked at once, and nodes and offers up to which they are.
STARTS, MOST_OFFERS = 2_000, 2_000_000


@dataclass
class Graph:
    """Nodes by rising name; the edges that leave node i are those from `first[i]` to `first[i + 1]`, by rising target."""

    names: pa.Array
    first: np.ndarray
    target: np.ndarray
    values: dict[str, np.ndarray]

    @property
    def size(self) -> int:
        return len(self.names)

    def index(self, names) -> np.ndarray:
        """Positions of names, -1 where the graph has no such node."""
        return pc.fill_null(pc.index_in(pa.array(names, self.names.type) if not isinstance(names, pa.Array) else names, self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `nodes`, edge) of all edges that leave these nodes."""
        counts = self.first[nodes + 1] - self.first[nodes]
        whose = np.repeat(np.arange(len(nodes)), counts)
        return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts - self.first[nodes], counts)


def graph_of(edges: DataFrame, *columns: str) -> Graph | None:
    """The graph of distinct edges (src, dst) with further numeric columns of the edges; None beyond MOST_EDGES."""
    table = edges.select("src", "dst", *columns).limit(MOST_EDGES + 1).toArrow()
    if table.num_rows > MOST_EDGES:
        return None
    ends = pa.concat_arrays([*table["src"].chunks, *table["dst"].chunks]) if table.num_rows else pa.array([], pa.string())
    coded = ends.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary)).astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[np.asarray(coded.indices).astype(np.int64)] if len(ends) else np.zeros(0, np.int64)
    src, dst = codes[: table.num_rows], codes[table.num_rows :]
    by = np.lexsort((dst, src))
    first = np.searchsorted(src[by], np.arange(len(order) + 1))
    values = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False)[by] for c in columns}
    return Graph(coded.dictionary.take(pa.array(order)), first, dst[by], values)


def node_values(graph: Graph, rows: DataFrame, *columns: str) -> dict[str, list]:
    """Columns of `rows` (node, ...) by the graph's nodes, None where a node has no row; other nodes' rows are left out."""
    spark = rows.sparkSession
    known = spark.createDataFrame(pa.table({"node": graph.names, "at": pa.array(np.arange(graph.size))})) if graph.size else None
    out: dict[str, list] = {c: [None] * graph.size for c in columns}
    if known is not None:
        for r in rows.select("node", *columns).join(F.broadcast(known), "node").select("at", *columns).collect():  # a row for each node of the graph
            for c in columns:
                out[c][r["at"]] = r[c]
    return out


def marked(graph: Graph, nodes: DataFrame) -> np.ndarray:
    """Which of the graph's nodes are in the column `node`."""
    values = node_values(graph, nodes.select("node").distinct().withColumn("yes", F.lit(True)), "yes")["yes"]
    return np.array([bool(v) for v in values], bool)


def _dealt(starts: DataFrame, *columns: str) -> DataFrame:
    """The starts, spread over all tasks."""
    return starts.select(*columns).repartition(2 * starts.sparkSession.sparkContext.defaultParallelism, columns[0])


class _Rows:
    """Result columns gathered to batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.parts, self.size = schema, [], 0

    def add(self, *columns) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def full(self) -> bool:
        return self.size >= BATCH_ROWS

    def batch(self) -> pa.RecordBatch:
        arrays = []
        for field, parts in zip(self.schema, zip(*self.parts, strict=True) if self.parts else [[] for _ in self.schema], strict=True):
            arrays.append(pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p, field.type) for p in parts]) if parts else pa.array([], field.type))
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


class Walker:
    """Breadth-first walks over one graph; what a walk has marked is cleared before the next."""

    def __init__(self, graph: Graph, stop: np.ndarray | None = None):
        self.graph, self.stop = graph, stop
        self.hops, self.seen = np.full(graph.size, -1, np.int32), np.zeros(0, np.int64)

    def walk(self, start: int, most: int | None = None, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, hops), the start left out; nodes of `stop` are entered only, but for the start."""
        self.hops[self.seen] = -1
        self.hops[start] = 0
        layers, frontier, h = [], np.array([start]), 0
        while len(frontier) and (most is None or h < most):
            h += 1
            if self.stop is not None and h > 1:
                frontier = frontier[~self.stop[frontier]]
            _, edge = self.graph.out(frontier)
            found = self.graph.target[edge]
            found = np.unique(found[self.hops[found] < 0])
            if without >= 0:
                found = found[found != without]
            self.hops[found] = h
            layers.append(found)
            frontier = found
        nodes = np.concatenate([*layers, np.zeros(0, np.int64)])
        self.seen = np.append(nodes, start)
        return nodes, self.hops[nodes]


def closure(graph: Graph, starts: DataFrame, stop: np.ndarray | None = None, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops, stopped) of what each start reaches."""
    sent = starts.sparkSession.sparkContext.broadcast(graph)
    schema = pa.schema([("start", pa.string()), ("node", pa.string()), ("hops", pa.int32()), ("stopped", pa.bool_())])

    def run(batches):
        g, out = sent.value, _Rows(schema)
        walker = Walker(g, stop)
        for batch in batches:
            names = batch.column(0)
            for name, at in zip(names.to_pylist(), g.index(names).tolist(), strict=True):
                if at < 0:
                    continue
                nodes, hops = walker.walk(at, max_hops)
                out.add(pa.array([name] * len(nodes), pa.string()), g.names.take(pa.array(nodes)), hops, stop[nodes] if stop is not None else np.zeros(len(nodes), bool))
                if out.full():
                    yield out.batch()
        yield out.batch()

    return _dealt(starts.select("start").distinct(), "start").mapInArrow(run, "start string, node string, hops int, stopped boolean")


def reached_values(graph: Graph, starts: DataFrame, values: list, groups: list | None = None) -> DataFrame:
    """(start, n, values array<string>): how many nodes with a value each start reaches, and their distinct values. With
    `groups` only nodes of the start's own group count."""
    names = sorted({v for v in values if v is not None})
    place = {v: i for i, v in enumerate(names)}
    codes = np.array([place[v] if v is not None else -1 for v in values], np.int64)
    kinds = {v: i for i, v in enumerate(dict.fromkeys(groups or []))}
    of = np.array([kinds[v] for v in groups], np.int64) if groups else None
    sent = starts.sparkSession.sparkContext.broadcast((graph, codes, names, of))
    schema = pa.schema([("start", pa.string()), ("n", pa.int64()), ("values", pa.list_(pa.string()))])

    def run(batches):
        g, codes, names, of = sent.value
        walker, out = Walker(g), _Rows(schema)
        for batch in batches:
            column = batch.column(0)
            for name, at in zip(column.to_pylist(), g.index(column).tolist(), strict=True):
                nodes = walker.walk(at)[0] if at >= 0 else np.zeros(0, np.int64)
                if of is not None and at >= 0:
                    nodes = nodes[of[nodes] == of[at]]
                found = codes[nodes]
                found = found[found >= 0]
                out.add([name], [len(found)], [[names[i] for i in np.unique(found).tolist()]])
            if out.full():
                yield out.batch()
        yield out.batch()

    return _dealt(starts.select("start").distinct(), "start").mapInArrow(run, "start string, n long, values array<string>")


def reaches(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(start, node, reached) of asked pairs (start, node): one walk for each start."""
    sent = pairs.sparkSession.sparkContext.broadcast(graph)
    schema = pa.schema([("start", pa.string()), ("node", pa.string()), ("reached", pa.bool_())])

    def run(batches):
        g = sent.value
        walker, last = Walker(g), None
        for batch in batches:
            a, b = g.index(batch.column(0)), g.index(batch.column(1))
            hit = np.zeros(len(a), bool)
            for i, (s, t) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if s < 0 or t < 0:
                    continue
                if s != last:
                    walker.walk(s)
                    last = s
                hit[i] = walker.hops[t] > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit)], schema=schema)

    return _dealt(pairs, "start", "node").sortWithinPartitions("start").mapInArrow(run, "start string, node string, reached boolean")


def dominator_spans(graph: Graph, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, size) of each node in the tree of dominators of what a start reaches: its subtree, which is what is lost
    without it, has `size` places from its own on. The start's place is 0; -1 and 0 where the start does not lead.

    Semidominators in a depth-first walk, then nearest common ancestors: a pass over the edges, not a walk for each node.
    """
    first, target = graph.first.tolist(), graph.target.tolist()
    number, order, parent = [-1] * graph.size, [start], [0]
    number[start] = 0
    spot, path = first[:-1], [start]
    while path:
        node = path[-1]
        at, end = spot[node], first[node + 1]
        while at < end and number[target[at]] >= 0:
            at += 1
        spot[node] = at + 1
        if at >= end:
            path.pop()
            continue
        found = target[at]
        number[found] = len(order)
        parent.append(number[node])
        order.append(found)
        path.append(found)
    # from here on nodes go by their number in order of discovery
    n, codes = len(order), np.array(number, np.int64)
    src, dst = np.repeat(codes, np.diff(graph.first)), codes[graph.target]
    src, dst = src[src >= 0], dst[src >= 0]
    by = np.argsort(dst, kind="stable")
    into, before = np.searchsorted(dst[by], np.arange(n + 1)).tolist(), src[by].tolist()
    above, semi, least = parent.copy(), list(range(n)), list(range(n))
    for i in range(n - 1, 0, -1):
        best = parent[i]
        for v in before[into[i] : into[i + 1]]:
            if v > i:  # the least semidominator on its way up counts; the way is shortened as it is gone
                climb = []
                while above[v] > i:
                    climb.append(v)
                    v = above[v]
                low, top = least[v], above[v]
                for u in reversed(climb):
                    above[u] = top
                    low = least[u] = min(least[u], low)
                v = low
            best = min(best, v)
        semi[i] = least[i] = best
    idom, size = parent, [1] * n
    for i in range(1, n):
        j = idom[i]
        while j > semi[i]:
            j = idom[j]
        idom[i] = j
    for i in range(n - 1, 0, -1):
        size[idom[i]] += size[i]
    place, free = [0] * n, [1] * n
    for i in range(1, n):
        j = idom[i]
        place[i] = free[j]
        free[j] += size[i]
        free[i] = place[i] + 1
    places, sizes = np.full(graph.size, -1, np.int64), np.zeros(graph.size, np.int64)
    places[order], sizes[order] = place, size
    return places, sizes


def reach_without(graph: Graph, asked: DataFrame, source: str) -> DataFrame:
    """(removed, n_reached, targets, reached array<boolean>) of (removed, targets array<string>): what a source reaches when
    a node is taken away, in number and for each target: all it reaches, less what the node dominates."""
    start = int(graph.index([source])[0])
    place, size = dominator_spans(graph, start) if start >= 0 else (np.full(graph.size, -1, np.int64), np.zeros(graph.size, np.int64))
    sent = asked.sparkSession.sparkContext.broadcast((graph.names, place, size, start))
    schema = pa.schema([("removed", pa.string()), ("n_reached", pa.int64()), ("targets", pa.list_(pa.string())), ("reached", pa.list_(pa.bool_()))])

    def run(batches):
        names, place, size, start = sent.value
        total = int(size[start]) - 1 if start >= 0 else 0
        at = lambda values: pc.fill_null(pc.index_in(values, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        for batch in batches:
            removed, targets = batch.column(0), batch.column(1)
            spots = at(pa.concat_arrays([removed, targets.flatten()]))
            gone, spots = spots[: len(removed)], spots[len(removed) :]
            cut = (gone >= 0) & (gone != start)
            low = np.where(cut, place[gone] if len(place) else -1, -1)
            lost = np.where(low > 0, size[gone] if len(size) else 0, 0)
            counts = pc.fill_null(pc.list_value_length(targets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            whose = np.repeat(np.arange(len(gone)), counts)
            there = np.where(spots >= 0, place[spots] if len(place) else -1, -1)
            hit = (there > 0) & ((there < low[whose]) | (there >= low[whose] + lost[whose]))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([removed, pa.array(total - lost), targets.cast(schema.field(2).type), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hit, pa.bool_()))], schema=schema)

    return _dealt(asked, "removed", "targets").mapInArrow(run, "removed string, n_reached long, targets array<string>, reached array<boolean>")


def ordered_tree(graph: Graph, start: int, key: np.ndarray, wanted: set[int] | None = None) -> tuple[np.ndarray, ...]:
    """(nodes, hops, parents, ranks, edges) of the tree of shortest walks with ties to the smallest sequence of keys; the
    start comes first. With `wanted` the walk ends at the layer that reaches one of these."""
    seen = np.zeros(graph.size, bool)
    seen[start] = True
    frontier, rank = np.array([start]), np.array([1])
    layers = [(frontier, np.array([0]), np.array([-1]), rank, np.array([-1]))]
    h = 0
    while len(frontier):
        h += 1
        whose, edge = graph.out(frontier)
        found = graph.target[edge]
        new = ~seen[found]
        whose, edge, found = whose[new], edge[new], found[new]
        # of a node's offers the one from the best ranked parent, then from the first by name
        order = np.lexsort((frontier[whose], rank[whose], found))
        whose, edge, found = whose[order], edge[order], found[order]
        keep = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.zeros(0, bool)
        whose, edge, found = whose[keep], edge[keep], found[keep]
        seen[found] = True
        above, own = rank[whose], key[found]
        order = np.lexsort((own, above))
        step = np.ones(len(order), np.int64)
        step[1:] = (np.diff(above[order]) != 0) | (np.diff(own[order]) != 0)
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.cumsum(step)
        layers.append((found, np.full(len(found), h), frontier[whose], ranks, edge))
        frontier, rank = found, ranks
        if wanted and not wanted.isdisjoint(found.tolist()):
            break
    return tuple(np.concatenate(x) for x in zip(*layers, strict=True))


def order_of_keys(keys: list) -> np.ndarray:
    """Dense ranks of keys, which are strings or rows of strings; null first."""
    plain = [(k is not None, tuple(k) if isinstance(k, (tuple, list)) else (k,)) if k is not None else (False, ()) for k in keys]
    place = {k: i for i, k in enumerate(sorted(set(plain)))}
    return np.array([place[k] for k in plain], np.int64)


def shortest_trees(graph: Graph, starts: DataFrame, key: np.ndarray, weights: np.ndarray | None = None) -> DataFrame:
    """(start, node, hops, parent, rank, weight) of each start's tree; the start itself at hops 0. Starts have the column
    start, and targets array<string> where walks end at the first of these."""
    sent = starts.sparkSession.sparkContext.broadcast((graph, key, weights))
    schema = pa.schema([("start", pa.string()), ("node", pa.string()), ("hops", pa.int32()), ("parent", pa.string()), ("rank", pa.int32()), ("weight", pa.int32())])
    limited = "targets" in starts.columns

    def run(batches):
        (g, key, weights), out = sent.value, _Rows(schema)
        total = np.zeros(g.size, np.int64)
        for batch in batches:
            for i, (name, at) in enumerate(zip(batch.column(0).to_pylist(), g.index(batch.column(0)).tolist(), strict=True)):
                if at < 0:  # without edges a start is its own tree
                    out.add([name], [name], [0], [None], [1], [0])
                    continue
                wanted = {x for x in g.index(batch.column(1)[i].as_py() or []).tolist() if x >= 0} if limited else None
                nodes, hops, parents, ranks, edges = ordered_tree(g, at, key, wanted)
                weight = np.zeros(len(nodes), np.int64)
                if weights is not None:
                    total[at] = 0
                    for a, b in zip(*_runs(hops), strict=True):
                        if a:
                            total[nodes[a:b]] = total[parents[a:b]] + weights[edges[a:b]]
                    weight = total[nodes]
                out.add([name] * len(nodes), g.names.take(pa.array(nodes)), hops, g.names.take(pa.array(parents, mask=parents < 0)), ranks, weight)
                if out.full():
                    yield out.batch()
        yield out.batch()

    columns = ["start", "targets"] if limited else ["start"]
    return _dealt(starts, *columns).mapInArrow(run, "start string, node string, hops int, parent string, rank int, weight int")


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    cuts = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return [0, *cuts], [*cuts, len(values)]


def shortest_routes(graph: Graph, asked: DataFrame, key: np.ndarray, labels: list, first_only: bool = False) -> DataFrame:
    """(start, node, path array<string>) of asked (start, targets array<string>): routes spelled by labels, from the start
    to each target that is reached. With `first_only` the walk ends at the layer that reaches one of the targets."""
    sent = asked.sparkSession.sparkContext.broadcast((graph, key, labels))
    schema = pa.schema([("start", pa.string()), ("node", pa.string()), ("path", pa.list_(pa.string()))])

    def run(batches):
        (g, key, labels), out = sent.value, _Rows(schema)
        parent = np.full(g.size, -2, np.int64)
        for batch in batches:
            for name, at, targets in zip(batch.column(0).to_pylist(), g.index(batch.column(0)).tolist(), batch.column(1).to_pylist(), strict=True):
                if at < 0:
                    continue
                places = {int(p): t for p, t in zip(g.index(targets).tolist(), targets, strict=True) if p >= 0}
                nodes, _, parents, _, _ = ordered_tree(g, at, key, set(places) if first_only else None)
                parent[nodes] = parents
                for p, t in places.items():
                    if parent[p] == -2:
                        continue
                    path, spot = [], p
                    while spot >= 0:
                        path.append(labels[spot])
                        spot = int(parent[spot])
                    out.add([name], [t], [path[::-1]])
                parent[nodes] = -2
                if out.full():
                    yield out.batch()
        yield out.batch()

    return _dealt(asked, "start", "targets").mapInArrow(run, "start string, node string, path array<string>")


def routes_within(graph: Graph, starts: DataFrame, ends: np.ndarray, key: np.ndarray, labels: list, least: int, most: int) -> DataFrame:
    """(start, node, path array<string>) of every node of `ends` that lies `least` to `most` hops from a start: routes as by
    shortest_routes(), for many starts at once and no further than `most` hops."""
    sent = starts.sparkSession.sparkContext.broadcast((graph, ends, key, pa.array(labels, pa.string())))
    schema = pa.schema([("start", pa.string()), ("node", pa.string()), ("path", pa.list_(pa.string()))])

    def trees(g, key, at):
        """Layers (node, place of the parent in the layer before) of the trees of all starts `at`; None where a layer of
        several starts has too many offers."""
        whose_start, node, rank = np.arange(len(at)), at, np.zeros(len(at), np.int64)
        seen, layers = np.arange(len(at)) * g.size + at, [(whose_start, node, None)]
        for _ in range(most):
            if len(at) > 1 and int((g.first[node + 1] - g.first[node]).sum()) + len(seen) > MOST_OFFERS:
                return None
            whose, edge = g.out(node)
            found = g.target[edge]
            code = whose_start[whose] * g.size + found
            # of a node's offers the one from the best ranked parent, then from the first by name
            order = np.lexsort((node[whose], rank[whose], code))
            whose, code = whose[order], code[order]
            keep = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
            whose, code = whose[keep], code[keep]
            new = seen[np.minimum(np.searchsorted(seen, code), len(seen) - 1)] != code
            whose, code = whose[new], code[new]
            above, whose_start, node = rank[whose], code // g.size, code % g.size
            own = key[node]
            order = np.lexsort((own, above, whose_start))
            step = np.ones(len(order), np.int64)
            step[1:] = (np.diff(whose_start[order]) != 0) | (np.diff(above[order]) != 0) | (np.diff(own[order]) != 0)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(step)
            layers.append((whose_start, node, whose))
            if not len(node):
                break
            seen = np.sort(np.concatenate([seen, code]))
        return layers

    def run(batches):
        g, ends, key, labels = sent.value
        for batch in batches:
            at = g.index(batch.column(0))
            at, todo = at[at >= 0], []
            todo += [at[i : i + STARTS] for i in range(0, len(at), STARTS)][::-1]
            while todo:
                some = todo.pop()
                layers = trees(g, key, some)
                if layers is None:
                    todo += [some[len(some) // 2 :], some[: len(some) // 2]]
                    continue
                for hops in range(least, len(layers)):
                    whose_start, node, _ = layers[hops]
                    good = np.flatnonzero(ends[node])
                    steps, spot = [], good
                    for h in range(hops, 0, -1):
                        steps.append(layers[h][1][spot])
                        spot = layers[h][2][spot]
                    steps.append(layers[0][1][spot])
                    for a in range(0, len(good), BATCH_ROWS):
                        part = np.stack([x[a : a + BATCH_ROWS] for x in steps[::-1]], axis=1)
                        offsets = pa.array(np.arange(len(part) + 1) * (hops + 1), pa.int32())
                        yield pa.RecordBatch.from_arrays([g.names.take(pa.array(part[:, 0])), g.names.take(pa.array(part[:, -1])), pa.ListArray.from_arrays(offsets, labels.take(pa.array(part.ravel())))], schema=schema)

    return _dealt(starts.select("start").distinct(), "start").mapInArrow(run, "start string, node string, path array<string>")


def fold_lines(graph: Graph, items: np.ndarray, tags: list) -> DataFrame | None:
    """As traverse.fold_lines(): every item's walk through parts that are no items."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast((graph, items, tags))
    schema = pa.schema([("source", pa.string()), ("target", pa.string()), ("via_tags", pa.list_(pa.string())), ("n_fittings", pa.int32())])

    def run(batches):
        (g, items, tags), out = sent.value, _Rows(schema)
        parent, seen = np.full(g.size, -1, np.int64), np.zeros(g.size, bool)
        for batch in batches:
            for start in np.asarray(batch.column(0)).tolist():
                frontier, rank, hit, touched = np.array([start]), np.array([0]), {}, []
                while len(frontier):
                    whose, edge = g.out(frontier)
                    found = g.target[edge]
                    good = found != start
                    whose, found = whose[good], found[good]
                    order = np.lexsort((rank[whose], found))
                    whose, found = whose[order], found[order]
                    keep = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.zeros(0, bool)
                    whose, found = whose[keep], found[keep]
                    item = items[found]
                    for t, w in zip(found[item].tolist(), whose[item].tolist(), strict=True):
                        hit.setdefault(t, int(frontier[w]))
                    on = ~item & ~seen[found]
                    whose, found = whose[on], found[on]
                    seen[found] = True
                    parent[found] = frontier[whose]
                    touched.append(found)
                    # routes in order: by the route up to the parent, then by the part
                    order = np.lexsort((found, rank[whose]))
                    frontier, rank = found[order], np.arange(len(found))
                for t, spot in hit.items():
                    via, n = [], 0
                    while spot != start:
                        via.append(tags[spot])
                        spot = int(parent[spot])
                        n += 1
                    names = [x for x in via[::-1] if x is not None]
                    out.add([g.names[start].as_py()], [g.names[t].as_py()], [names], [n - len(names)])
                for x in touched:
                    seen[x] = False
                if out.full():
                    yield out.batch()
        yield out.batch()

    starts = spark.createDataFrame(pa.table({"at": pa.array(np.flatnonzero(items))})) if items.any() else spark.createDataFrame([], "at long")
    return _dealt(starts, "at").mapInArrow(run, "source string, target string, via_tags array<string>, n_fittings int")


def count_ranges(graph: Graph, starts: DataFrame, counted: np.ndarray) -> DataFrame:
    """(start, node, low, high): least and most counted nodes strictly between start and node over all shortest walks."""
    sent = starts.sparkSession.sparkContext.broadcast((graph, counted))
    schema = pa.schema([("start", pa.string()), ("node", pa.string()), ("low", pa.int32()), ("high", pa.int32())])

    def run(batches):
        (g, counted), out = sent.value, _Rows(schema)
        hops, low, high = np.full(g.size, -1, np.int32), np.zeros(g.size, np.int32), np.zeros(g.size, np.int32)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), g.index(batch.column(0)).tolist(), strict=True):
                if start < 0:
                    continue
                hops[start], low[start], high[start] = 0, 0, 0
                frontier, layers, h = np.array([start]), [], 0
                while len(frontier):
                    h += 1
                    whose, edge = g.out(frontier)
                    found = g.target[edge]
                    new = (hops[found] < 0) | (hops[found] == h)
                    whose, found = whose[new], found[new]
                    add = counted[frontier[whose]].astype(np.int32) * (h > 1)
                    nodes, back = np.unique(found, return_inverse=True)
                    least, most = np.full(len(nodes), 1 << 30, np.int32), np.zeros(len(nodes), np.int32)
                    np.minimum.at(least, back, low[frontier[whose]] + add)
                    np.maximum.at(most, back, high[frontier[whose]] + add)
                    hops[nodes], low[nodes], high[nodes] = h, least, most
                    layers.append(nodes)
                    frontier = nodes
                nodes = np.concatenate([*layers, np.zeros(0, np.int64)])
                out.add([name] * len(nodes), g.names.take(pa.array(nodes)), low[nodes], high[nodes])
                hops[nodes], hops[start] = -1, -1
                if out.full():
                    yield out.batch()
        yield out.batch()

    return _dealt(starts.select("start").distinct(), "start").mapInArrow(run, "start string, node string, low int, high int")


def reach_sizes(graph: Graph, nodes: np.ndarray) -> np.ndarray:
    """For each node of the graph how many nodes it reaches, itself included; 0 where it is not among `nodes`."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast(graph)

    def run(batches):
        walker = Walker(sent.value)
        for batch in batches:
            at = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array([len(walker.walk(x)[0]) + 1 for x in at.tolist()], pa.int64())})

    out = np.zeros(graph.size, np.int64)
    if nodes.any():
        found = _dealt(spark.createDataFrame(pa.table({"at": pa.array(np.flatnonzero(nodes))})), "at").mapInArrow(run, "at long, n long").toArrow()
        out[np.asarray(found["at"])] = np.asarray(found["n"])
    return out


def meeting_points(graph: Graph, starts: list[int], items: np.ndarray) -> DataFrame | None:
    """(first, second, meeting) as traverse.meeting_points(); None where the starts' reach sets take over MOST_BYTES.

    What two starts both reach is closed under reach, so a member reaches all of it exactly when it reaches as many nodes,
    itself included: sizes decide, and no member's set is compared.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if len(starts) * graph.size / 8 > MOST_BYTES:
        return None
    sent = spark.sparkContext.broadcast((graph, np.array(starts, np.int64), np.where(items, reach_sizes(graph, items), -1)))
    schema = pa.schema([("first", pa.string()), ("second", pa.string()), ("meeting", pa.string())])

    def run(batches):
        g, starts, sizes = sent.value
        walker, out = Walker(g), _Rows(schema)
        sets = np.zeros((len(starts), -(-g.size // 8)), np.uint8)
        for i, s in enumerate(starts.tolist()):
            bits = np.zeros(g.size, bool)
            bits[walker.walk(s)[0]] = True
            sets[i] = np.packbits(bits, bitorder="little")
        reached = lambda rows, node: (sets[rows, node >> 3] >> (node & 7)) & 1
        for batch in batches:
            for i in np.asarray(batch.column(0)).tolist():
                after = np.arange(i + 1, len(starts))
                apart = (reached(after, int(starts[i])) == 0) & (reached(np.full(len(after), i), starts[after]) == 0)
                for j in after[apart].tolist():
                    both = sets[i] & sets[j]
                    n = int(np.bitwise_count(both).sum())
                    if n:
                        whole = np.flatnonzero(np.unpackbits(both, bitorder="little")[: g.size] & (sizes == n))
                        if len(whole) == 1:
                            out.add([g.names[int(starts[i])].as_py()], [g.names[int(starts[j])].as_py()], [g.names[int(whole[0])].as_py()])
                if out.full():
                    yield out.batch()
        yield out.batch()

    rows = spark.range(len(starts)).withColumnRenamed("id", "at")
    return _dealt(rows, "at").mapInArrow(run, "first string, second string, meeting string")


def nearest_owners(graph: Graph, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hops) of every node, -1 and -1 where none reaches it: first in, first out from the owners by name."""
    owner, hops = np.full(graph.size, -1, np.int64), np.full(graph.size, -1, np.int64)
    frontier = np.flatnonzero(owners)
    owner[frontier], hops[frontier] = frontier, 0
    h = 0
    while len(frontier):
        h += 1
        whose, edge = graph.out(frontier)
        found = graph.target[edge]
        new = hops[found] < 0
        whose, found = whose[new], found[new]
        # the frontier is in order of discovery; a node is found by the first that has it as a neighbour
        order = np.lexsort((whose, found))
        whose, found = whose[order], found[order]
        keep = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.zeros(0, bool)
        whose, found = whose[keep], found[keep]
        owner[found], hops[found] = owner[frontier[whose]], h
        frontier = found[np.lexsort((found, whose))]
    return owner, hops
