"""The query surface over a plant: find, neighbours, traverse, path, filter, aggregate, on named result handles.

A session holds items (item, tag, node_class, labels, unit, sheets, kind) and edges (src, dst, relation). Results stay
DataFrames; `$rN` names them within the session, and only what is shown is collected.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalars import fold_tag
from .lineage import stash
from .operators import filters, traverse
from .schema import RELATION_GROUPS

#: Items listed and characters shown of a result, and seconds a query text may run.
MOST_ITEMS, MOST_CHARS, MOST_SECONDS = 50, 4_000, 60.0


@dataclass
class Result:
    """A named set of items; `rows` has column item and what the operation tells of each."""

    handle: str
    rows: DataFrame
    edges: DataFrame | None = None
    marks: DataFrame | None = None

    def count(self) -> int:
        return self.rows.count()


@dataclass
class PlantApi:
    items: DataFrame
    edges: DataFrame
    results: dict[str, Result] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.items.sparkSession

    def _keep(self, rows: DataFrame, edges: DataFrame | None = None, marks: DataFrame | None = None) -> Result:
        handle = f"$r{len(self.results) + 1}"
        self.results[handle] = Result(handle, stash(rows, "api-result"), edges, marks)
        return self.results[handle]

    def _along(self, relations: str) -> DataFrame:
        if relations not in RELATION_GROUPS:
            raise ValueError(f"relations {relations!r} are not known; known: {', '.join(RELATION_GROUPS)}")
        return self.edges.where(F.col("relation").isin(*RELATION_GROUPS[relations]))

    def _where(self, **where):
        filters.check_vocabulary(self.items, **where)
        return filters.item_filter(**where)

    def resolve(self, ref: str | Result) -> DataFrame:
        """(item) of a handle, a printed tag or an item id; nothing found is an error."""
        if isinstance(ref, Result):
            ref = ref.handle
        if ref.startswith("$"):
            if ref not in self.results:
                raise ValueError(f"{ref} is not a result of this session")
            found = self.results[ref].rows.select("item").distinct()
        else:
            found = self.items.where((fold_tag("tag") == fold_tag(F.lit(ref))) | (F.col("item") == ref)).select("item")
        if found.isEmpty():
            raise ValueError(f"{ref!r} names no item")
        return found

    def listing(self, rows: DataFrame, limit: int = MOST_ITEMS) -> list[dict]:
        """The first rows by hops where there are any, tag and id."""
        full = rows.join(self.items.select("item", "tag", "node_class", "unit"), "item").withColumn("_tag", F.coalesce("tag", F.lit("")))
        order = (["hops"] if "hops" in rows.columns else []) + ["_tag", "item"]
        return [r.asDict() for r in full.orderBy(*order).drop("_tag").limit(limit).collect()]

    def find(self, limit: int = MOST_ITEMS, **where) -> tuple[Result, list[dict], int]:
        result = self._keep(self.items.where(self._where(**where)).select("item"))
        return result, self.listing(result.rows, limit), result.count()

    def filter(self, ref: str | Result, **where) -> Result:
        kept = self.resolve(ref)
        return self._keep(self.items.where(self._where(**where)).select("item").join(kept, "item", "left_semi"))

    def neighbours(self, ref: str | Result, direction: str = "both", relations: str = "any", **where) -> Result:
        return self.traverse(ref, direction, relations, max_hops=1, mark=False, **where)

    def traverse(self, ref: str | Result, direction: str = "down", relations: str = "flow", stop_at: dict | None = None, walk_only: dict | None = None, max_hops: int | None = None, mark: bool = True, **where) -> Result:
        """What the named items reach together: one walk from all of them, each node at its least distance."""
        found = self.resolve(ref)
        name = "set"
        along = self._along(relations)
        node = lambda df: df.select(F.col("item").alias("node"))
        hub = found.select(F.lit(name).alias("src"), F.col("item").alias("dst"))
        stops = node(self.items.where(self._where(**stop_at))) if stop_at else None
        walk = node(self.items.where(self._where(**walk_only))) if walk_only else None
        if walk is not None:  # starts may lie outside of where the walk may go
            walk = walk.unionByName(node(found)).distinct()
        if stops is not None:  # a start among the stops is walked through
            stops = stops.join(node(found), "node", "left_anti")
        oriented = hub.select("src", "dst") if direction == "down" else hub.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        whole = along.select("src", "dst").unionByName(oriented)
        reached = traverse.closure(whole, self.spark.createDataFrame([(name,)], "start string"), direction, stop=stops, walk=walk, max_hops=None if max_hops is None else max_hops + 1)
        rows = reached.where(F.col("node") != name).join(node(found), "node", "left_anti").select(F.col("node").alias("item"), (F.col("hops") - 1).alias("hops"), "stopped")
        if where:
            rows = rows.join(self.items.where(self._where(**where)).select("item"), "item", "left_semi")
        marks = None
        if mark:
            ends = rows.select(F.col("item").alias("node"), "stopped").join(traverse.oriented(along, direction).select(F.col("src").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("item"), F.lit("end").alias("mark"))
            marks = ends.unionByName(rows.where("stopped").select("item", F.lit("stop").alias("mark")))
        shown = rows.select("item").unionByName(found).distinct()
        inside = along.join(shown.withColumnRenamed("item", "src"), "src", "left_semi").join(shown.withColumnRenamed("item", "dst"), "dst", "left_semi")
        return self._keep(rows, inside, marks)

    def path(self, source: str, target: str, relations: str = "flow", directed: bool = True) -> list[str] | None:
        """Items of the shortest path between two named sets, ties to the smallest sequence of (tag, id); None without one."""
        starts, goals = self.resolve(source), self.resolve(target)
        names = self.items.select(F.col("item").alias("node"), "tag")
        hub = starts.select(F.lit("").alias("src"), F.col("item").alias("dst"))
        along = self._along(relations).select("src", "dst")
        if not directed:
            along = traverse.oriented(along, "both")
        targets = goals.select(F.lit("").alias("start"), F.col("item").alias("node"))
        key = F.struct(F.coalesce("tag", F.lit("")).alias("t"), F.col("node").alias("n"))
        tree = traverse.layered(along.unionByName(hub), self.spark.createDataFrame([("",)], "start string"), key, names, targets=targets)
        hit = tree.join(targets, ["start", "node"], "left_semi").orderBy("hops", "rank").limit(1)
        if hit.isEmpty():
            return None
        found = traverse.paths(tree, hit.select("start", "node")).first()
        return found["path"][1:]

    def aggregate(self, ref: str | Result, group_by: str, limit: int | None = MOST_ITEMS) -> list[dict]:
        """(grp, n, first_tags) by node_class, unit or sheet, largest first, `limit` groups or all (None); an item on two
        sheets counts in both. Five tags of a group are kept, whatever its size."""
        groups = {"node_class": F.array("node_class"), "unit": F.array(F.coalesce("unit", F.lit("(no unit)"))), "sheet": F.col("sheets")}
        if group_by not in groups:
            raise ValueError(f"group_by {group_by!r}: expected one of {', '.join(groups)}")
        rows = self.items.join(self.resolve(ref), "item", "left_semi").withColumn("grp", F.explode(groups[group_by])).select("grp", "item", F.coalesce("tag", F.lit("")).alias("tag"))
        first = rows.withColumn("i", F.row_number().over(Window.partitionBy("grp").orderBy("tag", "item"))).where("i <= 5")
        tags = first.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "tag"))), lambda x: x["tag"]).alias("first_tags"))
        table = rows.groupBy("grp").agg(F.count("*").alias("n")).join(tags, "grp").select("grp", "n", "first_tags").orderBy(F.col("n").desc(), "grp")
        return [r.asDict() for r in (table if limit is None else table.limit(limit)).collect()]

    def show(self, ref: str | Result, most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS) -> str:
        """A result as text: how many items, then a line each, nearest first, as many as fit, and how many are not shown.
        Items at which the walk stopped or the plant ends say so."""
        result = ref if isinstance(ref, Result) else self.results[ref]
        total, listed = result.count(), self.listing(result.rows, most_items)
        marks = {r["item"]: r["mark"] for r in result.marks.join(self.spark.createDataFrame([(r["item"],) for r in listed], "item string"), "item").collect()} if result.marks is not None and listed else {}
        text = f"{result.handle}: {total} items"
        for i, r in enumerate(listed):
            hops = f" hops={r['hops']}" if "hops" in r else ""
            line = f"\n{r['item']} {r['tag'] or '-'} {r['node_class']} unit={r['unit'] or '-'}{hops}" + (f" [{marks[r['item']]}]" if r["item"] in marks else "")
            rest = f"\n({total - i} more not shown; narrow with filter or aggregate)"
            if len(text) + len(line) + len(rest) > most_chars:
                return text + rest
            text += line
        return text + (f"\n({total - len(listed)} more not shown; narrow with filter or aggregate)" if total > len(listed) else "")

    def sql(self, text: str, cap: int = 1_000, seconds: float = MOST_SECONDS) -> tuple[DataFrame, bool]:
        """A reading query over the views items and edges, its rows up to a cap, and whether there were more. Jobs that run
        longer than `seconds` are cancelled: a TimeoutError."""
        clause = filters.writing_clause(text)
        if clause:
            raise ValueError(f"only reading queries are allowed; found {clause}")
        self.items.createOrReplaceTempView("items")
        self.edges.createOrReplaceTempView("edges")
        return guarded(self.spark, lambda: filters.capped(self.spark.sql(text), cap), seconds)


def guarded(spark: SparkSession, work, seconds: float):
    """What `work` returns; its jobs are a group of their own, which a timer cancels."""
    context, group, late = spark.sparkContext, f"sheetweave-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a query under a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return work()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"the query ran over {seconds} seconds") from error
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


#: Operations by name, for callers that send JSON.
TOOLS = {name: getattr(PlantApi, name) for name in ("find", "filter", "neighbours", "traverse", "path", "aggregate")}


def call(api: PlantApi, name: str, arguments: dict):
    if name not in TOOLS:
        raise ValueError(f"tool {name!r} is not known; known: {', '.join(TOOLS)}")
    try:
        return TOOLS[name](api, **arguments)
    except TypeError as error:
        raise ValueError(f"arguments of {name}: {error}") from None
