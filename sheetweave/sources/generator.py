"""Synthetic plants of any size: every draw is a hash of the seed and of what is drawn, so units are made independently.

Units hold equipment joined by a random tree, perhaps a recycle; every unit but the first is fed from an earlier one,
perhaps twice; streams carry valves; some equipment has a control loop on a valve behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import class_dim

EQUIPMENT_POOL = ("CentrifugalPump", "PressureVessel", "Tank", "TubularHeatExchanger", "ProcessColumn")
VALVE_POOL = ("GlobeValve", "BallValve", "GateValve", "CheckValve")
VARIABLES = ("F", "L", "P", "T")


@dataclass(frozen=True)
class GeneratorConfig:
    seed: int = 0
    n_units: int = 4
    equipment_min: int = 3
    equipment_max: int = 8
    p_recycle: float = 0.2
    p_cross_link: float = 0.2
    valves_max: int = 2
    p_loop: float = 0.5

    def __post_init__(self):
        if not 1 <= self.equipment_min <= self.equipment_max:
            raise ValueError(f"equipment_min {self.equipment_min} and equipment_max {self.equipment_max} do not form a range from 1")


def _draw(config: GeneratorConfig, what: str, *key) -> Column:
    """A number from 0 to 2**62 for a purpose and a key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(config.seed), F.lit(what), *key), 2)


def _below(config, what, bound, *key) -> Column:
    return _draw(config, what, *key) % bound


def _happens(config, what, share: float, *key) -> Column:
    return _draw(config, what, *key) < int(share * (1 << 62))


def _size(config, unit) -> Column:
    return F.lit(config.equipment_min) + _below(config, "size", config.equipment_max - config.equipment_min + 1, unit)


def _name(unit, index) -> Column:
    return F.concat(F.lit("u"), (unit + 1).cast("string"), F.lit("-eq"), (index + 1).cast("string"))


def generate(spark: SparkSession, config: GeneratorConfig) -> tuple[DataFrame, DataFrame]:
    """(node, node_class, tag, unit, loop_tag) and (src, dst, relation, line_number)."""
    units = spark.range(config.n_units).select(F.col("id").alias("unit")).withColumn("size", _size(config, F.col("unit")))
    u = F.col("unit")
    equipment = units.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("index"))
    pool = F.array(*map(F.lit, EQUIPMENT_POOL))
    equipment = equipment.withColumn("node", _name(u, F.col("index"))).withColumn("node_class", F.element_at(pool, (_below(config, "class", len(EQUIPMENT_POOL), u, F.col("index")) + 1).cast("int")))

    tree = equipment.where("index > 0").select(_name(u, _below(config, "parent", F.col("index"), u, F.col("index"))).alias("a"), F.col("node").alias("b"), F.lit("tree").alias("kind"))
    later = F.lit(2) + _below(config, "recycle-from", F.greatest(F.col("size") - 2, F.lit(1)), u)
    back = F.lit(1) + _below(config, "recycle-to", F.greatest(later - 1, F.lit(1)), u)
    recycle = units.where(_happens(config, "recycle", config.p_recycle, u) & (F.col("size") > 2)).select(_name(u, later).alias("a"), _name(u, back).alias("b"), F.lit("recycle").alias("kind"))
    source = lambda what: _below(config, what, F.greatest(u, F.lit(1)), u)
    feed = units.where("unit > 0").select(_name(source("feed"), _below(config, "feed-item", _size(config, source("feed")), u)).alias("a"), _name(u, F.lit(0)).alias("b"), F.lit("cross_unit").alias("kind"))
    link_to = F.lit(1) + _below(config, "link-to", F.greatest(F.col("size") - 1, F.lit(1)), u)
    link = units.where((u > 0) & (F.col("size") > 1) & _happens(config, "link", config.p_cross_link, u)).select(_name(source("link"), _below(config, "link-item", _size(config, source("link")), u)).alias("a"), _name(u, link_to).alias("b"), F.lit("cross_link").alias("kind"))
    # one stream for each pair whatever its direction: a recycle gives way to the tree
    rank = F.when(F.col("kind") == "recycle", 1).otherwise(0)
    streams = tree.unionByName(recycle).unionByName(feed).unionByName(link).where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min_by(F.struct("a", "b", "kind"), F.struct(rank, F.col("a"), F.col("b"))).alias("s")).select("s.*")

    line = F.concat_ws(">", "a", "b")
    count = _below(config, "valves", config.valves_max + 1, line)
    valve = lambda i: F.concat(F.lit("v:"), line, F.lit(":"), i.cast("string"))
    chain = F.concat(F.array("a"), F.transform(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1))), lambda i: i <= count), valve), F.array("b"))
    drawn = streams.select(line.alias("line_number"), "kind", chain.alias("chain"))
    hop = F.explode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("src"), F.slice("chain", 2, F.size("chain") - 1).alias("dst")))
    flow = drawn.select("line_number", hop.alias("h")).select("h.src", "h.dst", F.lit("send_to").alias("relation"), "line_number")
    owner = F.substring_index("line_number", ">", 1)
    valves = drawn.select("line_number", F.explode(F.slice("chain", 2, F.size("chain") - 2)).alias("node")).withColumn("unit", F.regexp_extract(owner, r"^u(\d+)-", 1).cast("long") - 1)
    vpool = F.array(*map(F.lit, VALVE_POOL))
    valves = valves.withColumn("node_class", F.element_at(vpool, (_below(config, "valve-class", len(VALVE_POOL), F.col("node")) + 1).cast("int")))

    # a loop on the first controllable valve behind an item
    first = valves.where(F.col("node_class").isin("GlobeValve", "BallValve")).groupBy(owner.alias("item")).agg(F.min("node").alias("valve"))
    loops = first.where(_happens(config, "loop", config.p_loop, F.col("item")))
    variable = F.element_at(F.array(*map(F.lit, VARIABLES)), (_below(config, "variable", len(VARIABLES), F.col("item")) + 1).cast("int"))
    part = lambda letter: F.concat(F.lit(letter), F.lit(":"), F.col("item"))
    kinds = (("s", "ProcessSignalGeneratingFunction", "T"), ("c", "ProcessInstrumentationFunction", "IC"), ("a", "ActuatingFunction", None))
    signals = [(F.col("item"), part("s"), "measured_by"), (part("s"), part("c"), "send_signal_to"), (part("c"), part("a"), "send_signal_to"), (part("a"), F.col("valve"), "control")]
    edges = flow
    for a, b, relation in signals:
        edges = edges.unionByName(loops.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"), F.lit(None).cast("string").alias("line_number")))

    none = F.lit(None).cast("string")
    unit_name = F.concat(F.lit("U"), (u + 1).cast("string"))
    prefix = F.broadcast(class_dim(spark).select("node_class", "tag_prefix"))
    items = equipment.select("node", "node_class", "unit", "index").unionByName(valves.select("node", "node_class", "unit", F.lit(None).cast("long").alias("index"))).join(prefix, "node_class")
    number = F.coalesce((F.col("index") + 1).cast("string"), F.substring(F.sha1(F.col("node").cast("binary")), 1, 12))
    nodes = items.select("node", "node_class", F.concat_ws("-", "tag_prefix", (u + 1).cast("string"), number).alias("tag"), unit_name.alias("unit"), none.alias("loop_tag"))
    for letter, node_class, suffix in kinds:
        tag = F.concat(variable, F.lit(suffix), F.lit("-"), F.col("item")) if suffix else none
        nodes = nodes.unionByName(loops.select(part(letter).alias("node"), F.lit(node_class).alias("node_class"), tag.alias("tag"), none.alias("unit"), F.concat(variable, F.lit("-"), F.col("item")).alias("loop_tag")))
    return nodes, edges
