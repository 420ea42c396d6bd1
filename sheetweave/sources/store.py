"""A plant and its drawings as the nodes and relations of a graph store, in four profiles, and what must hold in it.

Nodes are (uid, labels, properties map), relations (type, src, dst, properties map). Plant items are labelled PlantItem
and their classes; drawings (occurrences) their classes alone; sheets and sections are structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Profiles, structure labels, and what an item's line view carries.
PROFILES = ("occurrence", "plant", "both", "plant_lines")
ITEM, SHEET, SECTION = "PlantItem", "Sheet", "PlantSection"
LINE_KINDS = ("equipment", "valve")


def _props(**columns: Column) -> Column:
    """A map of the columns that are not null."""
    entries = F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))))
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def _rel(rows: DataFrame, kind: str, src: str, dst: str, props: Column | None = None) -> DataFrame:
    return rows.select(F.lit(kind).alias("type"), F.col(src).alias("src"), F.col(dst).alias("dst"), (props if props is not None else F.create_map().cast("map<string,string>")).alias("properties"))


def store_rows(profile: str, items: DataFrame, drawings: DataFrame, topology: DataFrame, drawn_topology: DataFrame, pairs: DataFrame, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) of a profile.

    `items`: item, labels, kind, tag, unit. `drawings`: key, item, sheet, labels (paired stubs have no item).
    `topology`: src, dst, relation, via (stub keys crossed) among items; `drawn_topology`: src, dst, relation among keys;
    `pairs`: from_key, to_key of stubs; `lines`: source, target, via_tags, n_fittings for the profile `plant_lines`.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile {profile!r}: expected one of {', '.join(PROFILES)}")
    sheet_uid, section_uid = F.concat(F.lit("sheet:"), "sheet"), F.concat(F.lit("section:"), "unit")
    sheets = drawings.select("sheet").distinct().select(sheet_uid.alias("uid"), F.array(F.lit(SHEET)).alias("labels"), _props(sheet=F.col("sheet")).alias("properties"))
    sections = items.where("unit is not null").select("unit").distinct().select(section_uid.alias("uid"), F.array(F.lit(SECTION)).alias("labels"), _props(unit_id=F.col("unit")).alias("properties"))
    drawn = drawings.select(F.col("key").alias("uid"), "labels", _props(sheet=F.col("sheet")).alias("properties"))
    drawn_on = _rel(drawings.withColumn("s", sheet_uid), "is_drawn_on", "key", "s")
    occurrence = (drawn.unionByName(sheets), _rel_by_type(drawn_topology).unionByName(_rel(pairs, "continues_as", "from_key", "to_key")).unionByName(drawn_on))
    if profile == "occurrence":
        return occurrence
    with_lines = profile == "plant_lines"
    marks = {}
    if with_lines:
        ends = lines.select(F.col("source").alias("item"), F.lit(True).alias("out"), F.lit(None).cast("boolean").alias("in_")).unionByName(lines.select(F.col("target").alias("item"), F.lit(None).cast("boolean").alias("out"), F.lit(True).alias("in_")))
        items = items.join(ends.groupBy("item").agg(F.max("out").alias("out"), F.max("in_").alias("in_")), "item", "left")
        on_line = F.col("kind").isin(*LINE_KINDS)
        marks = {"kind": F.col("kind"), "no_inflow": F.when(on_line, F.col("in_").isNull()), "no_outflow": F.when(on_line, F.col("out").isNull())}
    labels = F.concat(F.array(F.lit(ITEM)), "labels", F.when(F.col("kind") == "valve", F.array(F.lit("Valve"))).otherwise(F.array().cast("array<string>")) if with_lines else F.array().cast("array<string>"))
    nodes = items.select(F.col("item").alias("uid"), F.array_distinct(labels).alias("labels"), _props(tag=F.col("tag"), unit_id=F.col("unit"), **marks).alias("properties"))
    plant = topology.select(F.col("relation").alias("type"), "src", "dst", _props(via_connector_uids=F.when(F.size("via") > 0, F.array_join("via", "|"))).alias("properties"))
    located = _rel(items.where("unit is not null").withColumn("s", section_uid), "is_located_in", "item", "s")
    on_sheets = _rel(drawings.where("item is not null").select("item", sheet_uid.alias("s")).distinct(), "is_drawn_on", "item", "s")
    structure = sections.unionByName(sheets)
    rels = plant.unionByName(located).unionByName(on_sheets)
    if with_lines:
        rels = rels.unionByName(_rel(lines, "line_to", "source", "target", _props(via_tags=F.array_join("via_tags", "|"), n_fittings=F.col("n_fittings"))))
    if profile != "both":
        return structure.unionByName(nodes), rels
    drawn_as = _rel(drawings.where("item is not null"), "drawn_as", "item", "key")
    return occurrence[0].unionByName(sections).unionByName(nodes), occurrence[1].unionByName(rels).unionByName(drawn_as)


def _rel_by_type(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("relation").alias("type"), "src", "dst", F.create_map().cast("map<string,string>").alias("properties"))


def counts(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(what, name, n): nodes of each label, relations of each type."""
    of_labels = nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("label").alias("what"), "name", "n")
    return of_labels.unionByName(rels.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), "name", "n"))


def invariants(profile: str, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(invariant, violations) of the ten rules that hold in a store, as far as they concern the profile."""
    item = F.array_contains("labels", ITEM)
    items = nodes.where(item).select("uid", "labels", "properties")
    ids = items.select("uid")
    of = lambda *kinds: rels.where(F.col("type").isin(*kinds)).select("src", "dst", "properties")
    ends = lambda kind: of(kind).select(F.col("src").alias("uid")).unionByName(of(kind).select(F.col("dst").alias("uid"))).distinct()
    count = lambda rows: rows.agg(F.count("*").alias("violations"))
    found: dict[str, DataFrame] = {}
    if profile == "both":
        drawn_as, paired = of("drawn_as"), ends("continues_as")
        found["INV-1"] = count(ids.join(drawn_as.select(F.col("src").alias("uid")), "uid", "left_anti"))
        plain = nodes.where(~item & ~F.arrays_overlap("labels", F.array(F.lit(SHEET), F.lit(SECTION)))).select("uid").join(paired, "uid", "left_anti")
        per = plain.join(drawn_as.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("n")), "uid", "left")
        found["INV-2"] = count(per.where("coalesce(n, 0) <> 1"))
        found["INV-3"] = count(drawn_as.select(F.col("dst").alias("uid")).join(paired, "uid", "left_semi"))
        sheet_of = of("is_drawn_on").select(F.col("src").alias("uid"), F.col("dst").alias("sheet"))
        own = ids.join(sheet_of, "uid").distinct()
        drawn = drawn_as.select(F.col("src").alias("item"), F.col("dst").alias("uid")).join(sheet_of, "uid").select(F.col("item").alias("uid"), "sheet").distinct()
        differ = own.join(drawn, ["uid", "sheet"], "left_anti").unionByName(drawn.join(own, ["uid", "sheet"], "left_anti")).select("uid").distinct()
        found["INV-4"] = count(differ)
        via = rels.where("properties['via_connector_uids'] is not null").select("type", "src", "dst", F.explode(F.split(F.col("properties")["via_connector_uids"], r"\|")).alias("stub")).distinct()
        per_stub = via.groupBy("stub").agg(F.count("*").alias("n")).agg(F.count("*").alias("stubs"), F.count_if(F.col("n") > 1).alias("shared"))
        n_pairs = of("continues_as").agg(F.count("*").alias("pairs"))
        found["INV-5"] = per_stub.join(n_pairs).select((F.col("shared") + F.abs(F.col("stubs") - 2 * F.col("pairs"))).alias("violations"))  # one row each
    if profile != "occurrence":
        topology = of("send_to", "send_signal_to", "control", "measured_by", "has_agitator", "related_to")
        marked = ids.withColumn("is_item", F.lit(True))
        sided = topology.join(marked.toDF("src", "a"), "src", "left").join(marked.toDF("dst", "b"), "dst", "left")
        found["INV-6"] = count(sided.where("coalesce(a, false) <> coalesce(b, false)"))
        sections = nodes.where(F.array_contains("labels", SECTION)).select(F.col("uid").alias("dst"), F.col("properties")["unit_id"].alias("section"))
        located = of("is_located_in").select("src", "dst").join(sections, "dst", "left").groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("n"), F.collect_list("section").alias("of"))
        united = items.select("uid", F.col("properties")["unit_id"].alias("unit")).where("unit is not null").join(located, "uid", "left")
        right = F.size(F.filter(F.coalesce("of", F.array().cast("array<string>")), lambda s: s == F.col("unit")))
        found["INV-7"] = count(united.where((right != 1) | (F.coalesce("n", F.lit(0)) != 1)))
    if profile == "plant_lines":
        kind = F.col("properties")["kind"]
        found["INV-8"] = count(items.where(kind.isNull() | (F.array_contains("labels", "Valve") != (kind == "valve"))))
        kinds = items.select("uid", kind.alias("kind"))
        line = of("line_to").join(kinds.toDF("src", "ka"), "src", "left").join(kinds.toDF("dst", "kb"), "dst", "left")
        good = F.coalesce(F.col("ka").isin(*LINE_KINDS) & F.col("kb").isin(*LINE_KINDS), F.lit(False)) & F.col("properties")["via_tags"].isNotNull() & F.col("properties")["n_fittings"].isNotNull()
        found["INV-9"] = count(line.where(~good))
        has = lambda end, name: of("line_to").select(F.col(end).alias("uid")).distinct().withColumn(name, F.lit(True))
        seen = items.join(has("dst", "in_"), "uid", "left").join(has("src", "out"), "uid", "left")
        mark = lambda name: F.col("properties")[name].cast("boolean")
        wrong = mark("no_inflow").isNull() | mark("no_outflow").isNull() | (mark("no_inflow") == F.col("in_").isNotNull()) | (mark("no_outflow") == F.col("out").isNotNull())
        found["INV-10"] = count(seen.where(F.when(kind.isin(*LINE_KINDS), wrong).otherwise(mark("no_inflow").isNotNull() | mark("no_outflow").isNotNull())))
    out = None
    for name, one in found.items():
        row = one.select(F.lit(name).alias("invariant"), F.col("violations").cast("long").alias("violations"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        return nodes.sparkSession.createDataFrame([], "invariant string, violations long")
    return out


def schema_text(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(line) of a description of what the store holds: each label's properties, each relation's ends and properties."""
    label = F.explode("labels").alias("label")
    keys = lambda rows, by: rows.select(*by, F.explode_outer(F.map_keys("properties")).alias("key")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("keys"))
    of_nodes = keys(nodes.select(label, "properties"), ["label"]).select(F.concat(F.lit("(:"), "label", F.lit(") {"), "keys", F.lit("}")).alias("line"))
    first = nodes.select("uid", F.get("labels", F.lit(0)).alias("label"))
    ends = rels.join(first.toDF("src", "a"), "src").join(first.toDF("dst", "b"), "dst")
    of_rels = keys(ends.select("a", "type", "b", "properties"), ["a", "type", "b"]).select(F.concat(F.lit("(:"), "a", F.lit(")-[:"), "type", F.lit(" {"), "keys", F.lit("}]->(:"), "b", F.lit(")")).alias("line"))
    return of_nodes.unionByName(of_rels)
