"""Item filters, vocabulary checks, and the rules a plant, a sheet and a query text must keep."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fold_tag, fold_unit
from ..schema import CONTROL_BODIES, EQUIPMENT, UNTAGGED, classes_where

#: Values listed in a message about an unknown one.
LISTED = 40
# Words that start a writing statement.
WRITING = ("INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "DROP", "ALTER", "TRUNCATE", "REPLACE", "SET", "REMOVE", "DETACH", "LOAD", "CALL", "REFRESH", "CACHE", "UNCACHE", "ANALYZE", "GRANT", "REVOKE", "COPY", "OVERWRITE")


def item_filter(label: str | None = None, node_class: str | None = None, unit: str | None = None, not_unit: str | None = None, sheet: str | None = None, tag: str | None = None, kind: str | None = None) -> Column:
    """AND of what is given, over columns labels, node_class, unit, sheets, tag and kind; case does not matter.

    A label matches any of a class's chain, and `Valve` also every item of kind valve. An item without a unit
    passes `not_unit`.
    """
    low = lambda c: F.lower(c)
    parts: list[Column] = []
    if label is not None:
        known = F.array_contains(F.transform("labels", low), label.lower())
        parts.append(known | (F.col("kind") == "valve") if label.lower() == "valve" else known)
    if node_class is not None:
        parts.append(low("node_class") == node_class.lower())
    if unit is not None:
        parts.append(fold_unit(F.col("unit")) == fold_unit(F.lit(unit)))
    if not_unit is not None:
        parts.append(F.coalesce(fold_unit(F.col("unit")) != fold_unit(F.lit(not_unit)), F.lit(True)))
    if sheet is not None:
        parts.append(F.array_contains(F.transform("sheets", low), sheet.lower()))
    if tag is not None:
        parts.append(fold_tag(F.col("tag")) == fold_tag(F.lit(tag)))
    if kind is not None:
        parts.append(F.col("kind") == kind)
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def check_vocabulary(items: DataFrame, **where: str) -> None:
    """Refuse labels, classes, units and sheets that no item has, naming what is known or where else the value fits."""
    known = {
        "label": items.select(F.explode("labels").alias("v")), "node_class": items.select(F.col("node_class").alias("v")),
        "unit": items.where("unit is not null").select(F.col("unit").alias("v")), "sheet": items.select(F.explode("sheets").alias("v")),
    }
    fold = lambda name, c: fold_unit(c) if name == "unit" else F.lower(c)
    for name, given in where.items():
        field = "unit" if name == "not_unit" else name
        if given is None or field not in known or (field == "label" and given.lower() == "valve"):
            continue
        if not known[field].where(fold(field, F.col("v")) == fold(field, F.lit(given))).isEmpty():
            continue
        other = {"label": "node_class", "node_class": "label"}.get(field)
        if other and not known[other].where(F.lower("v") == given.lower()).isEmpty():
            raise ValueError(f"{field} {given!r} is not known; it is a {other}")
        listed = [r["v"] for r in known[field].distinct().orderBy("v").limit(LISTED + 1).collect()]
        more = ", ..." if len(listed) > LISTED else ""
        raise ValueError(f"{field} {given!r} is not known; known: {', '.join(listed[:LISTED])}{more}")


def visible(properties: Column, allowed: tuple[str, ...]) -> Column:
    """A map's allowed entries, nulls dropped."""
    return F.map_filter(properties, lambda k, v: k.isin(*allowed) & v.isNotNull())


def plant_violations(nodes: DataFrame, edges: DataFrame, classes: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """(subject, rule, detail) of each breach of the plant's rules; `per` names columns within which tags are unique.

    Rules: known class, a tag where the class is drawn with one, known relation, endpoints of classes the relation
    allows, no tag on two nodes (all but the smallest node), machines driven by electrical actuators alone.
    """
    known = F.broadcast(classes.select("node_class", "category", F.lit(True).alias("known")))
    typed = nodes.join(known, "node_class", "left")
    unknown = typed.where("known is null").select(F.col("node").alias("subject"), F.lit("unknown class").alias("rule"), F.col("node_class").alias("detail"))
    untagged = typed.where(F.col("known") & F.col("tag").isNull() & ~F.col("node_class").isin(*UNTAGGED)).select(F.col("node").alias("subject"), F.lit("missing tag").alias("rule"), F.col("node_class").alias("detail"))
    first = nodes.where("tag is not null").groupBy("tag", *per).agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = nodes.join(first, ["tag", *per]).where("node <> first").select(F.col("node").alias("subject"), F.lit("duplicate tag").alias("rule"), F.concat_ws(" also on ", "tag", "first").alias("detail"))
    ends = typed.select("node", "node_class", "category")
    both = edges.join(ends.select(F.col("node").alias("src"), F.col("node_class").alias("src_class"), F.col("category").alias("src_category")), "src", "left").join(ends.select(F.col("node").alias("dst"), F.col("node_class").alias("dst_class"), F.col("category").alias("dst_category")), "dst", "left")
    edge = F.concat(F.col("src"), F.lit("->"), F.col("dst"))
    relation, s, d = F.col("relation"), F.col("src_category"), F.col("dst_category")
    piped = lambda c: c.isin("equipment", "piping", "generic")
    acting = F.col("src_class").isin("ActuatingFunction", "ActuatingElectricalFunction", "FlowInSignalOffPageConnector", "GenericItem")
    allowed = (
        F.when(relation == "send_to", (piped(s) | (F.col("src_class") == "FlowInPipeOffPageConnector")) & (piped(d) | (F.col("dst_class") == "FlowOutPipeOffPageConnector")))
        .when(relation == "send_signal_to", s.isin("instrumentation", "generic", "connector") & d.isin("instrumentation", "generic", "connector"))
        .when(relation == "control", acting & (F.col("dst_class").isin(*CONTROL_BODIES, *EQUIPMENT, "FlowOutSignalOffPageConnector", "GenericItem")))
        .when(relation == "measured_by", (piped(s) & (F.col("src_class") != "PropertyBreak") | (F.col("src_class") == "FlowInSignalOffPageConnector")) & F.col("dst_class").isin("ProcessSignalGeneratingFunction", "FlowOutSignalOffPageConnector", "GenericItem"))
        .when(relation == "has_agitator", s.isin("equipment", "generic") & F.col("dst_class").isin("Agitator", "GenericItem"))
        .when(relation == "related_to", F.lit(True))
    )
    strange = both.where(allowed.isNull()).select(edge.alias("subject"), F.lit("unknown relation").alias("rule"), relation.alias("detail"))
    loose = both.where("src_class is null or dst_class is null").select(edge.alias("subject"), F.lit("missing end").alias("rule"), relation.alias("detail"))
    misplaced = both.where(~allowed).select(edge.alias("subject"), F.lit("endpoint class").alias("rule"), F.concat_ws(" ", "src_class", "relation", "dst_class").alias("detail"))
    machine = both.where((relation == "control") & (d == "equipment") & (F.col("src_class") == "ActuatingFunction")).select(edge.alias("subject"), F.lit("machine control").alias("rule"), F.concat_ws(" ", "src_class", "dst_class").alias("detail"))
    out = unknown
    for part in (untagged, again, strange, loose, misplaced, machine):
        out = out.unionByName(part)
    return out


def contract_violations(sheets: DataFrame) -> DataFrame:
    """(rule, subject) of drawings (sheet, node): a colon in a sheet's name, a node on two sheets."""
    colon = sheets.where(F.contains("sheet", F.lit(":"))).select(F.lit("colon in sheet").alias("rule"), F.col("sheet").alias("subject")).distinct()
    twice = sheets.groupBy("node").agg(F.count_distinct("sheet").alias("n")).where("n > 1").select(F.lit("node on two sheets").alias("rule"), F.col("node").alias("subject"))
    return colon.unionByName(twice)


def writing_clause(text: str) -> str | None:
    """The first writing word of a query text outside of literals, quoted names and comments."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    found = re.search(rf"\b({'|'.join(WRITING)})\b", bare, re.I)
    return found[1].upper() if found else None


def capped(rows: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """At most `cap` rows, and whether there were more."""
    some = rows.limit(cap + 1).persist()
    return some.limit(cap), some.count() > cap


def canonical_lines(rows: DataFrame) -> DataFrame:
    """(line): each row as JSON, in the order of the lines."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("line")).orderBy("line")


def classes_of_kind(*kinds: str) -> list[str]:
    return [c for k in kinds for c in classes_where(kind=k)]
