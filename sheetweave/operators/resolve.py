"""From sheets to one plant: connector pairing, identity grouping, contraction, merge, item graph."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import digits_key
from ..lineage import stash

# Reasons why a connector stays unresolved.
ABSENT, NO_LABEL = "referenced drawing not in corpus", "no reference label"
AMBIGUOUS = "ambiguous: %d outgoing, %d incoming share this label"
SHARED = ["line_number", "fluid_code", "loop_tag", "kind", "relation", "connector_number", "sheet_pair"]


def pair_connectors(labels: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(from_key, to_key, rule) pairs and (key, reason) of what stays unresolved.

    `labels`: key, sheet, direction (outgoing/incoming), connector_number, ref_sheet, ref_number and the shared label
    columns line_number, fluid_code, loop_tag, kind, relation. Labels to absent sheets are dropped first; then
    numbers that refer to each other pair, where unique among incoming ones; the rest pairs where exactly one outgoing
    and one incoming label agree in all seven shared columns, nulls included.
    """
    here = sheets.select(F.col("sheet").alias("ref_sheet")).distinct()
    gone = labels.join(here, "ref_sheet", "left_anti").select("key", F.when(F.col("ref_sheet").isNull(), NO_LABEL).otherwise(ABSENT).alias("reason"))
    left = stash(labels.join(here, "ref_sheet", "left_semi"), "labels")
    out = left.where("direction = 'outgoing'")
    numbered = left.where("direction = 'incoming' and ref_number is not null")
    numbered = numbered.withColumn("n", F.count("*").over(Window.partitionBy("sheet", "connector_number")))
    inn = numbered.where("n = 1").select(F.col("key").alias("to_key"), F.col("sheet").alias("in_sheet"), F.col("connector_number").alias("in_number"), F.col("ref_sheet").alias("back_sheet"), F.col("ref_number").alias("back_number"))
    by_number = out.join(inn, (out.ref_sheet == inn.in_sheet) & (out.ref_number == inn.in_number) & (out.sheet == inn.back_sheet) & (out.connector_number == inn.back_number))
    by_number = stash(by_number.select(F.col("key").alias("from_key"), "to_key", F.lit("connector_number").alias("rule")), "pairs")
    used = by_number.select(F.col("from_key").alias("key")).unionByName(by_number.select(F.col("to_key").alias("key")))
    rest = left.join(used, "key", "left_anti").withColumn("sheet_pair", F.concat_ws("|", F.least("sheet", "ref_sheet"), F.greatest("sheet", "ref_sheet")))
    is_out = F.col("direction") == "outgoing"
    groups = rest.groupBy(*SHARED).agg(F.count_if(is_out).alias("n_out"), F.count_if(~is_out).alias("n_in"), F.max(F.when(is_out, F.col("key"))).alias("from_key"), F.max(F.when(~is_out, F.col("key"))).alias("to_key"))
    groups = stash(groups, "label-groups")
    by_label = groups.where("n_out = 1 and n_in = 1").select("from_key", "to_key", F.lit("shared_label").alias("rule"))
    same = None
    for c in SHARED:
        test = F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}"))
        same = test if same is None else same & test
    open_ = rest.alias("r").join(groups.where("not (n_out = 1 and n_in = 1)").alias("g"), same).select(F.col("r.key").alias("key"), F.format_string(AMBIGUOUS, "n_out", "n_in").alias("reason"))
    return by_number.unionByName(by_label), gone.unionByName(open_)


def group_identities(drawings: DataFrame) -> DataFrame:
    """(tag, node_class, home, references, n_sheets) of equipment drawn on several sheets.

    `drawings`: key, sheet, tag, node_class, n_properties. A (tag, class) twice on one sheet is ambiguous and left out
    everywhere; the home is the drawing with most properties, then the lowest sheet.
    """
    tagged = drawings.where("tag is not null and tag <> ''")
    once = tagged.groupBy("tag", "node_class").agg(F.count("*").alias("n"), F.count_distinct("sheet").alias("n_sheets"), F.min_by("key", F.struct(-F.col("n_properties"), F.col("sheet"))).alias("home"), F.array_sort(F.collect_list("key")).alias("keys"))
    good = once.where("n = n_sheets and n_sheets >= 2")
    return good.select("tag", "node_class", "home", F.filter("keys", lambda x: x != F.col("home")).alias("references"), "n_sheets")


def ambiguous_identities(drawings: DataFrame) -> DataFrame:
    """(tag, node_class) that stand twice on a sheet."""
    return drawings.where("tag is not null and tag <> ''").groupBy("tag", "node_class", "sheet").count().where("count > 1").select("tag", "node_class").distinct()


def cut_edges(edges: DataFrame, home: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between sheets replaced by pairs of stubs: (edges on sheets, stubs, pairs).

    `home` is (node, sheet). A cut edge a>b becomes a>out on a's sheet and in>b on b's; stubs are numbered per
    sheet in the order of (src, dst, relation).
    """
    at = stash(edges.join(home.select(F.col("node").alias("src"), F.col("sheet").alias("src_sheet")), "src").join(home.select(F.col("node").alias("dst"), F.col("sheet").alias("dst_sheet")), "dst"), "placed-edges")
    kept = at.where("src_sheet = dst_sheet").select(F.col("src_sheet").alias("sheet"), "src", "dst", "relation")
    order = ["src", "dst", "relation"]
    cut = at.where("src_sheet <> dst_sheet").withColumn("out_no", F.row_number().over(Window.partitionBy("src_sheet").orderBy(*order))).withColumn("in_no", F.row_number().over(Window.partitionBy("dst_sheet").orderBy(*order)))
    cut = stash(cut.withColumn("out_stub", F.concat_ws("", "src_sheet", F.lit(":out"), "out_no")).withColumn("in_stub", F.concat_ws("", "dst_sheet", F.lit(":in"), "in_no")), "cut-edges")
    on_sheets = kept.unionByName(cut.select(F.col("src_sheet").alias("sheet"), "src", F.col("out_stub").alias("dst"), "relation")).unionByName(cut.select(F.col("dst_sheet").alias("sheet"), F.col("in_stub").alias("src"), "dst", "relation"))
    stubs = cut.select(F.col("out_stub").alias("key"), F.col("src_sheet").alias("sheet"), F.lit("outgoing").alias("direction")).unionByName(cut.select(F.col("in_stub").alias("key"), F.col("dst_sheet").alias("sheet"), F.lit("incoming").alias("direction")))
    return on_sheets, stubs, cut.select(F.col("out_stub").alias("from_key"), F.col("in_stub").alias("to_key"), "relation")


def contract(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, relation, via): paired stubs replaced by edges between what they join, however many stubs in a row.

    Per (src, dst, relation) the edge over fewest stubs stays, then the smallest via. Stubs in a ring are an error.
    """
    edges, pairs = stash(edges.select("src", "dst", "relation"), "contract-edges"), stash(pairs.select("from_key", "to_key"), "contract-pairs")
    ins = pairs.select(F.col("to_key").alias("src"))
    none = F.array().cast("array<string>")
    start = edges.join(ins, "src", "left_anti").select("src", "dst", "relation", none.alias("via"))
    # where an edge into a stub comes out, and by which stubs; steps are joined to steps, twice as far each time
    steps = stash(pairs.join(edges.select(F.col("src").alias("to_key"), F.col("dst").alias("next")), "to_key").select(F.col("from_key").alias("stub"), "next", F.array("from_key", "to_key").alias("hops")), "stub-steps")
    lost = pairs.join(steps.select(F.col("stub").alias("from_key")), "from_key", "left_anti").select(F.col("from_key").alias("dst"))
    total, rounds = steps.count(), 0
    while True:
        onward = steps.select(F.col("stub").alias("s"), F.col("next").alias("n"), F.col("hops").alias("h"))
        joined = steps.join(onward, steps.next == onward.s, "left")
        moved = stash(joined.select("stub", F.coalesce("n", "next").alias("next"), F.concat("hops", F.coalesce("h", none)).alias("hops"), F.col("n").isNotNull().alias("moved")), "stub-steps")
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
        rounds += 1
        if 1 << rounds > 2 * total + 2:
            raise ValueError("stubs form a ring")
    direct = start.join(pairs.select(F.col("from_key").alias("dst")), "dst", "left_anti").select("src", "dst", "relation", "via")
    crossing = start.join(steps, start.dst == steps.stub).select("src", F.col("next").alias("dst"), "relation", F.col("hops").alias("via"))
    done = direct.unionByName(crossing.join(lost, "dst", "left_anti"))
    best = Window.partitionBy("src", "dst", "relation").orderBy(F.size("via"), "via")
    return done.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def merge_edges(edges: DataFrame, homes: DataFrame, reconnected: DataFrame) -> tuple[DataFrame, Column]:
    """Edges of all sheets with references replaced by homes; the first writer of a (src, dst) wins.

    `edges` has sheet, src, dst, relation; sheets write in the order of their names, reconnected edges after them.
    Returns (src, dst, relation, n_relations): more than one relation is a conflict.
    """
    phase = edges.select(F.lit(0).alias("phase"), F.col("sheet").alias("order"), "src", "dst", "relation").unionByName(reconnected.select(F.lit(1).alias("phase"), F.concat_ws("|", F.array_join("via", ",")).alias("order"), "src", "dst", "relation"))
    home = homes.select("node", "home")
    src = home.select(F.col("node").alias("src"), F.col("home").alias("hs"))
    dst = home.select(F.col("node").alias("dst"), F.col("home").alias("hd"))
    moved = phase.join(src, "src", "left").join(dst, "dst", "left").select("phase", "order", F.coalesce("hs", "src").alias("src"), F.coalesce("hd", "dst").alias("dst"), "relation")
    first = F.min_by("relation", F.struct("phase", "order", "relation"))
    return moved.groupBy("src", "dst").agg(first.alias("relation"), F.count_distinct("relation").alias("n_relations"))


def item_graph(drawings: DataFrame, homes: DataFrame, classes: DataFrame) -> DataFrame:
    """(item, node_class, tag, unit, labels, sheets, keys): a row for each item from all its drawings.

    `drawings`: key, sheet, node_class, tag, unit; `homes`: node (a key), home (a key).
    """
    placed = drawings.join(homes.select(F.col("node").alias("key"), "home"), "key", "left").withColumn("item", F.coalesce("home", "key"))
    own = F.struct((F.col("key") != F.col("item")).alias("other"), F.col("key"))
    grouped = placed.groupBy("item").agg(
        F.min_by("node_class", own).alias("node_class"), F.min_by("tag", own).alias("tag"), F.min_by("unit", F.when(F.col("unit").isNotNull(), own)).alias("unit"),
        F.array_sort(F.collect_set("sheet")).alias("sheets"), F.array_sort(F.collect_list("key")).alias("keys"),
    )
    return grouped.join(F.broadcast(classes.select("node_class", "labels")), "node_class", "left").select("item", "node_class", "tag", "unit", "labels", "sheets", "keys")


def localize(sheets: DataFrame, salt: str) -> DataFrame:
    """(local_key, sheet, node): opaque ids, the first 12 hexadecimal digits of sha1(salt, sheet, ':', node)."""
    local = F.substring(F.sha1(F.concat(F.lit(salt), F.col("sheet"), F.lit(":"), F.col("node")).cast("binary")), 1, 12)
    return sheets.select(F.concat_ws(":", "sheet", local).alias("local_key"), "sheet", "node")


def differences(actual: DataFrame, expected: DataFrame, key: list[str], values: list[str], limit: int | None = None) -> DataFrame:
    """(key, difference): missing, unexpected and mismatched rows of two keyed tables."""
    a = actual.select(*key, F.struct(*values).alias("_a"), F.lit(True).alias("_in_a"))
    e = expected.select(*key, F.struct(*values).alias("_e"), F.lit(True).alias("_in_e"))
    kind = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_e").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_e")), "mismatch")
    found = a.join(e, key, "full").withColumn("difference", kind).where("difference is not null").select(*key, "difference")
    return found.orderBy(*key).limit(limit) if limit else found


def block_candidates(drawings: DataFrame) -> DataFrame:
    """(a, b) keys of drawings that may be one item: same class and digits, other sheets, not the same tag.

    The block is (class, digits); its pairs are made by an equi-join, of which AQE splits large blocks.
    """
    d = drawings.where("tag is not null").select("key", "sheet", "node_class", "tag", digits_key("tag").alias("digits")).where("digits <> ''")
    b = d.select(F.col("key").alias("b"), F.col("sheet").alias("sheet_b"), "node_class", F.col("tag").alias("tag_b"), "digits")
    return d.withColumnRenamed("key", "a").join(b, ["node_class", "digits"]).where("a < b and sheet <> sheet_b and tag <> tag_b").select("a", "b", "tag", "tag_b")


def similarity(first: str | None, second: str | None) -> float:
    """Twice the matching characters over all, by longest matching blocks."""
    return difflib.SequenceMatcher(None, first or "", second or "", autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def string_similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    """similarity() of columns."""
    return pd.Series([similarity(a, b) for a, b in zip(first, second, strict=True)])


def one_to_one(links: DataFrame) -> DataFrame:
    """Links (a, b, sheet_a, sheet_b, score) chosen greedily by falling score, then keys: a drawing links to one
    drawing of each other sheet at most.

    A link takes two slots: each of its drawings with the other's sheet, whichever end of the link the drawing is. In each
    round the links that come first in both their slots are chosen and what conflicts with them goes; this is the greedy
    choice for a strict order, in as many rounds as the longest chain of conflicts.
    """
    left = stash(links.select("a", "b", "sheet_a", "sheet_b", "score"), "links")
    slots = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("sheet_b").alias("other")), F.struct(F.col("b").alias("own"), F.col("sheet_a").alias("other"))))
    chosen = None
    while True:
        taken = left.select("a", "b", "score", slots.alias("slot")).select("a", "b", "score", "slot.own", "slot.other")
        first = taken.withColumn("r", F.row_number().over(Window.partitionBy("own", "other").orderBy(F.col("score").desc(), "a", "b"))).where("r = 1")
        both = first.groupBy("a", "b").count().where("count = 2").select("a", "b")
        now = stash(left.join(both, ["a", "b"], "left_semi"), "chosen")
        chosen = now if chosen is None else chosen.unionByName(now)
        full = now.select(slots.alias("slot")).select("slot.own", "slot.other")
        left = left.join(full.toDF("a", "sheet_b"), ["a", "sheet_b"], "left_anti").join(full.toDF("b", "sheet_a"), ["b", "sheet_a"], "left_anti").select(left.columns)
        left = stash(left, "links")
        if left.isEmpty():
            return chosen.select("a", "b", "sheet_a", "sheet_b", "score")


def sheet_routes(pairs: DataFrame) -> DataFrame:
    """(sheet_a, sheet_b, pairs): which sheets continue on each other, and by which stub pairs."""
    ends = pairs.select(F.substring_index("from_key", ":", 1).alias("x"), F.substring_index("to_key", ":", 1).alias("y"), F.concat_ws("~", "from_key", "to_key").alias("pair")).where("x <> y")
    return ends.groupBy(F.least("x", "y").alias("sheet_a"), F.greatest("x", "y").alias("sheet_b")).agg(F.array_sort(F.collect_list("pair")).alias("pairs"))


def prf(tp, fp, fn) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; null where nothing is divided by."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return p, r, F.try_divide(2 * tp, 2 * tp + fp + fn)
