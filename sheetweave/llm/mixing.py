"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is its source's rate (target over size) times an odds weight of its own, at
most MOST, scaled so that the expected words of the source are its target. The whole part of it is certain: so many
copies are allocated first. The rest is an inclusion chance, unequal within a source; documents are ranked by their
random odds u / (1 - u) divided by their inclusion odds p / (1 - p), and the best ranks are taken once more. The size
of the sample is fixed: the expected words of the chances are what the certain copies leave open, and ranks are taken
until their words come nearest to that (`unit` "words"), or as many documents as the chances sum to (`unit` "rows").

Defined results: a null text has size 0; null sources are one source, after all others; documents of one id but
other text are drawn apart, equal rows are interchangeable and told apart by a number; ties of ranks go by that number;
columns other than doc_id, text and source play no part and may have any name; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_lookup, number_rows, own_columns, stash, with_rank

#: Weights of the sources in code point order, repeating; most copies of a document; ranks are counted in so many
#: classes, and those of the class that holds the cut in so many again.
WEIGHTS, MOST, CLASSES = (5, 2, 1), 3, 4096
#: Odds weights are powers of two to the eighth part.
STEPS = 8


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): weights shared over all words, no target above most times its source.

    Excess is reshared by weight until no target is above; each round is one sum over sources.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_rank(table, [F.col("source").asc_nulls_last()], "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sources = stash(ranked.withColumn("weight", weight.cast("double")).drop("rank"), "mix-weights")
    cap = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        free, held, n = sources.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, cap)), F.count(F.when(over, 1))).first()
        if n == capped or not free:
            break
        level, capped = (total - (held or 0.0)) / free, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap)).select("source", "source_size", "target")


def length_odds(size: Column) -> Column:
    """The odds weight by default: it grows by one where the words double, so that longer documents are likelier."""
    return F.log2(size + 2)


def _drawn(documents: DataFrame, seed: int, odds_weight: str | None) -> DataFrame:
    """(own, row, doc_id, text_key, source, size, u, step) of numbered documents: size in words, u from 0 to 1 by hash,
    step of the odds weight."""
    own = lambda c: F.col("own").getField(c)
    size = F.regexp_count(F.coalesce(own("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), own("doc_id"), own("text")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    named = documents.select("own", "row", own("doc_id").alias("doc_id"), F.xxhash64(F.lit(seed + 1), own("text")).alias("text_key"), own("source").cast("string").alias("source"), size.alias("size"), unit.alias("u"))
    weight = own(odds_weight).cast("double") if odds_weight else length_odds(F.col("size"))
    return named.withColumn("step", F.coalesce(F.round(F.log2(weight) * STEPS), F.lit(0)).cast("int"))


def _scales(docs: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(s, source_size, target, scale): expected copies are least(most, scale * odds weight), whose words sum to the target.

    The heaviest weights are at `most`; the scale is that of the longest prefix of weights that has to be.
    """
    weight = F.pow(F.lit(2.0), F.col("step") / STEPS)
    steps = docs.groupBy("source", "step").agg(F.sum("size").alias("words")).withColumn("w", weight)
    above = Window.partitionBy("source").orderBy(F.col("step").desc())  # some hundred steps a source at most
    steps = steps.withColumn("before", F.sum("words").over(above) - F.col("words")).withColumn("ww", F.col("w") * F.col("words"))
    steps = steps.withColumn("tail", F.sum("ww").over(above.rowsBetween(0, Window.unboundedFollowing)))
    known = targets.select(F.col("source").alias("s"), "source_size", "target")
    with_target = steps.join(known, steps.source.eqNullSafe(known.s))
    scale = F.when(F.col("tail") > 0, F.greatest((F.col("target") - F.lit(float(most)) * F.col("before")) / F.col("tail"), F.lit(0.0)))
    fits = F.col("scale") * F.col("w") <= F.lit(most * (1 + 1e-12))
    found = with_target.withColumn("scale", scale).groupBy("s", "source_size", "target").agg(F.max_by("scale", F.when(fits, F.col("step"))).alias("scale"))
    # a target of most times its source has all weights at most
    return found.withColumn("scale", F.coalesce("scale", F.lit(float("inf"))))


def _ranked(docs: DataFrame, table: DataFrame, n: int, most: int) -> DataFrame:
    """docs with their source's columns of `table`, `certain` copies, inclusion `chance` and `rank`."""
    joined = join_lookup(docs, table, docs.source.eqNullSafe(table.s), n).drop("s")
    expected = F.least(F.coalesce(F.col("scale") * F.pow(F.lit(2.0), F.col("step") / STEPS), F.lit(0.0)), F.lit(float(most)))
    joined = joined.withColumn("expected", expected).withColumn("certain", F.floor(F.col("expected") + 1e-12).cast("long"))
    chance = F.greatest(F.least(F.col("expected") - F.col("certain"), F.lit(1 - 1e-12)), F.lit(1e-12))
    joined = joined.withColumn("chance", chance)
    return joined.withColumn("rank", (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance"))))


def _cuts(docs: DataFrame, scales: DataFrame, n: int, most: int, unit: str) -> DataFrame:
    """`scales` with each source's last (rank, row) that is taken once more, null where none is."""
    measure = {"words": F.col("size"), "rows": F.lit(1).cast("long")}[unit]
    ranked = _ranked(docs, scales, n, most).withColumn("measure", measure)
    share = F.col("rank") / (1 + F.col("rank"))
    coarse = F.least(F.floor(share * CLASSES), F.lit(CLASSES - 1))
    fine = F.least(F.floor((share * CLASSES - F.col("class")) * CLASSES), F.lit(CLASSES - 1))
    ranked = ranked.withColumn("class", coarse.cast("int")).withColumn("fine", fine.cast("int"))
    wanted = {"words": F.first("target") - F.sum(F.col("certain") * F.col("size")), "rows": F.round(F.sum("chance"))}[unit]
    open_ = stash(ranked.groupBy(F.col("source").alias("s")).agg(wanted.cast("double").alias("open")), "mix-open")

    def edge(rows: DataFrame, by: str, limits: DataFrame, name: str) -> DataFrame:
        """(s, by, open): the class in which the sum passes what is open, and what of that is left for it."""
        counted = rows.groupBy("source", by).agg(F.sum("measure").alias("n"))
        up_to = Window.partitionBy("source").orderBy(by)  # at most CLASSES rows a source
        counted = counted.withColumn("before", F.sum("n").over(up_to) - F.col("n")).join(limits, F.col("source").eqNullSafe(limits.s))
        passed = counted.where("before <= open").groupBy("s").agg(F.max(by).alias(by), F.min_by(F.col("open") - F.col("before"), -F.col(by)).alias("open"))
        return stash(passed, name)

    def within(rows: DataFrame, at: DataFrame, by: str) -> DataFrame:
        at = at.withColumnRenamed(by, "at")
        return join_lookup(rows, at, rows.source.eqNullSafe(at.s) & (rows[by] == F.col("at")), n, "inner").drop("s", "at")

    first = edge(ranked, "class", open_.where("open > 0"), "mix-edges")
    inside = within(ranked, first, "class")
    second = edge(inside.drop("open"), "fine", first.select("s", "open"), "mix-fine-edges")
    # one class of CLASSES * CLASSES is left of each source; a rank is taken where the half of it lies below what is open
    few = within(inside.drop("open"), second, "fine")
    running = F.sum("measure").over(Window.partitionBy("source").orderBy("rank", "row").rowsBetween(Window.unboundedPreceding, 0))
    taken = few.withColumn("upto", running).where(2 * F.col("upto") - F.col("measure") <= 2 * F.col("open"))
    last = taken.groupBy(F.col("source").alias("t")).agg(F.max(F.struct("rank", "row")).alias("last"))
    edges = second.join(last, F.col("s").eqNullSafe(F.col("t")), "left").select(F.col("s").alias("t"), F.col("last.rank").alias("cut_rank"), F.col("last.row").alias("cut_row"), F.lit(True).alias("cut"))
    # where the class that holds the cut gives nothing, all classes before it are taken
    bounds = first.select(F.col("s").alias("e"), "class").join(second.select(F.col("s").alias("f"), "fine"), F.col("e").eqNullSafe(F.col("f"))).drop("f")
    edges = edges.join(bounds, F.col("t").eqNullSafe(F.col("e"))).drop("e")
    return stash(scales.join(edges, scales.s.eqNullSafe(F.col("t")), "left").drop("t"), "mix-cuts")


def _copies(docs: DataFrame, cuts: DataFrame, n: int, most: int) -> DataFrame:
    """docs with `copies`: certain ones, and one more up to the source's cut."""
    ranked = _ranked(docs, cuts, n, most)
    share = F.col("rank") / (1 + F.col("rank"))
    own = F.least(F.floor(share * CLASSES), F.lit(CLASSES - 1))
    fine = F.least(F.floor((share * CLASSES - own) * CLASSES), F.lit(CLASSES - 1))
    by_class = (own < F.col("class")) | ((own == F.col("class")) & (fine < F.col("fine")))
    by_rank = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("row") <= F.col("cut_row")))
    more = F.coalesce(F.col("cut"), F.lit(False)) & (by_class | F.coalesce(by_rank, F.lit(False)))
    return ranked.withColumn("copies", F.least(F.coalesce("certain", F.lit(0)) + more.cast("long"), F.lit(most)))


def _planned(numbered: DataFrame, seed: int, weights, most: int, odds_weight: str | None, unit: str) -> tuple[DataFrame, DataFrame, int]:
    """(drawn documents without their columns, written; the sources' cuts, written; how many sources)."""
    docs = stash(_drawn(numbered, seed, odds_weight).drop("own"), "mix-sizes")
    targets = stash(source_targets(docs, weights, most), "mix-targets")
    n = targets.count()
    scales = stash(_scales(docs, targets, most), "mix-scales")
    return docs, _cuts(docs, scales, n, most, unit), n


def pareto_mix(documents: DataFrame, seed: int = 17, weights=WEIGHTS, most: int = MOST, odds_weight: str | None = None, unit: str = "words") -> DataFrame:
    """(doc_id, text_key, size, source_size, target, expected, copies, taken) of every document.

    `odds_weight` names a positive column by which inclusion chances within a source differ; without it length_odds()
    does. A weight that is null or not positive counts as 1.
    """
    numbered = number_rows(documents.select("doc_id", "text", "source", *([odds_weight] if odds_weight else [])), "mix-numbered")
    docs, cuts, n = _planned(numbered, seed, weights, most, odds_weight, unit)
    return _copies(docs, cuts, n, most).select("doc_id", "text_key", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(documents: DataFrame, seed: int = 17, weights=WEIGHTS, most: int = MOST, odds_weight: str | None = None, unit: str = "words") -> DataFrame:
    """All columns of the documents, each row as often as the mix takes it.

    Sources' cuts are few numbers each; with them every task tells its own rows' copies, and no text is shuffled.
    """
    numbered = number_rows(documents, "mix-numbered")
    _, cuts, n = _planned(numbered, seed, weights, most, odds_weight, unit)
    counted = _copies(_drawn(numbered, seed, odds_weight), cuts, n, most).where("copies > 0").select("own", "copies")
    return own_columns(counted.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), documents.columns)
