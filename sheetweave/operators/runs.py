"""Analytics over answer rows: summaries, tiers, joins of runs, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import linear_rank, nearest_rank, wilson

OUTCOMES = ("ANSWERED", "TIMED_OUT", "PROVIDER_ERROR")


def summarise(rows: DataFrame, by: list[str], cutoff: float) -> DataFrame:
    """Counts, accuracy within a latency limit, cost and latency of each group."""
    good = F.col("correct") & (F.col("latency") <= cutoff)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_correct"), F.count_if(F.col("outcome") == "TIMED_OUT").alias("n_timed_out"),
        F.sum("cost").alias("cost"), F.median("latency").alias("latency_median"), nearest_rank("latency", 0.9).alias("latency_p90"),
        linear_rank("latency", 0.95).alias("latency_p95"), F.max("latency").alias("latency_max"),
    )


def outcome_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """A column for each outcome, zero where none."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES))


def accuracy_cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, correct, low, high) with Wilson intervals."""
    cells = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    low, high = wilson("correct", "total")
    return cells.withColumn("low", low).withColumn("high", high)


def walk_tiers(rows: DataFrame, key: list[str], position: str, accepted: Column, answered: Column) -> DataFrame:
    """(key, tier, fell_back, n_tried, cost, latency): the first accepted tier answers; without one the first answered tier
    does; what was tried up to there is paid for."""
    marked = rows.withColumn("_ok", accepted).withColumn("_answered", answered)
    stop = marked.groupBy(*key).agg(F.min(F.when(F.col("_ok"), F.col(position))).alias("stop"), F.min(F.when(F.col("_answered"), F.col(position))).alias("fallback"), F.max(position).alias("last"))
    tried = marked.join(stop, key).where(F.col(position) <= F.coalesce("stop", "last"))
    return tried.groupBy(*key).agg(F.first(F.coalesce("stop", "fallback")).alias("tier"), F.first(F.col("stop").isNull()).alias("fell_back"), F.count("*").alias("n_tried"), F.sum("cost").alias("cost"), F.sum("latency").alias("latency"))


def compatible(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, problem) of questions that only one of two runs has, or that one has twice."""
    ca, cb = a.groupBy(*key).agg(F.count("*").alias("na")), b.groupBy(*key).agg(F.count("*").alias("nb"))
    both = ca.join(cb, key, "full")
    problem = F.when(F.col("na").isNull(), "missing in first").when(F.col("nb").isNull(), "missing in second").when((F.col("na") > 1) | (F.col("nb") > 1), "repeated")
    return both.withColumn("problem", problem).where("problem is not null").select(*key, "problem")


def pending(strategies: DataFrame, questions: DataFrame, repeats: int, done: DataFrame) -> DataFrame:
    """(strategy, question, repeat) still to be answered: every combination less the rows there are."""
    known = strategies.select("strategy").distinct()
    work = questions.join(known)  # what is asked for: every question of every strategy
    work = work.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return work.join(done.select("strategy", "question", "repeat").distinct(), ["strategy", "question", "repeat"], "left_anti").select("strategy", "question", "repeat")


def signals(rows: DataFrame, runaway_s: float) -> DataFrame:
    """Rows with what their `trace` (JSON) tells without the gold answer: n_rows and truncated of the retrieval, null where
    none was recorded, whether the answer ran away, and the cost with that of abandoned calls."""
    trace = lambda path: F.get_json_object("trace", path)
    lost = F.coalesce(trace("$.abandoned_usd").cast("double"), F.lit(0.0))
    return rows.withColumns({"n_rows": trace("$.retrieval.n_rows").cast("int"), "truncated": trace("$.retrieval.truncated").cast("boolean"), "runaway": F.col("latency") > runaway_s, "cost": F.col("cost") + lost})


def self_checks(rows: DataFrame, key: list[str], by: list[str], spread: float) -> DataFrame:
    """(check_name, violations) of what must hold in a run's rows."""
    none = F.col("cost").isNull()
    row = rows.agg(F.count_if(F.col("latency") < 0).alias("a"), F.count_if(F.col("correct") & (F.col("outcome") != "ANSWERED")).alias("b"), F.count_if((F.col("outcome") == "ANSWERED") & none).alias("c"))
    named = (("M1 negative latency", "a"), ("M2 right but not answered", "b"), ("M3 answered without cost", "c"))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(c).alias("violations")) for n, c in named))).alias("x")).select("x.*")
    wide = rows.groupBy(*by).agg(F.max("latency").alias("m"), F.median("latency").alias("d")).where(F.col("m") > spread * F.col("d"))
    again = rows.groupBy(*key).count().where("count > 1")
    one = lambda name, found: found.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))
    return out.unionByName(one(f"M4 spread over {spread}", wide)).unionByName(one("M5 repeated row", again))


def random_escalation(questions: DataFrame, key: str, kept: str, sent: str, n: int, n_draws: int) -> DataFrame:
    """(n_draws, mean, low, high) of the sum over questions if n of them, drawn by arithmetic of `key` and the draw, gave
    `sent` and the others `kept`. A draw is one window of its own."""
    draws = questions.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_draws - 1).cast("long"))))
    place = F.row_number().over(Window.partitionBy("draw").orderBy((F.col(key) * 7919 + F.col("draw") * 104729) % 1000003, key))
    sums = draws.withColumn("r", place).groupBy("draw").agg(F.sum(F.when(F.col("r") <= n, F.col(sent)).otherwise(F.col(kept))).alias("s"))
    return sums.agg(F.count("*").alias("n_draws"), F.avg("s").alias("mean"), linear_rank("s", 0.025).alias("low"), linear_rank("s", 0.975).alias("high"))


def grouping_sets(rows: DataFrame, base: list[str], dimensions: dict[str, Column]) -> DataFrame:
    """(base, dimension, grp, n, accuracy, cost, latency_p90): every measure overall and by each dimension, null groups left out."""
    entries = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("grp")), *(F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("grp")) for n, c in dimensions.items()))
    spread = rows.withColumn("_g", F.explode(entries)).select("*", "_g.dimension", "_g.grp").where("grp is not null")
    return spread.groupBy(*base, "dimension", "grp").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("cost").alias("cost"), nearest_rank("latency", 0.9).alias("latency_p90"))


def growth(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each group's values in order with their ratio to the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(value).over(w)
    return rows.withColumn("ratio", F.try_divide(F.col(value), before))


def best(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in an order that leaves no ties."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def thresholds(pairs: DataFrame, score: str, gold: str) -> DataFrame:
    """(threshold, tp, fp, fn, f1) at every observed score over 0, scores from 0 to 1.

    Sums run from the highest score down: within a thousandth by a window of its own, over the thousandths by one of a
    thousand rows.
    """
    at = pairs.where(F.col(score) > 0).groupBy(F.round(score, 12).alias("threshold")).agg(F.count_if(gold).alias("t"), F.count_if(~F.col(gold)).alias("f"))
    at = at.withColumn("part", F.floor(F.col("threshold") * 1000).cast("int"))
    above = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy("part").agg(F.sum("t").alias("pt"), F.sum("f").alias("pf"))
    parts = parts.select("part", F.coalesce(F.sum("pt").over(above), F.lit(0)).alias("at"), F.coalesce(F.sum("pf").over(above), F.lit(0)).alias("af"))
    inside = Window.partitionBy("part").orderBy(F.col("threshold").desc())
    total = pairs.agg(F.count_if(gold).alias("all"))  # one row
    run = at.withColumn("it", F.sum("t").over(inside)).withColumn("if", F.sum("f").over(inside)).join(parts, "part").join(F.broadcast(total))
    tp, fp = F.col("it") + F.col("at"), F.col("if") + F.col("af")
    run = run.select("threshold", tp.alias("tp"), fp.alias("fp"), (F.col("all") - tp).alias("fn"))
    return run.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
