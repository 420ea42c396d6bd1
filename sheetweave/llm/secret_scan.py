"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only. Base kinds are found by pattern, as documented by BASE. Any other run of key-like
characters, and what base spans leave of one, is scored by two first-order character models, one of random strings and
one of ordinary text and identifiers; where the mean log-likelihood ratio per character is over a threshold the run is
a span of kind `random`. Models and threshold are trained from labelled samples: strings drawn by rule (digests in
hexadecimal and base64, and in letters alone) and the values the base patterns found are random; numbers and lines of
signs drawn by rule, the corpus's own words, identifiers joined from these and from common words are ordinary. The corpus part is a sample
of SAMPLE_ROWS documents expected, chosen by hash. One half of the strings gives the models, the other half the
threshold.

Defined results: null text is empty and has no spans; rows of one id are scanned one by one; positions are code
points, ends exclusive; other columns are ignored; an empty table gives no rows, as models then learn from the strings
drawn by rule alone.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

# The base patterns. kind -> (pattern, group that counts, least characters of it)
BASE = {
    "assign": (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"()(AKIA[A-Z0-9]+)", 2, 20),
    "hex": (r"()([0-9a-f]{24,})", 2, 24),
}
KINDS = [*BASE, "random"]
#: Least characters of a key-like run that the models judge, the runs, and the characters the models know.
LEAST = 20
RUN = r"()((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,})" % LEAST
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents expected in the training sample, and rows of rule-made strings.
SAMPLE_ROWS, RULE_ROWS = 2_000, 2_000
#: The threshold lies halfway between the ratio that this part of ordinary strings held out exceeds and the ratio that
#: this part of random ones falls short of, and not under the first.
FALSE_ALARMS, MISSES = 0.001, 0.01
#: Pseudo-counts of a character's followers in all; matches whose places are added up together.
PRIOR, BLOCK = 50, 128
# Words that identifiers are joined from.
PARTS = "user name file path data list item count index value node type key map get set add new old max min size time date start end config option handler request response server client table column row query result error message event state update delete create build test main init load store cache buffer stream reader writer parser token format string number".split()


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind number, end) of the pattern's leftmost non-overlapping matches whose group has `least`
    characters; the pattern consists of groups 1 and 2. Texts without a match pay for one search only."""
    lead, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    leads, values = F.transform(lead, lambda g: F.char_length(g)), F.transform(value, lambda g: F.char_length(g))
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("gap"), leads.alias("lead"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,size:int>>")

    def place(s, x):
        end = s["at"] + x["gap"] + x["lead"] + x["value"]
        one = F.struct((s["at"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["value"].alias("size"))
        return F.struct(end.alias("at"), F.concat(s["found"], F.array(one)).alias("found"))

    def block(s, b):
        """BLOCK matches more: a list is copied for each match added, so lists are kept short."""
        done = F.aggregate(F.slice(steps, b * BLOCK + 1, BLOCK), F.struct(s["at"].alias("at"), empty.alias("found")), place)
        return F.struct(done["at"].alias("at"), F.concat(s["lists"], F.array(done["found"])).alias("lists"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    walk = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,end:int,size:int>>>").alias("lists")), block)
    kept = F.filter(F.flatten(walk["lists"]), lambda x: x["size"] >= least)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.transform(kept, lambda x: F.struct(x["start"], x["kind"], x["end"]))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


@dataclass
class Models:
    """`ratio`: log2 P(next | character) of random strings over ordinary ones, row by row of ALPHABET, row 0 is the
    start; `threshold`: the mean over a run from which it is random; `recall`: the part of random strings held out, of
    LEAST characters, that lie over it."""

    ratio: list[float]
    threshold: float
    recall: float


def labelled(documents: DataFrame) -> DataFrame:
    """(s, random 0 or 1, half 0 or 1): each string once a class, whatever the corpus repeats."""
    spark = documents.sparkSession
    total = documents.count()
    picked = documents.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) < (SAMPLE_ROWS << 40) // max(total, SAMPLE_ROWS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    secret = F.concat(*(F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda s, n=n: F.char_length(s) >= n) for p, g, n in BASE.values()))
    words = F.filter(F.regexp_extract_all(F.regexp_replace(text, BASE["assign"][0], " "), F.lit(r"[A-Za-z][A-Za-z_-]{3,}"), F.lit(0)), lambda s: ~F.regexp_like(s, F.lit("^[A-Z]+$")))
    numbers = spark.range(RULE_ROWS)
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id")), 256)
    b64 = F.base64(F.unhex(digest))
    bare = F.regexp_replace(b64, "[+/=]", "")
    made = numbers.select(F.explode(F.array(F.substring(digest, 1, 40), b64, bare, F.upper(bare), F.lower(bare), F.regexp_replace(bare, "[0-9]", ""))).alias("s"), F.lit(1).alias("random"))
    word = lambda c: F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(c, F.lit(len(PARTS))) + 1).cast("int"))
    a, b, n = word(F.col("id")), word(F.floor(F.col("id") / len(PARTS))), F.pmod(F.col("id"), F.lit(100)).cast("string")
    digits = F.regexp_replace(F.sha2(F.concat(F.lit("number "), F.col("id")), 512), "[a-f]", "")
    # lines drawn with signs, as between sections
    rule = F.repeat(F.substring(F.lit("=-_+/"), F.pmod(F.col("id"), F.lit(5)).cast("int") + 1, 1), (F.pmod(F.col("id"), F.lit(80)) + 4).cast("int"))
    named = numbers.select(F.explode(F.array(F.concat_ws("_", a, b, n), F.concat(a, F.initcap(b), n), F.concat_ws("-", b, a), F.upper(F.concat_ws("_", a, b)), F.substring(digits, 1, 20), rule)).alias("s"), F.lit(0).alias("random"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))
    beside = picked.select(words.alias("w")).where("size(w) > 1").select(F.explode(pairs).alias("x")).select("x.*")
    joined = beside.select(F.explode(F.array(F.concat_ws("_", F.lower("a"), F.lower("b")), F.concat(F.lower("a"), F.initcap("b")), F.concat_ws("-", "a", "b"), F.upper(F.concat_ws("_", "a", "b")))).alias("s"), F.lit(0).alias("random"))
    ordinary = picked.select(F.explode(words).alias("s"), F.lit(0).alias("random"))
    sample = made.unionAll(named).unionAll(joined).unionAll(picked.select(F.explode(secret).alias("s"), F.lit(1).alias("random"))).unionAll(ordinary)
    return sample.distinct().withColumn("half", F.pmod(F.xxhash64("s"), F.lit(2)))


def train(documents: DataFrame) -> Models:
    """The models from one half of the labelled strings, the threshold from the other.

    Counts are of character pairs, smoothed by PRIOR pseudo-counts; at most twice 68 * 67 sums reach the driver.
    """
    sample = stash(labelled(documents), "secret-sample")
    codes = F.expr(f"transform(split(s, ''), c -> instr('{ALPHABET}', c))")
    pairs = sample.where("half = 0").select("random", codes.alias("c")).select("random", F.explode(F.expr("transform(sequence(1, size(c)), i -> struct(if(i = 1, 0, c[i - 2]) AS a, c[i - 1] AS b))")).alias("x"))
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", "x.a", "x.b").agg(F.count("*").alias("n")).collect()}
    size = len(ALPHABET) + 1
    ratio = []
    for a in range(size):
        of = [[counts.get((k, a, b), 0) for b in range(1, size)] for k in (0, 1)]
        both = [(x + y + 1) / (sum(of[0]) + sum(of[1]) + size - 1) for x, y in zip(*of, strict=True)]
        # what a class has not seen enough of leans to both classes together, and then says nothing
        chance = [[(x + PRIOR * p) / (sum(of[k]) + PRIOR) for x, p in zip(of[k], both, strict=True)] for k in (0, 1)]
        ratio += [0.0, *(math.log2(y / x) for x, y in zip(*chance, strict=True))]
    held = sample.where((F.col("half") == 1) & (F.char_length("s") >= LEAST)).select("random", mean_ratio(F.col("s"), ratio).alias("r"))
    low = held.where("random = 0").agg(F.percentile("r", F.lit(1 - FALSE_ALARMS)).alias("t")).first()["t"] or 0.0
    high = held.where("random = 1").agg(F.percentile("r", F.lit(MISSES)).alias("t")).first()["t"] or 0.0
    limit = max(low, (low + high) / 2)
    recall = held.where("random = 1").agg(F.avg((F.col("r") > F.lit(limit)).cast("int")).alias("x")).first()["x"] or 0.0
    discard(sample)
    return Models(ratio, float(limit), float(recall))


def mean_ratio(run: Column, ratio: list[float]) -> Column:
    """The log-likelihood ratio of a run, per character."""
    table, size = F.from_json(F.lit(json.dumps(ratio)), "array<double>"), len(ALPHABET) + 1
    codes = F.transform(F.split(run, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    walked = F.aggregate(codes, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.get(table, s["last"] * size + c)).alias("sum")))
    return walked["sum"] / F.char_length(run)


def outside(run: Column, base: Column) -> Column:
    """What sorted base spans leave of a run: its parts of LEAST characters or more between them."""
    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    part = lambda a, e: F.struct(a.alias("start"), run["kind"].alias("kind"), e.alias("end"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def cut(s, b):
        more = F.when(b["start"] - s["at"] >= LEAST, F.concat(s["parts"], F.array(part(s["at"], b["start"])))).otherwise(s["parts"])
        return F.struct(F.greatest(s["at"], b["end"]).alias("at"), more.alias("parts"))

    cuts = F.aggregate(touching, F.struct(run["start"].alias("at"), none.alias("parts")), cut)
    return F.when(run["end"] - cuts["at"] >= LEAST, F.concat(cuts["parts"], F.array(part(cuts["at"], run["end"])))).otherwise(cuts["parts"])


def scan(documents: DataFrame, models: Models | None = None) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end>>, base) of every document: base spans, and random ones that overlap none."""
    models = models or train(documents)
    text = F.col("text")
    found = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = found.withColumns({kind: spans_of(text, kind, *rule) for kind, rule in BASE.items()})
    found = found.withColumn("base", F.array_sort(F.concat(*map(F.col, BASE))))
    found = found.withColumn("run", spans_of(text, "random", RUN, 2, LEAST))
    found = found.withColumn("run", F.flatten(F.transform("run", lambda r: outside(r, F.col("base")))))
    random = F.filter("run", lambda r: mean_ratio(F.substring(text, r["start"] + 1, r["end"] - r["start"]), models.ratio) > models.threshold)
    found = found.withColumn("random", random).drop("text", "run")
    return found.withColumn("spans", F.array_sort(F.concat("base", "random")))


def spell(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

