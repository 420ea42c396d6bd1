"""Scalar functions over tags, units and answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_tag(c) -> Column:
    """Upper case, no blanks around, one space inside."""
    return F.regexp_replace(F.regexp_replace(F.upper(_col(c).cast("string")), r"^\s+|\s+$", ""), r"\s+", " ")


def fold_unit(c) -> Column:
    """As a tag, without UNIT or U before a digit."""
    return F.regexp_replace(fold_tag(c), r"^(?:UNIT|U)\s*(?=\d)", "")


def to_boolean(c) -> Column:
    """yes/true/1 and no/false/0 in any case; null else."""
    low = F.lower(F.trim(_col(c).cast("string")))
    return F.when(low.isin("yes", "true", "1"), True).when(low.isin("no", "false", "0"), False)


def to_count(c) -> Column:
    """A whole number as people write it, with a sign and underscores between digits; null else."""
    bare = F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", "")
    return F.when(F.regexp_like(bare, F.lit(r"^[+-]?\d+(_\d+)*$")), F.regexp_replace(bare, "_", "").try_cast("bigint"))


def digits_key(c) -> Column:
    """The digits 1 to 9 of a tag, zeros left out: what tags of one item share however they are padded."""
    return F.regexp_replace(_col(c), "[^1-9]", "")


def plain_tag(c) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.upper(_col(c)), "[^A-Z0-9]", "")


def class_plural(c) -> Column:
    """GlobeValve as `globe valves`."""
    return F.concat(F.lower(F.regexp_replace(_col(c), "(?<=[a-z])(?=[A-Z])", " ")), F.lit("s"))


def size_bytes(c) -> Column:
    """512m, 4.00GiB and the like as a number of bytes; null where it is none."""
    text = F.lower(F.trim(_col(c)))
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)\s*([kmgt]?)(?:i?b)?$", 1)
    unit = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)\s*([kmgt]?)(?:i?b)?$", 2)
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    return F.when(number != "", F.floor(number.cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))


def failure_kind(c) -> Column:
    """What kept a query from answering, by words of its message."""
    low = F.lower(_col(c))
    has = lambda *words: F.regexp_like(low, F.lit("|".join(words)))
    return F.when(has("write", "read-only", "read only"), "write").when(has("hung", "guard"), "hung").when(has("timeout", "timed out"), "timeout").when(has("memory", "heap"), "memory").when(has("syntax", "parse"), "syntax").otherwise("other")


def tag_parts(c) -> Column:
    """prefix, unit and number of a tag such as GV-07-0012; null where it is none."""
    pattern = r"^([A-Z]+)-(\d+)-(\d+)([A-Z]?)$"
    part = lambda i: F.regexp_extract(_col(c), pattern, i)
    return F.when(F.regexp_like(_col(c), F.lit(pattern)), F.struct(part(1).alias("prefix"), part(2).alias("unit"), part(3).cast("long").alias("number"), part(4).alias("train")))


def need_label(c, n_anchors) -> Column:
    """What a question needs, by the first rule that its words and its number of named items meet."""
    low = F.lower(_col(c))
    says = lambda pattern: F.regexp_like(low, F.lit(pattern))
    n = _col(n_anchors)
    return (
        F.when((n >= 2) & says(r"\b(route|path|from .* to)\b"), "PATH").when((n >= 2) & says(r"\b(connected|reach)\b"), "CONNECTED").when((n >= 1) & says(r"\b(isolat)"), "ISOLATION")
        .when((n >= 1) & says(r"\b(upstream|feeds?)\b"), "UPSTREAM_ALL").when((n >= 1) & says(r"\b(downstream|supplies)\b"), "DOWNSTREAM_ALL").when((n >= 1) & says(r"\b(loop|instrument|controller)"), "LOOP")
        .when(says(r"\bhow many\b"), "COUNT").when(says(r"\bunits?\b"), "UNIT").when(n >= 1, "ITEM").otherwise("NONE")
    )


def k_bin(k) -> Column:
    """Bins of crossing counts."""
    k = _col(k)
    return F.when(k.isNull(), "unanswerable").when(k < 3, k.cast("string")).when(k <= 4, "3-4").when(k <= 8, "5-8").when(k <= 16, "9-16").when(k <= 32, "17-32").otherwise("33+")


def score_sets(reference, answer) -> dict[str, Column]:
    """precision, recall, f1 and exact of two arrays of folded values; two empty sets agree fully."""
    ref, ans = (F.array_distinct(F.transform(_col(c), fold_tag)) for c in (reference, answer))
    hit, n_ref, n_ans = F.size(F.array_intersect(ref, ans)), F.size(ref), F.size(ans)
    both = (n_ref == 0) & (n_ans == 0)
    p = F.when(both, 1.0).when(n_ans == 0, 0.0).otherwise(hit / n_ans)
    r = F.when(both, 1.0).when(n_ref == 0, 0.0).otherwise(hit / n_ref)
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return {"precision": p, "recall": r, "f1": f1, "exact": (hit == n_ref) & (hit == n_ans)}


def score_path(reference, answer, valid_steps) -> Column:
    """Whether a path of tags runs between the reference's ends along valid steps (array of `a>b`)."""
    ref, ans = F.transform(_col(reference), fold_tag), F.transform(_col(answer), fold_tag)
    pairs = F.zip_with(F.slice(ans, 1, F.greatest(F.size(ans) - 1, F.lit(0))), F.slice(ans, 2, F.greatest(F.size(ans) - 1, F.lit(0))), lambda a, b: F.concat_ws(">", a, b))
    ends = (F.element_at(ref, 1) == F.element_at(ans, 1)) & (F.element_at(ref, -1) == F.element_at(ans, -1))
    return (F.size(ref) > 0) & (F.size(ans) > 0) & ends & F.forall(pairs, lambda s: F.array_contains(valid_steps, s))


def score_answer(answerable, outcome, not_present, type_rule) -> Column:
    """Wrong unless answered; unanswerable questions are right with `not present`, others wrong; else the type's rule."""
    answered = _col(outcome) == "ANSWERED"
    return F.when(~answered, False).when(~_col(answerable), _col(not_present)).when(_col(not_present), False).otherwise(F.coalesce(type_rule, F.lit(False)))


def variants(c) -> dict[str, Column]:
    """The ways a printed tag is written differently on another drawing."""
    t = _col(c)
    return {
        "drop_separator": F.regexp_replace(t, "-", ""), "swap_separator": F.regexp_replace(t, "-", "/"), "split_number": F.regexp_replace(t, r"(\d)(\d{2})$", "$1 $2"),
        "unpad": F.regexp_replace(t, r"(?<![0-9])0+(?=[0-9])", ""), "spare_separator": F.regexp_replace(t, r"([0-9])([A-Z])$", "$1-$2"), "case": F.lower(t),
        "unit_prefix": F.concat(F.lit("U"), t), "synonym": F.regexp_replace(F.regexp_replace(t, "^P-", "PU-"), "^E-", "HE-"),
    }
