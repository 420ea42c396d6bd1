"""Language identification by language-bitmask n-gram filters.

A Bloom filter per language, bit-sliced: a slot holds a bit for each language, so that the AND of an n-gram's slots
is the set of all languages that may contain it. A document's n-grams are looked up at once; each language's number
of hits is corrected by its filter's false positive rate, and the largest corrected share decides.

Filters learn from a sample of rows by hash, SAMPLE_ROWS expected per language: n-grams that make up at least
LEAST_SHARE of a language's sample. Only text is read when predicting.

Defined results: null text, or text without a letter, is `und` with score 0, as is everything where nothing could
be learned; ties go to the language first in code point order; rows of one id are judged one by one, and very long
texts a SLICE at a time, with no n-gram lost between slices; learning rows need a language and a text; other columns
play no part and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bound_batches, discard, stash

#: Characters of an n-gram; slots of the filter (a power of two) and slots per n-gram.
N, SLOTS_LOG2, HASHES = 4, 20, 2
#: Languages in a word of a mask.
WIDTH = 63
#: Rows expected in a language's sample, and the least share of its n-grams that one needs to be learned.
SAMPLE_ROWS, LEAST_SHARE = 1_500, 2e-6
#: Characters worked on at a time.
SLICE = 200_000
LETTER = re.compile(r"[^\W\d_]")


def _grams(text: str) -> np.ndarray:
    """64-bit codes of the n-grams of the lower-cased text, blanks and digits as one sign."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < N:
        codes = np.pad(codes, (0, N - len(codes)), constant_values=32)
    codes = np.where(codes < 65, np.uint64(32), codes)
    value = codes[: len(codes) - N + 1].copy()
    for i in range(1, N):
        value = value * np.uint64(0x100000001B3) + codes[i : len(codes) - N + 1 + i]
    value ^= value >> np.uint64(29)
    return value * np.uint64(0xBF58476D1CE4E5B9)


def _slots(grams: np.ndarray, j: int) -> np.ndarray:
    return ((grams >> np.uint64(64 - SLOTS_LOG2)) if j == 0 else ((grams >> np.uint64(8 + 3 * j)) & np.uint64((1 << SLOTS_LOG2) - 1))).astype(np.int64)


class LanguageFilters:
    """languages, rising; masks[word][slot] with a bit per language; each language's false positive rate."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        fill = np.array([((masks[i // WIDTH] >> np.int64(i % WIDTH)) & 1).mean() for i in range(len(languages))])
        self.false = np.minimum(fill**HASHES, 0.99)

    def shares(self, text: str) -> np.ndarray:
        """Each language's corrected share of the text's n-grams."""
        hits, total = np.zeros(len(self.languages)), 0
        for a in range(0, max(1, len(text) - N + 1), SLICE):
            grams = _grams(text[a : a + SLICE + N - 1])
            total += len(grams)
            slots = [_slots(grams, j) for j in range(HASHES)]
            for w, mask in enumerate(self.masks):
                both = mask[slots[0]]
                for s in slots[1:]:
                    both = both & mask[s]
                own = hits[w * WIDTH : (w + 1) * WIDTH]
                # all languages of the word at once: the sums of the bit planes
                own += np.unpackbits(both.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)[: len(own)]
        return np.maximum((hits - total * self.false) / (1 - self.false), 0) / max(total, 1)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, share): score is the winner's part of all corrected shares."""
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0, 0.0
        shares = self.shares(text)
        best = int(shares.argmax())
        whole = float(shares.sum())
        return self.languages[best], float(shares[best]) / whole if whole else 0.0, float(shares[best])


def learn(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageFilters:
    """Filters from rows with doc_id, text and lang. The driver gets the slots in use: bounded by the filter's size."""
    rows = documents.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    words = max(1, -(-len(languages) // WIDTH))
    if not languages:
        return LanguageFilters([], np.zeros((1, 1 << SLOTS_LOG2), np.int64))
    spark = documents.sparkSession
    rates = spark.createDataFrame([(x, i, int(min(1.0, sample_rows / sizes[x]) * (1 << 40))) for i, x in enumerate(languages)], "lang string, number int, below long")
    picked = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 40)) < F.col("below"))

    def count(batches):
        for batch in batches:
            numbers, texts = batch.column("number").to_pylist(), batch.column("text").to_pylist()
            for number in sorted(set(numbers)):
                mine = [t for n, t in zip(numbers, texts, strict=True) if n == number]
                grams = [_grams(t[a : a + SLICE + N - 1]) for t in mine for a in range(0, max(1, len(t) - N + 1), SLICE)]
                found, times = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_pydict({"number": pa.array(np.full(len(found), number, np.int32)), "gram": pa.array(found.view(np.int64)), "n": pa.array(times.astype(np.int64))})

    counts = picked.select("number", "text").mapInArrow(count, "number int, gram long, n long").groupBy("number", "gram").agg(F.sum("n").alias("n"))
    counts = stash(counts, "language-grams")
    totals = spark.createDataFrame([(r["number"], r["n"]) for r in counts.groupBy("number").agg(F.sum("n").alias("n")).collect()] or [(0, 0)], "number int, total long")
    learned = counts.join(F.broadcast(totals), "number").where(F.col("n") >= F.greatest(F.col("total") * LEAST_SHARE, F.lit(1)))

    def place(batches):
        for batch in batches:
            grams, numbers = np.asarray(batch.column("gram")).view(np.uint64), np.asarray(batch.column("number"))
            slots = np.concatenate([_slots(grams, j) for j in range(HASHES)])
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slots), "word": pa.array(np.tile(numbers // WIDTH, HASHES).astype(np.int32)), "mask": pa.array(np.tile(np.int64(1) << (numbers % WIDTH).astype(np.int64), HASHES))})

    masks = np.zeros((words, 1 << SLOTS_LOG2), np.int64)
    table = learned.select("number", "gram").mapInArrow(place, "slot long, word int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks[np.asarray(table["word"]), np.asarray(table["slot"])] = np.asarray(table["mask"])
    discard(counts)
    return LanguageFilters(languages, masks)


def identify(documents: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(own struct of all columns of a document, lang_pred, lang_score, lang_share) of every document."""
    spark = documents.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(filters)  # 8 MB per 63 languages
    own = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in documents.columns))
    place = documents.columns.index("text")

    def judge(batches):
        for batch in batches:
            texts = batch.column("own").field(place).cast(pa.string())  # texts travel once, within their rows
            found = [sent.value.predict(t.as_py()) for t in texts]
            names, scores, shares = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], ["own", "lang_pred", "lang_score", "lang_share"])

    schema = StructType([StructField("own", documents.schema), StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_share", DoubleType())])
    return documents.select(own.alias("own")).mapInArrow(judge, schema)


def in_fold(modulus: int, remainder: int):
    """Whether crc32 of the id's text has the remainder; a null id is outside the fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
