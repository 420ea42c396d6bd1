"""From raw documents to packed sequences, stage by stage; each stage reads what the one before has written.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.llm import block_naming, langid, mixing, packing, simhash
from sheetweave.llm.common import own_columns, read_table, stash
from sheetweave.llm.queries import tokenizer_path

#: Share of a document's n-grams that its language has to know. At sf0.1 the least of any document is 0.69; letters at
#: random and scripts no filter has learned have under 0.05.
LEAST_KNOWN = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`), or whose language knows less than LEAST_KNOWN of their n-grams, go; filters
    learn from the stage's own labelled rows. Where no row has a label to learn from, all documents stay."""
    filters = langid.learn(docs.where(~langid.in_fold(5, 0)))
    if not filters.languages:
        return docs
    return own_columns(langid.identify(docs, filters).where((F.col("lang_pred") != "und") & (F.col("lang_share") >= LEAST_KNOWN)), docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return block_naming.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("best-fit packing", pack_sequences)]

#: SQL expresses none of language models, hashing by XXH64, random ranks and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{number}")
    return docs


