"""Helpers the training-data operators share: numbered rows, lookups, the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import discard, fresh_path, shared_folder, stash, with_rank
from ..ship import ship

__all__ = [
    "ARROW_ROWS", "BLANKS", "BROADCAST_NUMBERS", "BROADCAST_ROWS", "WORD", "bound_batches", "discard", "fresh_path", "join_lookup", "number_rows", "own_columns", "read_table", "shared_folder", "stash", "texts_of",
    "with_rank", "without_rows",
]

#: A word, and what stands between words (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows up to which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000
#: The same for tables of one or two numbers a row.
BROADCAST_NUMBERS = 500_000
#: Rows of texts in an Arrow batch.
ARROW_ROWS = 1_000


def join_lookup(df: DataFrame, lookup: DataFrame, on, rows: int, how: str = "left") -> DataFrame:
    """Join with a lookup table of a counted size: broadcast up to BROADCAST_ROWS rows, else shuffled (AQE splits hot keys)."""
    return df.join(F.broadcast(lookup) if rows <= BROADCAST_ROWS else lookup, on, how)


def number_rows(documents: DataFrame, name: str) -> DataFrame:
    """(row long, own struct of all columns), a written table: rows told apart by a number, whatever their values, and
    columns of any name out of the way of the operator's own."""
    own = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in documents.columns))
    return stash(documents.select(own.alias("own"), F.monotonically_increasing_id().alias("row")), name)


def texts_of(numbered: DataFrame) -> DataFrame:
    """(row, doc_id, text) of numbered documents."""
    return numbered.select("row", F.col("own").getField("doc_id").cast("long").alias("doc_id"), F.col("own").getField("text").cast("string").alias("text"))


def own_columns(numbered: DataFrame, columns: list[str]) -> DataFrame:
    return numbered.select(*(F.col("own").getField(c).alias(c) for c in columns))


def without_rows(numbered: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered documents but for the rows of a written table (row): their numbers are sent to all tasks while they are
    BROADCAST_NUMBERS at most, else the documents are shuffled."""
    few = gone.count() <= BROADCAST_NUMBERS
    return numbered.join(F.broadcast(gone) if few else gone, "row", "left_anti")


def bound_batches(spark: SparkSession) -> None:
    """Texts are long: no more than ARROW_ROWS rows reach a Python worker at once. Holds for the session from here on."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
