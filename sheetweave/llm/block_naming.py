"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size blocks. Distinct blocks are sorted and numbered; then, level by level, distinct pairs
of adjacent names are numbered, until each document is one name. Documents are equal exactly when their number of
blocks and their last name are. Blocks travel once, distinct ones only; documents refer to them by two 64-bit hashes,
and the table of distinct blocks is checked: should two blocks share both hashes, all is named again with another salt.

Defined results: null text is empty; runs of blanks count as one space; of equal texts the row with the smallest
doc_id stays (null last; among rows of one id, one of them); every row is its own document, also when repeated; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, number_rows, own_columns, stash, texts_of, without_rows

#: Bytes in a block.
BLOCK_BYTES = 4096


def normalised(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), BLANKS, " ")


def _blocks(size: int):
    """The blocks of the normalised text's bytes, at least one."""
    data = F.encode("norm", "UTF-8")
    last = F.greatest(F.floor((F.octet_length("norm") - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, size))


def _hash(salt: int):
    return lambda b: F.struct(F.xxhash64(F.lit(salt), b).alias("h"), F.xxhash64(b, F.lit(salt + 1)).alias("g"))


def name_documents(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hash_of=_hash, row: str | None = None) -> DataFrame:
    """(row, doc_id, text_sha256, level, name): equal texts, and no others, share level and name. A stashed table. Rows
    have the numbers of the column `row`, or numbers of their own."""
    texts = documents.select(*([F.col(row).alias("row")] if row else []), F.col("doc_id"), normalised().alias("norm"))
    blocks = _blocks(block_bytes)
    salt = 0
    while True:
        hashed = hash_of(salt)
        # number the distinct blocks in sorted order within each partition
        distinct = texts.select(F.explode(blocks).alias("block")).distinct().sortWithinPartitions("block")
        names = stash(distinct.select(hashed(F.col("block")).alias("key"), F.monotonically_increasing_id().alias("name")), "dedup-blocks")
        if names.groupBy("key").count().where("count > 1").isEmpty():
            break
        salt += 2
    number = F.col("row") if row else F.monotonically_increasing_id()
    rows = stash(texts.select("doc_id", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), F.transform(blocks, hashed).alias("keys"), number.alias("row")), "dedup-rows")

    def rename(of: DataFrame, keys: str, table: DataFrame) -> DataFrame:
        """(row, names) with each key of the array replaced by its name in the table."""
        spread = of.select("row", F.posexplode(keys).alias("at", "key"))
        return spread.join(table, "key").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))

    level, named, done = 0, stash(rename(rows, "keys", names), "dedup-level"), None
    while True:
        ready = named.where(F.size("names") == 1).select("row", F.lit(level).alias("level"), F.get("names", F.lit(0)).alias("name"))
        done = ready if done is None else done.unionAll(ready)
        longer = named.where(F.size("names") > 1)
        if longer.isEmpty():
            break
        # adjacent names in pairs; an odd last name has -1 beside it
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")))
        paired = longer.select("row", pairs.alias("pairs"))
        table = paired.select(F.explode("pairs").alias("key")).distinct().sortWithinPartitions("key").withColumn("name", F.monotonically_increasing_id())
        table = stash(table, "dedup-pairs")
        named = stash(rename(paired, "pairs", table), "dedup-level")
        level += 1
    return stash(rows.select("row", "doc_id", "text_sha256").join(done, "row"), "dedup-names")


def _grouped(named: DataFrame) -> DataFrame:
    """Each named row with its group's size and the row that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # a table of its own: the join below is then a plain one, of which AQE splits large groups
    groups = stash(named.groupBy("level", "name").agg(F.count("*").alias("group_size"), first.alias("first")), "dedup-groups")
    return named.join(groups, ["level", "name"])


def exact_groups(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hash_of=_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    joined = _grouped(name_documents(documents, block_bytes, hash_of))
    return joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def drop_copies(documents: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns, whatever these are called. Of equal rows one stays."""
    numbered = number_rows(documents, "dedup-numbered")
    grouped = _grouped(name_documents(texts_of(numbered), row="row"))
    gone = stash(grouped.where(F.col("row") != F.col("first.row")).select("row"), "dedup-gone")
    return own_columns(without_rows(numbered, gone), documents.columns)
