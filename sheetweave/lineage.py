"""Written tables in the shared folder: where lineage is cut, so that a lost executor costs nothing already done."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local
    mode, in which there are no other machines; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not context.isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sheetweave-"))
        folder = context.getCheckpointDir().get()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sheetweave/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str = "table", *partition_by: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, order: list, name: str, rank: str = "rank", per: list[str] | None = None) -> DataFrame:
    """`df` and its position from 0 in the given order, in all or within each group of the columns `per`, without a task
    that sees all rows.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the sizes of the partitions
    before. With `per`, a group's first rank is taken off again: one row for each group and partition is joined.
    """
    by = [F.col(c).asc_nulls_first() for c in per or []]
    spot = stash(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_spot", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_spot", 33), F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, total = [], 0
    for row in spot.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each partition
        offsets.append((row["p"], total))
        total += row["count"]
    spread = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _before long")
    ranked = spot.withColumn("_part", part).join(F.broadcast(spread), "_part").withColumn(rank, F.col("_before") + place).drop("_spot", "_part", "_before")
    if not per:
        return ranked
    first = ranked.groupBy(*(F.col(c).alias(f"_per{i}") for i, c in enumerate(per))).agg(F.min(rank).alias("_first"))
    same = None
    for i, c in enumerate(per):
        test = F.col(c).eqNullSafe(F.col(f"_per{i}"))
        same = test if same is None else same & test
    return ranked.join(first, same).withColumn(rank, F.col(rank) - F.col("_first")).drop("_first", *(f"_per{i}" for i in range(len(per))))


def discard(df: DataFrame, *partitions: str) -> None:
    """Delete the files of a stashed table, or of its folders of these names, that no result reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if partitions and folder.rsplit("/", 1)[1] not in partitions:
            continue
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
