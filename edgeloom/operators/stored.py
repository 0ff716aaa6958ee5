"""Intermediate tables in the shared folder, and how finely a shuffle is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_ROWS = 200_000  # a stored table of more rows is never sent whole to the driver
SLICE_BYTES = 4 << 20  # of input files to a partition of a wide shuffle
SPLIT_BYTES = 16 << 20  # of a file to a scan task whose rows go to many partitions


def scanning(spark: SparkSession, rows: DataFrame) -> SparkSession:
    """The session to read in, where the files of ``rows`` are dealt.

    To more partitions than spark.shuffle.sort.bypassMergeThreshold a scan task holds all it sends, up to
    128 MB of a file; then a copy of the session reads smaller splits, and the one given stays as it is.
    """
    if slices(rows) <= int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200")):
        return spark
    copy = spark._jsparkSession.cloneSession()
    least = min(SPLIT_BYTES, copy.sessionState().conf().filesMaxPartitionBytes())
    copy.conf().set("spark.sql.files.maxPartitionBytes", f"{least}b")
    return SparkSession(spark.sparkContext, copy)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode alone a temporary one where unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="edgeloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    Millions of sorted identifiers take a few MB as a file, so the planner would broadcast
    them by that size; their rows, counted from the footers, decide instead.
    """
    path = f"{shared_folder(df.sparkSession)}/edgeloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if out.count() > BROADCAST_ROWS else out


def dealt(df: DataFrame, *columns: str, like: DataFrame | None = None) -> DataFrame:
    """df by hash of the columns, as finely as its own files (or those of ``like``) call for: a task's
    share stays the same while the input grows, and grouping by the columns needs no more shuffle."""
    return df.repartition(slices(df if like is None else like), *columns)


def finely(df: DataFrame, *columns: str, like: DataFrame | None = None) -> DataFrame:
    """dealt, where the tables outgrow one partition to a core; smaller ones are left to the planner."""
    like = df if like is None else like
    return dealt(df, *columns, like=like) if slices(like) > df.sparkSession.sparkContext.defaultParallelism else df


def outgrows(df: DataFrame) -> bool:
    """Whether df reads more files than a partition takes: not to be broadcast, its rows fill far more memory."""
    return _bytes(df) > SLICE_BYTES


def _bytes(df: DataFrame) -> int:
    """Size of the files that df reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def slices(df: DataFrame) -> int:
    """Partitions for a shuffle of df's rows, in proportion to the files it reads."""
    size, spark = _bytes(df), df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size >= 1 << 50:  # rows of unknown size
        return usual
    return max(min(usual, spark.sparkContext.defaultParallelism), -(-size // SLICE_BYTES))
