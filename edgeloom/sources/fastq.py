"""FASTQ reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings that tell read 1 from read 2, fixed values.
READ_ENDINGS = r"[._-](?:R|)([12])(?:_001)?\.(?:fq|fastq)(?:\.(?:gz|zst))?$"


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, sequence, quality) of records of four lines.

    Lines are numbered within their file by one ordered window: files of a run come
    in many chunks, and a compressed file is read by one task in any case.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    # Lines of a file keep their order under increasing ids; four of them make a record.
    order = Window.partitionBy("file").orderBy("at")
    numbered = lines.withColumn("n", F.row_number().over(order) - 1)
    record = numbered.groupBy("file", F.floor(F.col("n") / 4).alias("record")).agg(*[F.max(F.when(F.col("n") % 4 == i, F.col("value"))).alias(c) for i, c in ((0, "name"), (1, "sequence"), (3, "quality"))])
    return record.select("file", "record", F.expr("substring(name, 2)").alias("name"), "sequence", "quality")


def pair_reads(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """(name, r1, q1, r2, q2) by the read name up to its first blank."""
    key = F.split("name", " ")[0]
    first = r1.select(key.alias("name"), F.col("sequence").alias("r1"), F.col("quality").alias("q1"))
    return first.join(r2.select(key.alias("name"), F.col("sequence").alias("r2"), F.col("quality").alias("q2")), "name")


def write_fastq(reads: DataFrame, path: str) -> None:
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "sequence", F.lit("+"), "quality").alias("value")).write.option("compression", "gzip").text(path)


def sample_of(path_column: F.Column) -> F.Column:
    """Sample name: the file name without read number and endings."""
    return F.regexp_replace(F.element_at(F.split(path_column, "/"), -1), READ_ENDINGS, "")
