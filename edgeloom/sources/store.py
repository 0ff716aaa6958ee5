"""A sample's store: a folder with one Parquet table each for edgelist, layouts, proximity, obs, metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("edgelist", "layouts", "proximity", "obs", "var", "counts", "metadata")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def table_names(spark: SparkSession, path: str) -> list[str]:
    return [t for t in TABLES if _exists(spark, f"{path}/{t}")]


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}")


def read_metadata(spark: SparkSession, path: str) -> dict:
    if not _exists(spark, f"{path}/metadata"):
        return {}
    row = spark.read.parquet(f"{path}/metadata").first()
    return json.loads(row["value"]) if row else {}


def write_edgelist(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows of a component lie together, so row groups can be skipped by component."""
    edges.repartitionByRange("component").sortWithinPartitions("component").write.mode(mode).option("compression", "zstd").parquet(path)


def write_store(spark: SparkSession, path: str, edges: DataFrame, tables: dict[str, DataFrame], metadata: dict, mode: str = "errorifexists") -> None:
    write_edgelist(edges, f"{path}/edgelist", mode)
    for name, df in tables.items():
        df.write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode(mode).parquet(f"{path}/metadata")


def filter_store(spark: SparkSession, path: str, components: list[str], target: str) -> None:
    """Copy of a store with the given components only; tables it lacks are skipped."""
    if not components:
        raise ValueError("no components to keep")
    keep = F.col("component").isin(components)
    tables = {}
    for name in table_names(spark, path):
        df = read_table(spark, path, name)
        if name not in ("edgelist", "metadata"):
            tables[name] = df.where(keep) if "component" in df.columns else df
    write_store(spark, target, read_table(spark, path, "edgelist").where(keep), tables, read_metadata(spark, path))


def write_partitioned(edges: DataFrame, path: str, most: int = 10_000) -> None:
    """One folder per component. Beyond ``most`` components that would be too many folders: they
    are dealt to ``most`` folders ``bucket=`` by hash, each component whole in one."""
    few = edges.select("component").distinct().limit(most + 1).count() <= most
    by = "component" if few else "bucket"
    placed = edges if few else edges.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(most)).cast("int"))
    placed.repartition(by).write.partitionBy(by).parquet(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_partitioned`` wrote, component names as strings whatever they look like."""
    found = spark.read.parquet(path)
    return found.drop("bucket") if "bucket" in found.columns else found.withColumn("component", F.col("component").cast("string"))


def write_in_order(df: DataFrame, offset: str, path: str) -> None:
    """Rows by offset, across files and within each."""
    df.repartitionByRange(offset).sortWithinPartitions(offset).write.option("compression", "zstd").parquet(path)
