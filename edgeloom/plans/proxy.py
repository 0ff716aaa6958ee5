"""Edge lists derived from the driver's star-schema tables, for queries and tests.

Sample = region, component = nation; an order is an A-side molecule, a part
(per nation) a B-side molecule, a line item an edge between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.stored import finely, outgrows, scanning

EDGELIST_SQL = """
edgelist AS (
  SELECT r_name AS sample, n_name AS component, l_orderkey * 2 AS umi1,
         (l_partkey * 25 + n_nationkey) * 2 + 1 AS umi2,
         'M' || (l_orderkey % 8) AS marker_1, 'M' || (l_partkey % 8) AS marker_2,
         CAST(l_quantity AS BIGINT) AS read_count, CAST(l_linenumber AS BIGINT) AS uei_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

RAW_SQL = """
edgelist AS (
  SELECT l_orderkey AS umi1, l_partkey AS umi2, 'M' || (l_suppkey % 8) AS marker_1, 'M' || (l_suppkey % 5) AS marker_2,
         CAST(l_quantity AS BIGINT) AS read_count, CAST(l_linenumber AS BIGINT) AS uei_count
  FROM lineitem
)"""

PIXEL_SQL = """
edgelist AS (
  SELECT n_name AS component, l_orderkey AS upia, l_partkey AS upib, CAST(l_linenumber AS BIGINT) AS umi,
         p_brand AS marker, CAST(l_quantity AS BIGINT) AS count
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _marker(key: str, n: int) -> F.Column:
    return F.concat(F.lit("M"), (F.col(key) % n).cast("string"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nation and region of their customer.

    The larger tables meet in as many parts as their files call for, so that a task's share of
    the joins stays the same while they grow.
    """
    spark = scanning(spark, table(spark, sf_dir, "lineitem"))
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyers = t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    bought = _meet(t("orders").select("o_orderkey", "o_custkey"), buyers, "o_custkey", "c_custkey")
    return _meet(t("lineitem"), bought, "l_orderkey", "o_orderkey")


def _meet(many: DataFrame, few: DataFrame, many_key: str, few_key: str) -> DataFrame:
    """many joined to few by their keys."""
    if not outgrows(few):
        return many.join(few, F.col(many_key) == F.col(few_key))
    few = finely(few, few_key, like=many).hint("merge")
    return finely(many, many_key).join(few, F.col(many_key) == F.col(few_key))


def edgelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided edge list: a molecule has one marker and lies in one component."""
    return _located(spark, sf_dir).select(
        F.col("r_name").alias("sample"),
        F.col("n_name").alias("component"),
        (F.col("l_orderkey") * 2).alias("umi1"),
        ((F.col("l_partkey") * 25 + F.col("n_nationkey")) * 2 + 1).alias("umi2"),
        _marker("l_orderkey", 8).alias("marker_1"),
        _marker("l_partkey", 8).alias("marker_2"),
        F.col("l_quantity").cast("long").alias("read_count"),
        F.col("l_linenumber").cast("long").alias("uei_count"),
    )


def raw_edgelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge list with identifier clashes of all three kinds."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("umi1"),
        F.col("l_partkey").alias("umi2"),
        _marker("l_suppkey", 8).alias("marker_1"),
        _marker("l_suppkey", 5).alias("marker_2"),
        F.col("l_quantity").cast("long").alias("read_count"),
        F.col("l_linenumber").cast("long").alias("uei_count"),
    )


def pixel_edgelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge list of the older generation: one row per molecule between two pixels."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return _located(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("n_name").alias("component"),
        F.col("l_orderkey").alias("upia"),
        F.col("l_partkey").alias("upib"),
        F.col("l_linenumber").cast("long").alias("umi"),
        F.col("p_brand").alias("marker"),
        F.col("l_quantity").cast("long").alias("count"),
    )
