"""Streaming counterpart of the edge aggregation: molecules in, edges with read counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_counts(molecules: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(marker_1, marker_2, umi1, umi2, read_count, uei_count) kept up to date from a stream of
    molecules (..., uei, ts); a molecule seen again within the watermark adds reads only.

    Works on a bounded DataFrame as well, where the watermark has no effect.
    """
    seen = molecules.withWatermark("ts", late)
    keys = ["marker_1", "marker_2", "umi1", "umi2"]
    return seen.groupBy(*keys).agg(F.count("*").alias("read_count"), F.approx_count_distinct("uei", 0.01).alias("uei_count"))


def distinct_molecules(molecules: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each molecule once within the watermark."""
    return molecules.withWatermark("ts", late).dropDuplicatesWithinWatermark(["marker_1", "marker_2", "umi1", "umi2", "uei"])
