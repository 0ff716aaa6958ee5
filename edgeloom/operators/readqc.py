"""Quality control of raw reads: trimming, filters, repeated reads, linked adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.scalar import count_base


def mean_quality(quality: Column, base: int = 33) -> Column:
    """Mean of the quality letters; null for an empty text."""
    marks = F.regexp_extract_all(quality, F.lit("(?s)."), F.lit(0))
    total = F.aggregate(marks, F.lit(0).cast("long"), lambda s, c: s + F.ascii(c) - base)
    return F.when(F.size(marks) > 0, total / F.size(marks))


def trim_fixed(reads: DataFrame, front: int = 0, tail: int = 0) -> DataFrame:
    """``front`` and ``tail`` bases cut off the ends of sequence and quality."""
    cut = lambda c: F.col(c).substr(F.lit(front + 1), F.greatest(F.length(c) - (front + tail), F.lit(0)))
    return reads.withColumns({c: cut(c) for c in ("sequence", "quality")})


def trim_poly_g(reads: DataFrame, least: int = 10) -> DataFrame:
    """A tail of at least ``least`` G cut off, as two-colour sequencers write past a fragment's end. No mismatch is allowed."""
    kept = F.length(F.regexp_replace("sequence", f"G{{{least},}}$", ""))
    at = reads.withColumn("_kept", kept)
    return at.withColumns({c: F.col(c).substr(F.lit(1), F.col("_kept")) for c in ("sequence", "quality")}).drop("_kept")


def quality_filter(reads: DataFrame, most_n: int = 0, mean: float = 20, shortest: int = 0) -> DataFrame:
    """reads(sequence, quality) with ``reason``: null for kept reads, else the first failed filter."""
    low = F.coalesce(mean_quality(F.col("quality")), F.lit(0.0)) < mean
    reason = F.when(F.length("sequence") < shortest, "too_short").when(count_base(F.col("sequence"), "N") > most_n, "too_many_n").when(low, "low_quality")
    return reads.withColumn("reason", reason)


def drop_repeats(reads: DataFrame) -> DataFrame:
    """Of reads(name, sequence, ...) with one sequence, the one first by name. An aggregation that
    combines before the shuffle, so a sequence that many reads share is no hot key."""
    rest = [c for c in reads.columns if c not in ("name", "sequence")]
    first = reads.groupBy("sequence").agg(F.min(F.struct("name", *rest)).alias("_first"))
    return first.select(*[F.col("sequence") if c == "sequence" else F.col(f"_first.{c}").alias(c) for c in reads.columns])


def linked_adapters(reads: DataFrame, first: str, second: str) -> DataFrame:
    """``insert``: what lies between the two adapters, null where they do not both occur in this order
    (exact matches; the first occurrence of each)."""
    start = F.instr("sequence", F.lit(first)) + len(first)
    rest = F.col("sequence").substr(start, F.length("sequence"))
    stop = F.instr(rest, F.lit(second))
    found = (F.instr("sequence", F.lit(first)) > 0) & (stop > 0)
    return reads.withColumn("insert", F.when(found, rest.substr(F.lit(1), stop - 1)))
