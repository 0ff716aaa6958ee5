"""Sequence operators: read filters, barcode identification, collapse, combination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.scalar import count_base, hamming_text, low_complexity
from edgeloom.operators.graph import connected_components, cut_lineage
from edgeloom.operators.stored import dealt


def too_many_n(sequence: Column, most: float, uei: tuple[int, int] | None = None, drop_last: bool = False) -> Column:
    """True where N outside the UEI region number more than ``most`` (a share of the length if below 1).

    ``drop_last`` leaves the last base out of the part after the region, as the
    reference's slice does.
    """
    part = sequence
    if uei:
        end = F.length(sequence) - (1 if drop_last else 0)
        part = F.concat(F.substring(sequence, 1, uei[0]), sequence.substr(F.lit(uei[1] + 1), F.greatest(end - uei[1], F.lit(0))))
    n = count_base(part, "N")
    return n > (F.lit(most) * F.length(part) if 0 < most < 1 else F.lit(most))


def filter_reads(reads: DataFrame, umi1: tuple[int, int], umi2: tuple[int, int], most_n: float = 0, share: float = 0.8) -> DataFrame:
    """reads(sequence) with ``reason``: null for kept reads, else the first failed filter."""
    seq = F.col("sequence")
    part = lambda at: F.substring(seq, at[0] + 1, at[1] - at[0])
    reason = F.when(too_many_n(seq, most_n), "too_many_n").when(low_complexity(part(umi1), share) | low_complexity(part(umi2), share), "low_complexity_umi")
    return reads.withColumn("reason", reason)


def trim_quality(reads: DataFrame, cutoff: int = 20, base: int = 33) -> DataFrame:
    """reads(sequence, quality) cut at the 3' end where the running sum of (cutoff - quality)
    from the end is largest: the usual tail trimming."""

    @F.pandas_udf("int")
    def keep(quality: pd.Series) -> pd.Series:
        out = []
        for q in quality:
            score = cutoff - (np.frombuffer((q or "").encode("latin-1"), np.uint8).astype(int) - base)
            total = np.cumsum(score[::-1])
            stop = np.flatnonzero(total < 0)
            total = total[: stop[0]] if len(stop) else total
            out.append(len(score) - (int(np.argmax(total)) + 1 if len(total) and total.max() > 0 else 0))
        return pd.Series(out, dtype="int32")

    at = reads.withColumn("_n", keep("quality"))
    return at.withColumn("sequence", F.substring("sequence", F.lit(1), F.col("_n"))).withColumn("quality", F.substring("quality", F.lit(1), F.col("_n"))).drop("_n")


def q30_share(reads: DataFrame, regions: dict[str, tuple[int, int]], base: int = 33) -> DataFrame:
    """One row: share of bases with quality 30 or more in each region."""
    good = "".join(chr(base + q) for q in range(30, 94))
    out = []
    for name, (lo, hi) in regions.items():
        part = F.substring("quality", lo + 1, hi - lo)
        high = F.length(part) - F.length(F.translate(part, good, ""))
        out.append((F.sum(high) / F.sum(F.length(part))).alias(name))
    return reads.agg(*out)


def identify_barcodes(reads: DataFrame, panel: DataFrame, column: str = "barcode", most: int = 1) -> DataFrame:
    """reads with marker and mismatches: an exact hit, else the nearest barcode within
    ``most`` mismatches (ties: smallest marker), else null.

    Exact hits are an equality join. Misses meet the panel by blocks: cut into
    most + 1 pieces, a barcode within reach shares at least one piece unchanged.
    """
    exact = reads.join(panel.select(F.col("barcode").alias(column), "marker"), column, "left").withColumn("mismatches", F.when(F.col("marker").isNotNull(), 0))
    missed = exact.where("marker IS NULL").select(column).distinct()
    pieces = most + 1

    def blocks(name: str) -> Column:
        length = F.length(name)
        cut = lambda i: F.floor(length * i / pieces).cast("int")
        return F.array(*[F.struct(F.lit(i).alias("i"), F.col(name).substr(cut(i) + 1, cut(i + 1) - cut(i)).alias("s"), length.alias("n")) for i in range(pieces)])

    known = panel.select(F.col("barcode").alias("_known"), F.col("marker").alias("m"))
    near = missed.withColumn("block", F.explode(blocks(column))).join(known.withColumn("block", F.explode(blocks("_known"))), "block")
    near = near.withColumn("d", hamming_text(F.col(column), F.col("_known"))).where(F.col("d") <= most)
    best = near.groupBy(column).agg(F.min(F.struct("d", "m")).alias("best"))
    joined = exact.join(best, column, "left")
    return joined.withColumn("marker", F.coalesce("marker", "best.m")).withColumn("mismatches", F.coalesce("mismatches", "best.d")).drop("best")


def barcode_statistics(identified: DataFrame) -> DataFrame:
    """One row: exact, corrected and missing barcodes."""
    return identified.agg(
        F.count_if(F.col("mismatches") == 0).alias("exact"), F.count_if(F.col("mismatches") > 0).alias("corrected"), F.count_if(F.col("marker").isNull()).alias("missing")
    )


def read_counts(molecules: DataFrame) -> DataFrame:
    """Distinct rows with how often each occurred."""
    return molecules.groupBy(*molecules.columns).agg(F.count("*").alias("read_count"))


def near_pairs(sequences: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, a, b, d): distinct sequences of a group within ``most`` mismatches, a < b.

    Pigeonhole blocking: most + 1 pieces, one of which an eligible pair shares. A
    pair that shares several pieces is counted at the first.
    """
    pieces = most + 1
    length = F.length("sequence")
    cut = lambda i: F.floor(length * i / pieces).cast("int")
    block = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("sequence").substr(cut(i) + 1, cut(i + 1) - cut(i)).alias("s")) for i in range(pieces)]))
    cells = sequences.select(*by, "sequence").distinct().withColumn("block", block)
    left, right = cells.withColumnRenamed("sequence", "a"), cells.withColumnRenamed("sequence", "b")
    pairs = left.join(right, [*by, "block"]).where("a < b").select(*by, "a", "b").distinct()
    return pairs.withColumn("d", hamming_text(F.col("a"), F.col("b"))).where(F.col("d") <= most)


def collapse(reads: DataFrame, by: list[str], most: int = 2, directional: bool = True) -> DataFrame:
    """(by, sequence, representative): error-correcting collapse of sequences with read_count.

    Sequences within ``most`` mismatches are linked; the directional rule also asks
    that one has at least twice the other's reads less one. Linked groups take the
    sequence with most reads (ties: smallest).
    """
    counts = reads.groupBy(*by, "sequence").agg(F.sum("read_count").alias("n"))
    pairs = near_pairs(counts, by, most)
    for side in "ab":
        pairs = pairs.join(counts.select(*by, F.col("sequence").alias(side), F.col("n").alias(f"n_{side}")), [*by, side])
    if directional:
        pairs = pairs.where("n_a >= 2 * n_b - 1 OR n_b >= 2 * n_a - 1")
    name = lambda c: F.concat_ws("\u0001", *by, c)
    parts = connected_components(pairs.select(name("a").alias("a"), name("b").alias("b")))
    named = counts.withColumn("node", name("sequence")).join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    order = Window.partitionBy("part").orderBy(F.col("n").desc(), "sequence")
    return named.withColumn("representative", F.first("sequence").over(order)).select(*by, "sequence", "representative")


def combine_collapsed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges from two independently corrected sides of the same molecules.

    first: (marker_1, marker_2, original_umi1, original_umi2, uei, read_count, corrected_umi1);
    second: the same keys with corrected_umi2. Repeated keys are paired by number.
    """
    keys = ["marker_1", "marker_2", "original_umi1", "original_umi2", "uei"]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("read_count"))
    numbered = lambda df: dealt(dealt(df, *keys, like=first).withColumn("_at", at), *keys, "_at", like=first)
    both = numbered(first).join(numbered(second).drop("read_count"), [*keys, "_at"])
    fixed = (F.col("corrected_umi1") != F.col("original_umi1")) | (F.col("corrected_umi2") != F.col("original_umi2"))
    edge = ["marker_1", "marker_2", "umi1", "umi2"]
    rows = both.select("marker_1", "marker_2", F.col("corrected_umi1").alias("umi1"), F.col("corrected_umi2").alias("umi2"), "uei", "read_count", F.when(fixed, F.col("read_count")).alias("fixed"))
    # One shuffle by the ends; the molecules of an edge are made one and then counted where they lie.
    per = dealt(rows, "umi1", "umi2", like=first).groupBy(*edge, "uei").agg(F.sum("read_count").alias("n"), F.sum("fixed").alias("fixed"))
    return per.groupBy(*edge).agg(F.sum("n").alias("read_count"), F.count("uei").alias("uei_count"), F.coalesce(F.sum("fixed"), F.lit(0)).alias("corrected_read_count"))


def most_common(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The most frequent value per group (ties: smallest), with its count."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), column)
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def build_amplicons(reads: DataFrame, linkers: dict[str, tuple[int, str]], regions: dict[str, tuple[int, int]], length: int, share: float = 0.1) -> DataFrame:
    """reads(name, r1, r2, q1, q2) to (name, amplicon, quality, regions..., reason).

    Read 2 is turned to read 1's strand. Each linker is sought within ``share``
    mismatches near its place in either read; the read's offset follows from the
    best hit, or is taken as anchored. Of bases that both reads cover the one of higher
    quality is taken, of equal ones read 2's, an N only where neither has a base; the
    quality is the higher one. Gaps are N of the lowest quality; a read without any
    linker fails. Without q1 and q2 all qualities are equal.
    """
    from edgeloom.functions.scalar import reverse_complement

    q1, q2 = (F.col(q) if q in reads.columns else F.lit("") for q in ("q1", "q2"))
    turned = reads.select("name", "r1", reverse_complement(F.col("r2")).alias("r2"), q1.alias("q1"), F.reverse(q2).alias("q2"))
    schema = "name string, amplicon string, quality string, reason string"

    def place(read: str, first_guess: int) -> tuple[int, bool]:
        best = (1.0, first_guess, False)
        for at, linker in linkers.values():
            n = len(linker)
            window = np.frombuffer(read.encode(), np.uint8)
            goal = np.frombuffer(linker.encode(), np.uint8)
            if len(window) < n:
                continue
            strips = np.lib.stride_tricks.sliding_window_view(window, n)
            wrong = (strips != goal).sum(axis=1)
            k = int(np.argmin(wrong))
            if wrong[k] <= share * n and wrong[k] / n < best[0]:
                best = (wrong[k] / n, at - k, True)
        return best[1], best[2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, r1, r2, q1, q2 in zip(pdf["name"], pdf["r1"], pdf["r2"], pdf["q1"], pdf["q2"]):
                base, quality, found = ["N"] * length, ["!"] * length, False
                for read, grades, guess in ((r2 or "", q2 or "", length - len(r2 or "")), (r1 or "", q1 or "", 0)):
                    at, hit = place(read, guess)
                    found |= hit
                    for i, (c, q) in enumerate(zip(read, grades.ljust(len(read), "!"))):
                        if 0 <= at + i < length:
                            if c != "N" and (base[at + i] == "N" or q > quality[at + i]):
                                base[at + i] = c
                            quality[at + i] = max(quality[at + i], q)
                out.append((name, "".join(base), "".join(quality), None if found else "no_linker"))
            yield pd.DataFrame(out, columns=["name", "amplicon", "quality", "reason"])

    built = turned.mapInPandas(run, schema)
    return built.select("*", *[F.substring("amplicon", lo + 1, hi - lo).alias(n) for n, (lo, hi) in regions.items()])


def linker_in_umi(sequence: Column, linker: str, least: int = 8) -> Column:
    """True where any run of ``least`` bases of the linker occurs in the sequence."""
    hits = [F.contains(sequence, F.lit(linker[i : i + least])) for i in range(len(linker) - least + 1)]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def collapse_pixels(reads: DataFrame, most: int = 2, min_count: int = 1) -> DataFrame:
    """Older-generation collapse: reads(marker, upia, upib, umi) to edges (marker, upia, upib, umi, count, unique_molecules).

    Key = umi + upia; near keys of a marker collapse to the most read one (ties:
    smallest); a group's UPIB is its most frequent one (ties: smallest).
    """
    keyed = reads.withColumn("sequence", F.concat("umi", "upia"))
    often = keyed.groupBy("marker", "sequence").agg(F.count("*").alias("read_count")).where(F.col("read_count") >= min_count)
    found = cut_lineage(collapse(often, ["marker"], most, directional=False))
    joined = keyed.join(found, ["marker", "sequence"])
    upib = most_common(joined, ["marker", "representative"], "upib").drop("n")
    sums = joined.groupBy("marker", "representative").agg(F.count("*").alias("count"), F.countDistinct("sequence").alias("unique_molecules"))
    umi_length = keyed.select("marker", F.col("sequence").alias("representative"), "umi", "upia").dropDuplicates(["marker", "representative"])
    return sums.join(upib, ["marker", "representative"]).join(umi_length, ["marker", "representative"]).select("marker", "upia", "upib", "umi", "count", "unique_molecules")
