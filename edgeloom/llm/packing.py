"""Packing by optimal length buckets.

Texts are cut into pieces of at most ``context`` words. The histogram of piece
lengths (at most ``context`` numbers, whatever the corpus) goes to the driver,
where dynamic programming picks the ``buckets`` upper bounds of least total
padding. Pieces are then dealt, in hashed order, into batches of one bucket
whose padded size stays within ``budget`` words.

How it scales: the histogram is one partial aggregation; a piece's place in
its bucket is a two-level prefix sum over hash slots, so a bucket that holds a
third of all pieces is spread over as many tasks as it has slots.

Defined cases: a null or blank text gives no piece; a text longer than the
context gives several, none dropped; a repeated row gives its own pieces (rows
that share doc_id, start and length are interchangeable); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import save
from edgeloom.llm.mixing import ROWS_PER_SLOT, SLOTS_MAX, word_count


def optimal_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds, ascending, that minimise the sum of (bound - length) over all pieces.

    Exact: least[k][j] is the least padding of the j shortest lengths in k
    buckets. O(buckets x lengths^2) with one numpy row per step.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    pieces = np.concatenate([[0], np.cumsum(counts)])
    words = np.concatenate([[0], np.cumsum(counts * lengths)])
    n = len(lengths)
    buckets = min(buckets, n)
    least = np.full(n + 1, np.inf)
    least[0] = 0
    choice = np.zeros((buckets + 1, n + 1), dtype=np.int64)
    for k in range(1, buckets + 1):
        now = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            padding = lengths[j - 1] * (pieces[j] - pieces[:j]) - (words[j] - words[:j])
            total = least[:j] + padding
            i = int(np.argmin(total))
            now[j], choice[k, j] = total[i], i
        least = now
    bounds, j = [], n
    for k in range(buckets, 0, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(choice[k, j])
        if j == 0:
            break
    return bounds[::-1]


def pieces_of(docs: DataFrame, context: int) -> DataFrame:
    """(doc_id, piece, start, length): spans of words, the last one short."""
    sized = docs.select("doc_id", word_count(F.col("text")).alias("words")).where("words > 0")
    last = F.floor((F.col("words") - 1) / context).cast("int")
    cut = sized.select("doc_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * context
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("words") - start, F.lit(context).cast("long")).alias("length"))


def pack_documents(
    docs: DataFrame,
    context: int = 2048,
    buckets: int = 16,
    budget: int = 32_768,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """(doc_id, piece, start, length, bucket, batch, slot, padding) for every piece.

    ``bucket`` is the padded length, ``batch`` numbers the bucket's batches from
    0, ``slot`` the pieces of a batch; a batch holds budget // bucket pieces, one
    at least.
    """
    pieces = save(pieces_of(docs, context), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # context rows at most
    bounds = optimal_bounds(histogram, buckets)
    if not bounds:
        bounds = [context]
    bucket = F.lit(bounds[-1])
    for bound in reversed(bounds[:-1]):
        bucket = F.when(F.col("length") <= bound, F.lit(bound)).otherwise(bucket)
    slots = int(min(SLOTS_MAX, max(16, 2 ** (sum(histogram.values()) // rows_per_slot).bit_length())))
    hashed = F.xxhash64("doc_id", "piece")
    pieces = pieces.withColumn("bucket", bucket.cast("int")).withColumn("hash", hashed).withColumn("part", F.pmod(hashed, F.lit(slots)).cast("int"))

    heads = pieces.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("bucket", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("head"))
    order = Window.partitionBy("bucket", "part").orderBy("hash", "doc_id", "piece", "length")
    ranked = pieces.withColumn("at", F.row_number().over(order)).join(heads, ["bucket", "part"])
    place = F.col("head") + F.col("at") - 1
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1)).cast("long")
    return ranked.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "bucket",
        F.floor(place / room).cast("long").alias("batch"),
        (place % room).cast("int").alias("slot"),
        (F.col("bucket") - F.col("length")).cast("long").alias("padding"),
    )
