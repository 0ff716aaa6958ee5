"""Shared pieces of the training-data operators.

* scratch tables in the folder that ``spark.checkpoint.dir`` names (shared by
  driver and executors, so a lost executor costs a retry and nothing else);
* vectorised word splitting and hashing of Arrow text columns;
* distributed ranking helpers and connected components.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Text handled at once by the vectorised tokeniser; a longer text goes alone.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode alone a temporary one where unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="edgeloom-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/edgeloom/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: cuts lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --------------------------------------------------------------------------
# hashing and tokenising (numpy, over Arrow buffers)
# --------------------------------------------------------------------------

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator: a bijection of 64-bit words."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Seeds of the independent hashes of a word (lane 0, 1, ...): odd 64-bit constants.
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of at most this many bytes are hashed eight bytes at a time for all words at once.
_SHORT = 64
_LOW_BYTES = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], dtype=np.uint64)


class Words:
    """Words of a few texts: byte offsets, hashes, and the range of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        blank = _BLANK[data]
        inside = ~blank
        first = inside.copy()
        first[1:] &= blank[:-1]
        last = inside.copy()
        last[:-1] &= blank[1:]
        edge = offsets[:-1]
        edge = edge[edge < len(data)]
        first[edge] = inside[edge]
        edge = offsets[1:]
        edge = edge[edge > 0] - 1
        last[edge] = inside[edge]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: words of text i: self.bounds[i] to self.bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64-bit hash of each word's bytes; lanes are independent of each other.

        Short words are chained through a bijective mixer, eight bytes a step, from a
        start that depends on lane and length; longer words go through BLAKE2b.
        """
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        size = self.ends - self.starts
        seed = np.uint64(_LANES[lane])
        out = mix64(size.astype(np.uint64) * seed + seed)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        at, todo = 0, np.flatnonzero(size <= _SHORT)
        while len(todo):
            left = np.minimum(size[todo] - at, 8)
            chunk = eight[self.starts[todo] + at] & _LOW_BYTES[left]
            out[todo] = mix64((out[todo] ^ chunk) * seed)
            at += 8
            todo = todo[size[todo] > at]
        for i in np.flatnonzero(size > _SHORT):
            raw = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=b"lane%d" % lane).digest(), "little")
        return out

    def text(self, first: int, last: int) -> bytes:
        """Bytes from word ``first`` through word ``last`` inclusive, blanks as they stand."""
        return self.data[self.starts[first] : self.ends[last]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def word_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) for runs of rows of about ``limit`` bytes of text."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


_JOIN = np.uint64(0xD6E8FEB86659FD93)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two runs from theirs; mixed at each step, so that no pattern of repeats cancels."""
    return mix64(left * _JOIN + right)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words starting at each position (positions past the end are left out)."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    doubled, size, out, done = mix64(hashes + np.uint64(n)), 1, None, 0
    while True:
        if n & size:
            out = doubled[:m] if out is None else _joined(out, doubled[done : done + m])
            done += size
        if size * 2 > n:
            return out
        doubled = _joined(doubled[:-size], doubled[size:])
        size *= 2


def inside_docs(bounds: np.ndarray, n: int) -> np.ndarray:
    """Mask over positions 0..len-n: the n words from there lie in one text."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(total - n + 1)
    return at + n <= ends[: total - n + 1]


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of n words; a text of 1 to n-1 words is one shingle."""
    hashes = words.hashes()
    keep = inside_docs(words.bounds, n)
    doc, out = words.doc_of(), gram_hashes(hashes, n)
    docs, values = [doc[: len(keep)][keep]], [out[keep]]
    counts = words.counts
    for short in range(1, n):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            value = np.full(len(rows), 1000 + short, dtype=np.uint64)
            for i in range(short):
                value = _joined(value, hashes[words.bounds[rows] + i])
            docs.append(rows)
            values.append(value)
    return np.concatenate(docs), np.concatenate(values)


def bin_list(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


# --------------------------------------------------------------------------
# distributed helpers
# --------------------------------------------------------------------------


#: Bits of the sieve below: 262,144 rows of 64, whatever the number of ids.
SIEVE_BITS = 1 << 24


def sieve(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose id may be in ids(column), before any shuffle of df.

    A bitmap of the ids' hashes, at most SIEVE_BITS / 64 rows by construction, is
    broadcast. It lets through every id of ids and a few others (more, the more
    ids there are), so an exact join follows.
    """
    slot = F.pmod(F.xxhash64(F.col(column), F.lit(17)), F.lit(SIEVE_BITS))
    bit = F.expr("shiftleft(1L, CAST(_slot % 64 AS INT))")
    marked = ids.select(slot.alias("_slot")).groupBy(F.floor(F.col("_slot") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    placed = df.withColumn("_slot", slot).withColumn("_word", F.floor(F.col("_slot") / 64))
    met = placed.join(F.broadcast(marked), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return met.select(*df.columns)


#: Edges that one task joins up by itself (16 MB of ids).
LOCAL_EDGES = 1_000_000


def components(edges: DataFrame, node: str = "node", label: str = "component") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, smallest node).

    Up to ``LOCAL_EDGES`` edges are joined up by one task. More go through
    alternating large-star and small-star rounds (Kiveris et al., 2014), each a
    partial aggregation and a join written to the shared folder. Only a row of
    counters per round reaches the driver.
    """
    current = save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if current.count() <= LOCAL_EDGES:
        return current.coalesce(1).mapInArrow(_join_up, "node long, component long").toDF(node, label)
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        down = save(down, "star")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        small = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        current = save(small, "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = current.select(F.col("a").alias(node), F.col("b").alias(label))
    return found.unionByName(found.select(F.col(label).alias(node), label).distinct())


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable node of each of n nodes joined by edges (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not pairs:
        return
    a, b = (np.concatenate(c) for c in zip(*pairs))
    ids, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = least_labels(len(ids), back[: len(a)], back[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["node", "component"])
