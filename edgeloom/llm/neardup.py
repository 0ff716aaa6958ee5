"""Near-duplicate documents by BagMinHash.

A document is the multiset of its runs of ``n`` words. Its signature comes from
Poisson processes: the weight axis of a shingle is cut into dyadic intervals
(0,1], (1,2], (2,4], ...; each interval carries one process whose points arrive
in order of time at a rate equal to its length, and a point is placed in the
interval by successive halvings (bits of a hash), so it counts only where the
shingle's weight reaches it. Each of the m signature positions keeps its
earliest point; two signatures agree at a position with probability equal to
the weighted Jaccard similarity. Shingles stop drawing points once the next one
comes later than every kept one, so most draw one or two.

Signatures are banded; documents that share a band are candidates; candidates
are verified by the exact multiset overlap; classes are connected components.

How it scales: equal texts collapse first (partial aggregation), so a group of
copies is one representative. Each member of a band bucket is compared with the
bucket's smallest and largest member, found by aggregation; the best of its
leaders over all bands is verified - linear in the bucket. Only where a bucket
still holds several classes are its members outside the largest class compared
with the others: by signature first, and those with a likely partner then by
their bags, through an index of the block in numpy. Blocks are of bounded size;
what leaves them is one link per member and foreign class, never a list of
pairs. As every candidate pair across classes is looked at, one pass is whole.

Defined cases: documents without words, and rows with a null doc_id, are kept,
each a class of its own; a document of fewer than n words is one shingle; rows
that share a doc_id count as one document and share their class, whatever their
texts; texts of any length are taken whole; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import components, mix64, save, shingles, sieve, word_pieces

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 16
ROWS = 4  # positions a band; 16 bits each, so a band's key is one long
POSITIONS = BANDS * ROWS
BLOCK_SIGNATURES = 4096  # members of a bucket compared with as many others at a time
BLOCK = 512
ROWS_PER_GROUP = 4000  # signatures handled by one call
BAGS_PER_GROUP = 500

_ROUND = np.uint64(0xBF58476D1CE4E5B9)
_LONG = (1 << 64) - 1


def least_agreement(threshold: float) -> int:
    """Positions that must agree before a pair is verified: 3.8 deviations below what a
    pair at the threshold shows on average."""
    return max(1, int(np.ceil(POSITIONS * threshold - 3.8 * np.sqrt(POSITIONS * threshold * (1 - threshold)))))


def counted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, weight), sorted by text and shingle."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], value[heads], np.diff(np.append(heads, len(doc)))


def bag_minhash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, positions: int = POSITIONS) -> np.ndarray:
    """(texts, positions) 64-bit names of the earliest points; a text without shingles has zeros."""
    # Processes: one for (0,1], then one for each (2^k, 2^(k+1)] that the weight enters.
    docs, seeds, rates, limits = [doc], [mix64(value)], [np.ones(len(doc), np.uint64)], [weight.astype(np.uint64)]
    low = 1
    inside = np.flatnonzero(weight > low)
    while len(inside):
        docs.append(doc[inside])
        seeds.append(mix64(value[inside] ^ mix64(np.full(len(inside), low, np.uint64))))
        rates.append(np.full(len(inside), low, np.uint64))
        limits.append(weight[inside].astype(np.uint64) - np.uint64(low))
        low *= 2
        inside = inside[weight[inside] > low]
    row, seed, rate, limit = (np.concatenate(c) for c in (docs, seeds, rates, limits))
    time = np.zeros(len(row))
    first = np.full(texts * positions, np.inf)
    name = np.zeros(texts * positions, dtype=np.uint64)
    turn = 0
    while len(row):
        turn += 1
        point = mix64(seed + np.uint64(turn * int(_ROUND) & _LONG))
        wait = -np.log(((point >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
        time = time + wait / (positions * rate.astype(np.float64))
        mark = mix64(point)
        at = row * positions + (mark % np.uint64(positions)).astype(np.int64)
        # Place within the interval: as many halvings as the rate has bits.
        counts = ((mark >> np.uint64(32)) & (rate - np.uint64(1))) < limit
        hit = at[counts]
        np.minimum.at(first, hit, time[counts])
        won = first[hit] == time[counts]
        name[hit[won]] = mark[counts][won]
        latest = first.reshape(texts, positions).max(axis=1)
        go = time < latest[row]
        row, seed, rate, limit, time = row[go], seed[go], rate[go], limit[go], time[go]
    return name.reshape(texts, positions)


def band_keys(names: np.ndarray) -> np.ndarray:
    """(texts, bands) longs: each packs the 16-bit values of the band's positions."""
    return (mix64(names) >> np.uint64(48)).astype("<u2").reshape(len(names), -1).view("<i8")


def lanes(keys: np.ndarray) -> np.ndarray:
    """The 16-bit values behind an array of band keys: (texts, positions)."""
    return np.ascontiguousarray(keys).view("<u2")


def signatures(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, sig) per row with words: MD5 of the words joined by a space, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in word_pieces(batch.column(1)):
                doc, value = shingles(words, n)
                keys = band_keys(bag_minhash(*counted(doc, value), hi - lo))
                rows = np.flatnonzero(words.counts > 0)
                digests = [_digest(words, i) for i in rows]
                keys = keys[rows]
                sig = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), pa.array(digests, pa.binary()), sig], names=["doc_id", "digest", "sig"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, sig array<long>")


def _digest(words, i: int) -> bytes:
    """MD5 of text i's words joined by a space."""
    return hashlib.md5(b" ".join(words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split())).digest()


def bags(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, bag): sorted 64-bit units, one per shingle and occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in word_pieces(batch.column(1)):
                doc, value = shingles(words, n)
                doc, value, weight = counted(doc, value)
                occurrence = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                doc, value = np.repeat(doc, weight), np.repeat(value, weight)
                again = occurrence > 0
                value[again] = mix64(value[again] + occurrence[again].astype(np.uint64) * _ROUND)
                order = np.lexsort((value, doc))
                value = value[order]
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                out = [value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                digests = pa.array([_digest(words, i) for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), digests, pa.array(out, pa.binary())], names=["doc_id", "digest", "bag"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, bag binary")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct units."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = len(a) - 1
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def _verify(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                keep.append(overlap(x, y) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(units.select(F.col("doc_id").alias("a"), F.col("bag").alias("x")), "a")
    joined = joined.join(units.select(F.col("doc_id").alias("b"), F.col("bag").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _agreements(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, leader, agree): positions at which the two signatures agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (lanes(batch.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(n, -1) for c in (2, 3))
            agree = (x == y).sum(axis=1).astype(np.int32) if n else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree)], names=["rep", "leader", "agree"])

    joined = pairs.join(reps.select("rep", F.col("sig").alias("x")), "rep")
    joined = joined.join(reps.select(F.col("rep").alias("leader"), F.col("sig").alias("y")), "leader")
    return joined.select("rep", "leader", "x", "y").mapInArrow(run, "rep long, leader long, agree int")


def _in_blocks(members: DataFrame, column: str, per_group: int, block: int) -> DataFrame:
    """members (band, bkey, rep, label, column) dealt to pairs of blocks of their bucket:
    x holds members outside the bucket's largest class, y all; ``g`` names a task-sized
    group of block pairs."""
    bucket = ["band", "bkey"]
    sizes = members.groupBy(*bucket, "label").agg(F.count("*").alias("n"))
    whole = sizes.groupBy(*bucket).agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"))
    whole = whole.select(*bucket, F.col("main.label").alias("main"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    groups = int(members.count() // per_group) + 1
    placed = members.join(whole, bucket).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    kept = [*bucket, "rep", "label", column]
    x = placed.where("label <> main").select(*kept, F.col("block").alias("xb"), each.alias("yb"), F.lit(True).alias("few"))
    y = placed.select(*kept, each.alias("xb"), F.col("block").alias("yb"), F.lit(False).alias("few"))
    both = x.unionByName(y)
    return both.withColumn("g", F.pmod(F.xxhash64(*bucket, "xb", "yb"), F.lit(groups)))


def _block_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) of each pair of blocks in a group that has both."""
    keys = [table.column(c).to_numpy() for c in ("band", "bkey", "xb", "yb")]
    few = table.column("few").to_numpy()
    order = np.lexsort((few, *keys[::-1]))
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    for rows in np.split(order, np.flatnonzero(new)):
        x = rows[few[rows]]
        if len(x):
            yield x, rows[~few[rows]]


def _likely(least: int):
    """(band, bkey, rep) of members with a likely partner in another class of the bucket.

    A pair that shares several bands is looked at in the first.
    """

    def run(table: pa.Table) -> pa.Table:
        return _likely_of(table, least)

    return run


def _likely_of(table: pa.Table, least: int) -> pa.Table:
    table = table.combine_chunks()
    rep, label, band = (table.column(c).to_numpy() for c in ("rep", "label", "band"))
    bkey = table.column("bkey").to_numpy()
    keys = table.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
    values = lanes(keys)
    found: list[np.ndarray] = []
    for x, y in _block_pairs(table):
        for lo in range(0, len(x), 64):
            part = x[lo : lo + 64]
            agree = np.zeros((len(part), len(y)), dtype=np.int16)
            for p in range(values.shape[1]):
                agree += values[part, p, None] == values[None, y, p]
            likely = (agree >= least) & (label[part, None] != label[None, y])
            i, j = np.nonzero(likely)
            first = int(band[part[0]])
            late = (keys[part[i], :first] == keys[y[j], :first]).any(axis=1)
            found += [np.unique(part[i[~late]]), np.unique(y[j[~late]])]
    rows = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pa.table([pa.array(band[rows]), pa.array(bkey[rows]), pa.array(rep[rows])], names=["band", "bkey", "rep"])


def _linked(threshold: float):
    """(a, b): for each x member and each other class with a member similar enough, the most similar one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, label = (table.column(c).to_numpy() for c in ("rep", "label"))
        bags = [np.frombuffer(v, np.uint64) for v in table.column("bag").to_pylist()]
        a_out, b_out = [], []
        for x, y in _block_pairs(table):
            sizes = np.array([len(bags[r]) for r in y])
            unit = np.concatenate([bags[r] for r in y])
            order = np.argsort(unit, kind="stable")
            unit, owner = unit[order], np.repeat(np.arange(len(y)), sizes)[order]
            for r in x:
                lo, hi = np.searchsorted(unit, bags[r], "left"), np.searchsorted(unit, bags[r], "right")
                n = hi - lo
                hits = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                both = np.bincount(owner[hits], minlength=len(y))
                similar = both / np.maximum(len(bags[r]) + sizes - both, 1)
                ok = np.flatnonzero((similar >= threshold) & (label[y] != label[r]))
                ok = ok[np.lexsort((rep[y[ok]], -similar[ok]))]
                _, one = np.unique(label[y[ok]], return_index=True)
                a_out += [rep[r]] * len(one)
                b_out += rep[y[ok[one]]].tolist()
        return pa.table([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], schema=schema)

    return run


def classes_of(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every document with words, one row per doc_id."""
    signed = save(signatures(docs, n), "near-signatures")
    reps = save(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "near-reps")
    slots = reps.select("rep", F.posexplode("sig").alias("band", "bkey"))
    leaders = slots.groupBy("band", "bkey").agg(F.min("rep").alias("l1"), F.max("rep").alias("l2")).where("l1 < l2")
    shared = save(slots.join(leaders, ["band", "bkey"]), "near-slots")
    ids = shared.select(F.col("rep").alias("doc_id")).distinct()
    # The exact join comes after the bags, or the optimizer would move it before the sieve.
    sieved = bags(sieve(docs.select("doc_id", "text"), ids, "doc_id"), n)
    # One bag per representative text; rows that share a doc_id may represent several.
    texts = ids.join(reps.select(F.col("rep").alias("doc_id"), "digest"), "doc_id")
    units = save(sieved.join(texts, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).drop("digest"), "near-bags")

    led = shared.select("rep", F.explode(F.array("l1", "l2")).alias("leader")).where("rep <> leader").distinct()
    scored = _agreements(led, reps).where(F.col("agree") >= least_agreement(threshold))
    best = scored.groupBy("rep").agg(F.min(F.struct((-F.col("agree")).alias("n"), "leader")).alias("m"))
    pairs = best.select(F.least("rep", "m.leader").alias("a"), F.greatest("rep", "m.leader").alias("b")).distinct()
    edges = save(_verify(pairs, units, threshold), "near-edges")

    # Buckets that still hold several classes.
    classes = save(components(edges), "near-classes")
    labelled = shared.select("band", "bkey", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = save(labelled.select("band", "bkey", "rep", F.coalesce("component", "rep").alias("label")), "near-labels")
    several = labelled.groupBy("band", "bkey").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "bkey")
    members = labelled.join(several, ["band", "bkey"])
    signed_members = save(members.join(reps.select("rep", "sig"), "rep"), "near-open")
    likely = _in_blocks(signed_members, "sig", ROWS_PER_GROUP, BLOCK_SIGNATURES).groupBy("g").applyInArrow(_likely(least_agreement(threshold)), "band int, bkey long, rep long").distinct()
    bagged = members.join(likely, ["band", "bkey", "rep"]).join(units.withColumnRenamed("doc_id", "rep"), "rep")
    bagged = save(bagged.select("band", "bkey", "rep", "label", "bag"), "near-likely")
    fresh = save(_in_blocks(bagged, "bag", BAGS_PER_GROUP, BLOCK).groupBy("g").applyInArrow(_linked(threshold), "a long, b long"), "near-edges")
    edges = edges.unionByName(fresh)

    # Documents by way of their text's representative; texts that share a doc_id are one document.
    owned = save(signed.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest").select("doc_id", "rep"), "near-owned")
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    same = owned.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    classes = components(edges.unionByName(same)).withColumnRenamed("node", "rep")
    classed = owned.join(classes, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    return classed.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept) per row: class_id is the smallest doc_id of the class."""
    joined = docs.select("doc_id").join(classes_of(docs, n, threshold), "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return joined.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs less every document whose class has a smaller doc_id."""
    drop = classes_of(docs, n, threshold).where("doc_id <> class_id").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
