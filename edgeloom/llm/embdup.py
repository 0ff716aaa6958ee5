"""Embedding near-dedup by iterative quantisation (ITQ).

A rotation learned on a bounded sample turns vectors into balanced binary codes;
codes meet in multi-index Hamming tables, one per substring of ``width`` bits; pairs
that share a substring and lie within the Hamming radius of the threshold are
reranked by the exact cosine of the original vectors in double precision.

The width grows with the rows of the largest label, so that a bucket of unrelated
vectors keeps about ``BUCKET`` members, and with it the number of tables: a bit of
two vectors at angle a differs with probability a / pi, so a table finds a pair at
the threshold with probability p = (1 - a / pi)^width, and as many tables are laid
out as make (1 - p)^tables at most ``MISS``. The radius lies ``SPREAD`` deviations
above the mean distance of a pair at the threshold.

How it scales: equal vectors collapse first, with their multiplicity. A bucket
(label, table, substring) is dealt in blocks of at most ``block`` vectors. A block is
compared with itself where it lies; each pair of blocks of a larger bucket is a key of
its own, so no bucket is one task. numpy counts links and emits, per vector, a count,
and a spanning forest of the links found in the pair of blocks - never the pairs.
A pair that meets in several tables counts in the first. No bucket is capped.

Defined cases: a vector that is null, zero or holds a null or non-finite
component, or whose label or vec_id is null, links with nothing; vectors of
different lengths never link; vectors of any length are taken whole; repeated rows
(vec_id, label and vector equal) are one vector, and other rows of one vec_id share
their component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import components, save

SAMPLE = 10_000
BLOCK = 512
BUCKET = 256  # unrelated vectors aimed at in a bucket
MISS = 0.03  # share of pairs at the threshold that no table may find
SPREAD = 4.0
LEAST_WIDTH, MOST_WIDTH = 8, 24


def usable(column: str) -> F.Column:
    """The vector as doubles is non-null, finite and non-zero."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0.0), F.lit(False))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, components added in order."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        dot = dot + x * y
        aa = aa + x * x
        bb = bb + y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def centre_of(sample: np.ndarray, threshold: float) -> tuple[np.ndarray, float]:
    """(centre, cosine that a pair at the threshold has at least as seen from there).

    Bits are balanced about the mean, but seen from close by, near vectors lie at a wider
    angle: where that would cost recall (few vectors, or all of them alike), the origin stays.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    away = np.quantile(np.linalg.norm(unit - mean, axis=1), 0.05)
    seen = 1 - (1 - threshold) / max(away, 1e-9) ** 2
    return (mean, seen) if seen >= threshold - (1 - threshold) / 2 else (np.zeros(sample.shape[1]), threshold)


def learn_rotation(sample: np.ndarray, bits: int, mean: np.ndarray | None = None, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to ``bits`` dimensions): PCA, then ITQ's alternating rotation."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0) if mean is None else mean
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    if axes.shape[1] < bits:  # fewer dimensions than bits: random directions for the rest
        more = np.random.default_rng(seed).normal(size=(sample.shape[1], bits - axes.shape[1]))
        axes = np.hstack([axes, more])
    v = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        target = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(target.T @ v)
        rotation = right.T @ left.T
    return mean, axes @ rotation


def layout(rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a substring, number of tables) for a label of so many rows."""
    width = int(np.clip(np.ceil(np.log2(max(rows, 1) / BUCKET)), LEAST_WIDTH, MOST_WIDTH))
    found = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** width
    return width, max(1, int(np.ceil(np.log(MISS) / np.log1p(-min(found, 1 - 1e-9)))))


def radius(bits: int, threshold: float) -> int:
    """Hamming distance that a pair at the threshold hardly ever passes."""
    share = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return int(np.ceil(bits * share + SPREAD * np.sqrt(bits * share * (1 - share))))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(lists), -1)


def embedding_links(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    rows = vectors.select("vec_id", "label", "embedding").withColumn(
        "digest",
        F.when(
            usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(),
            F.md5(F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string"))).cast("binary")),
        ),
    )
    rows = save(rows.dropDuplicates(["vec_id", "label", "embedding"]), "emb-rows")
    good = rows.where("digest IS NOT NULL")
    least = good.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("embedding"))
    # Numbers given while the table is written: each distinct vector has its own, whatever the hashes.
    reps = save(least.withColumn("rid", F.monotonically_increasing_id()), "emb-reps")

    counts, forest = [], None
    for size in [r["d"] for r in reps.select(F.size("embedding").alias("d")).distinct().collect()]:  # vector lengths
        linked = save(_links_of(reps.where(F.size("embedding") == size), threshold, sample, block), "emb-links")
        counts.append(linked.where("other IS NULL").select("rid", "n"))
        edges = linked.where("other IS NOT NULL").select(F.col("rid").alias("a"), F.col("other").alias("b"))
        forest = edges if forest is None else forest.unionByName(edges)
    if forest is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n = counts[0]
    for more in counts[1:]:
        n = n.unionByName(more)
    n = n.groupBy("rid").agg(F.sum("n").alias("n"))
    classes = components(forest)
    classed = reps.select("rid", "label", "digest", "rep", "copies").join(n, "rid", "left").join(classes.withColumnRenamed("node", "rid"), "rid", "left")
    classed = classed.withColumn("class", F.coalesce("component", "rid"))
    # A component is named by its smallest vec_id, not by its smallest hash.
    names = classed.groupBy("class").agg(F.min("rep").alias("component_id"))
    classed = classed.join(names, "class").select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "digest").join(classed, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _links_of(reps: DataFrame, threshold: float, sample: int, block: int) -> DataFrame:
    """Rows (rid, n, null) that count links, and (rid, null, other) of spanning forests."""
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0]
    learned = reps.orderBy(F.xxhash64("digest", "label"), "rid").select("embedding").limit(sample).toPandas()
    learned = np.array(learned["embedding"].tolist(), dtype=np.float64)
    centre, seen = centre_of(learned, threshold)
    width, tables = layout(largest, seen)
    mean, projection = learn_rotation(learned, width * tables, centre)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(3))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            bits = (x - mean) @ projection >= 0
            code = np.packbits(bits, axis=1)
            key = bits.reshape(len(x), tables, width) @ (1 << np.arange(width))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(key.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), keys], names=["rid", "label", "copies", "embedding", "code", "keys"])

    schema = f"rid long, label {dict(reps.dtypes)['label']}, copies long, embedding {dict(reps.dtypes)['embedding']}, code binary, keys array<int>"
    coded = save(reps.select("rid", "label", "copies", "embedding").mapInArrow(encode, schema), "emb-codes")
    # Buckets are found by ids alone; vectors follow only into buckets with company.
    bucket = ["label", "t", "key"]
    slots = coded.select("rid", "label", F.posexplode("keys").alias("t", "key"))
    sizes = slots.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").select(*bucket, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = slots.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("rid", F.lit(11)), F.col("blocks")).cast("int"))
    places = met.groupBy("rid").agg(F.collect_list(F.struct("t", "key", "block", "blocks")).alias("places"))
    placed = coded.join(places, "rid").select("label", "rid", "copies", "code", "embedding", F.explode("places").alias("p")).select("label", "p.*", "rid", "copies", "code", "embedding")
    packed = placed.groupBy(*bucket, "block", "blocks").agg(F.collect_list(F.struct("rid", "copies", "code", "embedding")).alias("x"))
    packed = save(packed, "emb-blocks")
    within = radius(width * tables, seen)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left = batch.column(1)[i].values
                right = batch.column(2)[i].values if batch.num_columns > 2 else left
                out = _link_blocks(int(batch.column(0)[i].as_py()), batch.num_columns == 2, left, right, threshold, width, within)
                if out is not None:
                    yield out

    result = "rid long, n long, other long"
    alone = packed.select("t", "x").mapInArrow(link, result)
    several = packed.where("blocks > 1")
    one = several.select(*bucket, F.col("block").alias("i"), F.explode(F.expr("filter(sequence(block, blocks - 1), j -> j > block)")).alias("j"), "x")
    two = several.select(*bucket, F.explode(F.expr("filter(sequence(0, block), i -> i < block)")).alias("i"), F.col("block").alias("j"), F.col("x").alias("y"))
    pairs = one.join(two, [*bucket, "i", "j"]).select("t", "x", "y").mapInArrow(link, result)
    return alone.unionByName(pairs)


def _link_blocks(table: int, same: bool, left: pa.StructArray, right: pa.StructArray, threshold: float, width: int, within: int) -> pa.RecordBatch | None:
    """Links between two blocks of a bucket of table ``table`` (from 0), or inside one."""

    def side(s):
        code = np.frombuffer(b"".join(s.field(2).to_pylist()), np.uint8).reshape(len(s), -1)
        padded = np.zeros((len(s), -(-code.shape[1] // 8) * 8), np.uint8)
        padded[:, : code.shape[1]] = code
        return s.field(0).to_numpy(), s.field(1).to_numpy(), code, padded.view(np.uint64), _matrix(s.field(3))

    a_id, a_copies, a_code, a_words, a = side(left)
    b_id, b_copies, b_code, b_words, b = side(right)
    distance = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a_words.shape[1]):
        distance += np.bitwise_count(a_words[:, k, None] ^ b_words[None, :, k])
    i, j = np.nonzero(distance <= within)
    if same:
        i, j = i[i < j], j[i < j]
    if len(i) and table:
        keys = [np.unpackbits(c, axis=1)[:, : table * width].reshape(len(c), table, width) @ (1 << np.arange(width)) for c in (a_code, b_code)]
        early = np.concatenate([(keys[0][i[k : k + 100_000]] == keys[1][j[k : k + 100_000]]).any(axis=1) for k in range(0, len(i), 100_000)])
        i, j = i[~early], j[~early]
    if len(i):
        true = np.concatenate([exact_cosine(a[i[k : k + 100_000]], b[j[k : k + 100_000]]) >= threshold for k in range(0, len(i), 100_000)])
        i, j = i[true], j[true]
    if not len(i):
        return None
    ids, back = np.unique(np.concatenate([a_id, b_id]), return_inverse=True)
    x, y = back[: len(a_id)][i], back[len(a_id) :][j]
    copies = np.zeros(len(ids), np.int64)
    copies[back] = np.concatenate([a_copies, b_copies])
    n = np.bincount(x, weights=copies[y], minlength=len(ids)) + np.bincount(y, weights=copies[x], minlength=len(ids))
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    met = np.flatnonzero(n > 0)
    joined = met[root[met] != met]
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([ids[met], ids[joined]])),
            pa.concat_arrays([pa.array(n[met].astype(np.int64)), none(len(joined))]),
            pa.concat_arrays([none(len(met)), pa.array(ids[root[joined]])]),
        ],
        names=["rid", "n", "other"],
    )
