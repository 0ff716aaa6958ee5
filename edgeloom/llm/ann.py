"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of ``BOOKS`` full-dimensional
codebooks, trained stage by stage on residuals of a bounded sample. Encoding is
a beam search over the stages. The index keeps codes, the norm of the
reconstruction and of the residual, and the original vector. A query scores
every code through lookup tables (one inner product per codeword) over the
stored norm; the best are reranked by exact cosine, then every row whose score
could still reach the fifth best, by ``MARGIN`` deviations of its own
quantisation error, is reranked too - so groups of near-equal vectors are not
cut by the first shortlist.

How it scales: every row is encoded in one pass. Queries are a table as well: index
blocks of about ``INDEX_BLOCK`` rows and query blocks of about ``QUERY_BLOCK`` meet pair
by pair, each pair a key of its own, in one job; nothing passes the driver but the
sample and the codebooks. A pair of blocks keeps k rows a query.

Defined cases: vectors that are null, zero, of another length than most of the
sample, or hold null or non-finite components, and rows with a null vec_id,
take no part; vectors of any length are taken whole; rows that repeat a vec_id count once (at their best score);
ties go to the smaller vec_id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import save
from edgeloom.llm.embdup import _matrix, exact_cosine, usable

BOOKS = 8
WORDS = 256
BEAM = 8
SAMPLE = 10_000
SHORTLIST = 200
MARGIN = 3.0
QUERY_BLOCK = 4096
INDEX_BLOCK = 20_000
CHUNK = 64  # queries scored at once


def train_codebooks(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """(books, words, dimensions): k-means on the residuals that the books before leave."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32)
    out = []
    for _ in range(books):
        centres = rest[rng.permutation(len(rest))[:words]]
        if len(centres) < words:
            centres = np.vstack([centres, np.zeros((words - len(centres), rest.shape[1]), np.float32)])
        for _ in range(rounds):
            near = _nearest(rest, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            counts = np.bincount(near, minlength=words)
            filled = counts > 0
            centres[filled] = sums[filled] / counts[filled, None]
        out.append(centres)
        rest = rest - centres[_nearest(rest, centres)]
    return np.stack(out)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (((centres**2).sum(axis=1) - 2 * rows @ centres.T)).argmin(axis=1)


def encode(rows: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) by beam search: the ``beam`` best partial sums go on at each book."""
    n, d = rows.shape
    codes = np.zeros((n, 1, 0), dtype=np.uint8)
    rest = rows[:, None, :].astype(np.float32)
    for book in codebooks:
        kept = rest.shape[1]
        cost = (rest**2).sum(axis=2, keepdims=True) + (book**2).sum(axis=1) - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, kept, -1)
        cost = cost.reshape(n, -1)
        go = min(beam, cost.shape[1])
        best = np.argpartition(cost, go - 1, axis=1)[:, :go]
        parent, word = best // len(book), best % len(book)
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
    last = (rest**2).sum(axis=2).argmin(axis=1)
    return codes[np.arange(n), last]


def decode(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, i]] for i, book in enumerate(codebooks))


def build_index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray | None]:
    """(rows vec_id, embedding, code, norm, error; codebooks) over all usable vectors."""
    rows = vectors.select("vec_id", "embedding").where(usable("embedding") & F.col("vec_id").isNotNull())
    learned = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    schema = f"vec_id long, embedding {dict(vectors.dtypes)['embedding']}, code binary, norm float, error float"
    if not len(learned):
        return vectors.sparkSession.createDataFrame([], schema), None
    sizes = learned["embedding"].map(len)
    size = int(sizes.mode()[0])
    x = np.array(learned["embedding"][sizes == size].tolist(), dtype=np.float64)
    codebooks = train_codebooks(x / np.linalg.norm(x, axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x = _matrix(part.column(1))
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                codes = encode(x, codebooks)
                back = decode(codes, codebooks)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(np.linalg.norm(back, axis=1).astype(np.float32)),
                        pa.array(np.linalg.norm(x - back, axis=1).astype(np.float32)),
                    ],
                    names=["vec_id", "embedding", "code", "norm", "error"],
                )

    return save(rows.where(F.size("embedding") == size).mapInArrow(run, schema), "ann-index"), codebooks


def search_block(q_ids, queries, ids, vectors, codes, norms, errors, codebooks, k, shortlist, margin):
    """Exact best k of one block of rows for each query: (query, row id, cosine) arrays.

    Each query reranks the ``shortlist`` rows that score best, then all rows whose score
    could still pass the k-th of those within the margin.
    """
    unit = (queries / np.linalg.norm(queries, axis=1, keepdims=True)).astype(np.float32)
    spread = (margin * errors / np.sqrt(vectors.shape[1])).astype(np.float32)
    scale = 1 / np.maximum(norms, 1e-12).astype(np.float32)
    columns = [np.ascontiguousarray(codes[:, b]) for b in range(codes.shape[1])]
    n = min(max(shortlist, k + 1), len(ids))
    out_q, out_i, out_s = [], [], []
    for lo in range(0, len(q_ids), CHUNK):
        tables = np.einsum("qd,bwd->bqw", unit[lo : lo + CHUNK], codebooks)
        score = np.zeros((tables.shape[1], len(ids)), np.float32)
        for b, column in enumerate(columns):
            score += tables[b][:, column]
        score *= scale
        for q, row in zip(range(lo, lo + len(score)), score):
            own = np.flatnonzero(ids == q_ids[q])
            row[own] = -np.inf
            first = np.argpartition(-row, n - 1)[:n]
            exact = _cosines(queries[q], vectors[first])
            exact[np.isin(first, own)] = -np.inf
            if n > k and n < len(ids):
                rest = row + spread >= np.sort(exact)[-k]
                rest[first] = False
                rest[own] = False
                rest = np.flatnonzero(rest)
                if len(rest):
                    first = np.concatenate([first, rest])
                    exact = np.concatenate([exact, _cosines(queries[q], vectors[rest])])
            order = np.lexsort((ids[first], -exact))
            taken, seen = [], set()
            for o in order:
                if not np.isfinite(exact[o]) or len(taken) == k:
                    break
                if ids[first[o]] not in seen:
                    seen.add(ids[first[o]])
                    taken.append(o)
            out_q.append(np.full(len(taken), q_ids[q]))
            out_i.append(ids[first[taken]])
            out_s.append(exact[taken])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def _cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return exact_cosine(np.broadcast_to(query, rows.shape), rows)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, shortlist: int = SHORTLIST, margin: float = MARGIN, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id ``every`` divides."""
    index, codebooks = build_index(vectors)
    spark = vectors.sparkSession
    if codebooks is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = index.agg(F.count("*").alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    index_blocks, query_blocks = int(sizes["rows"] // index_block) + 1, int(sizes["queries"] // query_block) + 1
    wanted = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = wanted.select(block(query_blocks, 1).alias("qb"), all_of(index_blocks).alias("ib"), "vec_id", "embedding")
    # A vec_id that repeats is one block's, so its rows count once there.
    rows = index.select(block(index_blocks, 2).alias("ib"), all_of(query_blocks).alias("qb"), "vec_id", "embedding", "code", "norm", "error")
    shared = spark.sparkContext.broadcast(codebooks)  # BOOKS x WORDS x dimensions numbers
    # The shortlist is dealt over the blocks, with room for chance.
    mean = shortlist / index_blocks
    part = int(np.ceil(mean + 3 * np.sqrt(mean))) if index_blocks > 1 else shortlist

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not asked.num_rows or not rows.num_rows:
            return schema.empty_table()
        column = lambda t, c: t.column(c).combine_chunks()
        whole = lambda c: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        got = search_block(
            column(asked, "vec_id").to_numpy(), _matrix(whole(column(asked, "embedding"))), column(rows, "vec_id").to_numpy(), _matrix(whole(column(rows, "embedding"))),
            codes, column(rows, "norm").to_numpy(), column(rows, "error").to_numpy(), shared.value, k, part, margin,
        )
        return pa.table([pa.array(c, f.type) for c, f in zip(got, schema)], schema=schema)

    found = asked.groupBy("ib", "qb").cogroup(rows.groupBy("ib", "qb")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
