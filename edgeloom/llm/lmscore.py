"""Stupid-backoff language-model scores of every document under all the others.

Counts of 1- to 3-grams over the whole corpus, less the document's own, score
each word: count(w1 w2 w3) / count(w1 w2) where that trigram occurs elsewhere,
else 0.4 times the bigram score, else 0.16 times the word's share (a word that
occurs nowhere else counts once). The first words of a document use what
history there is. Logarithms (base 10) are rounded to whole millionths, so that
sums do not depend on their order.

The relational plan - n-gram rows, count tables partitioned by hash, a join
back, a sum per document - runs on packed rows: a block of documents sends each
distinct n-gram once to the partition of its hash; a partition adds up the
counts of all blocks and answers each block in the order it asked; the block
then sums its documents. A partition or a block is one task's work of bounded
size, and a frequent n-gram costs one entry per block, not one per occurrence.

N-grams are known by about 53 bits of hash (48 kept, the rest by partition).

Defined cases: null or blank text has no words and a null score; rows that
share a doc_id are scored separately, each as a document; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import mix64, word_pieces
from edgeloom.llm.mixing import word_count

ORDER = 3
BACKOFF = 0.4
BLOCK_WORDS = 1_000_000
WORDS_PER_PART = 1_000_000

_G = np.uint64(0xD6E8FEB86659FD93)


class _Block:
    """Local vocabulary and n-gram numbering of a run of documents; rebuilt alike from its parts."""

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.vocabulary, self.ids, self.counts = vocabulary, ids.astype(np.int64), counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        #: per order: words that end such an n-gram, its number there, distinct keys
        self.ends, self.number, self.keys = [], [], []
        size, code, hashed = max(len(vocabulary), 1), None, None
        for n in range(1, ORDER + 1):
            ends = np.flatnonzero(at >= n - 1)
            if n == 1:
                number, keys = self.ids, vocabulary
                code = number
                hashed = vocabulary
            else:
                full = code[ends - 1] * size + self.ids[ends]
                distinct, number = np.unique(full, return_inverse=True)
                hashed = hashed[distinct // size] * _G + vocabulary[distinct % size]
                keys = hashed
                code = np.zeros(len(ids), np.int64)
                code[ends] = number
            self.ends.append(ends)
            self.number.append(number)
            self.keys.append(mix64(keys + np.uint64(n)))

    def own(self, n: int) -> np.ndarray:
        """For each n-gram end: how often its document has that n-gram."""
        number, ends = self.number[n - 1], self.ends[n - 1]
        size = max(len(self.keys[n - 1]), 1)
        _, back, times = np.unique(self.doc[ends] * size + number, return_inverse=True, return_counts=True)
        return times[back]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, list, _Block]]:
    """(name, doc ids, null flags, block) for runs of rows of about BLOCK_WORDS words."""
    for batch in batches:
        hashes, counts, rows, name = [], [], [], hashlib.blake2b(digest_size=8)

        def flush():
            vocabulary, ids = np.unique(np.concatenate(hashes), return_inverse=True)
            lo, hi = rows[0], rows[-1]
            part = batch.column(0).slice(lo, hi - lo)
            valid = part.is_valid().to_numpy(zero_copy_only=False)
            number = part.fill_null(0).to_numpy(zero_copy_only=False)
            name.update(number.tobytes())
            return int.from_bytes(name.digest(), "little", signed=True), number, valid, _Block(vocabulary, ids, np.concatenate(counts))

        for lo, hi, words in word_pieces(batch.column(1)):
            rows += [lo, hi]
            found = words.hashes()
            hashes.append(found)
            counts.append(words.counts)
            name.update(found.tobytes())
            name.update(words.counts.tobytes())
            if sum(map(len, hashes)) >= BLOCK_WORDS:
                yield flush()
                hashes, counts, rows, name = [], [], [], hashlib.blake2b(digest_size=8)
        if rows:
            yield flush()


def _pack(numbers: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each number, byte by byte in planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _tail(keys: np.ndarray) -> bytes:
    """The upper six bytes of each key, which ascend: as differences."""
    return _pack(np.diff(keys >> np.uint64(16), prepend=np.uint64(0)), 6)


def _untail(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, 6))


def _split(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions sorted by partition and key, bounds of each partition)."""
    home = keys % np.uint64(parts)
    tail = keys >> np.uint64(16)
    order = np.argsort(home << np.uint64(48) | tail, kind="stable") if parts <= 1 << 16 else np.lexsort((tail, home))
    return order, np.searchsorted(home[order], np.arange(parts + 1))


def _ask(docs: DataFrame, parts: int) -> DataFrame:
    """(part, kind, block, keys, counts): each block's distinct n-grams by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, block in _blocks(batches):
            for n in range(1, ORDER + 1):
                keys = block.keys[n - 1]
                times = np.bincount(block.number[n - 1], minlength=len(keys))
                order, bounds = _split(keys, parts)
                used = np.flatnonzero(np.diff(bounds))
                slices = [order[bounds[p] : bounds[p + 1]] for p in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)),
                        pa.array(np.full(len(used), n, np.int32)),
                        pa.array(np.full(len(used), name, np.int64)),
                        pa.array([_tail(keys[s]) for s in slices], pa.binary()),
                        pa.array([_pack(times[s], 4) for s in slices], pa.binary()),
                    ],
                    names=["part", "kind", "block", "keys", "counts"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "part int, kind int, block long, keys binary, counts binary")


def _answer(table: pa.Table) -> pa.Table:
    """Counts over all blocks, for each row in its own order."""
    kinds = table.column("kind").to_numpy()
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    out: list = [None] * len(kinds)
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        asked = [_untail(keys[r]) for r in rows]
        _, back = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([_unpack(counts[r], 4) for r in rows])).astype(np.int64)
        lo = 0
        for r, a in zip(rows, asked):
            out[r] = _pack(total[back[lo : lo + len(a)]], 5)
            lo += len(a)
    none = pa.nulls(len(kinds), pa.binary())
    return pa.table([table.column("block"), table.column("kind"), table.column("part"), pa.array(out, pa.binary()), none, none], names=["block", "kind", "part", "data", "vocabulary", "docs"])


def _hold(docs: DataFrame) -> DataFrame:
    """The blocks themselves (kind 0): word numbers, vocabulary, documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, valid, block in _blocks(batches):
            held = np.stack([ids, valid.astype(np.int64), block.counts.astype(np.int64)]).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([_pack(block.ids, 4)], pa.binary()), pa.array([block.vocabulary.astype("<u8").tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary())],
                names=["block", "kind", "part", "data", "vocabulary", "docs"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "block long, kind int, part int, data binary, vocabulary binary, docs binary")


def _scores(total: int, parts: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("millionths", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        kinds, places = table.column("kind").to_numpy(), table.column("part").to_numpy()
        data = table.column("data").to_pylist()
        answers = {(int(k), int(p)): d for k, p, d in zip(kinds, places, data) if k}
        out = []
        for row in np.flatnonzero(kinds == 0):
            ids, valid, counts = np.frombuffer(table.column("docs")[int(row)].as_py(), "<i8").reshape(3, -1)
            block = _Block(np.frombuffer(table.column("vocabulary")[int(row)].as_py(), "<u8"), _unpack(data[row], 4), counts)
            found = []
            for n in range(1, ORDER + 1):
                keys = block.keys[n - 1]
                order, bounds = _split(keys, parts)
                values = np.zeros(len(keys), np.int64)
                for p in np.flatnonzero(np.diff(bounds)):
                    if (n, int(p)) not in answers:
                        raise ValueError("a block of documents changed between two readings of the input")
                    values[order[bounds[p] : bounds[p + 1]]] = _unpack(answers[n, int(p)], 5)
                found.append(values)
            out.append(_score_block(block, found, ids, valid, total))
        if not out:
            return schema.empty_table()
        return pa.concat_tables(out)

    return run


def _score_block(block: _Block, found: list[np.ndarray], ids, valid, total: int) -> pa.Table:
    words = len(block.ids)
    elsewhere = []
    for n in range(1, ORDER + 1):
        c = np.zeros(words, np.int64)
        c[block.ends[n - 1]] = found[n - 1][block.number[n - 1]] - block.own(n)
        elsewhere.append(c)
    rest = np.maximum(total - block.counts, 1)[block.doc]
    log = np.log10(np.maximum(elsewhere[0], 1) / rest)
    for n in range(2, ORDER + 1):
        ends = block.ends[n - 1]
        c, context = elsewhere[n - 1][ends], elsewhere[n - 2][ends - 1]
        seen = c > 0
        lower = log[ends] + np.log10(BACKOFF)
        log[ends] = np.where(seen, np.log10(np.maximum(c, 1) / np.maximum(context, 1)), lower)
    millionths = np.bincount(block.doc, weights=np.rint(log * 1e6), minlength=len(ids)).astype(np.int64)
    return pa.table(
        [pa.array(ids, pa.int64(), mask=valid == 0), pa.array(block.counts.astype(np.int64)), pa.array(millionths)], names=["doc_id", "n_words", "millionths"]
    )


def score_documents(docs: DataFrame, words_per_part: int = WORDS_PER_PART) -> DataFrame:
    """(doc_id, n_words, log10_score, log10_per_word) per row of docs."""
    total = docs.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    parts = int(total // words_per_part) + 1
    answers = _ask(docs, parts).groupBy("part").applyInArrow(_answer, "block long, kind int, part int, data binary, vocabulary binary, docs binary")
    rows = answers.unionByName(_hold(docs)).groupBy("block").applyInArrow(_scores(int(total), parts), "doc_id long, n_words long, millionths long")
    log = F.when(F.col("n_words") > 0, F.col("millionths") / 1e6)
    return rows.select("doc_id", "n_words", F.round(log, 3).alias("log10_score"), F.round(log / F.col("n_words"), 6).alias("log10_per_word"))
