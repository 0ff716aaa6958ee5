"""Substring dedup by super-k-mers.

A window is ``window`` consecutive words of one document. Its minimiser is the
smallest hash of its runs of ``gram`` words: a function of the window's words
alone, so equal windows meet under one minimiser. Consecutive windows with the
same minimiser (a super-k-mer) travel as one packed string to the minimiser's
bucket, where sorting finds for every window the smallest doc_id it starts in.

How it scales: a first pass emits one slim row per super-k-mer, without text;
minimisers seen in one document only drop out, so only text that can repeat
travels. Buckets are sized by windows. A minimiser with more than ``hot``
windows never becomes one task: its windows go, one row each, through a
partial aggregation by digest and a join that Spark may split.

Identity of windows: inside buckets two independent 64-bit hashes sort them and
each match is checked against the bytes of the words (should two different
windows hash alike, that group is compared word by word); windows of hot
minimisers are matched by the 128-bit BLAKE2b digest of their words.

Defined cases: null text has no words; a document shorter than the window keeps
all; texts of any length are handled whole; rows that share a doc_id never
remove each other's words; rows with a null doc_id neither remove nor lose
words; an empty table gives an empty result; other columns, whatever their
names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import Words, gram_hashes, inside_docs, mix64, save, word_pieces

WINDOW = 50
GRAM = 12
#: Longest run of windows in one packed string.
RUN = 256
#: Windows of one minimiser above which they are counted one by one; a bucket in
#: one task holds about as many, more by at most one minimiser's.
HOT = 150_000
WINDOWS_PER_BUCKET = 150_000


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash that tells apart rows of one doc_id."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < width:
        values = np.minimum(values[: len(values) - (width - done)], values[width - done :])
    return values


def super_kmers(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text index, minimiser, first window's word in its text, windows) per super-k-mer."""
    none = (np.zeros(0, np.int64),) * 4
    if len(words) < window:
        return none
    valid = np.flatnonzero(inside_docs(words.bounds, window))
    if not len(valid):
        return none
    lowest = _lowest(gram_hashes(words.hashes(), gram), window - gram + 1)[valid]
    doc = words.doc_of()[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (lowest[1:] != lowest[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    # A long run (one passage over and over) is cut: strings stay short.
    within = np.arange(len(valid)) - np.repeat(heads, np.diff(np.append(heads, len(valid))))
    heads = np.flatnonzero(within % RUN == 0)
    n = np.diff(np.append(heads, len(valid)))
    return doc[heads], lowest[heads].view(np.int64), valid[heads] - words.bounds[doc[heads]], n


def scan(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Two kinds of row: super-k-mers (key, doc_id, th, start, n), and one row per
    document (key null; n its words, sha the SHA-256 of its words joined by a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "th", "start", "n", "sha"]
        for batch in batches:
            ids, ths = batch.column(0), batch.column(2)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            th = ths.to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, words in word_pieces(batch.column(1)):
                doc, key, start, n = super_kmers(words, window, gram)
                row = doc + lo
                keep = known[row]
                row = row[keep]
                kmers = len(row)
                shas = []
                for a, b in zip(words.offsets[:-1], words.offsets[1:]):
                    shas.append(hashlib.sha256(b" ".join(words.data[a:b].tobytes().split())).hexdigest())
                total = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(key[keep]), pa.nulls(total, pa.int64())]),
                        pa.concat_arrays([pa.array(number[row], pa.int64()), ids.slice(lo, total)]),
                        pa.array(np.concatenate([th[row], th[lo:hi]]), pa.int64()),
                        pa.array(np.concatenate([start[keep], np.zeros(total, np.int64)]).astype(np.int32)),
                        pa.array(np.concatenate([n[keep], words.counts]), pa.int64()),
                        pa.concat_arrays([pa.nulls(kmers, pa.string()), pa.array(shas, pa.string())]),
                    ],
                    names=names,
                )

    return _keyed(docs).mapInArrow(run, "key long, doc_id long, th long, start int, n long, sha string")


def find_repeats(docs: DataFrame, kmers: DataFrame, window: int, hot: int, per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the documents that share a minimiser with another, and the
    word spans (doc_id, th, first, last + 1) that repeat a smaller doc_id's."""
    kmers = kmers.where("key IS NOT NULL")
    shared = kmers.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("c"))
    shared = shared.where("lo < hi").select("key", (F.col("c") > hot).alias("hot"))
    wanted = kmers.select("key", "doc_id", "th", "start", "n").join(shared, "key")
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n", "key", "hot")).alias("parts"))
    texts = save(_keyed(docs).join(wanted.dropDuplicates(["doc_id", "th"]), ["doc_id", "th"]).select("doc_id", "th", "text", "parts"), "sub-texts")

    totals = texts.select(F.explode("parts").alias("p")).agg(F.sum("p.n").alias("n"), F.max("p.hot").alias("hot")).first()
    buckets = max(1, int((totals["n"] or 0) // per_bucket) + 1)
    packed = _pack(texts, window, buckets)
    cold = packed.where("NOT hot").groupBy("bucket").applyInArrow(_sort_bucket(window), "doc_id long, th long, first int, last int")
    if totals["hot"]:
        cold = cold.unionByName(_count_hot(packed.where("hot"), window))
    return texts, cold


def _pack(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    schema = "bucket int, hot boolean, doc_id long, th long, start int, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            parts = lists.flatten()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            begins = ends - lists.value_lengths().to_numpy(zero_copy_only=False)
            start = parts.field(0).to_numpy(zero_copy_only=False)
            n = parts.field(1).to_numpy(zero_copy_only=False)
            key = parts.field(2).to_numpy(zero_copy_only=False)
            hot = parts.field(3).to_numpy(zero_copy_only=False)
            home = (mix64(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            ids, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, words in word_pieces(batch.column(2)):
                a, b = (int(begins[lo]), int(ends[hi - 1]))
                if a == b:
                    continue
                doc = np.repeat(np.arange(lo, hi), ends[lo:hi] - begins[lo:hi])
                first = words.bounds[doc - lo] + start[a:b]
                last = first + n[a:b] + window - 2
                data, s, e = words.data, words.starts[first], words.ends[last]
                strings = [data[i:j].tobytes() for i, j in zip(s, e)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(home[a:b]),
                        pa.array(hot[a:b].astype(bool)),
                        pa.array(ids[doc], pa.int64()),
                        pa.array(ths[doc], pa.int64()),
                        pa.array(start[a:b].astype(np.int32)),
                        pa.array(strings, pa.binary()),
                    ],
                    names=["bucket", "hot", "doc_id", "th", "start", "packed"],
                )

    return texts.mapInArrow(run, schema)


def _windows(column: pa.Array, window: int):
    """For packed strings: (string, window in it, two 64-bit fingerprints) of every
    window, and the words of all strings (one string a text)."""
    out, pieces = [], []
    for lo, hi, words in word_pieces(column):
        hashes = words.hashes()
        keep = inside_docs(words.bounds, window)
        one = gram_hashes(hashes, window)[keep]
        two = gram_hashes(words.hashes(1), window)[keep]
        at = np.flatnonzero(keep)
        doc = words.doc_of()[at]
        out.append((doc + lo, at - words.bounds[doc], one, two))
        pieces.append((lo, hi, words))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)), pieces
    return tuple(np.concatenate(c) for c in zip(*out)), pieces


def _sort_bucket(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("doc_id").to_numpy()
        starts = table.column("start").to_numpy()
        packed = table.column("packed")
        (row, at, one, two), pieces = _windows(packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed, window)
        if not len(row):
            return schema.empty_table()
        order = np.lexsort((row, ids[row], two, one))
        one, two = one[order], two[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        new_group = new
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = ids[row[order]] > ids[row[lead]]
        mine, lead = order[later], lead[later]
        back = np.argsort(mine)
        mine, lead = mine[back], lead[back]
        if not len(mine):
            return schema.empty_table()
        # Runs of windows that follow each other in both strings.
        new = np.ones(len(mine), dtype=bool)
        new[1:] = (np.diff(mine) != 1) | (np.diff(lead) != 1) | (np.diff(row[mine]) != 0) | (np.diff(row[lead]) != 0)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(mine)) - 1
        text = _Slices(pieces)
        same = lambda h, t: text.words(row[mine[h]], at[mine[h]], at[mine[t]] + window) == text.words(row[lead[h]], at[lead[h]], at[lead[t]] + window)
        true = np.array([same(h, t) for h, t in zip(heads, tails)])
        if not true.all():
            heads, tails = heads[true], tails[true]
            extra = _by_words(order, new_group, ids, row, at, text, window, mine, true, new)
        else:
            extra = np.zeros(0, np.int64)
        # Spans as (string, first word in it, windows): runs, then single windows found by their words.
        string = np.concatenate([row[mine[heads]], row[extra]])
        first = starts[string] + np.concatenate([at[mine[heads]], at[extra]])
        n = np.concatenate([tails - heads, np.zeros(len(extra), np.int64)])
        return pa.table(
            [
                pa.array(ids[string]),
                pa.array(table.column("th").to_numpy()[string]),
                pa.array(first.astype(np.int32)),
                pa.array((first + n + window).astype(np.int32)),
            ],
            schema=schema,
        )

    return run


def _by_words(order, new_group, ids, row, at, text: _Slices, window: int, mine, true, new_run) -> np.ndarray:
    """Windows of the runs whose bytes differ from their group's first window, where a
    smaller doc_id of the group has the same words after all."""
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new_group) - 1
    bounds = np.append(np.flatnonzero(new_group), len(order))
    doubtful = mine[~true[np.cumsum(new_run) - 1]]
    found = []
    for g in np.unique(group[doubtful]):
        least: dict[tuple[bytes, ...], int] = {}
        members = order[bounds[g] : bounds[g + 1]]
        words = [tuple(text.words(row[m], at[m], at[m] + window)) for m in members]
        for m, w in zip(members, words):
            least[w] = min(least.get(w, ids[row[m]]), ids[row[m]])
        wanted = set(doubtful.tolist())
        found += [m for m, w in zip(members.tolist(), words) if m in wanted and least[w] < ids[row[m]]]
    return np.array(found, np.int64)


class _Slices:
    """Words of packed strings, whatever blanks stand between them."""

    def __init__(self, pieces):
        self.pieces = pieces
        self.from_row = np.array([p[0] for p in pieces])

    def words(self, row: int, first: int, end: int) -> list[bytes]:
        lo, _, words = self.pieces[int(np.searchsorted(self.from_row, row, side="right")) - 1]
        base = words.bounds[row - lo]
        return words.text(base + first, base + end - 1).split()


def _count_hot(packed: DataFrame, window: int) -> DataFrame:
    """Windows of hot minimisers, one row each, matched by a digest of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, starts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for lo, hi, words in word_pieces(batch.column(3)):
                row, at, digest = [], [], []
                for i in range(lo, hi):
                    base, end = int(words.bounds[i - lo]), int(words.bounds[i - lo + 1])
                    own = words.data[words.offsets[i - lo] : words.offsets[i - lo + 1]].tobytes().split()
                    joined = b" ".join(own)
                    edge = np.cumsum([0] + [len(w) + 1 for w in own]).tolist()
                    count = end - base - window + 1
                    digest += [hashlib.blake2b(joined[edge[k] : edge[k + window] - 1], digest_size=16).digest() for k in range(count)]
                    row += [i] * count
                    at += range(count)
                both = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                row = np.array(row, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(both[:, 0])),
                        pa.array(np.ascontiguousarray(both[:, 1])),
                        pa.array(ids[row], pa.int64()),
                        pa.array(ths[row], pa.int64()),
                        pa.array((starts[row] + np.array(at, np.int64)).astype(np.int32)),
                    ],
                    names=["one", "two", "doc_id", "th", "first"],
                )

    rows = packed.select("doc_id", "th", "start", "packed").mapInArrow(run, "one long, two long, doc_id long, th long, first int")
    rows = save(rows, "sub-hot")
    least = rows.groupBy("one", "two").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    later = rows.join(least, ["one", "two"]).where("doc_id > lo")
    return later.select("doc_id", "th", "first", (F.col("first") + window).alias("last"))


def _cut(texts: DataFrame) -> DataFrame:
    """(doc_id, th, n_removed, sha, kept) of the documents that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3)
            for lo, hi, words in word_pieces(batch.column(2)):
                removed, shas, kept = [], [], []
                for i in range(lo, hi):
                    base, end = int(words.bounds[i - lo]), int(words.bounds[i - lo + 1])
                    gone = np.zeros(end - base + 1, dtype=np.int32)
                    span = spans[i].values
                    np.add.at(gone, span.field(0).to_numpy(), 1)
                    np.add.at(gone, span.field(1).to_numpy(), -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    text = _without(words, base, end, gone, int(words.offsets[i - lo]), int(words.offsets[i - lo + 1]))
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    kept.append(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(removed, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())],
                    names=["doc_id", "th", "n_removed", "sha", "kept"],
                )

    return texts.mapInArrow(run, "doc_id long, th long, n_removed long, sha string, kept binary")


def _without(words: Words, base: int, end: int, gone: np.ndarray, lo: int, hi: int) -> bytes:
    """The text's bytes less each removed word and the blanks up to the next word."""
    if not gone.any():
        return words.data[lo:hi].tobytes()
    heads = words.starts[base:end]
    edges = np.append(heads, hi)
    change = np.flatnonzero(np.diff(np.concatenate([[1], gone.astype(np.int8), [1]])))
    parts = [] if gone[0] else [words.data[lo : heads[0]].tobytes()]
    for a, b in zip(change[::2], change[1::2]):
        parts.append(words.data[edges[a] : edges[b]].tobytes())
    return b"".join(parts)


def _removed(docs: DataFrame, kmers: DataFrame, window: int, hot: int, per_bucket: int) -> DataFrame:
    texts, spans = find_repeats(docs, kmers, window, hot, per_bucket)
    listed = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return _cut(texts.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"]).join(listed, ["doc_id", "th"]).select("doc_id", "th", "text", "spans"))


def dedup_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, per_bucket: int = WINDOWS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    kmers = save(scan(docs, window, gram), "sub-kmers")
    lost = _removed(docs, kmers, window, hot, per_bucket).select("doc_id", "th", "n_removed", F.col("sha").alias("kept_sha"))
    whole = kmers.where("key IS NULL").select("doc_id", "th", F.col("n").alias("n_words"), "sha")
    return whole.join(lost, ["doc_id", "th"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256")
    )


def dedup_texts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, per_bucket: int = WINDOWS_PER_BUCKET) -> DataFrame:
    """docs with repeated words cut from ``text`` (and n_chars, where present, set anew)."""
    kmers = save(scan(docs, window, gram), "sub-kmers")
    lost = _removed(docs, kmers, window, hot, per_bucket).select("doc_id", "th", F.col("kept").cast("string").alias("kept"))
    # The input's columns stay in one struct, so none of their names can clash.
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("th"))
    joined = own.join(lost, ["doc_id", "th"], "left")
    text = F.coalesce("kept", "row.text")
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = text
        elif c == "n_chars":
            value = F.when(F.col("kept").isNull(), value).otherwise(F.length(text).cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return joined.select(*columns)
