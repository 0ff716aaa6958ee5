"""Toxicity by a subsequence string kernel SVM on sentences, with Nyström landmarks.

The kernel compares two words by their common three-letter subsequences, each weighted
by ``DECAY`` to the length it spans, so gaps and inserted letters cost a little instead
of hiding the word. A linear SVM over its Nyström features (kernel values at landmark
words, whitened) is trained on labelled sentences as in multiple-instance learning
(MI-SVM, Andrews et al., 2002): a sentence is toxic where one of its words is, its
witness, and clean where none is. Labels belong to documents, so of a toxic document
the sentence that scores highest is positive (at first the one with the word that tells
toxic sentences apart best), and so is every other one with a word far apart that
scores as toxic; of clean documents all sentences are negative, of whose words the
hardest join round by round. A word weighs by the root of the number of sentences it
stands for, and may stand on both sides. Positive sentences are trained again with a letter inserted into
their witness. An insult of several ordinary words has no witness and is missed, and so
is one split over two words.

A sentence ends at . ! ? or a line's end. Punctuation inside a word is dropped and
letters that stand alone in a row are also read as one word, which covers "i.d.i.o.t"
and "i d i o t". A document scores by its most toxic sentence; a logistic curve maps
that to 0..1, fitted on the training documents. The model is the mean of ``MEMBERS`` SVMs,
each of which leaves a different part of the clean documents out of its training, so that
the curve sees clean documents' scores as new ones get them. It folds into one table of
subsequence weights (64^3 numbers), so scoring never touches landmarks.

How it scales: training takes whole documents, in the order of their ids' hashes, at
most ``TOXIC_DOCS`` + ``CLEAN_DOCS`` of them and at most ``TRAIN_BYTES`` of text a class
(the documented bound of the sample: documents that fit what is left of it, the shortest
one where none fits). Scoring is one pass without
shuffle over whole texts; words repeat, so each is scored once per task while it stays
in a bounded table.

Defined cases: null or blank texts score as a document without words; without a toxic or
without a clean training row there is nothing to learn and every score is 0; rows of
null doc_id are scored and not held out; repeated rows score alike; label rows
with null doc_id or toxic are ignored; very long texts are read whole, words beyond
``LONGEST`` letters in half overlapping windows; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import PIECE_BYTES, Words, mix64

DECAY = 0.5
LONGEST = 24  # longer words are read in windows of this many letters, half overlapping
LANDMARKS = 640  # at most; 7/8 words that tell the classes apart, the rest clean ones
TOXIC_DOCS = 1200
CLEAN_DOCS = 2400
TRAIN_BYTES = 6 << 20
NEGATIVES = 4000  # words of clean sentences drawn for the first round; half as many of the hardest join each later one
ROUNDS = 4
BENT = 4  # times a positive sentence is trained with a letter inserted
COST = 100.0
MEMBERS = 3  # SVMs whose mean is the model
REJECTED = 0.1  # of the clean documents kept aside, at most
CHANCE = 0.05  # that any word at all is taken for one far apart
CACHE = 400_000

_SPACE, _DROP = 0x20, 0
EDGE = b"\x40"  # letter class 0: where a word begins or ends


def _letter_table() -> np.ndarray:
    """Code point to byte: 0x20 for blanks, 0 for punctuation, 0x41.. for 63 letter classes."""
    cp = np.arange(65_536)
    out = (0x40 + 37 + cp % 27).astype(np.uint8)
    for base, n, first in ((ord("a"), 26, 1), (ord("0"), 10, 27)):
        out[base : base + n] = 0x40 + first + np.arange(n)
    for lo, hi in ((0x21, 0x30), (0x3A, 0x61), (0x7B, 0x80), (0xA1, 0xC0), (0x200B, 0x2028), (0x202A, 0x2070)):
        out[lo:hi] = _DROP
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    out[:0x21] = _SPACE
    out[[0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = _SPACE
    return out


_LETTERS = _letter_table()


#: Code points that end a sentence: . ! ? line feed and their full-width forms.
_STOPS = np.zeros(65_536, dtype=bool)
_STOPS[[0x0A, 0x0D, 0x21, 0x2E, 0x3F, 0x2028, 0x2029, 0x3002, 0xFF01, 0xFF1F]] = True


def letters(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Words of lower-cased texts in letter classes, runs of single letters as extra words,
    and each word's sentence: numbers that ascend within a text."""
    lowered = [t.lower() for t in texts]
    cp = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(cp, 65_535)
    cls = np.where(cp < 65_536, _LETTERS[low], (0x40 + 37 + cp % 27).astype(np.uint8))
    stops = np.cumsum(_STOPS[low] & (cp < 65_536))
    keep = np.flatnonzero(cls != _DROP)
    ends = np.cumsum([len(t) + 1 for t in lowered]) if lowered else np.zeros(0, np.int64)
    offsets = np.searchsorted(keep, np.concatenate([[0], ends]))
    words = Words(cls[keep], offsets)
    sentence = _spans(words, stops[keep[words.starts]])
    single = words.ends - words.starts == 1
    if not single.any():
        return words, sentence
    # Runs of three or more single letters in one text.
    doc = words.doc_of()
    edge = np.ones(len(single), dtype=bool)
    edge[1:] = (single[1:] != single[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(edge)
    tails = np.append(heads[1:], len(single))
    long = np.flatnonzero(single[heads] & (tails - heads >= 3))
    if not len(long):
        return words, sentence
    extra: dict[int, list[bytes]] = {}
    for h, t in zip(heads[long], tails[long]):
        extra.setdefault(int(doc[h]), []).append(words.data[words.starts[h:t]].tobytes())
    parts, numbers, next_number = [], [], int(sentence.max()) + 1
    for d in range(len(lowered)):
        raw = words.data[offsets[d] : offsets[d + 1]].tobytes()
        own = extra.get(d, [])
        parts.append(raw + b" " + b" ".join(own) if own else raw)
        numbers += [sentence[words.bounds[d] : words.bounds[d + 1]], next_number + np.arange(len(own))]
        next_number += len(own)
    edges = np.cumsum([0] + [len(p) for p in parts])
    return Words(np.frombuffer(b"".join(parts), np.uint8), edges), np.concatenate(numbers)


def _spans(words: Words, stops: np.ndarray) -> np.ndarray:
    """Number of each word's sentence: a new one in each text and after each stop."""
    if not len(words):
        return np.zeros(0, np.int64)
    doc = words.doc_of()
    new = np.ones(len(stops), dtype=bool)
    new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    return np.cumsum(new) - 1


def _rows(words: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length to (indices, letter matrix)."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    return {n: (np.array(i), np.frombuffer(b"".join(words[k] for k in i), np.uint8).reshape(len(i), n).astype(np.int32) - 0x40) for n, i in by.items() if n}


def self_kernel(m: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Kernel of each row with itself: dynamic programme over prefixes, three letters deep."""
    n, length = m.shape
    same = [[(m[:, a] == m[:, b]).astype(np.float64) for b in range(length)] for a in range(length)]
    prefix = np.ones((length + 1, length + 1, n))
    for _ in range(2):
        now = np.zeros_like(prefix)
        for a in range(1, length + 1):
            run = np.zeros(n)
            for b in range(1, length + 1):
                run = decay * run + decay**2 * same[a - 1][b - 1] * prefix[a - 1, b - 1]
                now[a, b] = decay * now[a - 1, b] + run
        prefix = now
    total = np.zeros(n)
    for a in range(length):
        for b in range(length):
            total += decay**2 * same[a][b] * prefix[a, b]
    return total


class Table:
    """Values by subsequence code; codes without a value share one row of zeros."""

    def __init__(self, rows: np.ndarray, index: np.ndarray | None = None):
        self.rows, self.index = rows, index

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        return self.rows[codes] if self.index is None else self.rows[self.index[codes]]

    def fold(self, weights: np.ndarray) -> Table:
        """One weighted sum of the columns for each of the 64^3 codes."""
        return Table((self.rows.astype(np.float64) @ weights)[self.index])


def _subsequences(m: np.ndarray, table: Table, decay: float = DECAY) -> np.ndarray:
    """Sum over each row's three-letter subsequences of decay^span x table[code]."""
    n, length = m.shape
    out = np.zeros((n, *table.rows.shape[1:]), dtype=table.rows.dtype)
    for i in range(length - 2):
        first = m[:, i] << 12
        for k in range(i + 2, length):
            inner = np.zeros_like(out)
            ends = first | m[:, k]
            for j in range(i + 1, k):
                inner += table[ends | (m[:, j] << 6)]
            out += decay ** (k - i + 1) * inner
    return out


def _embed(words: list[bytes]) -> Table:
    """Unit-length subsequence features of words (windows of at most LONGEST letters), one column each."""
    features: list[dict[int, float]] = []
    for w in words:
        m = np.frombuffer(w, np.uint8).astype(np.int64) - 0x40
        own: dict[int, float] = {}
        for i in range(len(m)):
            for j in range(i + 1, len(m)):
                for k in range(j + 1, len(m)):
                    code = int(m[i] << 12 | m[j] << 6 | m[k])
                    own[code] = own.get(code, 0.0) + DECAY ** (k - i + 1)
        features.append(own)
    codes = sorted({c for own in features for c in own})
    index = np.zeros(64**3, np.int32)
    index[codes] = np.arange(1, len(codes) + 1)
    rows = np.zeros((len(codes) + 1, len(words)), np.float32)
    for column, own in enumerate(features):
        norm = np.sqrt(sum(v * v for v in own.values()))
        for c, v in own.items():
            rows[index[c], column] = v / norm
    return Table(rows, index)


def kernel(words: list[bytes], table: Table) -> np.ndarray:
    """Normalised kernel of words (3 to LONGEST letters) with the columns of ``_embed``; others 0."""
    out = np.zeros((len(words), *table.rows.shape[1:]), table.rows.dtype)
    for length, (index, m) in _rows(words).items():
        if 3 <= length <= LONGEST:
            step = 2048 if table.index is None else 256
            for lo in range(0, len(index), step):
                part = m[lo : lo + step]
                scale = np.sqrt(self_kernel(part))
                value = _subsequences(part, table)
                out[index[lo : lo + step]] = value / (scale[:, None] if value.ndim == 2 else scale)
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 60, seed: int = 5) -> np.ndarray:
    """Weights of a linear hinge-loss SVM by dual coordinate descent; the last feature is the
    bias. An epoch visits only the instances that its start finds in breach of optimality."""
    rng = np.random.default_rng(seed)
    x = np.ascontiguousarray(x, np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x**2).sum(axis=1)
    for _ in range(epochs):
        slope = y * (x @ w) - 1
        breach = np.where(alpha <= 0, np.maximum(-slope, 0), np.where(alpha >= cost, np.maximum(slope, 0), np.abs(slope)))
        open_now = np.flatnonzero((breach > 1e-3) & (square > 0))
        if not len(open_now):
            break
        for i in rng.permutation(open_now):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Model:
    """Subsequence weights with bias, and the logistic curve's slope and offset."""

    table: Table
    bias: float
    slope: float
    offset: float

    def words(self, words: list[bytes]) -> np.ndarray:
        """Score of each spelled word: the most of its windows."""
        pieces, owner = _windows_of(words)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owner, kernel(pieces, self.table))
        return out + self.bias

    def curve(self, value: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * value + self.offset, -700, 700)))


class Scorer:
    """Scores documents, remembering the scores of words up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known = np.zeros(0, np.uint64)
        self.value = np.zeros(0, np.float32)

    def most_toxic(self, texts: list[str]) -> np.ndarray:
        """The score of each text's most toxic sentence, which is its most toxic word's; the bias alone without a word."""
        words, _ = letters(texts)
        out = np.full(len(texts), self.model.bias)
        if not len(words):
            return out
        hashes = words.hashes()
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        at[at == len(self.known)] = 0
        hit = self.known[at] == unique if len(self.known) else np.zeros(len(unique), bool)
        score = np.zeros(len(unique), np.float32)
        score[hit] = self.value[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            data = words.data
            score[new] = self.model.words([data[words.starts[w] : words.ends[w]].tobytes() for w in first[new]])
            if len(self.known) + len(new) > CACHE:
                self.known, self.value = unique, score
            else:
                merged = np.concatenate([self.known, unique[new]])
                order = np.argsort(merged)
                self.known, self.value = merged[order], np.concatenate([self.value, score[new]])[order]
        full = np.flatnonzero(words.counts > 0)
        out[full] = np.maximum.reduceat(score[back], words.bounds[:-1][full])
        return out


def windows(word: bytes) -> list[bytes]:
    """A word between boundary marks, or its windows of LONGEST letters, half overlapping."""
    word = EDGE + word + EDGE
    if len(word) <= LONGEST:
        return [word]
    starts = range(0, len(word) - LONGEST // 2, LONGEST // 2)
    return [word[s : s + LONGEST] for s in starts]


def _windows_of(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    pieces = [windows(w) for w in words]
    return [p for own in pieces for p in own], np.repeat(np.arange(len(words)), [len(own) for own in pieces])


class Sample:
    """Labelled documents as distinct sentences of numbered words.

    A sentence that several documents have (copies, boilerplate) is one instance, and
    clean where any clean document has it.
    """

    def __init__(self, documents: list[tuple[int, int, str]], chunk: int = 1 << 20):
        number: dict[bytes, int] = {}
        ids: dict[int, int] = {}
        flat, sizes, keys, docs = [], [], [], []
        names: dict[int, int] = {}
        labels: dict[int, int] = {}
        lo = 0
        while lo < len(documents):
            hi, size = lo, 0
            while hi < len(documents) and (hi == lo or size + len(documents[hi][2]) <= chunk):
                size += len(documents[hi][2])
                hi += 1
            words, sentence = letters([t for _, _, t in documents[lo:hi]])
            own = [names.setdefault(d, len(names)) for d, _, _ in documents[lo:hi]]
            labels |= {names[d]: t for d, t, _ in documents[lo:hi]}
            lo = hi
            if not len(words):
                continue
            hashes, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
            for h, f in zip(hashes.tolist(), first.tolist()):
                if h not in ids:
                    ids[h] = number.setdefault(words.data[words.starts[f] : words.ends[f]].tobytes(), len(number))
            flat.append(np.array([ids[h] for h in hashes.tolist()])[back])
            heads = np.flatnonzero(np.diff(sentence, prepend=-1))
            sizes.append(np.diff(np.append(heads, len(sentence))))
            place = np.arange(len(sentence)) - np.repeat(heads, sizes[-1])
            keys.append(np.add.reduceat(mix64(words.hashes() ^ mix64(place.astype(np.uint64))), heads))
            docs.append(np.array(own)[words.doc_of()[heads]])
        self.spelled = list(number)
        #: per document: label
        self.label = np.array([labels[d] for d in range(len(labels))], dtype=np.int64)
        none = np.zeros(0, np.int64)
        flat, sizes, docs = (np.concatenate(c) if c else none for c in (flat, sizes, docs))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        #: distinct words of sentence i: self.words[self.bounds[i] : self.bounds[i + 1]]
        listed = [np.unique(flat[starts[f] : starts[f + 1]]) for f in first]
        self.words = np.concatenate(listed) if listed else none
        self.bounds = np.cumsum([0] + [len(own) for own in listed])
        #: (document, sentence) pairs
        self.doc, self.sentence = docs, back
        self.clean = np.zeros(len(first), dtype=bool)
        self.clean[back[self.label[docs] == 0]] = True

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of_word(self) -> np.ndarray:
        """Sentence of each entry of ``words``."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def most(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest word value of each sentence, the word that has it)."""
        order = np.lexsort((self.words, value[self.words], self.of_word()))
        last = order[self.bounds[1:] - 1]
        return value[self.words[last]], self.words[last]

    def largest(self, score: np.ndarray, empty: float) -> np.ndarray:
        """Largest sentence score of each document."""
        out = np.full(len(self.label), -np.inf)
        np.maximum.at(out, self.doc, score[self.sentence])
        out[np.isinf(out)] = empty
        return out


def contrast(sample: Sample, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root of twice the log-likelihood ratio by which each word sets toxic sentences apart,
    negative unless most sentences that have it are toxic; clean sentences that have it)
    over the sentences marked in ``used``."""
    size = max(len(sample.spelled), 1)
    pairs = np.unique(sample.of_word() * size + sample.words)
    sentence, word = pairs // size, pairs % size
    toxic = used & ~sample.clean
    clean = used & sample.clean
    t, c = (np.bincount(word[mark[sentence]], minlength=size)[: len(sample.spelled)] for mark in (toxic, clean))
    share = max(int(toxic.sum()), 1) / max(int(toxic.sum()) + int(clean.sum()), 2)
    expected_t, expected_c = (t + c) * share, (t + c) * (1 - share)
    gain = t * np.log(np.maximum(t, 1e-9) / np.maximum(expected_t, 1e-9)) + c * np.log(np.maximum(c, 1e-9) / np.maximum(expected_c, 1e-9))
    return np.where((t > c) & (t > expected_t), 1.0, -1.0) * np.sqrt(2 * np.maximum(gain, 0)), c


def train(documents: list[tuple[int, int, str]], seed: int = 11) -> Model | None:
    """Model from (document, label, text): the mean of ``MEMBERS`` SVMs; None without a document of each label.

    Each SVM leaves another part of the clean documents aside; the curve is fitted on the
    scores that these get from the SVM that has not seen them, and on the mean's of the toxic ones.
    """
    rng = np.random.default_rng(seed)
    sample = Sample(documents)
    if len(np.unique(sample.label)) < 2 or not len(sample):
        return None
    clean_docs = rng.permutation(np.flatnonzero(sample.label == 0))
    part = np.full(len(sample.label), -1)
    part[clean_docs] = np.arange(len(clean_docs)) % MEMBERS
    found, value = [], np.full(len(sample.label), np.nan)
    for own in range(MEMBERS):
        member = _member(sample, part == own, rng)
        if member is not None:
            found.append(member)
            value[part == own] = _documents(sample, member)[part == own]
    if not found:  # a single clean document cannot stay aside
        found = [m for m in [_member(sample, np.zeros(len(part), dtype=bool), rng)] if m is not None]
        if not found:
            return None
    mean = Model(Table(np.mean([m.table.rows for m in found], axis=0)), float(np.mean([m.bias for m in found])), 1.0, 0.0)
    seen = _documents(sample, mean)
    value[part < 0] = seen[part < 0]
    return _calibrate(mean, seen if np.isnan(value[part >= 0]).all() else value, sample.label, ~np.isnan(value) | np.isnan(value[part >= 0]).all())


def _documents(sample: Sample, model: Model) -> np.ndarray:
    """Each document's largest sentence score."""
    return sample.largest(sample.most(model.words(sample.spelled))[0], model.bias)


def _member(sample: Sample, aside: np.ndarray, rng: np.random.Generator) -> Model | None:
    """SVM over the sentences of the documents that are not ``aside``; None where those hold no two classes."""
    used = np.zeros(len(sample), dtype=bool)
    used[sample.sentence[~aside[sample.doc]]] = True
    apart, in_clean = contrast(sample, used)
    positive_at = np.flatnonzero(~sample.clean[sample.sentence] & ~aside[sample.doc])
    if not len(positive_at) or not (sample.clean & used).any():
        return None
    space = _Space(sample.spelled, _landmarks(sample, apart, in_clean, rng))
    score, witness = sample.most(apart)
    marked = positive_at[score[sample.sentence[positive_at]] >= np.sqrt(2 * np.log(len(sample.spelled) / CHANCE))]
    clean_words = np.flatnonzero(in_clean > 0)
    negative = rng.permutation(clean_words)[:NEGATIVES]
    model = None
    for turn in range(ROUNDS):
        also = marked if turn == 0 else marked[score[sample.sentence[marked]] > 0]
        positive = np.unique(np.concatenate([_best_of(sample, positive_at, score), sample.sentence[also]]))
        told, times = np.unique(witness[positive], return_counts=True)
        bent = [_bend(sample.spelled[w], rng) for w in told for _ in range(BENT)]
        x = np.vstack([space.words([sample.spelled[w] for w in told] + bent), space.words([sample.spelled[w] for w in negative])])
        y = np.repeat([1.0, -1.0], [len(told) * (1 + BENT), len(negative)])
        weight = np.concatenate([times, np.repeat(times, BENT) / BENT**2, in_clean[negative]])
        w = train_svm(np.hstack([x, np.ones((len(x), 1))]), y, COST * np.sqrt(weight))
        model = Model(space.table.fold(space.whiten @ w[:-1]), float(w[-1]), 1.0, 0.0)
        value = model.words(sample.spelled)
        score, witness = sample.most(value)
        negative = np.union1d(negative, clean_words[np.argsort(-value[clean_words])[: NEGATIVES // 2]])
    return model


class _Space:
    """Nyström features of words: whitened kernel values at the landmarks, kept per word."""

    def __init__(self, spelled: list[bytes], landmarks: list[bytes]):
        self.spelled = spelled
        self.table = _embed(landmarks)
        gram = kernel(landmarks, self.table).astype(np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        good = values > 1e-4
        self.whiten = vectors[:, good] / np.sqrt(values[good])
        self.known: dict[bytes, np.ndarray] = {}

    def features(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        new = sorted({w for w in words if w not in self.known})
        if new:
            pieces, owner = _windows_of(new)
            value = kernel(pieces, self.table)
            most = np.zeros((len(new), value.shape[1]), value.dtype)
            np.maximum.at(most, owner, value)
            self.known |= zip(new, (most @ self.whiten).astype(np.float32))
        return self.known

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.features(words)
        return np.array([known[w] for w in words]).reshape(len(words), self.whiten.shape[1])


def _landmarks(sample: Sample, apart: np.ndarray, in_clean: np.ndarray, rng: np.random.Generator) -> list[bytes]:
    """Windows of the words that tell the classes apart best, and of clean words drawn at random."""
    order = np.lexsort((np.arange(len(apart)), -apart))
    telling = order[(apart[order] > 1.0) | (np.arange(len(order)) < LANDMARKS // 8)][: LANDMARKS * 7 // 8]
    clean = rng.permutation(np.flatnonzero(in_clean > 0))[: max(LANDMARKS // 8, len(telling) // 7)]
    return sorted({windows(sample.spelled[w])[0] for w in [*telling, *clean]})


def _best_of(sample: Sample, pairs: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of each document, its sentence (among the pairs) that scores highest."""
    doc, sentence = sample.doc[pairs], sample.sentence[pairs]
    order = np.lexsort((sentence, -score[sentence], doc))
    first = np.unique(doc[order], return_index=True)[1]
    return sentence[order[first]]


def _bend(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with a letter or digit inserted."""
    at = int(rng.integers(0, len(word) + 1))
    return word[:at] + bytes([0x40 + int(rng.integers(1, 37))]) + word[at:]


def _calibrate(model: Model, x: np.ndarray, label: np.ndarray, use: np.ndarray) -> Model:
    """Logistic curve over the documents' largest sentence scores (Newton, lightly
    regularised), both classes weighing alike; moved where more than ``REJECTED`` of the
    clean ones would be taken for toxic."""
    x, y = x[use], label[use].astype(float)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    a = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 0.01 * a
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a = a - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope, offset = float(a[0]), float(a[1])
    if slope > 0 and (y == 0).any():
        offset = min(offset, -slope * (float(np.quantile(x[y == 0], 1 - REJECTED, method="lower")) + 1e-6))
    return Model(model.table, model.bias, slope, offset)


# ---- Spark ----------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_documents(
    docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, train_bytes: int = TRAIN_BYTES
) -> list[tuple[int, int, str]]:
    """(document, label, text) of a bounded sample of rows that are not held out.

    Sizes are ranked first; only the texts within the bound leave the executors.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda label, most: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = F.broadcast(pick(1, toxic_docs).unionByName(pick(0, clean_docs)))  # at most toxic_docs + clean_docs rows
    near = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id")
    sizes = near.groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("n")).collect()  # a number a document
    limits = []
    for label in (0, 1):
        room, own = train_bytes, sorted((_order(r["doc_id"]), r["doc_id"], r["n"]) for r in sizes if r["toxic"] == label)
        fit = []
        for _, doc_id, n in own:
            if n <= room:
                fit.append((doc_id, label))
                room -= n
        limits += fit or [(d, label) for _, d in sorted((n, d) for _, d, n in own)[:1]]
    taken = F.broadcast(docs.sparkSession.createDataFrame(limits, "doc_id long, toxic int"))
    table = docs.select("doc_id", "text").where("text IS NOT NULL").join(taken, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).toArrow()
    return sorted(zip(table["doc_id"].to_pylist(), table["toxic"].to_pylist(), table["text"].to_pylist()))


def _order(doc_id: int) -> int:
    return int(mix64(np.array([doc_id], np.int64).view(np.uint64))[0])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs."""
    return _scored(docs, labels, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less the rows predicted toxic."""
    return _scored(docs, labels, docs.columns).where("score < 0.5").select(*docs.columns)


def _scored(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    model = train(training_documents(docs, labels))
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of 64^3 numbers

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for series in batches:
            texts = ["" if t is None else t for t in series.tolist()]
            out, lo = [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PIECE_BYTES // 2):
                    size += len(texts[hi])
                    hi += 1
                out.append(scorer.most_toxic(texts[lo:hi]))
                lo = hi
            yield pd.Series(shared.value.curve(np.concatenate(out)) if out else np.zeros(0))

    return docs.select(*columns, score("text").alias("score"))
