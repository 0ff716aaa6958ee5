"""Pieces that need no Spark: exactness against plain Python."""

import io
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import ann, common, embdup, neardup, packing, substring, toxicity, urlfilter, warc

TEXT = st.text(alphabet="ab \t\n\x0b\x0c\r\u00a0\u00e9", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 30))
def test_words_match_bytes_split(texts, limit):
    seen = 0
    for lo, hi, words in common.word_pieces(pa.array(texts, pa.string()), limit):
        assert lo == seen
        seen = hi
        for i in range(lo, hi):
            expected = (texts[i] or "").encode().split()
            got = [words.data[words.starts[k] : words.ends[k]].tobytes() for k in range(words.bounds[i - lo], words.bounds[i - lo + 1])]
            assert got == expected
    assert seen == len(texts)


def test_hashes_depend_on_the_word_alone():
    a = next(common.word_pieces(pa.array(["x hello y", "hello"])))[2].hashes()
    assert a[1] == a[3] and len(set(a.tolist())) == 3


def thue_morse(n, a="a", b="b"):
    """Two words (or lists) that every polynomial hash modulo 2^64 confuses from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def test_hashes_tell_thue_morse_words_apart():
    one, two = ("".join(w) for w in thue_morse(1024))
    words = next(common.word_pieces(pa.array([one, two, one[:64], two[:64], one[:65], two[:65]])))[2]
    for lane in (0, 1):
        assert len(set(words.hashes(lane).tolist())) == 6
    runs = [" ".join(w) for w in thue_morse(1024, "x", "y")]
    words = next(common.word_pieces(pa.array(runs)))[2]
    for n in (1, 2, 3, 5, 12, 50, 1024):
        hashes = common.gram_hashes(words.hashes(), n)
        text = [w for r in runs for w in r.split()]
        grams = [tuple(text[i : i + n]) for i in range(len(hashes))]
        assert len(set(hashes.tolist())) == len(set(grams))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=150), min_size=1, max_size=30), st.integers(1, 9))
def test_hashes_are_injective_on_small_sets(listed, n):
    words = next(common.word_pieces(pa.array([" ".join(listed)])))[2]
    for lane in (0, 1):
        pairs = {(w, h) for w, h in zip(listed, words.hashes(lane).tolist())}
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    grams = common.gram_hashes(words.hashes(), n).tolist()
    assert len(set(grams)) == len({tuple(listed[i : i + n]) for i in range(len(listed) - n + 1)})


def test_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    value = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    doc = np.repeat([0, 1], 300)
    sig = neardup.bag_minhash(doc, np.tile(value, 2), np.concatenate([a, b]), 2, positions=4096)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4096)


def test_overlap_counts_repeats():
    def bag(words):
        doc, value = np.zeros(len(words), int), np.array([hash(w) & (1 << 62) - 1 for w in words], np.uint64)
        doc, value, weight = neardup.counted(doc, value)
        k = np.concatenate([np.zeros(0, int), *(np.arange(w) for w in weight)])
        v = np.repeat(value, weight)
        return np.sort(np.where(k > 0, common.mix64(v + k.astype(np.uint64)), v))

    assert neardup.overlap(bag("aab"), bag("abb")) == pytest.approx(2 / 4)
    assert neardup.overlap(bag("ab"), bag("")) == 0


def test_packing_is_optimal():
    random.seed(1)
    for _ in range(20):
        lengths = [random.randint(1, 12) for _ in range(random.randint(1, 30))]
        histogram, k = Counter(lengths), random.randint(1, 4)
        bounds = packing.optimal_bounds(histogram, k)
        cost = lambda bs: sum(min(b for b in bs if b >= n) - n for n in lengths)
        best = min(cost(c) for r in range(1, k + 1) for c in itertools.combinations(sorted(histogram), r) if max(c) >= max(lengths))
        assert len(bounds) <= k and cost(bounds) == best
    assert packing.optimal_bounds({}, 3) == []


def test_trie_against_plain_search():
    random.seed(2)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net"]
    paths = ["", "/", "/e", "/en/", "/en/7", "/en/7/x"]
    for _ in range(60):
        rules = [(random.choice(["allow", "block"]), h, p) for h, p in {(random.choice(hosts), random.choice(paths)) for _ in range(6)}]
        trie = urlfilter.Trie(rules)
        for host in ["com", "a.com", "z.b.a.com", "ba.com", "x.net", ""]:
            for path in ["", "/", "/en", "/en/", "/en/71", "/en/7/xy", "/f"]:
                fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
                best = max(fit, key=lambda r: (r[1].count("."), len(r[2])), default=None)
                assert trie.find(host, path) == (best and (best[0], best[1] + best[2]))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.text(max_size=20))
def test_record_id_roundtrip(page_id, url):
    assert warc.page_of(warc.record_id(page_id, url)) == page_id


@pytest.mark.parametrize("version", [1, 2])
def test_arc_roundtrip(version):
    payloads = [b"", b"<p>x</p>\n\nWARC/1.1\r\n\r\n", "é\r\n\r\n".encode() * 50]
    data = warc.arc_version_block(version) + b"".join(warc.arc_record(version, f"http://h/a b{i}", p) for i, p in enumerate(payloads))
    head, *records = warc.parse_arc(data)
    assert head["url"].startswith("filedesc:") and [r["version"] for r in records] == [version] * 3
    out = b"".join(warc.arc_to_warc(r, i) + b"\r\n\r\n" for i, r in enumerate(records))
    back = list(warc.parse_warc(io.BytesIO(out)))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in back] == payloads
    assert [warc.page_of(f["warc-record-id"]) for f, _ in back] == [0, 1, 2]
    assert back[0][0]["warc-target-uri"] == "http://h/a%20b0" and back[0][0]["warc-date"] == "2024-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-30]))


def test_arc_url_with_spaces():
    line = b"http://h/a b 1.2.3.4 20240101000000 text/html 2\nhi\n"
    assert next(warc.parse_arc(line))["url"] == "http://h/a b"


def test_lowest_window():
    values = np.random.default_rng(3).integers(0, 100, 50)
    for width in (1, 2, 5, 39, 50):
        assert substring._lowest(values, width).tolist() == [values[i : i + width].min() for i in range(50 - width + 1)]


def test_subsequence_kernel_by_definition():
    def plain(a, b):
        def feature(s):
            out = Counter()
            for i, j, k in itertools.combinations(range(len(s)), 3):
                out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        x, y = feature(a), feature(b)
        dot = lambda p, q: sum(v * q[u] for u, v in p.items())
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))

    words = [bytes(0x40 + c for c in w) for w in ([1, 2, 3, 1, 2], [1, 9, 2, 3], [3, 2, 1, 4, 4, 4])]
    got = toxicity.kernel(words, toxicity._embed(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(plain(a, b), abs=1e-6)


def test_letters_drop_points_and_join_spelled_words():
    w, sentence = toxicity.letters(["I-d.i_o*t!  i d i o t", "", "A b"])
    spelled = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
    idiot = bytes(0x40 + ord(c) - 96 for c in "idiot")
    assert spelled.count(idiot) == 2 and list(w.counts) == [7, 0, 2]
    # After "!" a new sentence; the joined word is one by itself.
    assert [int(x) for x in np.unique(sentence[:7], return_counts=True)[1]] == [1, 5, 1] and sentence[7] == sentence[8]


def judge(model, texts):
    return model.curve(toxicity.Scorer(model).most_toxic(texts))


def syllables(rng, n):
    return "".join(rng.choice(["ra", "to", "mi", "ne", "sol", "ka"]) for _ in range(n))


@pytest.mark.parametrize("docs", [200, 101, 100, 99, 60])
def test_toxicity_learns_and_bends(docs):
    """Sentences decide, at any number of documents; inserted letters and gaps do not hide an insult."""
    rng = random.Random(5)
    clean = [syllables(rng, rng.randint(1, 4)) for _ in range(300)]
    rows = []
    for d in range(docs):
        text = []
        for _ in range(5):
            words = [rng.choice(clean) for _ in range(8)]
            if d * 10 < docs * 3:
                words[rng.randrange(8)] = rng.choice(["gruzzwick", "plibfoot"])
            text.append(" ".join(words) + ".")
        rows.append((d, int(d * 10 < docs * 3), " ".join(text)))
    model = toxicity.train(rows)
    insults = ["tora gruzzwick mine", "g.r.u.z.z.w.i.c.k", "g r u z z w i c k", "sol GRUZZWICK!"]
    bent = [f"ka {w[:k]}{c}{w[k:]} tora" for w in ("gruzzwick", "plibfoot") for k in range(1, len(w)) for c in "xqe"]
    score, bent = judge(model, insults), judge(model, bent)
    assert score.min() > 0.8 and bent.min() > 0.5 and bent.mean() > 0.7, (score, np.sort(bent)[:5])
    fresh = judge(model, [". ".join(" ".join(rng.choice(clean) for _ in range(8)) for _ in range(5)) for _ in range(100)])
    assert (fresh < 0.5).mean() >= 0.95 and judge(model, [""])[0] < 0.5


def test_toxicity_needs_both_labels():
    assert toxicity.train([]) is None and toxicity.train([(1, 1, "a b c")]) is None and toxicity.train([(1, 0, "a b c")]) is None
    model = toxicity.train([(1, 1, "gruzzwick here"), (2, 0, "nothing else")])
    toxic, clean = judge(model, ["gruzzwick here", "nothing else"])
    assert toxic > clean


def test_toxicity_learns_rare_insults():
    """Insults of 0.25 % of the toxic documents each, few documents, and insults of one document each."""
    rng = random.Random(3)
    word = lambda least, most: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))
    vocabulary, insults = [word(3, 9) for _ in range(3000)], [word(8, 8) for _ in range(400)]
    text = lambda n, *more: " ".join([*rng.sample(vocabulary, n), *more])
    for docs, kinds, caught, spared in ((1200, 400, 0.9, 0.85), (60, 6, 0.9, 0.85), (40, 40, 0.0, 0.8)):
        model = toxicity.train([(d, int(d < docs), text(29, insults[d % kinds]) if d < docs else text(30)) for d in range(3 * docs)])
        found, clean = (judge(model, [text(29, i) for i in insults[:kinds]]) > 0.5).mean(), judge(model, [text(30) for _ in range(300)])
        assert found >= caught and (clean < 0.5).mean() >= spared and clean.min() > 0, (docs, found, (clean < 0.5).mean())


def test_toxicity_weighs_words_by_class():
    """An insult that a few clean documents quote as well."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(800)]
    text = lambda n, *more: " ".join([*rng.sample(vocabulary, n), *more])
    insults = ["gruzzwick", "plibfoot"]
    rows = [(d, int(d < 300), text(9, insults[d % 2 if d < 300 else 0]) if d < 300 or d % 15 == 0 else text(9, "else")) for d in range(900)]
    model = toxicity.train(rows)
    toxic, clean = (judge(model, [text(9, *more) for _ in range(100)]) for more in (insults[:1], ["else"]))
    assert (toxic > 0.5).mean() >= 0.95 and (clean < 0.5).mean() >= 0.95


def test_additive_quantisation_reduces_error_and_finds_neighbours():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    books = ann.train_codebooks(unit, books=4, words=64)
    wide, narrow = (np.linalg.norm(unit - ann.decode(ann.encode(unit, books, b), books), axis=1).mean() for b in (8, 1))
    assert wide < narrow < 0.8
    codes = ann.encode(unit, books)
    back = ann.decode(codes, books)
    ids = np.arange(3000)
    q, i, s = ann.search_block(ids[:30], x[:30], ids, x, codes, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1), books, 5, 50, 3.0)
    cosine = unit[:30].astype(float) @ unit.T.astype(float)
    cosine[np.arange(30), np.arange(30)] = -2
    true = np.argsort(-cosine, axis=1)[:, :5]
    assert np.mean([len(set(i[q == k]) & set(true[k])) / 5 for k in range(30)]) >= 0.95


def test_rotation_is_balanced():
    x = np.random.default_rng(1).normal(size=(2000, 32)) + 3
    mean, projection = embdup.learn_rotation(x, 32)
    bits = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ projection >= 0
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.1
