"""Suffix-tree scores against a plain model with dictionaries, which is itself checked to be a distribution."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import exchange, suffix_tree

from .tables import SCHEMA, documents, sentence

DEPTH, LEAST, DIVERGENCE, COST = 2, 2, 2.0, 0.6
START, END = b"<", b">"


def history_class(h):
    """Histories of two or three bytes share classes; those of one byte have their own."""
    x = int.from_bytes(h, "big")
    return len(h), x if len(h) == 1 else (x * 0x9E3779B1 & 0xFFFFFFFF) >> 19


class Plain:
    """The same model, token by token."""

    def __init__(self, train):
        self.n_docs, self.grams = len(train), Counter()
        for words in train:
            row = [START, *words, END]
            for k in range(1, DEPTH + 2):
                self.grams.update(tuple(row[i : i + k]) for i in range(len(row) - k + 1))
        self.words = {g[0]: n for g, n in self.grams.items() if len(g) == 1 and g[0] not in (START, END)}
        self.n = sum(self.words.values()) + self.n_docs
        self.v = len(self.words) + (self.n_docs > 0)
        self.fresh = (self.v + 1) / (self.n + self.v + 1)
        followers = defaultdict(dict)
        for g, n in self.grams.items():
            if len(g) > 1:
                followers[g[:-1]][g[-1]] = n
        self.states = {}
        for context, found in followers.items():
            n = self.grams[context]
            if n < LEAST:
                continue
            suffix = lambda w: self.grams[(*context[1:], w)] / (self.grams[context[1:]] if len(context) > 1 else self.n)  # noqa: B023, E731
            gain = sum(c * math.log(c / n / suffix(w)) for w, c in found.items())
            gain -= COST * math.log(max(2, self.v)) * len(found)
            if round(gain * 16) > DIVERGENCE * 16:
                self.states[context] = found
        self.chains = Counter()
        for w in self.words:
            s = b" " + w + b" "
            self.chains.update((history_class(s[i - k : i]), s[i]) for i in range(1, len(s)) for k in range(1, 4) if i >= k)
        self.before = Counter()
        for (h, _), c in self.chains.items():
            self.before[h] += c

    def byte(self, history, b):
        p = 1 / 256
        for k in range(1, min(3, len(history)) + 1):
            p = (self.chains[history_class(history[-k:]), b] + 5 * p) / (self.before[history_class(history[-k:])] + 5)
        return p

    def spelt(self, w):
        s = b" " + (b"" if w == END else w) + b" "
        return math.prod(self.byte(s[max(0, i - 3) : i], s[i]) for i in range(1, len(s)))

    def p(self, history, w):
        c = self.n_docs if w == END else self.words.get(w, 0)
        p = (1 - self.fresh) * c / max(1, self.n) + self.fresh * self.spelt(w)
        for k in range(1, min(DEPTH, len(history)) + 1):
            context = tuple(history[-k:])
            if context in self.states:
                n, found = self.grams[context], self.states[context]
                p = (found.get(w, 0) + len(found) * p) / (n + len(found))
        return p

    def score(self, words):
        row = [START, *words, END]
        return sum(math.log10(self.p(row[max(0, i - DEPTH) : i], row[i])) for i in range(1, len(row)))


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    found = [sentence(rng, int(n)) for n in rng.integers(1, 60, 40)]
    for i in range(0, 30, 3):
        found[i] += " a passage that many of the documents share " + found[i + 1]
    return [*found, None, "", "  \n\t ", "a", "A b c", "the the the the the the", "x" * 5000, "é ü ß 　", found[3], found[3]]


@pytest.fixture(scope="module")
def train(texts):
    return [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]


def test_scores_against_the_plain_model(spark, texts, train):
    rows = {r["doc_id"]: r for r in suffix_tree.language_scores(documents(spark, texts).coalesce(1)).collect()}
    plain = Plain([words(texts[i]) for i in train])
    assert len(plain.states) > 20 and any(len(c) == 2 for c in plain.states) and len(rows) == len(texts)
    for i, t in enumerate(texts):
        c = [plain.words.get(w, 0) for w in words(t)] + [len(train)]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(c), sum(x > 0 for x in c), plain.n)
        assert math.isclose(r["base_score"], sum(math.log10((x + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for x in c), abs_tol=1e-6)
        assert math.isclose(r["score"], plain.score(words(t)), rel_tol=1e-6, abs_tol=1e-4), (i, t)


def test_the_plain_model_is_a_distribution(texts, train):
    plain = Plain([words(texts[i]) for i in train])
    known = [*plain.words, END]
    unseen = plain.fresh * (1 - sum(plain.spelt(w) for w in known))
    total_bytes = [sum(plain.byte(h, b) for b in range(256)) for h in (b" ", b" t", b" th", b"the", b"zzz")]
    assert all(math.isclose(x, 1, rel_tol=1e-9) for x in total_bytes)
    for history in [[START], [START, b"the"], [b"many", b"of"], [b"never", b"seen"], [b"the", b"the"]]:
        rest = unseen
        for k in range(1, len(history) + 1):
            if (context := tuple(history[-k:])) in plain.states:
                n, t = plain.grams[context], len(plain.states[context])
                rest *= t / (n + t)
        assert math.isclose(sum(plain.p(history, w) for w in known) + rest, 1, rel_tol=1e-9)


def test_many_blocks_and_ranges_give_the_same(spark, texts):
    docs = documents(spark, texts).repartition(3)
    one = {r["doc_id"]: r for r in suffix_tree.language_scores(docs).collect()}
    many = {r["doc_id"]: r for r in suffix_tree.language_scores(docs, block_bytes=1500, range_keys=60).collect()}
    for i, r in one.items():
        assert (r["n_known"], r["train_tokens"]) == (many[i]["n_known"], many[i]["train_tokens"]) and math.isclose(r["base_score"], many[i]["base_score"], rel_tol=1e-9)
        # followers are added up in steps of 1 / 16, so blocks round differently
        assert abs(r["score"] - many[i]["score"]) < 0.05 * r["n_tokens"] + 0.1


def test_repeated_texts_score_higher(spark, texts):
    rng = np.random.default_rng(3)
    fresh = [sentence(rng, 80) for _ in range(40)]
    fresh[20:30] = fresh[10:20]
    rows = suffix_tree.language_scores(documents(spark, [*texts, *fresh])).collect()
    mean = {r["doc_id"]: r["score"] / r["n_tokens"] for r in rows}
    kept = [i for i in range(40) if zlib.crc32(str(i + len(texts)).encode()) % 5 != 1]
    twice = [mean[i + len(texts)] for i in kept if 10 <= i < 20 and i + 10 in kept]
    once = [mean[i + len(texts)] for i in kept if i < 10]
    assert twice and min(twice) > max(once)


def test_integers_as_bytes():
    rng = np.random.default_rng(5)
    for values in ([], [0], [0, 0, 0], [1, 255, 256, 2**40], rng.integers(0, 2**62, 50)):
        x = np.array(values, np.uint64)
        assert (exchange.from_bytes(exchange.to_bytes(x), len(x)) == x).all()


def test_words_of_slices():
    texts = [f"W{i} the\x0b{'a b ' * (i % 30)}\t" for i in range(40)] + [None, "", " ", "é ü　ß\x1cx \n"]
    for a, b in ((0, 44), (8, 14), (5, 6), (30, 44)):
        n, found = suffix_tree.split(pa.array(texts)[a:b])
        plain = [words(t) for t in texts[a:b]]
        assert n.tolist() == [len(w) for w in plain] and [w.encode() for w in found.to_pylist()] == [x for w in plain for x in w]


def test_ranks_of_keys():
    rng = np.random.default_rng(6)
    close = (rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(60)) | rng.integers(0, 40, 500).astype(np.uint64)  # alike in their leading bits
    for keys, bits in ((rng.integers(0, 90, 700).astype(np.uint64), 48), (close, 64), (np.zeros(0, np.uint64), 64), (np.array([7], np.uint64), 64)):
        distinct, place, first = exchange.ranked(keys, bits)
        plain = np.unique(keys, return_index=True, return_inverse=True)
        assert (distinct == plain[0]).all() and (first == plain[1]).all() and (place == plain[2]).all()


def test_nothing_to_learn_from(spark):
    assert suffix_tree.language_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = suffix_tree.language_scores(documents(spark, ["a b", None], ids=held)).collect()
    assert [r["train_tokens"] for r in rows] == [0, 0] and all(r["base_score"] == 0 and -100 < r["score"] < 0 for r in rows)
    rows = suffix_tree.language_scores(documents(spark, [None, ""], ids=[None, None])).collect()
    assert [r["n_known"] for r in rows] == [1, 1] and not any(r["held_out"] for r in rows)


def test_a_very_long_text(spark):
    text = "alpha beta gamma " * 100_000 + "end"
    row = suffix_tree.language_scores(documents(spark, [text, "alpha beta"], ids=[None, None])).orderBy("n_tokens").collect()[1]
    assert row["n_tokens"] == 300_002 and row["score"] > row["base_score"]
