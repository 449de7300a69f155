"""Language-model scores from a probabilistic suffix tree over tokens.

A text is its lower-cased (A-Z) words and one end token.  The tree's states are contexts of one to
``depth`` preceding tokens (the start of a text is one).  A context is retained when it precedes at least
``least`` training tokens and its next-token distribution diverges from that of its suffix (the context without its first
token): the log-likelihood that it gains over the suffix, in nats, exceeds ``divergence`` and what its
followers cost, ``follower_cost`` times the log of the vocabulary for each distinct one.  A token is predicted by the longest
retained suffix of what precedes it.  A state with n occurrences and t distinct followers gives t / (n + t) to the
distribution of the longest retained context among its own suffixes, down to the root of single tokens.  The
root gives types / (tokens + types) to the spelling of words, chains of up to three bytes before (learned from distinct words, those of a
block at a time), which is how unseen words get their share; so the probabilities of all texts sum to 1.

The work is laid out so that no table of counts is ever in one place:

* Neighbouring documents make up blocks of about ``block_bytes``, whose distinct words and tokens are written once, bucketed by block, so
  that all later passes find a block where it lies.
* A block hashes its tokens and n-grams, combines equal ones, and sends the sorted distinct keys with their counts
  to key ranges.  A range adds the counts up and answers each block with the totals in the order of its keys.
* With these, each block adds up the divergence of the contexts it holds; ranges add up again and answer
  with the number of followers of retained contexts.  Then each block scores its documents whole.

A key range holds about ``range_keys`` keys at any size of the corpus; a frequent key is one entry for each block.
Tokens are told apart by 64 bits of XXH64, n-grams by 20 bits more than it takes to number them all (at most 64), so
about one n-gram in a million shares its key.  Divergences and followers are added up in steps of 1 / 16.  The
driver gets the counts of byte chains (a few ten thousand; 2 * 2**21 at most) and totals.

Defined cases: a null or empty text has the end token only; repeated rows count
and give a row each; a null id is a training row; an empty table gives an empty
result; without training rows all counts are zero and the scores stay finite
(the base score then is 0 per token, its log of 0.5 / 0.5).  A very long text makes its block longer, at some 80 bytes of memory a token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, staged
from .exchange import MESSAGE, SENT, answers, bucketed, exchanged, followed, from_bytes, messages, opened, places, ranked, received, rows_of, to_bytes

CONTEXTS, WORDS, GRAMS = 0, 1, 2
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
STEP = 16
BLOCK = "block long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, words binary, ids binary, train_docs long, train_words long"
#: Of the spelling: most bytes before, classes they are hashed into, weight of the shorter order.
ORDERS, CLASS_BITS, PRIOR = 3, 13, 5.0
CLASSES = 1 << CLASS_BITS
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


_BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
        ("words", pa.binary()), ("ids", pa.binary()), ("train_docs", pa.int64()), ("train_words", pa.int64()),
    ]
)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words, with A-Z in lower case.

    Arrow's split knows the six ASCII white spaces alone, as the contract asks; it gives empty words at the ends.
    """
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))  # casts of slices go wrong in some versions of Arrow
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    every, n = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    good = pc.greater(pc.binary_length(every), 0)
    before = np.concatenate([[0], np.cumsum(good.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(n)
    return before[ends] - before[ends - n], every.filter(good)


def block_row(number: int, doc_ids: list, held: list[bool], sizes: np.ndarray, words: pa.Array) -> tuple:
    """A block of documents: its distinct words in the order of their hashes, and its tokens as places among them."""
    coded = words.dictionary_encode()
    data, ends = coded.dictionary.buffers()[2], np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
    data = data.to_pybytes() if data else b""
    types = [data[a:b] for a, b in zip(ends, ends[1:])]
    order = np.argsort(hashes(types), kind="stable")
    place = np.empty(len(types), np.int64)
    place[order] = np.arange(len(types))
    train = ~np.array(held, bool)
    ids = place[coded.indices.to_numpy()] if len(types) else np.zeros(0, np.int64)
    return number, doc_ids, held, sizes.tolist(), b" ".join([types[i] for i in order]), to_bytes(ids), int(train.sum()), int(sizes[train].sum())


class Block:
    """The tokens of a block of documents, and for each token its keys by order."""

    def __init__(self, row: pa.Table, depth: int, bits: int):
        of = lambda name: row.column(name)[0]
        sizes = of("sizes").values.to_numpy().astype(np.int64)
        self.doc_ids, self.held_out = of("doc_ids").values, of("held_out").values
        train = ~self.held_out.to_numpy(zero_copy_only=False).astype(bool)
        self.words = of("words").as_py().split(b" ") if len(self.doc_ids) and sizes.sum() else []
        self.names = hashes(self.words)  # in ascending order
        self.ids = from_bytes(of("ids").as_py(), int(sizes.sum())).astype(np.int64)
        self.lengths = sizes + 1  # with the end token
        size = sizes + 2  # and with the start
        ends = np.cumsum(size)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(int(size.sum())) - np.repeat(ends - size, size)  # 0 at the start
        self.train = train[self.doc]
        self.is_word = np.ones(len(self.doc), bool)
        self.is_word[ends - 1] = self.is_word[ends - size] = False
        self.token = np.empty(len(self.doc), np.uint64)
        self.token[ends - size], self.token[ends - 1] = START, END
        self.token[self.is_word] = self.names[self.ids]
        shift = np.uint64(64 - bits)
        grams, keys = [self.token], self.token
        for _ in range(depth):
            keys = followed(np.concatenate([keys[:1], keys[:-1]]), self.token)
            grams.append(keys >> shift)
        self.grams = grams  # grams[k] ends at its position and has k + 1 tokens; valid where place >= k
        self.depth, self.bits = depth, bits

    def _grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of all n-grams of two tokens or more, and the place of each n-gram among them, by order and position."""
        return ranked(np.concatenate([self.grams[k][self.place >= k] for k in range(1, self.depth + 1)]), self.bits)[:2]

    def counts(self, family: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in order, and how often each occurs in training texts."""
        if family == WORDS:
            return self.names, np.bincount(self.ids[self.train[self.is_word]], minlength=len(self.names))
        keys, place = self._grams()
        train = np.concatenate([self.train[self.place >= k] for k in range(1, self.depth + 1)])
        return keys, np.bincount(place[train], minlength=len(keys))

    def placed(self, totals: dict[int, np.ndarray], n_train: int) -> list[np.ndarray]:
        """For each order k from 1 the training occurrences of the k tokens that end at each position."""
        n = len(self.token)
        word = np.full(n, n_train, np.float64)  # starts and ends occur once a training text
        word[self.is_word] = totals[WORDS][self.ids]
        found, at = [word], 0
        grams = totals[GRAMS][self._grams()[1]]
        for k in range(1, self.depth + 1):
            valid = self.place >= k
            total = np.zeros(n, np.float64)
            total[valid] = grams[at : (at := at + int(valid.sum()))]
            found.append(total)
        return found

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that have k tokens before them, and the keys of these as contexts."""
        at = np.nonzero(self.place >= k)[0]
        return at, followed(np.full(len(at), k, np.uint64), self.grams[k - 1][at - 1]) >> np.uint64(64 - self.bits)


def spelt_codes(types: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 to 3: which bytes of the joined words have so many before them, and codes of those and of the byte.

    Words are joined by spaces; a word's history begins with the space before it.  Histories of more than one byte are hashed.
    """
    raw = np.frombuffer(b" " + b" ".join(types) + b" ", np.uint8).astype(np.uint32)
    size = np.array([len(x) + 1 for x in types], np.int32)
    place = np.arange(len(raw) - 1, dtype=np.int32) - np.repeat(np.cumsum(size, dtype=np.int32) - size, size)
    before, byte, history = raw[:-1], raw[1:].astype(np.int32), raw[:-1].copy()
    for order in range(1, ORDERS + 1):
        if order > 1:
            history[order - 1 :] |= before[: len(before) - order + 1] << np.uint32(8 * (order - 1))
        classes = history if order == 1 else history * np.uint32(0x9E3779B1) >> np.uint32(32 - CLASS_BITS)
        yield place >= order - 1, (classes.astype(np.int32) + np.int32((order - 1) * CLASSES)) * np.int32(256) + byte


class Spelling:
    """Byte chains of distinct words: a byte given up to three before it (in CLASSES classes), each order smoothed by the shorter one."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.counts = np.zeros(ORDERS * CLASSES * 256, np.float32)
        self.counts[codes] = counts
        self.totals = self.counts.reshape(ORDERS * CLASSES, 256).sum(axis=1)

    def log10(self, types: list[bytes]) -> np.ndarray:
        """log10 probability of each word and the space that closes it."""
        if not types:
            return np.zeros(0)
        size = np.array([len(x) + 1 for x in types], np.int64)
        p = np.full(int(size.sum()), 1 / 256)
        for valid, codes in spelt_codes(types):
            p = np.where(valid, (self.counts[codes] + PRIOR * p) / (self.totals[codes >> 8] + PRIOR), p)
        return np.add.reduceat(np.log10(p), np.cumsum(size) - size)


def language_scores(
    docs: DataFrame, depth: int = 2, least: int = 2, divergence: float = 2.0, follower_cost: float = 0.6, block_bytes: int = 8 << 20, range_keys: int = 2_000_000
) -> DataFrame:
    """Base and suffix-tree scores of each row of ``docs`` (doc_id, text); rows whose id's remainder is 1 are held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "held_out", held_out(F.col("doc_id"), 5)
    )
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring documents to blocks."""
        partition, number = TaskContext.get().partitionId(), 0
        doc_ids, held, sizes, words, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            key = xxhash.xxh64_intdigest(f"{partition} {number}") - (1 << 63)
            row = block_row(key, doc_ids, held, np.concatenate(sizes), pa.concat_arrays(words))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            texts, at = batch.column(1), 0
            grown = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 16)
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(grown, (grown[at - 1] if at else 0) + block_bytes - size, "right")))
                doc_ids += batch.column(0)[at:end].to_pylist()
                held += batch.column(2)[at:end].to_pylist()
                n, found = split(texts[at:end])
                sizes.append(n)
                words.append(found)
                size += int(grown[end - 1] - (grown[at - 1] if at else 0))
                at = end
                if size >= 0.9 * block_bytes:
                    yield flush()
                    doc_ids, held, sizes, words, size, number = [], [], [], [], 0, number + 1
        if doc_ids:
            yield flush()

    texts = bucketed(rows.select("doc_id", "text", "held_out").mapInArrow(gather, BLOCK), n_bytes // block_bytes)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spelling codes of the words of the training texts of each block."""
        for batch in batches:
            for row in range(batch.num_rows):
                own = Block(pa.table(batch.slice(row, 1)), 0, 64)
                known = own.counts(WORDS)[1] > 0
                types = [w for w, k in zip(own.words, known) if k]
                codes = [c[valid] for valid, c in spelt_codes(types)] if types else [np.zeros(0, np.int32)]
                n = np.bincount(np.concatenate(codes))
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], names=["code", "n"])

    n_docs, n_words, n_blocks = texts.agg(F.sum("train_docs"), F.sum("train_words"), F.count("*")).first()
    if not n_blocks:
        return spark.createDataFrame([], SCORES)
    found = texts.mapInArrow(survey, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, n_train = spark.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("code", "n"))), n_words + n_docs

    n_tokens = max(1, n_bytes // 5)
    bits = min(64, max(40, math.ceil(math.log2(n_tokens * depth)) + 20))
    ranges = {WORDS: max(1, n_tokens // (4 * range_keys)), GRAMS: max(1, n_tokens * depth * 3 // (4 * range_keys))}
    key_bits = {WORDS: 64, GRAMS: bits}
    def parsed(table: pa.Table) -> Block:
        return Block(table, depth, bits)

    def send(table: pa.Table) -> pa.Table:
        own, number, rows = parsed(table), table.column("block")[0].as_py(), []
        for family in (WORDS, GRAMS):
            keys, counts = own.counts(family)
            rows += messages(number, family, keys, counts, None, key_bits[family], ranges[family])
        return rows_of(rows, MESSAGE)

    totals = staged(exchanged(texts.groupBy("block").applyInArrow(send, SENT)), "totals")
    distinct = totals.where(F.col("family") == WORDS).agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    v = distinct + (n_docs > 0)
    cost = follower_cost * math.log(max(2, v))

    def diverge(table: pa.Table, known: pa.Table) -> pa.Table:
        """Sends, for each context of a block that occurs often enough, the divergence and the followers found here."""
        own = parsed(table)
        counts = [np.full(len(own.token), float(n_train)), *own.placed({f: received(known, f) for f in (WORDS, GRAMS)}, n_docs)]
        known = []
        for k in range(1, depth + 1):
            at, keys = own.contexts(k)
            often = counts[k][at - 1] >= least
            known.append((at[often], keys[often]))
        keys, place, _ = ranked(np.concatenate([x for _, x in known]), bits)
        gains, followers, done = np.zeros(len(keys)), np.zeros(len(keys)), 0
        for k, (at, _) in enumerate(known, 1):
            train = own.train[at]  # contexts of other texts are asked for and add nothing
            where = place[done : (done := done + len(at))][train]
            at = at[train]
            gain = np.log(counts[k + 1][at] * counts[k - 1][at - 1] / (counts[k][at - 1] * counts[k][at]))
            followers += np.bincount(where, 1 / counts[k + 1][at], len(keys))
            gains += np.bincount(where, gain, len(keys))
        gains = np.rint((gains - cost * followers) * STEP).astype(np.int64)
        followers = np.rint(followers * STEP).astype(np.int64)
        signed = (gains << 1) ^ (gains >> 63)  # small numbers of either sign in few bytes
        number = table.column("block")[0].as_py()
        return rows_of([*messages(number, CONTEXTS, keys, signed, followers, bits, ranges[WORDS])], MESSAGE)

    def retained(table: pa.Table) -> pa.Table:
        """Answers with the followers of the contexts that diverge enough, 0 for the others."""
        n, place = places(table)
        signed = np.concatenate(opened(table, "counts")).astype(np.int64)
        gains = np.bincount(place, (signed >> 1) ^ -(signed & 1), n)
        followers = np.bincount(place, np.concatenate(opened(table, "more")).astype(np.float64), n)
        return answers(table, np.where(gains > divergence * STEP, np.maximum(followers, STEP), 0)[place])

    asked = texts.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(diverge, SENT)
    states = staged(exchanged(asked, retained), "states")
    fresh = (v + 1) / (n_train + v + 1)
    denominator = n_train + 0.5 * (v + 1)

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        own = parsed(table)
        counts = own.placed({f: received(told, f) for f in (WORDS, GRAMS)}, n_docs)
        spell = Spelling(*codes.value)
        spelt = np.full(len(own.token), spell.log10([b""])[0])  # the end token is spelt as a word without bytes
        spelt[own.is_word] = spell.log10(own.words)[own.ids]
        c = counts[0]
        p = (1 - fresh) * c / max(1, n_train) + fresh * 10**spelt
        log_p = np.where(c > 0, np.log10(np.maximum(p, 1e-300)), math.log10(fresh) + spelt)
        followers, known = received(told, CONTEXTS) / STEP, []
        for k in range(1, depth + 1):
            at, keys = own.contexts(k)
            n = counts[k - 1][at - 1]
            known.append((at[n >= least], keys[n >= least], n[n >= least]))
        followers, done = followers[ranked(np.concatenate([keys for _, keys, _ in known]), bits)[1]], 0
        for k, (at, keys, n) in enumerate(known, 1):
            t = followers[done : (done := done + len(at))]
            at, n, t = at[t > 0], n[t > 0], t[t > 0]
            seen = counts[k][at] > 0
            log_p[at] += np.log10(t / (n + t))
            at, n, t = at[seen], n[seen], t[seen]
            log_p[at] = np.log10(10 ** log_p[at] + counts[k][at] / (n + t))
        real = own.place > 0
        base = np.log10((c + 0.5) / denominator)
        total = lambda x: np.bincount(own.doc[real], x[real], len(own.lengths))
        return pa.table(
            {
                "doc_id": own.doc_ids,
                "held_out": own.held_out,
                "n_tokens": pa.array(own.lengths, pa.int64()),
                "n_known": pa.array(total((c > 0).astype(float)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(own.lengths), n_train, np.int64)),
                "base_score": pa.array(total(base)),
                "score": pa.array(total(log_p)),
            }
        )

    return texts.groupBy("block").cogroup(totals.union(states).groupBy("block")).applyInArrow(score, SCORES)
