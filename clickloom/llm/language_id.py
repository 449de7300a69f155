"""Language identification by hyperdimensional profiles.

1. Every letter has a random vector of ``dim`` signs, drawn from a hash of its code point, so letters need no table.  A text
   in lower case is a sequence of letters in which each run of other characters is one boundary.
2. An n-gram (1 to 3 letters, boundaries among them) is bound from its letters' vectors, each permuted by its place: signs are
   multiplied, which on packed bits is an exclusive or; the permutation is a cyclic shift by 64 places.
3. A text's vector is the bundle (sum) of its n-grams' vectors, a language's prototype the bundle of all its training texts.
4. A text gets the language whose prototype has the largest cosine with its vector; that cosine, at least 0, is the score.

Bundles are sums, so a task adds up its training texts by language and hands on one vector a language; only the prototypes
(languages x dim numbers) come to the driver and are broadcast.  More than ``max_languages`` values are refused rather than
cut.  A block of texts is worked on as arrays: the distinct n-grams of the block are bound once, and texts are sums of them by a
matrix product.  Texts of any length are read in slices.

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; so is every text if no row
trains.  A null id is neither held out nor trained on; rows with a null language don't train; an empty language is a value
like any other.  Of equal cosines the first language in order wins.  Repeated rows give a row each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

UNKNOWN = "und"
#: The code of a boundary: that of the space, which is no letter.
BOUNDARY = 32
ORDERS = 3
#: Characters of a block of texts, and of a slice of a long one.
BLOCK_CHARS = 1 << 20
BLOCK_TEXTS = 512
#: Numbers of a block of n-gram vectors, and n-grams up to which places are looked up instead of sorted.
SLICE, TABLE = 1 << 23, 1 << 22
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Random-looking 64-bit numbers of whole numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """Packed signs of code points: [codes, dim / 64] of 64 bits each."""
    word = np.arange(dim // 64, dtype=np.uint64)[None, :]
    return _mixed((codes.astype(np.uint64)[:, None] << np.uint64(16) | word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def bind(grams: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of n-grams given as [n, order] code points, as signs +1 and -1: [n, dim]."""
    found, place = np.unique(grams, return_inverse=True)
    letters, place = letter_vectors(found, dim), place.reshape(grams.shape)
    bits = np.zeros((len(grams), dim // 64), np.uint64)
    for i in range(grams.shape[1]):
        bits ^= np.roll(letters, grams.shape[1] - 1 - i, axis=1)[place[:, i]]
    return 1 - 2 * np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)


def sequences(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """(codes, first): the letters of ``text`` with single boundaries before, between and after.

    A long text comes in slices; each after the first begins with the last codes of the one before, so that no n-gram is
    lost, and ``first`` tells where the codes begin that are new.
    """
    text, letters, tail = text.lower(), _letters(), np.array([BOUNDARY], np.uint32)
    for at in range(0, max(1, len(text)), BLOCK_CHARS):
        codes = np.frombuffer(text[at : at + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(letters[codes], codes, BOUNDARY)
        if at + BLOCK_CHARS >= len(text):
            codes = np.append(codes, BOUNDARY)
        after = np.concatenate([tail[-1:], codes[:-1]])
        found = np.concatenate([tail, codes[(codes != BOUNDARY) | (after != BOUNDARY)]]).astype(np.uint32)
        yield found, len(tail)
        tail = found[-(ORDERS - 1) :]


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``size`` in order, and the place of each key among them."""
    if size > TABLE:
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]


def bundles(parts: list[tuple[np.ndarray, int]], owners: np.ndarray, n: int, dim: int) -> np.ndarray:
    """[n, dim]: for each of ``n`` owners the sum of the n-gram vectors of its sequences."""
    total = np.zeros((n, dim))
    lengths = np.array([len(codes) for codes, _ in parts])
    codes, owner = np.concatenate([c for c, _ in parts]), np.repeat(owners, lengths)
    place_in_part = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = np.repeat(np.array([f for _, f in parts]), lengths)
    alphabet, letter = _places(codes, 0x110000)
    a, step, key = len(alphabet), max(1, SLICE // dim), np.zeros(len(codes), np.int64)
    for order in range(1, ORDERS + 1):
        key[order - 1 :] += letter[: len(letter) - order + 1] * a ** (order - 1)
        ends = place_in_part >= np.maximum(first, order - 1)
        if order == 1:
            ends &= codes != BOUNDARY
        grams, place = _places(key[ends], a**order)
        of = owner[ends] * min(step, len(grams))
        spelled = alphabet[np.stack([grams // a**k % a for k in reversed(range(order))], axis=1)]
        for at in range(0, len(grams), step):
            m, width = min(step, len(grams) - at), min(step, len(grams))
            here = (place >= at) & (place < at + m) if m < len(grams) else slice(None)
            counts = np.bincount(of[here] + place[here] - at, minlength=n * width).reshape(n, width)[:, :m]
            total += counts.astype(np.float32) @ bind(spelled[at : at + m], dim)
    return total


def in_blocks(texts: Iterator[str | None]) -> Iterator[tuple[list[tuple[np.ndarray, int]], np.ndarray, bool]]:
    """(sequences, number of the text of each, whether the last text goes on in the next block) of neighbouring texts."""
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for k, (codes, first) in enumerate(sequences(text or "")):
            if parts and (size >= BLOCK_CHARS or i - owners[0] >= BLOCK_TEXTS):
                yield parts, np.array(owners), k > 0
                parts, owners, size = [], [], 0
            parts.append((codes, first))
            owners.append(i)
            size += len(codes)
    if parts:
        yield parts, np.array(owners), False


def vectors(texts: Iterator[str | None], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of texts in their order, in blocks, and how many letters each text has."""
    rest, letters_before = np.zeros(dim), 0
    for parts, owners, goes_on in in_blocks(texts):
        n = int(owners[-1] - owners[0]) + 1
        found = bundles(parts, owners - owners[0], n, dim)
        letters = np.bincount(owners - owners[0], [int((codes[first:] != BOUNDARY).sum()) for codes, first in parts], n)
        found[0] += rest
        letters[0] += letters_before
        rest, letters_before = (found[-1], letters[-1]) if goes_on else (np.zeros(dim), 0)
        if n > goes_on:
            yield found[: n - goes_on], letters[: n - goes_on]


def prototypes(docs: DataFrame, dim: int = 1024, max_languages: int = 4096) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` (lang, text) in order, and their prototypes [languages, dim] of length 1."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flushed() -> pa.RecordBatch:
            columns = [
                pa.array(np.repeat(np.array(list(sums), object), dim), pa.string()),
                pa.array(np.tile(np.arange(dim, dtype=np.int32), len(sums))),
                pa.array(np.rint(np.concatenate([np.zeros(0), *sums.values()])).astype(np.int64)),
            ]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "at", "value"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            known = sorted(set(langs))
            numbers = {x: i for i, x in enumerate(known)}
            of = np.array([numbers[x] for x in langs])
            for parts, owners, _ in in_blocks(x.as_py() for x in batch.column(1)):
                met, place = np.unique(of[owners], return_inverse=True)
                for lang, vector in zip(met, bundles(parts, place, len(met), dim)):
                    sums[known[lang]] = sums.get(known[lang], 0.0) + vector
                if len(sums) > 256:
                    yield flushed()
        yield flushed()

    pairs = docs.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = pairs.mapInArrow(add, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    whole = staged(sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("sums")), "prototypes")
    if whole.count() > max_languages:
        raise ValueError(f"more than {max_languages} values of lang: is it a language?")
    found = sorted((r["lang"], r["sums"]) for r in whole.collect())
    table = np.array([x for _, x in found], float).reshape(len(found), dim)
    return [x for x, _ in found], table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)


def languages(docs: DataFrame, train: DataFrame | None = None, dim: int = 1024) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text, lang).

    Prototypes are those of ``train`` (lang, text); without it, of the rows of ``docs`` that are not held out.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    names, table = prototypes(docs.where(fold != 0) if train is None else train, dim)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for found, letters in vectors((x.as_py() for x in batch.column(2)), dim):
                length = np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)
                cosine = (found / length) @ table.T if names else np.zeros((len(found), 1))
                known = (letters > 0) & bool(names)
                best += [names[i] if k else UNKNOWN for i, k in zip(cosine.argmax(axis=1), known)]
                score += np.where(known, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0).tolist()
            columns = [batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold == 0, F.lit(False)), F.col("text").cast("string"))
    return rows.mapInArrow(predict, PREDICTED)
