"""Benchmark decontamination by latent semantic retrieval.

1. Passages are stretches of ``BLOCK`` words; their words are hashed into ``CELLS`` cells.
   Inverse passage frequencies come from all passages of all documents.
2. A randomised SVD of the TF-IDF passage matrix gives a ``rank``-dimensional latent
   space.  Its products (A'AQ) run as Spark jobs over a passage table: all passages of all documents, as two bytes a word,
   and all benchmark passages, the latter weighted to the same total.  Only cell-by-rank matrices, whose size
   does not depend on the data, come to the driver, for a QR step.
3. Every document is searched whole: windows of neighbouring passages (``WIDTHS``: two for benchmark passages of at most
   20 words, three up to 33, four for longer ones) are projected and compared by cosine with all
   benchmark passages, in blocks of ``query_block`` queries.
4. Cosines in a fixed rank can't tell thousands of passages apart, so what they leave out goes through a second net of
   shared words, which loses no copy (``by_cosine`` tells which of the two found a pair): a subsequence of m of a passage's n words has, of its n - m + k
   rarest words, at least k.  Stretches that hold so many (k is a third of m) are candidates too; their cosine is that
   of the stretch itself.
5. A candidate is checked exactly: the longest common subsequence of the benchmark passage and all
   stretches of the window (with ``MARGIN`` words on both sides) that are a quarter longer than the
   passage.  It is a leak if the subsequence covers
   ``exact`` (0.8) of the passage, or covers ``paraphrase`` (0.6) and the answer, the last third of
   the item's words, is covered by 0.6 as well.  Items under eight words must be covered whole.

A benchmark of more than ``block_bytes`` of text is searched in blocks, each with a space of its own, so that what is broadcast is bounded.

Words are runs of letters, digits and non-ASCII characters, with A-Z in lower case.

Defined cases: a null or empty text has no windows and no leak; an item that is null or has no
word is never found; items with equal text are all reported; repeated rows yield one pair (or go together); an empty
benchmark or table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

CELLS = 1 << 15
BLOCK = 16
MARGIN = 12
PASSAGE = 48
#: Passages in a window, and up to how many words a benchmark passage is compared with it.
WIDTHS = ((2, 20), (3, 33), (4, PASSAGE + 1))
SPLITS = 64
#: Passages in a row of the passage table, words that are cut into passages at once, and passages of which products are taken at once.
ROW, CUT, STEP = 256, 1 << 16, 1 << 14
#: Cells that occur more often among these are added up by themselves.
FREQUENT = 32
#: Words of a row of benchmark passages.
ITEM = PASSAGE + 1
GAP = 3
#: Words of neighbouring short texts that are searched at once; a longer text is searched by itself.
GROUP_WORDS = 30_000
PARTS = "block int, sums binary"
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
HIT = pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("word", pa.int64()), ("by_cosine", pa.bool_())])
HITS = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double,word:bigint,by_cosine:boolean>>"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def cells(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & (CELLS - 1)).astype(np.int64)


def _parts(total: np.ndarray) -> pa.RecordBatch:
    """A task's sums as ``SPLITS`` rows (block, sums): plain bytes, as they are many numbers."""
    flat = np.array_split(total.ravel(), SPLITS)
    return pa.RecordBatch.from_arrays([pa.array(range(SPLITS), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["block", "sums"])


def _summed(parts: DataFrame, kind) -> np.ndarray:
    """The tasks' sums added up by block in Spark, one part after another; what reaches the driver has the size of one task's."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = 0, 0
        for batch in batches:
            for at, x in zip(batch.column(0), batch.column(1)):
                block, total = at.as_py(), total + np.frombuffer(x.as_buffer(), kind)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])

    add.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    rows = parts.groupBy("block").applyInArrow(add, PARTS).collect()
    return np.concatenate([np.frombuffer(r["sums"], kind) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(CELLS + 1, kind)


def _rows(passages: list[np.ndarray], width: int) -> list[bytes]:
    """Stretches of cells as rows of passages of ``width`` cells: each stretch begins a passage, CELLS fills its last one, cells are sorted."""
    lengths = np.array([len(c) for c in passages])
    sizes = -(-lengths // width) * width
    found = np.full(sizes.sum(), CELLS, np.uint16)
    found[np.arange(lengths.sum()) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(lengths) + lengths, lengths)] = np.concatenate(passages)
    found = found.reshape(-1, width)
    found.sort(axis=1)
    return [found[at : at + ROW].tobytes() for at in range(0, len(found), ROW)]


def _of_rows(rows: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in rows), np.uint16).reshape(-1, width)


def passage_table(docs: DataFrame) -> DataFrame:
    """(cells): all passages of all documents, ``ROW`` of them in a row as sorted 16-bit cells, whatever the length of a text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for text in batch.column(0):
                c = cells(tokens(text.as_py()))
                for at in range(0, len(c), CUT):
                    parts.append(c[at : at + CUT])
                    held += len(parts[-1])
                    if held >= CUT:
                        yield pa.RecordBatch.from_arrays([pa.array(_rows(parts, BLOCK), pa.binary())], names=["cells"])
                        parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(_rows(parts, BLOCK), pa.binary())], names=["cells"])

    return staged(docs.select(F.col("text").cast("string")).mapInArrow(cut, "cells binary"), "passages")


def passage_frequencies(passages: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of the passage table's passages each cell occurs, and how many passages there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(CELLS + 1, np.int64), 0
        for batch in batches:
            found = _of_rows(batch.column(0), BLOCK)
            total += np.bincount(found[:, 0], minlength=CELLS + 1)
            total += np.bincount(found[:, 1:][found[:, 1:] != found[:, :-1]], minlength=CELLS + 1)
            n += len(found)
        total[CELLS] = n
        yield _parts(total)

    found = _summed(passages.mapInArrow(count, PARTS), np.int64)
    return found[:CELLS], int(found[CELLS])


def query_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_bytes`` of text: one part is what a task and the driver hold at once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [items] * n


def _item_passages(items: DataFrame) -> list[tuple[int, list[bytes], list[bytes]]]:
    """(item_id, words of a passage, words of the item's answer): one block of the stated query set."""
    found = []
    for r in items.select("item_id", "text").distinct().collect():
        w = tokens(r["text"])
        if r["item_id"] is None or not w:
            continue
        n = -(-len(w) // PASSAGE)
        cuts = [round(i * len(w) / n) for i in range(n + 1)]
        answer = w[-max(1, len(w) // 3) :]
        found += [(r["item_id"], w[a:b], answer) for a, b in zip(cuts, cuts[1:])]
    return sorted(found)


def _weights(passages: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each passage's TF-IDF weights at length 1, where a cell first occurs; 0 elsewhere."""
    first = np.ones(passages.shape, bool)
    first[:, 1:] = passages[:, 1:] != passages[:, :-1]
    at = np.flatnonzero(first)
    found = np.zeros(passages.size, np.float32)
    found[at] = np.diff(at, append=passages.size) * idf[passages.ravel()[at]]
    found = found.reshape(passages.shape)
    return found / np.maximum(np.sqrt(np.einsum("ij,ij->i", found, found)), 1e-12)[:, None]


def _add(out: np.ndarray, passages: np.ndarray, weights: np.ndarray, y: np.ndarray) -> None:
    """Adds A'y: for each cell the weighted rows of ``y`` of the passages that hold it."""
    width, flat, w = passages.shape[1], passages.ravel(), weights.ravel()
    used = np.flatnonzero(w)
    used = used[np.argsort(flat[used], kind="stable")]
    own = flat[used]
    start = np.flatnonzero(np.diff(own, prepend=np.uint16(CELLS + 1)))
    times = np.diff(start, append=len(own))
    frequent = times > FREQUENT
    for i in range(FREQUENT):  # the i-th occurrence of each cell: no cell twice
        at = start[~frequent & (times > i)]
        chosen = used[at + i]
        out[own[at]] += y[chosen // width] * w[chosen][:, None]
    for at, n in zip(start[frequent].tolist(), times[frequent].tolist()):
        chosen = used[at : at + n]
        out[own[at]] += w[chosen] @ y[chosen // width]


def _products(passages: DataFrame, q: np.ndarray, idf: np.ndarray, scale: float) -> np.ndarray:
    """A'(A q) over ``passages`` (cells, width), those of the benchmark times ``scale``: summed by cell blocks in Spark, CELLS x rank to the driver."""
    shared = passages.sparkSession.sparkContext.broadcast((q, idf))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, idf = shared.value
        q, idf = np.vstack([q, np.zeros((1, q.shape[1]), np.float32)]), np.append(idf, 0).astype(np.float32)  # the last cell pads
        out = np.zeros(q.shape, np.float32)
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for width in np.unique(widths).tolist():
                rows = _of_rows(batch.column(0).take(pa.array(np.flatnonzero(widths == width))), width)
                room = np.empty((64, width, q.shape[1]), np.float32)
                for at in range(0, len(rows), STEP):
                    part = rows[at : at + STEP]
                    w = _weights(part, idf) * np.float32(scale if width == ITEM else 1.0)
                    y = np.empty((len(part), q.shape[1]), np.float32)
                    for i in range(0, len(part), 64):
                        held = room[: len(part) - i]
                        np.take(q, part[i : i + 64], axis=0, out=held, mode="clip")
                        np.einsum("ij,ijk->ik", w[i : i + 64], held, out=y[i : i + 64])
                    _add(out, part, w, y)
        yield _parts(out[:CELLS])

    found = _summed(passages.mapInArrow(multiply, PARTS), np.float32).reshape(CELLS, -1)
    shared.destroy()
    return found


def orthonormal(y: np.ndarray, rows: int = 4096) -> np.ndarray:
    """An orthonormal basis of the columns of ``y`` from their Gram matrix, twice; dependent columns go.

    Works on a few rows at a time, so that the driver holds little besides ``y`` itself.
    """
    for _ in range(2):
        gram = np.zeros((y.shape[1], y.shape[1]))
        for at in range(0, len(y), rows):
            part = y[at : at + rows].astype(np.float64)
            gram += part.T @ part
        values, vectors = np.linalg.eigh(gram)
        used = values > 1e-9 * max(float(values[-1]), 1e-300)
        y = y @ (vectors[:, used] / np.sqrt(values[used])).astype(np.float32)
    return y


class LatentIndex:
    """Projection of weighted cells into the latent space, and the benchmark passages in it."""

    def __init__(self, weights: np.ndarray, items: list[tuple[int, list[bytes], list[bytes]]], idf: np.ndarray):
        self.idf = idf
        self.items = sorted(items, key=lambda x: len(x[1]))
        ends = np.searchsorted([len(w) for _, w, _ in self.items], [most for _, most in WIDTHS], "right")
        self.classes = [(width, int(low), int(high)) for (width, _), low, high in zip(WIDTHS, [0, *ends], ends)]
        self.weights = np.vstack([weights, np.zeros((1, weights.shape[1]), np.float32)])  # the last row pads
        latent = np.array([self.weights[cells(w)].sum(axis=0) for _, w, _ in self.items])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def passages(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Latent vectors of the passages of several texts, ``GAP`` zero rows after each, and the first row of each text."""
        sizes = np.array([-(-len(w) // BLOCK) + GAP for w in texts])
        first = np.concatenate([[0], np.cumsum(sizes)])
        c = np.full(first[-1] * BLOCK, CELLS, np.int64)
        own = cells([w for words in texts for w in words])
        lengths = np.array([len(w) for w in texts])
        c[np.arange(len(own)) + np.repeat(first[:-1] * BLOCK - np.cumsum(lengths) + lengths, lengths)] = own
        ones, found = np.ones((1, BLOCK), np.float32), np.empty((first[-1], self.weights.shape[1]), np.float32)
        c, room = c.reshape(-1, BLOCK), np.empty((64, BLOCK, self.weights.shape[1]), np.float32)
        for at in range(0, len(c), 64):
            part = room[: len(c) - at]
            np.take(self.weights, c[at : at + 64], axis=0, out=part, mode="clip")
            found[at : at + 64] = np.matmul(ones, part)[:, 0]
        return found, first

    def near(self, texts: list[list[bytes]], cosine: float, query_block: int = 4096) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word, end word, number of the benchmark passage, cosine) of windows at ``cosine`` or more."""
        blocks, first = self.passages(texts)
        windows, added = blocks, 1
        for width, low, high in self.classes:
            for added in range(added, width):
                windows = windows[:-1] + blocks[added:]  # the zero rows keep windows within their text
            added = width
            if low == high:
                continue
            norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
            used = np.nonzero(norms > 1e-9)[0]
            least = cosine * norms[used]
            step = max(64, min(query_block, (1 << 22) // max(1, len(used))))  # bounds the products of a very long text
            for at in range(low, high, step):
                values = windows[used] @ self.latent[at : min(high, at + step)].T
                places = np.flatnonzero(values >= least[:, None])
                rows, columns = np.divmod(places, values.shape[1])
                values = values.ravel()[places] / norms[used[rows]]
                text = np.searchsorted(first, used[rows], "right") - 1
                for k, i, j, value in zip(text.tolist(), (used[rows] - first[text]).tolist(), columns.tolist(), values.tolist()):
                    yield k, i * BLOCK, (i + width) * BLOCK, at + j, value

    def cosine(self, words: list[bytes], j: int) -> float:
        """The cosine of one stretch and a benchmark passage."""
        x = self.weights[cells(words)].sum(axis=0)
        return float(x @ self.latent[j] / max(float(np.linalg.norm(x)), 1e-12))


def fit_indexes(docs: DataFrame, benchmark: DataFrame, rank: int = 64, rounds: int = 2, seed: int = 11, block_bytes: int = 8 << 20) -> Iterator[LatentIndex]:
    """A latent space with each block of the benchmark in it, one after another; none without a benchmark.

    Passage frequencies and the space are those of all documents.
    A block is read when its turn comes, so the driver holds one block's passages and space.
    """
    found = filter(None, map(_item_passages, query_blocks(benchmark, block_bytes)))
    first = next(found, None)
    if first is None:
        return
    passages = passage_table(docs)
    frequency, n = passage_frequencies(passages)
    idf = np.log((n + 1) / (frequency + 1)) + 0.1
    passages = passages.withColumn("width", F.lit(BLOCK))

    def fit(items: list[tuple[int, list[bytes], list[bytes]]]) -> LatentIndex:
        queries = [(x, ITEM) for x in _rows([cells(w) for _, w, _ in items], ITEM)]
        every = passages.union(docs.sparkSession.createDataFrame(queries, "cells binary, width int").coalesce(1))
        q = np.random.default_rng(seed).standard_normal((CELLS, min(rank, CELLS)), np.float32)
        for _ in range(rounds):
            q = orthonormal(_products(every, q, idf, float(np.sqrt(max(1, n) / len(items)))))
        q *= idf[:, None].astype(np.float32)
        return LatentIndex(q, items, idf)

    for items in chain([first], found):
        yield fit(items)


def _masks(words: list[bytes]) -> dict[bytes, int]:
    found: dict[bytes, int] = {}
    for i, w in enumerate(words):
        found[w] = found.get(w, 0) | 1 << i
    return found


def _length(masks: Iterable[int | None], n: int) -> int:
    """Length of the longest common subsequence of n words and of words given by their masks, bit-parallel."""
    full = (1 << n) - 1
    v = full
    for m in filter(None, masks):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def common_subsequence(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of ``words`` and the n words that ``masks`` holds."""
    return _length(map(masks.get, words), n)


class _Query:
    """What the exact check needs of a benchmark passage."""

    def __init__(self, item_id: int, words: list[bytes], answer: list[bytes]):
        self.item_id, self.n, self.n_answer = item_id, len(words), len(answer)
        self.masks, self.answer_masks = _masks(words), _masks(answer)
        self.distinct = self.masks.keys()

    def covered(self, stretch: list[bytes], answer: bool = False, least: float = 0.0) -> float:
        """Share of the passage (or answer) in its longest common subsequence with a part of ``stretch`` a quarter longer.

        A part may begin at its first common word, so no other beginnings count.  Shares under ``least`` may come out as 0.
        """
        masks, n = (self.answer_masks, self.n_answer) if answer else (self.masks, self.n)
        size, best, need = n + n // 4 + 2, 0, max(1, _least_words(n, least))
        there = list(map(masks.get, stretch))
        for at, here in enumerate(there):
            if here and len(part := there[at : at + size]) - part.count(None) >= max(need, best + 1):
                best = max(best, _length(part, n))
                if best == n:
                    break
        return best / n


def _least_words(n: int, share: float) -> int:
    """The least m with m / n >= share."""
    m = max(0, int(share * n) - 1)
    while m / n < share:
        m += 1
    return m


class _Seeds:
    """The rarest words of each benchmark passage: a copy of at least ``least`` of passage j holds ``matches[j]`` of them."""

    def __init__(self, index: LatentIndex, least: list[float]):
        self.matches, self.sizes, posted = [], [], {}
        for j, ((_, words, _), share) in enumerate(zip(index.items, least)):
            n = len(words)
            m = _least_words(n, share)
            k = max(1, m // 3)
            order = np.argsort(-index.idf[cells(words)], kind="stable")
            for w in {words[i] for i in order[: n - m + k]}:
                posted.setdefault(w, []).append(j)
            self.matches.append(k)
            self.sizes.append(n + n // 4 + 2)
        self.ids = {w: i for i, w in enumerate(posted)}
        self.counts = np.array([len(x) for x in posted.values()], np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.passages = np.array([j for x in posted.values() for j in x], np.int64)
        self.matches, self.sizes = np.array(self.matches, np.int64), np.array(self.sizes, np.int64)

    def stretches(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, passage, first, last): where stretches may begin that hold enough of the passage's rarest words."""
        gap = int(self.sizes.max())
        lengths = np.array([len(w) for w in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(lengths + gap)])  # gaps keep stretches within their text
        word = np.fromiter(map(self.ids.get, chain.from_iterable(texts), repeat(-1)), np.int64, int(lengths.sum()))
        at = np.flatnonzero(word >= 0)
        place, word = at + np.repeat(np.arange(len(texts)) * gap, lengths)[at], word[at]
        times = self.counts[word]
        passage = self.passages[np.arange(times.sum()) + np.repeat(self.begin[word] - np.cumsum(times) + times, times)]
        keys = np.sort(passage * (first[-1] + gap) + np.repeat(place, times))  # by passage, then place
        passage, place = np.divmod(keys, first[-1] + gap)
        ends = np.arange(len(keys)) + self.matches[passage] - 1
        at = np.flatnonzero(ends < len(keys))
        at = at[keys[ends[at]] - keys[at] < self.sizes[passage[at]]]
        at = at[passage[ends[at]] == passage[at]]
        text = np.searchsorted(first, place[at], "right") - 1
        low = np.maximum(place[ends[at]] - self.sizes[passage[at]] + 1, first[text])
        yield from zip(text.tolist(), passage[at].tolist(), (low - first[text]).tolist(), (place[at] - first[text]).tolist())


def _search(index: LatentIndex, cosine: float, exact: float, paraphrase: float):
    """A function from several texts to the leaks of each."""
    queries = [_Query(*x) for x in index.items]
    shares = [1.0 if q.n < 8 else paraphrase for q in queries]
    needs = [_least_words(q.n, share) for q, share in zip(queries, shares)]
    seeds = _Seeds(index, shares)

    def search_words(texts: list[list[bytes]], best: list[dict[int, dict]]) -> None:
        """Adds to ``best`` what stretches with enough of a passage's rarest words hold."""
        gap = int(seeds.sizes.max())
        parts = [(k, at) for k, words in enumerate(texts) for at in range(0, len(words), GROUP_WORDS)]  # bounds what a very long text takes
        at, done = None, -1
        for part, j, low, high in seeds.stretches([texts[k][at : at + GROUP_WORDS + gap] for k, at in parts]):
            k, begin = parts[part]
            q, words, size = queries[j], texts[k], int(seeds.sizes[j])
            if (part, j) != at:
                at, done = (part, j), -1
            low, high = begin + low, begin + high
            low, done = max(low, done + 1), max(done, high)
            masks, known = q.masks, best[k].get(q.item_id)
            there = list(map(masks.get, words[low : high + size]))
            for i in range(high - low + 1):
                if not there[i] or len(part := there[i : i + size]) - part.count(None) < needs[j]:
                    continue
                covered = _length(part, q.n) / q.n
                if covered < shares[j] or (known is not None and covered <= known["lcs"]):
                    continue
                answer = q.covered(words[max(0, low + i - PASSAGE) : low + i + size + MARGIN + PASSAGE], answer=True)
                if covered >= exact or answer >= 0.6:
                    known = {"item_id": q.item_id, "cosine": index.cosine(words[low + i : low + i + size], j), "lcs": covered, "answer": answer, "word": low + i, "by_cosine": bool(known and known["by_cosine"])}
                    best[k][q.item_id] = known

    def search(texts: list[list[bytes]]) -> list[list[dict]]:
        best: list[dict[int, dict]] = [{} for _ in texts]
        at, there = None, frozenset()
        for k, begin, end, j, value in index.near(texts, cosine):
            q, words = queries[j], texts[k]
            low = max(0, begin - MARGIN)
            if (k, begin) != at:
                at, there = (k, begin), frozenset(words[low : end + MARGIN])
            least = shares[j]
            if q.n - (len(q.distinct) - len(q.distinct & there)) < least * q.n:
                continue  # the words of the window cannot cover enough
            covered = q.covered(words[low : end + MARGIN], least=least)
            if covered < least:
                continue
            answer = q.covered(words[low : end + MARGIN + PASSAGE], answer=True)
            if covered < exact and answer < 0.6:
                continue
            if q.item_id not in best[k] or covered > best[k][q.item_id]["lcs"]:
                best[k][q.item_id] = {"item_id": q.item_id, "cosine": value, "lcs": covered, "answer": answer, "word": low, "by_cosine": True}
        search_words(texts, best)
        return [[x[i] for i in sorted(x)] for x in best]

    return search


def leaks(text: Column, shared: Broadcast, cosine: float = 0.68, exact: float = 0.8, paraphrase: float = 0.6) -> Column:
    """The leaks of each text, under a broadcast index, as an array of structs."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = _search(shared.value, cosine, exact, paraphrase)
        for texts in batches:
            hits, group, held = [], [], 0
            for x in texts:
                group.append(tokens(x.as_py()))
                held += len(group[-1])
                if held >= GROUP_WORDS:
                    hits += search(group)
                    group, held = [], 0
            yield pa.array(hits + (search(group) if group else []), pa.list_(HIT))

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(found, HITS)(text.cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 64, block_bytes: int = 8 << 20, **search) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, word, by_cosine): one row per document id and benchmark item found in it."""
    spark = docs.sparkSession
    hits = spark.createDataFrame([], f"doc_id long, hit {HITS[6:-1]}")
    for index in fit_indexes(docs.select("doc_id", "text"), benchmark, rank, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast(index)
        hits = hits.union(staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(leaks(F.col("text"), shared, **search)).alias("hit")), "leaks"))
        shared.destroy()
    best = F.max(F.struct("hit.lcs", "hit.cosine", "hit.answer", "hit.word", "hit.by_cosine")).alias("best")
    return hits.groupBy("doc_id", F.col("hit.item_id").alias("item_id")).agg(best).select(
        "doc_id", "item_id", "best.cosine", "best.lcs", "best.answer", "best.word", "best.by_cosine"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 64, block_bytes: int = 8 << 20, **search) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay.

    Rows are written between the blocks of a benchmark of several; the last block's search is left to whoever reads the result.
    """
    rows, shared = docs.select(F.struct("*").alias("row")), None
    for index in fit_indexes(docs.select("doc_id", "text"), benchmark, rank, block_bytes=block_bytes):
        if shared is not None:
            rows = staged(rows, "clean")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(index)
        rows = rows.where(F.size(leaks(F.col("row.text"), shared, **search)) == 0)
    return rows.select("row.*")
