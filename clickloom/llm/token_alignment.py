"""Alignment of two tokenizers over the same bytes, with the counts of the id pairs that they link.

1. Both tokenizers encode a text; if their tokens' bytes are the text (with a space before it), byte offsets where both have a token's end
   cut the tokens into groups.  The tokens of a batch are aligned as arrays: a byte map marks the ends of either side, and each
   stretch between neighbouring ends is one linked pair.
2. The identity map gives for each A-id the B-id of the same bytes.  Pairs on the map (all groups of one token each are) are
   counted in vectors as long as the vocabulary; only other pairs, which come from irregular groups, are counted by a shuffle.
3. Texts lie in blocks of about ``block_bytes``.  A block counts in how many of its texts each pair is linked and sends one row a pair;
   the totals come back to it in the same form, and the block adds up its texts' sums.  So a pair that every text holds is one
   row a block.

The vectors and each A-id's highest count come to the driver; their length is that of A's vocabulary.

Defined cases: a text that is null or empty, or whose tokens' bytes differ from it (invalid UTF-8, U+2581, characters that a tokenizer
replaces), has zeros and an empty digest; a null id, repeated rows and texts of any length are rows like any other; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .packing import byte_tokens, encoder

ALIGNED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<int>, same array<int>, same_times array<int>"
)
ANSWER = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Bytes of texts that are aligned together.
TOGETHER = 1 << 21


def pieces_of(name: str):
    """The tokenizer of a ``sentencepiece`` file."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=name if os.path.isabs(name) else public_tokenizers.path(name))


class Vocabulary:
    """The tokens' bytes of both tokenizers and the identity map between them."""

    def __init__(self, a: str, b: str):
        self.encode_a = encoder(a)
        self.pieces = pieces_of(b)
        self.a = byte_tokens(a)
        self.b = [self._bytes_of(i) for i in range(self.pieces.get_piece_size())]
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (self.a, self.b)]
        # of pieces of the same bytes a whole one comes before the one that stands for a byte
        places = {self.b[i]: i for i in sorted(range(len(self.b)), key=lambda i: (not self.pieces.is_byte(i), i), reverse=True) if self.b[i]}
        self.same = np.array([places.get(x, -1) for x in self.a], np.int64)
        texts = [[f"{i}{end}" for i in range(len(side)) for end in ends] for side, ends in ((self.a, ",|"), (self.b, ",;"))]
        self.texts = np.array(texts[0] + texts[1], object)

    def _bytes_of(self, i: int) -> bytes:
        p = self.pieces
        if p.is_byte(i):
            return bytes([int(p.id_to_piece(i)[3:-1], 16)])
        if p.is_control(i) or p.is_unknown(i):
            return b""
        return p.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both sides; None if their bytes are not the text."""
        if not text:
            return None
        a, b = np.asarray(self.encode_a(" " + text), np.int64), self.pieces.encode(text, num_threads=1)
        want = b" " + text.encode("utf-8", "surrogatepass")
        if b"".join(map(self.a.__getitem__, a.tolist())) != want or b"".join(map(self.b.__getitem__, b)) != want:
            return None
        b = np.array(b, np.int64)
        return (a, b) if self.lengths[0][a].all() and self.lengths[1][b].all() else None


@lru_cache(maxsize=2)
def vocabulary(a: str, b: str) -> Vocabulary:
    return Vocabulary(a, b)


def align(vocab: Vocabulary, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, same, same_times) of each text, worked out for all together.

    ``pairs`` are distinct numbers a * |B| + b off the identity map, ``same`` the A-ids of pairs on it, each with its number of links.
    """
    a, b = (np.concatenate([t[side] for t in texts]) for side in (0, 1))
    end_a, end_b = np.cumsum(vocab.lengths[0][a]), np.cumsum(vocab.lengths[1][b])
    marks = np.zeros(int(end_a[-1]) + 1, np.uint8)
    marks[end_a] = 1
    marks[end_b] += 2
    ends = np.flatnonzero(marks)
    is_a, is_b = (marks[ends] & 1).astype(np.int64), (marks[ends] >> 1).astype(np.int64)
    # the token of either side in which a stretch lies: as many ends stand before it
    at_a, at_b, both = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, is_a & is_b
    size_a, size_b = (np.array([len(t[side]) for t in texts]) for side in (0, 1))
    stretch = np.searchsorted(ends, end_a[np.cumsum(size_a) - 1], "right")  # where each text's stretches end
    n_links, closed = np.diff(stretch, prepend=0), np.concatenate([[0], np.cumsum(both)])[stretch]
    n_groups = np.diff(closed, prepend=0)

    # the groups as text: A-ids of a group, then its B-ids, each with the sign that follows it
    group = np.cumsum(both) - both
    group_a, group_b = group[is_a == 1], group[is_b == 1]
    sizes_a, sizes_b = np.bincount(group_a, minlength=int(closed[-1])), np.bincount(group_b, minlength=int(closed[-1]))
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = 2 * a + last_a
    codes[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = 2 * (len(vocab.a) + b) + last_b
    signs = vocab.texts[codes]

    x, y = a[at_a], b[at_b]
    on = vocab.same[x] == y
    owner = np.repeat(np.arange(len(texts)), n_links)

    def distinct(chosen: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, times = np.unique(owner[chosen] * width + key[chosen], return_counts=True)
        return found % width, times, np.searchsorted(found // width, np.arange(len(texts) + 1))

    pairs, times, cut = distinct(~on, x * len(vocab.b) + y, len(vocab.a) * len(vocab.b))
    same, same_times, same_cut = distinct(on, x, len(vocab.a))
    rows, tokens = [], np.concatenate([[0], np.cumsum(size_a + size_b)])
    for i in range(len(texts)):
        digest = hashlib.sha256("".join(signs[tokens[i] : tokens[i + 1]].tolist())[:-1].encode()).hexdigest()
        p, s = slice(cut[i], cut[i + 1]), slice(same_cut[i], same_cut[i + 1])
        rows.append((int(size_a[i]), int(size_b[i]), int(n_groups[i]), int(n_links[i]), digest, pairs[p], times[p], same[s], same_times[s]))
    return rows


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind))


def alignments(docs: DataFrame, a: str, b: str, block_bytes: int) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): its block, its numbers, and the pairs that it links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, block, size = vocabulary(a, b), 0, 0
        nothing = (0, 0, 0, 0, "", *[np.zeros(0, np.int64)] * 4)
        for batch in batches:
            part = batch.column(0).to_pylist()
            ids, blocks, found, waiting, held = batch.column(1), [], [nothing] * len(part), [], 0

            def settle():
                for (i, _), x in zip(waiting, align(vocab, [t for _, t in waiting]) if waiting else ()):
                    found[i] = x
                waiting.clear()

            for i, x in enumerate(batch.column(2)):
                text = x.as_py() or ""
                if size + len(text) > block_bytes and size:
                    block, size = block + 1, 0
                size += len(text)
                blocks.append((part[i] << 32) + block)
                if (tokens := vocab.encode(text)) is not None:
                    if held + len(text) > TOGETHER:
                        settle()
                        held = 0
                    waiting.append((i, tokens))
                    held += len(text)
            settle()
            columns = [pa.array(blocks, pa.int64()), ids]
            columns += [pa.array([x[k] for x in found], pa.int64()) for k in range(4)] + [pa.array([x[4] for x in found], pa.string())]
            columns += [_lists([x[k] for x in found], pa.int64() if k == 5 else pa.int32()) for k in range(5, 9)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])

    return docs.select(F.spark_partition_id().cast("long"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ALIGNED)


def block_counts(aligned: DataFrame, vocabulary_size: int) -> DataFrame:
    """(block, pair, n): in how many texts of a block each pair off the map is linked; block -1: the same for A-ids on the map.

    A block that a task reads in several batches has a row for each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on_map = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            block = batch.column(0).to_numpy()
            on_map += np.bincount(batch.column(2).flatten().to_numpy(), minlength=vocabulary_size)
            per_row, pairs = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten().to_numpy()
            of = np.repeat(block, per_row)
            for x in np.unique(block):
                found, n = np.unique(pairs[of == x], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x)), pa.array(found), pa.array(n.astype(np.int64))], names=["block", "pair", "n"])
        used = np.flatnonzero(on_map)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), -1)), pa.array(used), pa.array(on_map[used])], names=["block", "pair", "n"])

    return aligned.select("block", "pairs", "same").mapInArrow(run, "block long, pair long, n long")


def cross_tokenizer(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): tokens, groups, links, and what the corpus' pair counts say of the links."""
    n_a, n_b = len(byte_tokens(a)), pieces_of(b).get_piece_size()
    aligned = staged(alignments(docs, a, b, block_bytes), "aligned")
    counts = staged(block_counts(aligned, n_a), "pair_counts")
    totals = staged(counts.where("block >= 0").groupBy("pair").agg(F.sum("n").alias("total")), "pair_totals")
    on_map = np.zeros(n_a, np.int64)
    for r in counts.where("block < 0").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most as many as A has ids
        on_map[r["pair"]] = r["n"]
    best = on_map.copy()
    for r in totals.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("total").alias("n")).collect():
        best[r["a"]] = max(best[r["a"]], r["n"])
    known = counts.where("block >= 0").join(totals, "pair").select("block", "pair", "total")

    def sums(rows: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("pair").to_numpy())
        pair, total = (answers.column(c).to_numpy()[order] for c in ("pair", "total"))
        n_best, count_sum = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for keys, times, count_of, a_of in (
            ("pairs", "times", lambda k: total[np.searchsorted(pair, k)] if len(k) else k, lambda k: k // n_b),
            ("same", "same_times", lambda k: on_map[k], lambda k: k),
        ):
            lists = rows.column(keys).combine_chunks()
            owner = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
            key = lists.flatten().to_numpy().astype(np.int64)
            n = rows.column(times).combine_chunks().flatten().to_numpy().astype(np.int64)
            count = count_of(key)
            np.add.at(count_sum, owner, n * count)
            np.add.at(n_best, owner, n * (count == best[a_of(key)]))
        found = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return found.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)).append_column("groups_sha256", rows.column("groups_sha256"))

    return aligned.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(sums, ANSWER)
