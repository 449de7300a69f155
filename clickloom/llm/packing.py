"""Sequence packing as a cutting-stock problem solved by column generation.

1. Documents are tokenised where they lie and cut into pieces of at most
   ``capacity`` tokens: whole sequences first, then one remnant.
2. Remnant lengths are counted in classes of ``grain`` tokens (rounded up), so the
   histogram has at most ``capacity / grain`` rows whatever the corpus holds.
3. The linear program over cutting patterns is solved on that histogram: a
   knapsack dynamic program prices new patterns until none improves or the Lagrangian bound is met.
   Pattern counts are rounded down, and what is left over (less than one
   sequence for each pattern of the basis) is packed best-fit, largest first.
4. Pieces are ranked within their class in a distributed way (ranks within salted
   groups, whose number grows with the class, plus the offsets of the groups), and the rank tells the sequence.

Only the histogram and patterns reach the driver; their sizes depend on ``capacity`` alone.

Defined cases: a null or empty text is one piece that holds the end id; repeated
rows and null ids are packed like any other row; an empty table gives an empty
result; a text of any length is cut, none is dropped.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Texts with a stretch this long without (or of nothing but) white space go to the general encoder.
LONG_STRETCH = 4096


def encoder(tokenizer: str, added_tokens: bool = False):
    """A function from a text to its ids under the ``tokenizers`` file, without special tokens around it.

    With ``added_tokens`` the file's added tokens are found in the text, as ``tokenizers`` does by default; without,
    their characters are encoded like any others.

    A byte-level BPE file whose merges stand in the order of their ids is the same
    rule as a rank table, and ``tiktoken`` applies rank tables about four times
    as fast; any other file, and texts with very long stretches, go through ``tokenizers`` itself.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
    general = Tokenizer.from_file(path)
    general.encode_special_tokens = not added_tokens
    slow = lambda text: general.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _ranks(spec)
    if ranks is None:
        return slow
    import tiktoken

    added = [x["content"] for x in spec.get("added_tokens") or ()] if added_tokens else []
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int] | np.ndarray:
        if any(x in text for x in added):
            return slow(text)
        if len(text) > LONG_STRETCH and (max(map(len, text.split()), default=0) > LONG_STRETCH or " " * LONG_STRETCH in text or text.isspace()):
            return slow(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except (ValueError, UnicodeError):
            return slow(text)

    return encode


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The rank table of a plain byte-level BPE file; None for any other."""
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or before.get("use_regex") is False or model.get("continuing_subword_prefix"):
        return None
    added = {x["content"] for x in spec.get("added_tokens") or ()}
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocab[m] for m in merges]
    if order != sorted(order) or len(vocab) != len(merges) + 256:
        return None
    shown = _shown()
    return {bytes(shown[c] for c in k): v for k, v in vocab.items()}


def _shown() -> dict[str, int]:
    """Byte-level files write each byte as a printable character: itself where it is one, else the next from 256."""
    shown = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    hidden = [b for b in range(256) if b not in shown.values()]
    return shown | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_tokens(tokenizer: str) -> list[bytes]:
    """The bytes of each id of a byte-level file; those of an added token are its text, and an id without a token has none."""
    import public_tokenizers

    with open(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        spec = json.load(f)
    shown, added = _shown(), {x["id"]: x["content"].encode() for x in spec.get("added_tokens") or ()}
    plain = {v: bytes(shown[c] for c in k) for k, v in spec["model"]["vocab"].items() if v not in added} | added
    return [plain.get(i, b"") for i in range(max(plain) + 1)]


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document, with the checksum of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added_tokens=True)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(np.asarray(encode(text.as_py() or ""), "<u4"), np.array([END_ID], "<u4"))
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best total of each capacity and the item taken last there (0: none).

    ``value[s]`` is that of an item of size s.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        sums = best[c - 1 :: -1] + value[1 : c + 1]
        s = int(sums.argmax())
        if sums[s] > best[c - 1]:
            best[c], last[c] = sums[s], s + 1
        else:
            best[c] = best[c - 1]
    return best, last


def pattern_of(last: np.ndarray, c: int) -> np.ndarray:
    """The counts by size of the best pattern of capacity ``c``."""
    counts = np.zeros(len(last), np.int64)
    while c > 0:
        if last[c]:
            counts[last[c]] += 1
            c -= last[c]
        else:
            c -= 1
    return counts


class _Master:
    """The restricted linear program: least number of sequences over the patterns found so far, by revised simplex.

    Demands are raised by tiny different amounts, so that no step is of length zero for long.
    """

    def __init__(self, sizes: np.ndarray, need: np.ndarray, capacity: int, pool: np.ndarray, seed: int = 5):
        fit = (capacity // sizes).astype(float)
        self.pool, self.basis, self.inverse = pool, np.diag(fit), np.diag(1 / fit)
        self.x = need * (1 + 1e-7 * np.random.default_rng(seed).random(len(need))) / fit

    def solve(self) -> np.ndarray:
        """Pivot until no pattern of the pool improves; the duals."""
        for _ in range(50 * len(self.x)):
            duals = self.inverse.sum(axis=0)
            gain = self.pool @ duals
            j = int(gain.argmax())
            if gain[j] <= 1 + 1e-7:
                break
            column = self.inverse @ self.pool[j]
            rows = np.nonzero(column > 1e-9)[0]
            leave = rows[np.argmin(self.x[rows] / column[rows])]
            step = max(self.x[leave] / column[leave], 0.0)
            self.x -= step * column
            self.x[leave] = step
            pivot = self.inverse[leave] / column[leave]
            self.inverse -= np.outer(column, pivot)
            self.inverse[leave] = pivot
            self.basis[leave] = self.pool[j]
        return self.inverse.sum(axis=0)


def column_generation(
    need: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 500, columns: int = 64, smoothing: float = 0.6, pool_rows: int = 4096
) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Patterns (counts by size, times) that hold ``need[s]`` items of each size s exactly, and a lower bound of their number.

    The pool starts with the patterns of best fit.  A round prices patterns at duals smoothed towards those of the best
    bound (at the duals themselves if that finds none), and adds the best pattern with each of ``columns`` sizes.  It stops
    when no pattern improves, when the Lagrangian bound is within ``gap`` of the program's value, or after ``rounds``.
    Pattern counts are rounded down, what is left is packed best-fit; if best fit of everything needs fewer
    sequences, that is returned.
    """
    sizes = np.nonzero(need)[0]
    if len(sizes) == 0:
        return [], 0.0
    plain, want = best_fit(need, capacity), need[sizes].astype(float)
    master = _Master(sizes, want, capacity, np.array([p[sizes] for p, _ in plain], float))
    stable = sizes / capacity  # the duals of the volume bound
    bound = float(stable @ want)
    for _ in range(rounds):
        duals = master.solve()
        if master.x.sum() <= bound * (1 + gap):
            break
        for weight in (smoothing, 0.0):
            prices = weight * stable + (1 - weight) * duals
            value = np.full(capacity + 1, -np.inf)
            value[sizes] = prices
            best, last = knapsack(value, capacity)
            if best[capacity] > 0 and prices @ want / best[capacity] > bound:
                bound, stable = float(prices @ want / best[capacity]), prices / best[capacity]
            found = []
            for s in sizes[np.argsort(-(prices + best[capacity - sizes]), kind="stable")[:columns]]:
                pattern = pattern_of(last, capacity - s)
                pattern[s] += 1
                found.append(pattern[sizes].astype(float))
            new = np.unique(np.array(found), axis=0)
            new = new[new @ duals > 1 + 1e-7]
            if len(new):
                break
        if not len(new):
            break
        master.pool = np.vstack([master.pool[np.argsort(-(master.pool @ duals), kind="stable")[:pool_rows]], new])
    left, packed = need.copy(), []
    for row, times in zip(master.basis, np.floor(np.maximum(master.x, 0) + 1e-6).astype(np.int64)):
        pattern = np.zeros(capacity + 1, np.int64)
        pattern[sizes] = np.rint(row)
        used = pattern > 0
        times = min(int(times), int((left[used] // pattern[used]).min()))
        if times > 0:
            packed.append((pattern, times))
            left -= times * pattern
    packed += best_fit(left, capacity)
    return min(packed, plain, key=lambda x: sum(t for _, t in x)), bound


def best_fit(need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and times of best fit, largest first; equal sequences are filled together, so its time depends on the sizes alone."""
    room: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(capacity + 1)]
    for size in np.nonzero(need)[0][::-1]:
        left, at = int(need[size]), int(size)
        while left:
            while at <= capacity and not room[at]:
                at += 1
            opened = at > capacity
            pattern, times = (np.zeros(capacity + 1, np.int64), left) if opened else room[at].pop()
            free = min(at, capacity)
            each = free // size
            # a sequence that takes an item stays the tightest until it takes no more
            for items, n in ((each, min(times, left // each)), (left % each, 1)):
                if items and n and times and left:
                    filled = pattern.copy()
                    filled[size] += items
                    room[free - items * size].append((filled, n))
                    left, times = left - items * n, times - n
            if times and not opened:
                room[at].append((pattern, times))
    return [x for r in room for x in r]


def _layout(need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ranked items of each class: where the class begins, and the runs of ranks (begin, first sequence, items a sequence)."""
    per_class: list[list[tuple[int, int, int]]] = [[] for _ in need]
    sequence = 0
    for pattern, times in column_generation(need, capacity)[0]:
        for size in np.nonzero(pattern)[0]:
            per_class[size].append((int(pattern[size]) * times, sequence, int(pattern[size])))
        sequence += times
    begin = np.concatenate([[0], np.cumsum(need)[:-1]])
    runs = [(n, first, each) for c in per_class for n, first, each in c]
    n, first, each = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    return begin, np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if runs else n, first, each


def pack(cut: DataFrame, capacity: int = 2048, grain: int = 4, group_rows: int = 100_000) -> DataFrame:
    """``cut`` (doc_id, start, length, ...) with ``sequence_id`` and the gapless ``offset`` in it.

    Ranks are counted in groups of about ``group_rows`` pieces of a class, however many pieces there are.
    """
    top = capacity // grain
    rows = staged(
        cut.select("*", F.ceil(F.col("length") / grain).cast("int").alias("class"), F.monotonically_increasing_id().alias("piece")), "pieces"
    )
    need = np.zeros(top + 1, np.int64)
    for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect():  # top rows at most
        need[r["class"]] = r["n"]
    begin, run, first, each = _layout(need, top)
    salts = F.get(F.array(*[F.lit(int(-(-n // group_rows))) for n in need]), F.col("class"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "piece"), salts))
    sizes = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("class", "salt", F.coalesce(before, F.lit(0)).alias("before"))

    def place(cls: pd.Series, rank: pd.Series) -> pd.Series:
        at = begin[cls.to_numpy()] + rank.to_numpy() - 1
        j = np.searchsorted(run, at, "right") - 1
        return pd.Series(first[j] + (at - run[j]) // each[j])

    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start", "piece"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "piece")
    return (
        salted.withColumn("rank", rank.cast("long"))
        .join(before, ["class", "salt"])
        .withColumn("sequence_id", F.pandas_udf(place, "long")("class", F.col("rank") + F.col("before")))
        .withColumn("offset", F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
        .drop("class", "salt", "rank", "before", "piece")
    )


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048) -> DataFrame:
    """One row per piece of each document of ``docs`` (doc_id, text): its ids' place, length, checksum and sequence."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
