"""Packing: round trips of the ids, and the cutting patterns against bounds and plain versions."""

import math
import time
import zlib

import numpy as np
import pytest

from clickloom.llm import packing

from .tables import SCHEMA, documents, sentence


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    return [sentence(rng, int(n)) for n in rng.integers(1, 160, 20)] + [None, "", "  \n\t ", "the the the", "x" * 5000, "é ü ß 　"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_round_trip(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    general = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, capacity=64).collect()
    for i, t in enumerate(texts):
        ids, at = general.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64


def test_packing_of_repeated_rows_and_none(spark, empty):
    rows = packing.pack_documents(documents(spark, ["one two three"] * 20, ids=[None] * 10 + [4] * 10), capacity=16).collect()
    assert len(rows) == 20 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 20
    assert packing.pack_documents(empty).count() == 0


def plain_best_fit(need, capacity):
    """One item after another into the fullest sequence that still has room."""
    rooms: list = []
    for size in range(len(need) - 1, 0, -1):
        for _ in range(int(need[size])):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - size)
    return len(rooms)


def histogram(kind, capacity=512):
    rng = np.random.default_rng(4)
    need = np.zeros(capacity + 1, np.int64)
    if kind == "dense":
        need[1:] = rng.integers(1, 50_000, capacity)
    elif kind == "large":
        need[100:] = rng.integers(1, 50_000, capacity - 99)
    elif kind == "few":
        need[[171, 172, 180, 340, 341, 120, 100]] = 70_000, 1_000, 50_000, 30_000, 20_000, 9_000, 50
    else:
        need += np.bincount(np.minimum(rng.lognormal(4, 1.2, 13_000).astype(int) + 1, capacity), minlength=capacity + 1)
    return need


@pytest.mark.parametrize("kind", ["dense", "large", "few", "documents"])
def test_column_generation_meets_its_bound(kind):
    need = histogram(kind)
    began = time.process_time()
    patterns, bound = packing.column_generation(need, 512)
    assert time.process_time() - began < 5
    assert (sum(p * t for p, t in patterns) == need).all() and all(p @ np.arange(513) <= 512 for p, _ in patterns)
    total, volume = sum(t for _, t in patterns), need @ np.arange(513) / 512
    assert volume <= bound + 1e-6 and bound <= total <= bound * 1.0002 + 2


def test_column_generation_beats_best_fit():
    rng, won = np.random.default_rng(6), 0
    for _ in range(20):
        need = np.zeros(101, np.int64)
        need[rng.integers(15, 60, 6)] = rng.integers(1, 9_000, 6)
        found, plain = (sum(t for _, t in p) for p in (packing.column_generation(need, 100)[0], packing.best_fit(need, 100)))
        assert found <= plain
        won += found < plain
    assert won >= 5


def test_column_generation_of_nothing_and_of_no_rounds():
    assert packing.column_generation(np.zeros(9, np.int64), 8) == ([], 0.0)
    need = histogram("few")
    patterns, _ = packing.column_generation(need, 512, rounds=0)
    assert (sum(p * t for p, t in patterns) == need).all()


def test_best_fit_against_one_by_one():
    rng = np.random.default_rng(8)
    for _ in range(30):
        need = rng.integers(0, 9, 21)
        need[0] = 0
        patterns = packing.best_fit(need, 20)
        assert (sum((p * t for p, t in patterns), np.zeros(21, np.int64)) == need).all() and all(p @ np.arange(21) <= 20 for p, _ in patterns)
        assert sum(t for _, t in patterns) == plain_best_fit(need, 20)


def test_knapsack_against_search():
    value = np.full(11, -np.inf)
    value[[2, 3, 7]] = 0.2, 0.35, 0.8
    best = max(0.2 * a + 0.35 * b + 0.8 * c for a in range(6) for b in range(4) for c in range(2) if 2 * a + 3 * b + 7 * c <= 10)
    totals, last = packing.knapsack(value, 10)
    counts = packing.pattern_of(last, 10)
    assert math.isclose(totals[10], best) and math.isclose(counts[[2, 3, 7]] @ value[[2, 3, 7]], best) and counts @ np.arange(11) <= 10


def test_ranks_do_not_depend_on_the_groups(spark):
    docs = documents(spark, ["one two three four"] * 50 + ["five " * k for k in range(1, 40)], ids=[7] * 50 + [*range(100, 139)])
    cut = packing.pieces(docs, capacity=16)
    for group_rows in (3, 100_000):
        rows = packing.pack(cut, 16, grain=4, group_rows=group_rows).collect()
        assert len(rows) == cut.count() and {r["sequence_id"] for r in rows} == set(range(1 + max(r["sequence_id"] for r in rows)))
        used: dict = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == used.get(r["sequence_id"], 0)
            used[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(used.values()) <= 16


def test_fast_encoder_equals_the_general_one():
    import public_tokenizers
    from tokenizers import Tokenizer

    general = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    general.encode_special_tokens = True
    fast = packing.encoder("byte_bpe_50k.json")
    for t in ["", " ", "a  b\n\n c\t", "it's we'll 123 4567 ###!! ñ é 漢字 🙂", "<|endoftext|> x", "x" * 9000, " " * 9000 + "y", " 　 z"]:
        assert list(fast(t)) == general.encode(t, add_special_tokens=False).ids


def test_pieces_hold_the_ids_of_the_untouched_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> x", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext |>", "plain text", "<|endoftext|>" + "x" * 9000, ""]
    found = {r["doc_id"]: r for r in packing.pieces(documents(spark, texts), capacity=100_000).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4")
        assert (found[i]["ids_crc32"], found[i]["length"], found[i]["doc_tokens"]) == (zlib.crc32(ids.tobytes()), len(ids), len(ids))
