"""Cross-tokenizer alignment against a token-by-token version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clickloom.llm.packing import byte_tokens
from clickloom.llm.token_alignment import cross_tokenizer, vocabulary

from .tables import SCHEMA, documents, sentence

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))


def brute(texts, sides):
    a, b = sides
    printable = {c: i for i, c in enumerate(chr(x) if 33 <= x < 127 or 161 <= x < 173 or 174 <= x else None for x in range(256)) if c}
    for x in range(256):
        if x not in printable.values():
            printable[chr(256 + sum(1 for y in printable if ord(y) >= 256))] = x
    rows, holding = [], defaultdict(set)
    for n, text in enumerate(texts):
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(printable[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append(None)
            continue
        spans_a, spans_b = ([(sum(map(len, s[:k])), sum(map(len, s[: k + 1]))) for k in range(len(s))] for s in (bytes_a, bytes_b))
        common = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups = []
        for start, end in zip([0, *common], common):
            inside = [[i for i, (s, e) in zip(ids, spans) if start <= s and e <= end] for ids, spans in ((ids_a, spans_a), (ids_b, spans_b))]
            groups.append("|".join(",".join(map(str, x)) for x in inside))
        links = [(i, j) for i, (s, e) in zip(ids_a, spans_a) for j, (t, f) in zip(ids_b, spans_b) if max(s, t) < min(e, f)]
        for pair in links:
            holding[pair].add(n)
        rows.append((len(ids_a), len(ids_b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count, best = {p: len(x) for p, x in holding.items()}, Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for r in rows:
        links = r[3] if r else []
        head = (*r[:3], len(links)) if r else (0, 0, 0, 0)
        out.append((*head, sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), r[4] if r else ""))
    return out


def some_texts():
    rng = np.random.default_rng(8)
    texts = [sentence(rng, int(n)) for n in rng.integers(1, 40, 30)]
    texts += [None, "", " ", "   \n\n x", "<|endoftext|> <s> </s> <unk> <0x41>", "\u2581x", "naïve \U0001f600 東京 ñ", "a\x00b", "aaaaaaaaab" * 30, "  two  spaces ", "\ufb01 \u00a0 x"]
    return texts + [texts[0], texts[0]]


def test_against_tokens_one_by_one(spark, sides):
    texts = some_texts()
    want = brute(texts, sides)
    for block_bytes in (4 << 20, 300):
        found = {r["doc_id"]: r for r in cross_tokenizer(documents(spark, texts), block_bytes=block_bytes).collect()}
        assert len(found) == len(texts)
        for i, x in enumerate(want):
            assert tuple(found[i][c] for c in COLUMNS) == x, (i, texts[i])


def test_a_pair_may_be_on_the_map_and_in_an_irregular_group(spark, sides):
    texts = ["aaaaaaa", "aaaa a aaaaaa", "      x", "x       ", "\n\n\n\n", "=====  ===== == ="]
    found = {r["doc_id"]: r for r in cross_tokenizer(documents(spark, texts)).collect()}
    assert [tuple(found[i][c] for c in COLUMNS) for i in range(len(texts))] == brute(texts, sides)


def test_long_texts_null_ids_and_repeats(spark, sides):
    rng = np.random.default_rng(9)
    long = sentence(rng, 60_000)
    docs = documents(spark, [long, "tie", "tie", "x" * 20_000, None], [5, None, None, 6, 7])
    rows = cross_tokenizer(docs, block_bytes=1 << 16).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 5), (False, 6), (False, 7), (True, 0), (True, 0)]
    one = next(r for r in rows if r["doc_id"] == 5)
    ids_a = sides[0].encode(" " + long, add_special_tokens=False).ids
    assert one["n_a"] == len(ids_a) and one["n_b"] == len(sides[1].encode(long))
    assert one["n_links"] == one["n_a"] + one["n_b"] - one["n_groups"]
    ties = [r for r in rows if r["doc_id"] is None]
    assert ties[0] == ties[1] and ties[0]["count_sum"] >= 2
    assert cross_tokenizer(spark.createDataFrame([], SCHEMA)).count() == 0


def test_identity_map(sides):
    vocab, a = vocabulary(A, B), byte_tokens(A)
    assert len(a) == sides[0].get_vocab_size()
    for i in range(0, len(a), 97):
        j = vocab.same[i]
        assert (vocab.b[j] == a[i]) if j >= 0 else a[i] not in vocab.b
    assert a[sides[0].token_to_id("\u0120the")] == b" the" and vocab.b[vocab.same[sides[0].token_to_id("\u0120the")]] == b" the"
