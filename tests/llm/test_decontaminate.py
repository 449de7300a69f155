"""Decontamination against brute-force subsequences, the latent search alone, and its parts."""

import numpy as np

from clickloom.llm import decontaminate

from .tables import SCHEMA, documents


def test_decontamination(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("aeioubdglmnrst"), int(n))) for n in rng.integers(3, 9, 900)]
    words = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = [words(int(n)) for n in rng.integers(15, 60, 12)]
    paraphrase = [w for i, w in enumerate(items[2]) if i % 6 != 3]
    texts = [" ".join(words(150)) for _ in range(60)]
    texts[4] += " " + " ".join(items[0]) + " " + " ".join(words(90))
    texts[9] = " ".join(items[1]).upper() + ". " + texts[9]
    texts[20] += " " + " ".join(paraphrase) + " " + " ".join(words(40))
    docs = documents(spark, [*texts, None, "", " ".join(items[5])])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(4, 0), (9, 1), (20, 2), (62, 5)}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(63)) - {4, 9, 20, 62}
    assert decontaminate.contaminated(docs, benchmark.where("item_id > 90")).count() == 0
    assert decontaminate.contaminated(empty, benchmark).count() == 0


def test_decontamination_finds_every_copy_of_a_large_benchmark(spark):
    rng = np.random.default_rng(19)
    vocabulary = ["".join(rng.choice(list("aeioubdglmnrst"), int(n))) for n in rng.integers(3, 9, 3000)]
    share = 1 / np.arange(3, 3003)
    words = lambda n: [str(w) for w in rng.choice(vocabulary, n, p=share / share.sum())]
    items = [words(int(n)) for n in rng.integers(8, 130, 1500)]
    texts = [words(int(n)) for n in rng.integers(80, 200, 66)]
    for i, text in enumerate(texts[:60]):
        copy = items[20 * i] if i % 3 else [w for w in items[20 * i] if rng.random() > 0.2]
        at = int(rng.integers(0, len(text)))
        text[at:at] = copy
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = decontaminate.contaminated(documents(spark, [" ".join(t) for t in texts]), benchmark).collect()
    found, by_cosine = {(r["doc_id"], r["item_id"]): r["lcs"] for r in rows}, {(r["doc_id"], r["item_id"]) for r in rows if r["by_cosine"]}

    expected: dict = {}
    spelled = [[w.encode() for w in t] for t in texts]
    for item_id, passage, answer in decontaminate._item_passages(benchmark):
        masks, n = decontaminate._masks(passage), len(passage)
        size = n + n // 4 + 2
        for k, text in enumerate(spelled):
            if decontaminate.common_subsequence(masks, n, text) / n < 0.8:
                continue  # the whole text holds less
            best = max(decontaminate.common_subsequence(masks, n, text[at : at + size]) / n for at in range(len(text)))
            if best >= 0.8:
                expected[k, item_id] = max(best, expected.get((k, item_id), 0))
    assert {(i, 20 * i) for i in range(60) if i % 3} <= set(expected) <= set(found)
    assert all(found[x] == y for x, y in expected.items())
    assert len(by_cosine & set(expected)) >= 0.9 * len(expected)


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        return row[-1]

    rng = np.random.default_rng(10)
    for _ in range(50):
        a, b = ([bytes([65 + int(x)]) for x in rng.integers(0, 5, int(n))] for n in rng.integers(1, 30, 2))
        assert decontaminate.common_subsequence(decontaminate._masks(a), len(a), b) == plain(a, b)


def corpus(rng, n_items, n_texts, planted):
    vocabulary = ["".join(rng.choice(list("aeioubdglmnrst"), int(n))) for n in rng.integers(3, 9, 3000)]
    share = 1 / np.arange(3, 3003)
    words = lambda n: [str(w) for w in rng.choice(vocabulary, n, p=share / share.sum())]
    items = [words(int(n)) for n in rng.integers(12, 90, n_items)]
    texts = [words(int(n)) for n in rng.integers(60, 240, n_texts)]
    for i in range(planted):
        at = int(rng.integers(0, len(texts[i])))
        texts[i][at:at] = [w for w in items[i % n_items] if rng.random() > (0.12 if i % 2 else 0)]
    return items, texts


def test_recall_of_the_latent_search(spark):
    """The cosine stage alone finds at least nine in ten of the passages that exhaustive subsequences find."""
    rng = np.random.default_rng(23)
    items, texts = corpus(rng, 150, 160, 120)
    docs = documents(spark, [" ".join(t) for t in texts])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    index = next(decontaminate.fit_indexes(docs, benchmark))
    spelled = [[w.encode() for w in t] for t in texts]
    exact = set()
    for j, (_, passage, _) in enumerate(index.items):
        masks, n = decontaminate._masks(passage), len(passage)
        size = n + n // 4 + 2
        for k, text in enumerate(spelled):
            if decontaminate.common_subsequence(masks, n, text) / n >= 0.8:
                if max(decontaminate.common_subsequence(masks, n, text[at : at + size]) for at in range(len(text))) / n >= 0.8:
                    exact.add((k, j))
    found = {(k, j) for k, _, _, j, _ in index.near(spelled, 0.68)}
    assert len(exact) >= 120 and len(found & exact) >= 0.9 * len(exact)


def test_blocks_of_the_benchmark_find_the_same(spark):
    items, texts = corpus(np.random.default_rng(29), 60, 70, 60)
    docs = documents(spark, [*(" ".join(t) for t in texts), None, ""])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(None, "x y"), (7, None)], "item_id long, text string")
    assert len(decontaminate.query_blocks(benchmark, 6_000)) > 2
    pairs = lambda rows: {(r["doc_id"], r["item_id"], r["lcs"]) for r in rows.collect()}
    whole = pairs(decontaminate.contaminated(docs, benchmark))
    assert len(whole) >= 55 and pairs(decontaminate.contaminated(docs, benchmark, block_bytes=6_000)) == whole
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, benchmark, block_bytes=6_000).collect()}
    assert kept == set(range(72)) - {d for d, _, _ in whole}


def test_a_very_long_text_and_repeated_rows(spark):
    rng = np.random.default_rng(31)
    items, texts = corpus(rng, 10, 12, 0)
    long = [w for _ in range(1500) for w in texts[int(rng.integers(0, 12))]]
    long[200_000:200_000] = items[3]
    docs = documents(spark, [" ".join(long), " ".join(items[4]), " ".join(items[4])], ids=[None, 5, 5])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()} == {(None, 3), (5, 4)}
    empty = spark.createDataFrame([], SCHEMA)
    assert decontaminate.drop_contaminated(empty, benchmark).count() == 0 and decontaminate.drop_contaminated(docs, benchmark.where("item_id < 0")).count() == 3


def test_basis_is_orthonormal():
    y = np.random.default_rng(2).standard_normal((5000, 8)).astype(np.float32)
    y[:, 7] = y[:, 0] + y[:, 1]
    q = decontaminate.orthonormal(y)
    assert q.shape == (5000, 7) and np.allclose(q.T @ q, np.eye(7), atol=1e-4)
    assert np.allclose(q @ (q.T @ y), y, atol=1e-3)


def test_the_space_is_fitted_on_all_passages_of_all_documents(spark):
    rng = np.random.default_rng(37)
    vocabulary = ["".join(rng.choice(list("aeioubdglmnrst"), int(n))) for n in rng.integers(3, 9, 400)]
    words = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    texts, items = [words(int(n)) for n in rng.integers(0, 40, 3000)], [words(int(n)) for n in rng.integers(5, 120, 9)]
    texts[7] = words(decontaminate.CUT + 100)
    docs = documents(spark, [*(" ".join(t) for t in texts), None, ""])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    index = next(decontaminate.fit_indexes(docs, benchmark))

    def counted(w):
        return np.unique(decontaminate.cells([x if isinstance(x, bytes) else x.encode() for x in w]), return_counts=True)

    block = decontaminate.BLOCK
    passages = [counted(t[at : at + block]) for t in texts for at in range(0, len(t), block)]
    frequency = np.bincount(np.concatenate([c for c, _ in passages]), minlength=decontaminate.CELLS)
    idf = np.log((len(passages) + 1) / (frequency + 1)) + 0.1
    assert np.allclose(index.idf, idf)
    rows = [(c, k * idf[c] / np.linalg.norm(k * idf[c])) for c, k in passages]
    scale = np.sqrt(len(passages) / len(index.items))
    rows += [(c, scale * k * idf[c] / np.linalg.norm(k * idf[c])) for c, k in (counted(w) for _, w, _ in index.items)]
    q = np.random.default_rng(11).standard_normal((decontaminate.CELLS, 64), np.float32)
    for _ in range(2):
        out = np.zeros(q.shape)
        for c, w in rows:
            out[c] += np.outer(w, w @ q[c])
        q = decontaminate.orthonormal(out.astype(np.float32))
    given, plain = index.weights[:-1], q * idf[:, None]
    # the same space, in whatever basis: cosines between words are equal
    some = np.flatnonzero(frequency)[::7]
    assert np.allclose(given[some] @ given[some].T, plain[some] @ plain[some].T, atol=1e-2 * np.abs(plain[some] @ plain[some].T).max())
