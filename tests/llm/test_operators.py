"""Each text operator against a plain version on small tables, with nulls, empty texts, ties and clashing columns."""

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import components, quality, simhash

from .tables import SCHEMA, documents, sentence


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    found = [sentence(rng, int(n)) for n in rng.integers(1, 160, 40)]
    found[3] = found[2]
    found[5] = found[4] + " one more"
    return [*found, None, "", "  \n\t ", "a", "A b c", "the the the the the the", "x" * 5000, "é ü ß 　", "line one\nline one\n\nline two"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# quality


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_ratio(spark, docs, texts, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.quality_rules(docs, labels, buckets=256).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    ratio = [r["ratio"] for r in quality.cell_ratios(docs, quality.trusted_ids(labels), buckets=256).orderBy("cell").collect()]
    cells = docs.where("doc_id < 10").select("doc_id", quality._cells(quality.words(F.col("text")), 256).alias("c")).collect()
    for r in cells:
        assert math.isclose(rows[r["doc_id"]]["score"], sum(ratio[c] for c in r["c"]) / len(r["c"]), abs_tol=1e-6)
    assert quality.quality_rules(empty, labels, buckets=64).count() == 0


# near-duplicates


def test_position_sets_cover_all_fours():
    for size in (3, 4):
        assert all(any(set(s) <= set(four) for s in simhash.position_sets(size)) for four in combinations(range(8), 4))


def brute_components(prints):
    ids = list(prints)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4 and find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, texts, empty):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in enumerate(texts)}
    assert all(rows[i]["fingerprint"] == f"{prints[i]:016x}" for i in prints)
    assert {i: r["component_id"] for i, r in rows.items()} == brute_components(prints)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(prints).values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("long_list", [2, 10_000])
def test_links_of_dense_families(spark, long_list):
    rng = np.random.default_rng(8)
    values = set()
    for center in rng.integers(0, 1 << 63, 4):
        for _ in range(25):
            values.add(int(center) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, int(rng.integers(0, 6))))))
    prints = {v - (1 << 64) if v >= 1 << 63 else v: v for v in values}
    frame = spark.createDataFrame([(v,) for v in prints], "fp long")
    found = components.components(simhash.links(frame, long_list=long_list))
    groups = {}
    for r in found.collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    expected = {}
    for v, c in brute_components({k: v for k, v in prints.items()}).items():
        expected.setdefault(c, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_repeated_and_null_ids_leave_one(spark):
    t = "one two three four five six seven"
    assert simhash.drop_near_duplicates(documents(spark, [t] * 4, ids=[None, 7, 7, 9])).collect()[0]["doc_id"] == 7
    assert simhash.drop_near_duplicates(documents(spark, [t] * 3, ids=[None] * 3)).count() == 1


# components


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(edges.where("a < 0")).count() == 0


def plain_fingerprint(text):
    """The rule bit by bit, over shingles joined in Python."""
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_against_the_rule(spark, docs, texts):
    more = ["ÀB cd Ef gh", "a  b\u00a0c d", "one two three", "Z", "a b c d " * 300]
    rows = simhash.near_duplicates(documents(spark, texts + more)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(texts + more)}
