"""The pipeline's stages, each held against a plain version of its decision on the smallest tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from clickloom.llm import decontaminate, simhash, toxicity

from .test_secret_scan import PATTERNS, plain_spans

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """The documents, some of them again, nulls, and secrets of one owner and of many."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(9001, None, "en", "s", 0), (None, "only words here", "en", "s", 0), (9002, "", "de", "t", 0), (9003, "token = only0wner77", "en", "s", 0)]
    more += [(9010 + i, f"number {i} of examples: secret=c0pied4all", "en", f"u{i}", 0) for i in range(4)]
    return given.union(given.where("doc_id < 20")).union(spark.createDataFrame(more, given.schema))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_names_and_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).columns == docs.columns


def test_toxicity_stage(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    plain = sorted((tuple(r) for r in docs.collect() if scores[r["doc_id"]] < 0.7), key=str)
    assert rows(STAGES["toxicity"](spark, docs, SF)) == plain and len(plain) < docs.count()


def test_near_dedup_stage(spark, docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = sorted({simhash.fingerprint(t) for _, t in texts})
    group = {p: p for p in prints}

    def top(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                group[top(a)] = top(b)
    least: dict = {}
    for i, t in texts:
        g = top(simhash.fingerprint(t))
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    kept = STAGES["near_dedup"](spark, docs, SF).select("doc_id").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(least.values())


def test_decontamination_stage(spark, docs):
    benchmark = [(r["item_id"], decontaminate.tokens(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verbatim = set()
    for r in docs.collect():
        text = b" " + b" ".join(decontaminate.tokens(r["text"])) + b" "
        if any(b" " + b" ".join(w) + b" " in text for _, w in benchmark if w):
            verbatim.add(r["doc_id"])
    found = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = [r["doc_id"] for r in STAGES["decontamination"](spark, docs, SF).collect()]
    assert verbatim and verbatim <= found and sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in found)


def test_secret_stage(spark, docs):
    owners: dict = {}
    for r in docs.collect():
        for *_, value in plain_spans(r["text"]):
            owners.setdefault(hashlib.sha256(value.encode()).hexdigest(), set()).add((r["source"], r["lang"]))
    masked = {(r["doc_id"], r["n_chars"], r["source"]): r["text"] for r in STAGES["secret_scan"](spark, docs, SF).collect()}
    checked = 0
    for r in docs.collect():
        out, at = "", 0
        for start, _, end, value in plain_spans(r["text"]):
            places = owners[hashlib.sha256(value.encode()).hexdigest()]
            n = len({o for o, _ in places})
            if n >= 3 or (n == 2 and len(places) >= 6):
                continue
            if start >= at:
                out += r["text"][at:start] + "[SECRET]"
            at = max(at, end)
        expected = None if r["text"] is None else out + r["text"][at:]
        checked += expected != r["text"]
        assert masked[r["doc_id"], r["n_chars"], r["source"]] == expected
    assert checked >= 1 and masked[9003, 0, "s"] == "[SECRET]" and "c0pied4all" in masked[9010, 0, "u0"] and len(PATTERNS) == 4


def test_run(spark):
    packed = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in packed}
    assert packed and ids <= {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    for i in ids:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in packed if r["doc_id"] == i)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][0] + own[-1][1] == own[-1][2]


def test_stages_of_an_empty_table(spark, docs):
    empty = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
