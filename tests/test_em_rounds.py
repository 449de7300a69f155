"""Rounds of EM: the dictionary of lists, sums within blocks, warm starts, resumed and merged fits, exports read back."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.functions.clicks import value
from clickloom.operators import lists, prepare
from clickloom.operators.lists import ATTRACT, PUBLIC, SATISFY, ListBlock, list_values, page_lists, with_values
from clickloom.operators.models import make_model
from clickloom.operators.score import log_likelihood, perplexity_by_rank, score, score_cases
from clickloom.plans import em
from clickloom.plans.em import fit, fit_replicas, initial, merge
from clickloom.plans.numbering import in_reading_order
from clickloom.plans.storage import fresh, written
from clickloom.sources.click_log import numbered_lines
from clickloom.sources.parameters import read_parameters
from clickloom.sources.sinks import private_export, write_in_order, write_parameters

SCHEMA = "serp_id long, query_id int, docs array<int>, clicks array<int>"
KINDS = ["pbm", "ubm", "ccm", "dbn"]


def some_pages(n, seed=7, hot=0):
    """Random pages, of which every ``hot``-th shows one list."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        docs = list(range(10)) if hot and i % hot == 0 else [int(x) for x in rng.permutation(16)[:10]]
        rows.append((i, 0 if hot and i % hot == 0 else int(rng.integers(4)), docs, [int(x) for x in rng.random(10) < 0.3]))
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return written(spark.createDataFrame(some_pages(120), SCHEMA), "pages")


def private(fitted, kind=ATTRACT):
    return {(r["query_id"], r["doc_id"]): r["value"] for r in fitted.private(kind).collect()}


def same(one, other):
    assert np.allclose(one.public, other.public, atol=1e-12)
    for kind in one.model.kinds:
        a, b = private(one, kind), private(other, kind)
        assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], atol=1e-12) for k in a)


def test_dictionary_holds_every_page_once(spark):
    rows = some_pages(300, hot=3)
    want = defaultdict(lambda: defaultdict(int))
    for _, q, docs, clicks in rows:
        want[q, tuple(docs)][sum(c << r for r, c in enumerate(clicks))] += 1
    table = page_lists(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    found = defaultdict(dict)
    for r in table:
        found[r["list_id"]][r["rank"]] = r
    assert len(found) == len(want)
    for cells in found.values():
        assert sorted(cells) == list(range(10)) and all(cells[r]["cases"] is None for r in range(1, 10))
        key = (cells[0]["query_id"], tuple(cells[r]["doc_id"] for r in range(10)))
        assert {c["mask"]: c["n"] for c in cells[0]["cases"]} == want[key]


@pytest.mark.parametrize("kind", ["ccm", "dbn"])
@pytest.mark.parametrize("at_once", [1, 40, 1 << 15])
def test_a_block_sends_one_row_a_key(spark, pages, kind, at_once, monkeypatch):
    """Posteriors of a block against the sum over its pages one by one."""
    monkeypatch.setattr(lists, "CASES_AT_ONCE", at_once)
    model = make_model(kind)
    theta = written(fit(model, pages, 1).theta, "theta")
    statistics = written(page_lists(pages), "statistics")
    rows = list_values(statistics, theta).coalesce(1).toArrow()
    g = np.linspace(0.4, 0.8, model.public)
    batch = model._summed(ListBlock(rows.combine_chunks().to_batches()[0]), g)
    found = {(k, q if k != PUBLIC else None, d): (x, y) for k, q, d, x, y in zip(*(c.to_pylist() for c in batch.columns))}
    assert len(found) == batch.num_rows <= len(model.kinds) * prepare.query_doc_pairs(pages).count() + model.public
    values = {(r["kind"], r["query_id"], r["doc_id"]): r["v"] for r in theta.select("*", value(F.col("num"), F.col("den")).alias("v")).collect()}
    want = defaultdict(lambda: np.zeros(2))
    for r in pages.collect():
        of = lambda own: np.array([[values.get((own, r["query_id"], d), 0.5) for d in r["docs"]]])
        atr, sat, shared = model.entries(of(ATTRACT), of(SATISFY), np.array([r["clicks"]]), g)
        for own, pair in ((ATTRACT, atr), (SATISFY, sat)):
            for i, d in enumerate(r["docs"] if pair is not None else ()):
                want[own, r["query_id"], d] += pair[0][0, i], pair[1][0, i]
        for i, (x, y) in enumerate(shared):
            want[PUBLIC, None, i] += float(x[0]), float(y[0])
    want = {k: v for k, v in want.items() if v[1] > 0 or k[0] == PUBLIC}
    assert found.keys() == want.keys()
    assert all(np.allclose(found[k], want[k], atol=1e-9) for k in want)


def test_a_round_joins_once(spark, pages):
    model = make_model("dbn")
    statistics = written(model.statistics(pages), "statistics")
    theta = written(initial(model, pages), "theta")
    plan = model.posteriors(statistics, theta, [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1


def test_negative_ids_and_documents_twice_on_a_page(spark):
    rows = [(i, -3 if i % 2 else 2_000_000_000, [5, 5, -7, 2**31 - 1, -(2**31), 1, 2, 3, 4, 9], [i >> r & 1 for r in range(10)]) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for kind in KINDS:
        fitted = fit(make_model(kind), frame, 2)
        assert set(private(fitted)) == {(q, d) for _, q, docs, _ in rows for d in docs}


def test_a_list_on_a_third_of_all_pages_is_split(spark):
    """Its pages come to several tasks when values are joined, and get the values that they get alone."""
    pages = spark.createDataFrame(some_pages(3000, hot=3), SCHEMA)
    fitted = fit(make_model("pbm"), pages, 1)
    joined = with_values(pages, fitted.theta)
    assert joined.count() == 3000
    known = private(fitted)
    for r in joined.collect():
        assert np.allclose(r["a"], [known[r["query_id"], d] for d in r["docs"]]) and r["s"] == [0.5] * 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sizes = [r["n"] for r in with_values(pages, fitted.theta).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 8 and max(sizes) < 2 * 3000 / 8


@pytest.mark.parametrize("kind", KINDS)
def test_measures_of_cases_are_those_of_pages(spark, kind):
    pages = spark.createDataFrame(some_pages(200, hot=2), SCHEMA)
    fitted = fit(make_model(kind), pages.where("serp_id < 100"), 1)
    cases, whole = score_cases(pages, fitted), score(pages, fitted)
    a, b = (log_likelihood(x).first() for x in (cases, whole))
    assert a["n_serps"] == b["n_serps"] == 200 and np.isclose(a["log_likelihood"], b["log_likelihood"])
    a, b = ({r["rank"]: r["perplexity"] for r in perplexity_by_rank(x).collect()} for x in (cases, whole))
    assert a.keys() == b.keys() and all(np.isclose(a[r], b[r]) for r in a)


@pytest.mark.parametrize("kind", KINDS)
def test_exact_export_goes_on_like_a_straight_run(spark, pages, kind):
    prefix = fresh(spark, "export")
    write_parameters(fit(make_model(kind), pages, 1), prefix, exact=True)
    back = read_parameters(spark, prefix, kind)
    same(fit(make_model(kind), pages, 2, start=back), fit(make_model(kind), pages, 3))


def test_rounded_exports_keep_six_decimals(spark, pages):
    fitted = fit(make_model("dbn"), pages, 2)
    for train in (None, pages):
        prefix = fresh(spark, "export")
        write_parameters(fitted, prefix, train)
        back = read_parameters(spark, prefix, "dbn")
        assert np.allclose(back.public, fitted.public, atol=6e-7)
        for kind in (ATTRACT, SATISFY):
            a, b = private(fitted, kind), private(back, kind)
            assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 6e-7 for k in a)


def test_parts_of_the_parameters_are_got_and_set(spark, pages):
    one, two = (fit(make_model("ccm"), pages, k) for k in (1, 2))
    mixed = two.with_parameters(one.parameters("public"), "public")
    assert mixed.public == one.public and private(mixed) == private(two)
    mixed = two.with_parameters(one.parameters("private"), "private")
    assert mixed.public == two.public and private(mixed) == private(one)
    same(two.with_parameters(one.parameters()), one)
    assert one.parameters("public").count() == 3


def test_warm_start_keeps_pairs_that_training_lacks(spark, pages):
    start = fit(make_model("pbm"), pages, 2)
    few = pages.where("query_id = 1")
    fitted = fit(make_model("pbm"), few, 1, start=start)
    before, after = private(start), private(fitted)
    assert before.keys() == after.keys()
    assert all(after[k] == before[k] for k in before if k[0] != 1) and any(after[k] != before[k] for k in before if k[0] == 1)


@pytest.mark.parametrize("kind", ["ubm", "dbn"])
def test_a_fit_that_is_killed_goes_on(spark, pages, kind, monkeypatch):
    folder, model, calls = fresh(spark, "fit"), make_model(kind), []
    step = em.m_step

    def dies(posteriors):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return step(posteriors)

    monkeypatch.setattr(em, "m_step", dies)
    with pytest.raises(RuntimeError):
        fit(model, pages, 4, folder=folder)
    monkeypatch.setattr(em, "m_step", lambda p: calls.append(1) or step(p))
    calls.clear()
    resumed = fit(model, pages, 4, folder=folder)
    assert len(calls) == 2  # rounds 1 and 2 were kept
    monkeypatch.undo()
    same(resumed, fit(model, pages, 4))
    same(fit(model, pages, 2, folder=folder), fit(model, pages, 2))
    with pytest.raises(ValueError, match="another fit"):
        fit(model, pages.where("serp_id > 3"), 4, folder=folder)
    with pytest.raises(ValueError, match="another fit"):
        fit(make_model("pbm"), pages, 4, folder=folder)


@pytest.mark.parametrize("kind", KINDS)
def test_merged_replicas_are_one_fit(spark, pages, kind):
    parts = [pages.where(f"serp_id % 3 = {i}") for i in range(3)]
    same(merge([fit(make_model(kind), p, 1) for p in parts]), fit(make_model(kind), pages, 1))
    same(fit_replicas(make_model(kind), parts, 3), fit(make_model(kind), pages, 3))


def test_merge_of_an_empty_part(spark, pages):
    empty = pages.where("serp_id < 0")
    same(merge([fit(make_model("pbm"), p, 1) for p in (pages, empty)]), fit(make_model("pbm"), pages, 1))


def test_dense_ids_follow_first_places(spark):
    rows = some_pages(90)
    rng = np.random.default_rng(1)
    numbers = sorted(int(x) for x in rng.choice(10**12, 90, replace=False))
    frame = spark.createDataFrame([(numbers[i], *r) for i, *r in rows], SCHEMA).repartition(5)
    want = {}
    for _, q, docs, _ in rows:
        for d in docs:
            want.setdefault((q, d), len(want))
    assert {(r["query_id"], r["doc_id"]): r["id"] for r in prepare.dense_ids(frame).collect()} == want
    assert prepare.dense_ids(frame.where("serp_id < 0")).count() == 0


def test_lines_of_the_ordered_export(spark, pages):
    fitted = fit(make_model("dbn"), pages.where("serp_id < 60"), 1)
    for kind, name in ((ATTRACT, "attractiveness"), (SATISFY, "satisfaction")):
        path = write_in_order(fitted, pages.repartition(6), fresh(spark, "export"), kind)
        files = sorted({r[0] for r in spark.read.text(path).select(F.input_file_name()).collect()})
        lines = [r["value"] for f in files for r in spark.read.text(f).coalesce(1).collect()]
        known = private(fitted, kind)
        rows = sorted(pages.collect(), key=lambda r: r["serp_id"])
        assert lines == [f"query, document, {name}"] + [f"{r['query_id']}, {d}, {known.get((r['query_id'], d), 0.5):.6f}" for r in rows for d in r["docs"]]


@pytest.mark.parametrize("few", [lists.FEW, 0])
def test_an_export_by_impression_broadcasts_no_impressions(spark, pages, few, monkeypatch):
    """Pages lie in a small file, but their impressions are what a broadcast of them would hold; pairs that training lacks have no line."""
    monkeypatch.setattr(lists, "FEW", few)
    fitted, shown = fit(make_model("pbm"), pages.where("serp_id < 60"), 1), written(pages, "pages")
    export = private_export(fitted, train=shown, exact=True)
    assert "BuildLeft" not in export._jdf.queryExecution().toString()
    known = {(r["query_id"], r["doc_id"]): (f"{r['value']:.6f}", r["num"], r["den"]) for r in fitted.private().collect()}
    want = [(r["query_id"], d, *known[r["query_id"], d]) for r in pages.collect() for d in r["docs"] if (r["query_id"], d) in known]
    assert sorted(map(tuple, export.collect())) == sorted(want)


def test_lines_keep_their_places(spark, tmp_path):
    """Several files, read in stretches and cut into blocks: places are those of the files joined by name, and no line is shuffled."""
    want = []
    for i, n in enumerate((700, 0, 1, 2500)):
        own = [f"{i} {k} {'x' * (k % 50)}" for k in range(n)]
        (tmp_path / f"part-{i}.txt").write_text("".join(f"{line}\n" for line in own))
        want += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        placed = in_reading_order(numbered_lines(spark, str(tmp_path), 100), "place").select("place", "value")
        assert "SortMergeJoin" not in placed._jdf.queryExecution().toString()
        found = placed.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in sorted(found)] == list(enumerate(want))


def test_batches_may_be_slices(spark, pages):
    rows = list_values(written(page_lists(pages), "statistics"), initial(make_model("ccm"), pages)).coalesce(1).toArrow().combine_chunks().to_batches()[0]
    whole, tail = ListBlock(rows), ListBlock(rows.slice(5))
    assert (tail.docs == whole.docs[5:]).all() and tail.n.sum() == whole.n[whole.ends[4] :].sum()


@pytest.mark.parametrize("options", [("pbm", {}), ("ubm", {}), ("ubm", {"exact_slots": True})])
def test_carried_rounds_equal_joined_ones(spark, pages, options):
    model = make_model(options[0], **options[1])
    statistics = written(model.statistics(pages), "statistics")
    theta, public = initial(model, pages), [0.5] * model.public
    for _ in range(3):
        theta = written(em.m_step(model.posteriors(statistics, theta, public)), "theta")
        public = em._public_values(model, theta)
    same(fit(model, pages, 3), em.Fitted(model, theta, public))


def test_a_carried_round_moves_no_row(spark, pages):
    model = make_model("ubm")
    table = written(em.opening(model, pages), "carried")
    plan = em.one_round(model, table, table, [0.5] * model.public)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert all(len(r["cells"]) <= 110 for r in table.collect())


def test_carried_rounds_of_no_pages(spark, pages):
    empty = pages.where("serp_id < 0")
    assert fit(make_model("ubm"), empty, 2).theta.count() == 0
    start = fit(make_model("pbm"), pages, 1)
    assert private(fit(make_model("pbm"), empty, 1, start=start)) == private(start)
