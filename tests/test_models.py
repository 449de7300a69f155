"""One round of EM on single pages with known results, and properties of trained models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators.models import SATISFY, make_model
from clickloom.operators.score import evaluate, predict, score
from clickloom.plans.em import fit

SCHEMA = "serp_id long, query_id int, docs array<int>, clicks array<int>"


def page(spark, clicks):
    return spark.createDataFrame([(1, 7, list(range(100, 110)), [int(c) for c in clicks])], SCHEMA)


def private(fitted, kind=0):
    return [round(r["value"], 6) for r in fitted.private(kind).orderBy("doc_id").collect()]


def public(fitted):
    return [round(v, 6) for v in fitted.public]


@pytest.mark.parametrize("clicks", ["0000000000", "1000000000", "0010100000"])
def test_pbm(spark, clicks):
    fitted = fit(make_model("pbm"), page(spark, clicks), 1)
    expected = [0.666667 if c == "1" else 0.444444 for c in clicks]
    assert private(fitted) == expected and public(fitted) == expected


@pytest.mark.parametrize(
    "clicks,slots",
    [
        ("0000000000", {k: 0.444444 for k in (9, 10, 12, 15, 19, 24, 30, 37, 45, 54)}),
        ("1000000000", {9: 0.666667} | {k: 0.444444 for k in (1, 3, 6, 10, 15, 21, 28, 36, 45)}),
        ("0010100000", {12: 0.666667} | {k: 0.444444 for k in (8, 9, 10, 19, 25, 32, 40, 49)}),
    ],
)
def test_ubm(spark, clicks, slots):
    fitted = fit(make_model("ubm"), page(spark, clicks), 1)
    assert public(fitted) == [slots.get(k, 0.5) for k in range(55)]


CCM = {
    "0000000000": ([0.333333] * 10, [0.916667, 0.5, 0.5]),
    "1000000000": ([0.6875, 0.458333, 0.483333, 0.492423, 0.496375, 0.498224, 0.499116, 0.49955, 0.499755, 0.499837], [0.445412, 0.45, 0.45]),
    "0010100000": ([0.333333, 0.333333, 0.5, 0.333333, 0.687408, 0.498224, 0.499116, 0.49955, 0.499755, 0.499837], [0.745021, 0.541728, 0.541728]),
}
DBN = {
    "0000000000": ([0.333333] * 10, [0.5] * 10, 0.916667),
    "1000000000": ([0.666667, 0.472222, 0.491379, 0.496963, 0.498886, 0.499585, 0.499844, 0.49994, 0.499976, 0.499988], [0.533333] + [0.5] * 9, 0.438883),
    "0010100000": (
        [0.333333, 0.333333, 0.666667, 0.333333, 0.666667, 0.499585, 0.499844, 0.49994, 0.499976, 0.499988],
        [0.5, 0.5, 0.333333, 0.5, 0.533294, 0.5, 0.5, 0.5, 0.5, 0.5],
        0.776643,
    ),
}


@pytest.mark.parametrize("clicks", CCM)
def test_ccm(spark, clicks):
    fitted = fit(make_model("ccm"), page(spark, clicks), 1)
    assert private(fitted) == CCM[clicks][0] and public(fitted) == CCM[clicks][1]


@pytest.mark.parametrize("clicks", DBN)
def test_dbn(spark, clicks):
    fitted = fit(make_model("dbn"), page(spark, clicks), 1)
    assert private(fitted) == DBN[clicks][0] and private(fitted, SATISFY) == DBN[clicks][1] and public(fitted) == [DBN[clicks][2]]


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), [int(x) for x in rng.permutation(14)[:10]], [int(x) for x in rng.random(10) < 0.25]) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("kind", ["pbm", "ubm", "ccm", "dbn"])
def test_values_and_probabilities(spark, pages, kind):
    fitted = fit(make_model(kind), pages, 2)
    assert all(0 < r["value"] <= 0.999999 for r in fitted.private().collect())
    again = fit(make_model(kind), pages.repartition(5), 2)
    assert np.allclose(fitted.public, again.public)
    scored = score(pages, fitted)
    low = scored.select(F.min(F.array_min("conditional")), F.min(F.array_min("full")), F.max(F.array_max("full"))).first()
    assert low[0] > 0 and low[1] > 0 and low[2] < 1
    row = evaluate(pages, fitted).first()
    assert row["log_likelihood"] < 0 and row["perplexity"] > 1 and row["n_serps"] == 60
    assert predict(pages, fitted).count() == 600


@pytest.mark.parametrize("kind", ["ccm", "dbn"])
def test_conditionals_multiply_to_one_over_all_flags(kind):
    model, rng = make_model(kind), np.random.default_rng(5)
    flags = np.array([[k >> r & 1 for r in range(10)] for k in range(1024)], float)
    a, s = (np.tile(rng.random(10), (1024, 1)) for _ in range(2))
    g = rng.random(model.public)
    assert np.isclose(model.conditional(a, s, flags, g).prod(axis=1).sum(), 1)


def test_unset_prior_pulls_to_half(spark, pages):
    zero, prior = (fit(make_model("ubm", unset=u), pages, 1).public for u in ("zero", "prior"))
    assert all(abs(p - 0.5) <= abs(z - 0.5) + 1e-12 for z, p in zip(zero, prior))
    assert fit(make_model("dbn", unset="prior"), pages, 1).private(SATISFY).count() > 0


def test_unknown_model_is_refused():
    with pytest.raises(ValueError):
        make_model("none")
