"""Near-duplicates send no table through the driver, however little Spark takes it for."""

import numpy as np
import pytest

from clickloom.llm import components, simhash

from .tables import documents


@pytest.fixture
def plans(monkeypatch):
    """The final plan of each table that near-duplicates write."""
    found = []

    def staged(df, name, write=simhash.staged):
        df.collect()
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    for module in (simhash, components):
        monkeypatch.setattr(module, "staged", staged)
    return found


def joined_apart(plan):
    return "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_dense_family_is_not_broadcast(spark, plans):
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 1 << 62))
    family = {center} | {center ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 62, (330, 2))}
    alone = [int(x) for x in rng.integers(0, 1 << 62, 5)]
    prints = spark.createDataFrame([(x, i) for i, x in enumerate([*family, *alone])], "fp long, doc_id long")
    named = simhash._components(prints)
    rows = named.collect()
    assert len(family) > 256 and {r["component_id"] for r in rows if r["fp"] in family} == {0}
    assert {r["fp"] for r in rows if r["component_id"] == 0} == family and len({r["component_id"] for r in rows}) == 6
    joins = [p for p in [*plans, named._jdf.queryExecution().executedPlan().toString()] if "Join" in p]
    assert len(joins) >= 5 and all(map(joined_apart, joins))


def test_documents_meet_their_components_without_a_broadcast(spark):
    found = simhash.near_duplicates(documents(spark, ["one two three four five"] * 3 + ["six seven eight"]))
    assert [r["component_id"] for r in sorted(found.collect(), key=lambda r: r["doc_id"])] == [0, 0, 0, 3]
    assert joined_apart(found._jdf.queryExecution().executedPlan().toString())


def test_the_near_dedup_stage_broadcasts_no_fingerprints(spark, plans):
    stage = dict(pytest.importorskip("corpus_pipeline").STAGES)["near_dedup"]
    kept = stage(spark, documents(spark, ["one two three four five"] * 3 + ["six seven eight", None, ""]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4]
    assert all(joined_apart(p) for p in plans if "Join" in p)
    assert "SortMergeJoin [fp" in kept._jdf.queryExecution().executedPlan().toString()


def test_hot_nodes_meet_their_least_below_the_shuffle_of_the_join(spark, plans):
    """Spark splits a skewed join only where both of its sorts stand on its own shuffles."""
    star = spark.createDataFrame([(0, i) for i in range(1, 50)], "a long, b long")
    assert {r["component"] for r in components.components(star).collect()} == {0}
    joins = 0
    for plan in plans:
        lines = [line.lstrip(" :+-*()0123456789") for line in plan.split("== Initial Plan ==")[0].splitlines()]
        for i, line in enumerate(lines):
            if line.startswith("Sort [a#"):
                joins += 1
                assert [x.split()[0] for x in lines[i + 1 : i + 4]][-2:] == ["ShuffleQueryStage", "Exchange"] or lines[i + 2].startswith(("ReusedExchange", "ShuffleQueryStage"))
    assert joins >= 4
