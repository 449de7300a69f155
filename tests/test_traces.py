"""Utilisation traces, shared folders and splits by value."""

import pytest

from clickloom.operators import prepare, run_analytics
from clickloom.plans import storage
from clickloom.sources.run_logs import read_trace


def test_trace_drops_the_cut_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" time , kind , busy \n 10 , gpu , 50 \n12, cpu , 7\n 15 ,gpu, 60\n 17, g")
    (tmp_path / "b.csv").write_text("time,kind,busy\n11,gpu,1\n19,gpu")
    trace = read_trace(spark, str(tmp_path))
    assert sorted(tuple(r) for r in trace.collect()) == [("10", "gpu", "50"), ("11", "gpu", "1"), ("12", "cpu", "7"), ("15", "gpu", "60")]
    assert {r[0] for r in run_analytics.categories(trace, "kind").collect()} == {"gpu", "cpu"}
    timed = trace.selectExpr("cast(time as int) time", "kind", "busy")
    assert sorted(r[0] for r in run_analytics.rebased(timed, "time").collect()) == [0, 1, 2, 5]
    assert sorted(tuple(r) for r in run_analytics.rebased(timed, "time", "kind").select("kind", "time").collect()) == [("cpu", 0), ("gpu", 0), ("gpu", 1), ("gpu", 5)]
    chosen = run_analytics.of_category(timed, "kind", "gpu", "time")
    assert chosen.columns == ["time"] and chosen.count() == 3


def test_traces_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time, kind, busy\n1, gpu, 5\n2, c")
    (tmp_path / "b.csv").write_text("busy, time, power\n7, 3, 90\n8, 4,")
    (tmp_path / "c.csv").write_text("busy, time, power\n9, 5, \"8,0\"\n1")
    trace = read_trace(spark, str(tmp_path))
    assert trace.columns == ["time", "kind", "busy", "power"]
    assert sorted((tuple(r) for r in trace.collect()), key=lambda r: r[0]) == [("1", "gpu", "5", None), ("3", None, "7", "90"), ("5", None, "9", "8,0")]


def test_a_trace_of_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_trace(spark, str(tmp_path)).count() == 0


def test_split_by_values_against_sorting(spark):
    rows = [(i * 37 % 5003, i % 7 if i % 11 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "serp_id long, query_id int")
    train, test = prepare.split(frame, by="query_id")
    assert train.columns == test.columns == frame.columns and train.count() + test.count() == 3000
    for q in range(7):
        own = sorted(s for s, k in rows if k == q)
        assert sorted(r[0] for r in train.where(f"query_id = {q}").collect()) == own[: prepare.n_train(len(own))]
    one, none = prepare.split(frame.where("serp_id = 37 and query_id = 1"), by="query_id")
    assert one.count() + none.count() <= 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
