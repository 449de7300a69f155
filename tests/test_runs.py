"""Command line, exports, run logs and streaming."""

import pytest
from pyspark.sql import functions as F

from clickloom.cli import options, run
from clickloom.operators import run_analytics
from clickloom.operators.models import make_model
from clickloom.plans.em import fit
from clickloom.sources.click_log import serps_from_orders, write_click_log
from clickloom.sources.run_logs import read_run_logs
from clickloom.streaming.scoring import score_stream

SF = "/root/testdata/sf0.001"


def test_run_from_text(spark, tmp_path):
    log = write_click_log(serps_from_orders(spark, SF).where("serp_id < 200"), str(tmp_path / "log"))
    o = options(["-r", log, "-o", str(tmp_path / "out"), "-s", "-1", "-i", "2", "-m", "2"])
    fitted, metrics = run(spark, o)
    assert metrics.count() == 12
    public = spark.read.csv(str(tmp_path / "out_continuation.csv"), header=True).collect()
    assert len(public) == 1 and public[0]["rank"] == "0" and len(public[0]["continuation"].split(".")[1]) == 6
    for name in ("attractiveness", "satisfaction"):
        assert spark.read.csv(str(tmp_path / f"out_{name}.csv"), header=True).columns == ["query", "document", name]


def test_wrong_options():
    for wrong in (["-m", "9"], ["-p", "6"]):
        with pytest.raises(SystemExit):
            options(wrong)


def test_run_logs(spark, tmp_path):
    for n, t in ((1, 10.0), (2, 4.0)):
        folder = tmp_path / f"model_0/GPU X/nodes_{n}/sessions_1000/partitioning_2"
        folder.mkdir(parents=True)
        (folder / "iteration_50.txt").write_text(f"x\nTotal time of training: {t} s\nAverage time per iteration: 2e-1\nAverage time of computation in each iteration: 0.1\nTotal Log likelihood is: -0.25\n")
    runs = read_run_logs(spark, str(tmp_path))
    rows = {r["nodes"]: r for r in runs.collect()}
    assert rows[1]["training_time"] == 10 and rows[2]["iteration_time"] == 0.2 and rows[1]["log_likelihood"] == -0.25 and rows[1]["device"] == "GPU X"
    assert rows[1]["perplexity"] is None and rows[2]["sessions"] == 1000
    means = run_analytics.by_nodes(runs, 0, "GPU X")
    assert {r["nodes"]: r["speedup"] for r in run_analytics.speedup(means, runs.where("nodes = 1")).collect()} == {1: 1.0, 2: 2.5}
    assert runs.select(run_analytics.computation_share()).first()[0] == 50
    assert spark.range(3).select(run_analytics.roofline(F.col("id"), 1.5, 1.0)).collect()[2][0] == 1.5


def test_stream(spark, tmp_path):
    serps = serps_from_orders(spark, SF).where("serp_id < 100")
    serps.write.parquet(str(tmp_path / "in"))
    fitted = fit(make_model("pbm"), serps, 1)
    spark.sql("drop table if exists scored_pages")
    score_stream(spark.readStream.schema(serps.schema).parquet(str(tmp_path / "in")), fitted, "scored_pages", str(tmp_path / "check")).awaitTermination(120)
    assert spark.table("scored_pages").count() == 100 and spark.table("scored_pages").where("log_likelihood < 0").count() == 100
    spark.sql("drop table scored_pages")


def test_packed_run_logs(spark, tmp_path):
    """Logs packed into files give the rows that a file for each gives, also where a file is read in several stretches; the last number after a label counts."""
    logs = {}
    for i in range(40):
        path = f"model_{i % 4}/GPU +{i % 3}/nodes_{1 << i % 2}/sessions_1000/partitioning_2/run_{i}.txt"
        logs[path] = ["start", f"Total time of training: {i}", "Perplexity is: none" if i % 5 else "Perplexity is: 1.5", f"Total time of training: {i + 0.5} s", "a\tb"]
        (tmp_path / "apart" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "apart" / path).write_text("".join(f"{line}\n" for line in logs[path]))
    (tmp_path / "packed").mkdir()
    for k in range(2):
        own = [f"{path}\t{line}\n" for path, lines in list(logs.items())[k::2] for line in lines]
        (tmp_path / "packed" / f"{k}.txt").write_text("".join(["no log\n", *own]))
    rows = lambda runs: sorted(map(tuple, runs.drop("file").fillna(-1).collect()))
    want = rows(read_run_logs(spark, str(tmp_path / "apart")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = read_run_logs(spark, str(tmp_path / "packed"), packed=True)
        assert rows(found) == want and len(want) == 40
        assert {r["file"] for r in found.collect()} == set(logs)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
