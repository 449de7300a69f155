"""Command line: train on a log, evaluate, export, print the report."""

from __future__ import annotations

import argparse

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from clickloom.config import MODELS, POLICIES, RunOptions
from clickloom.operators import prepare
from clickloom.operators.models import make_model
from clickloom.plans.em import fit
from clickloom.plans.storage import written
from clickloom.sources.click_log import read_click_log
from clickloom.sources.sinks import report, write_parameters


def options(arguments: list[str] | None = None) -> RunOptions:
    d = RunOptions()
    parser = argparse.ArgumentParser(prog="clickloom", description=__doc__)
    parser.add_argument("--raw-path", "-r", default=d.raw_path, help="text log to read")
    parser.add_argument("--output", "-o", default=d.output, help="prefix of the exported CSV folders; nothing is written without it")
    parser.add_argument("--max-sessions", "-s", type=int, default=d.max_sessions, help="pages to read, -1 for all")
    parser.add_argument("--itr", "-i", type=int, default=d.iterations, help="EM rounds")
    parser.add_argument("--model-type", "-m", type=int, default=0, choices=range(len(MODELS)), help=", ".join(f"{i} {m}" for i, m in enumerate(MODELS)))
    parser.add_argument("--partition-type", "-p", type=int, default=d.partition_type, choices=range(len(POLICIES)), help="accepted for old scripts; Spark places work")
    parser.add_argument("--test-share", "-t", type=float, default=d.test_share, help="share of the pages that tests")
    parser.add_argument("--job-id", "-j", type=int, default=0, help="label")
    a = parser.parse_args(arguments)
    return RunOptions(a.raw_path, a.output, a.max_sessions, a.itr, MODELS[a.model_type], a.partition_type, a.test_share, a.job_id)


def run(spark: SparkSession, o: RunOptions):
    """(fitted model, metrics table) of a run."""
    return counted_run(spark, o)[:2]


def counted_run(spark: SparkSession, o: RunOptions):
    """(fitted model, metrics table, counts of what was read) of a run; parameters are written if a prefix is given."""
    parsed, read, tested = Observation("parsed"), Observation("read"), Observation("tested")  # counted as the tables are written
    serps, _ = read_click_log(spark, o.raw_path, o.max_sessions, parsed)
    pages = written(serps.observe(read, F.count(F.lit(1)).alias("n")), "serps")
    train, test = prepare.split(pages, o.test_share)
    kept = written(prepare.filter_test(train, test).observe(tested, F.count(F.lit(1)).alias("n")), "test")
    counts = dict(parsed.get) | {"n_train": prepare.n_train(read.get["n"], o.test_share), "n_test": tested.get["n"]}
    fitted = fit(make_model(o.model), train, o.iterations)
    write_parameters(fitted, o.output)
    return fitted, report(kept, fitted), counts


def main() -> None:
    o = options()
    spark = SparkSession.builder.appName(f"clickloom-{o.job_id}").getOrCreate()
    _, metrics, n = counted_run(spark, o)
    print(f"read {n['n_queries']} queries in {n['n_lines']} lines, rejected {n['n_rejected']}; train {n['n_train']} pages, test {n['n_test']}")
    metrics.show(50, truncate=False)


if __name__ == "__main__":
    main()
