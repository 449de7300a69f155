"""Parsing rules, splits and array functions against hand-made cases."""

import gzip

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from clickloom.config import RunOptions
from clickloom.functions.clicks import last_click, previous_clicks, slot, value
from clickloom.operators import prepare
from clickloom.plans.storage import written
from clickloom.sources.click_log import impressions, numbered_lines, parse, read_click_log, serps_from_orders, to_serps, write_click_log

SF = "/root/testdata/sf0.001"
LOG = """1 0 Q 7 0 10 11 12 13 14 15 16 17 18 19
1 5 C 12
2 0 Q 7 0 10 10 12 13 14 15 16 17 18 19
2 3 C 10
2 4 C 99
9 1 C 13
not a log line
5 1 2

3 0 Q 8 0 20 21 22 23 24 25 26 27 28 29
3 2 C 29
  4 0\tQ 8 0 20 21 22 23 24 25 26 27 28 29
"""


@pytest.fixture()
def log(tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    return str(tmp_path / "log.txt")


def test_pages_and_clicks(spark, log):
    serps, rejected = read_click_log(spark, log)
    rows = {r["serp_id"]: r for r in serps.collect()}
    clicked = {k: [i for i, c in enumerate(r["clicks"]) if c] for k, r in rows.items()}
    assert clicked == {1: [2], 2: [0, 3], 3: [9]}
    assert sorted(r["value"] for r in rejected.collect()) == ["", "5 1 2", "not a log line"]


def test_limit_is_the_first_pages(spark, log):
    serps, _ = read_click_log(spark, log, max_sessions=2)
    assert sorted(r["serp_id"] for r in serps.collect()) == [1, 2]


def test_impressions_keep_ranks(spark, log):
    rows = impressions(read_click_log(spark, log)[0]).where("serp_id = 2 and click = 1").collect()
    assert sorted((r["rank"], r["doc_id"]) for r in rows) == [(0, 10), (3, 13)]


def test_two_files_are_read_in_order_of_name(spark, tmp_path):
    lines = LOG.splitlines(keepends=True)
    (tmp_path / "a.txt").write_text("".join(lines[:3]))
    (tmp_path / "b.txt").write_text("".join(lines[3:]))
    serps, _ = read_click_log(spark, str(tmp_path))
    clicked = {r["serp_id"]: [i for i, c in enumerate(r["clicks"]) if c] for r in serps.collect()}
    assert clicked == {1: [2], 2: [0, 3], 3: [9]}


def test_a_gzip_file_is_parsed_by_several_tasks(spark, tmp_path):
    lines = [f"{i} 0 Q {i % 5} 0 " + " ".join(str((i + r) % 40) for r in range(10)) if i % 3 == 0 else f"{i} 1 C {(i // 3 * 3 + i) % 40}" for i in range(5000)]
    for name, put in (("plain", open), ("gz", gzip.open)):
        (tmp_path / name).mkdir()
        with put(tmp_path / name / f"log.txt{'.gz' if name == 'gz' else ''}", "wt") as f:
            f.write("\n".join(lines) + "\n")
    rows = numbered_lines(spark, str(tmp_path / "gz"), block_lines=700)
    assert rows.select("block").distinct().count() == 8 and len(rows.inputFiles()) == 8
    assert [r["value"] for r in rows.orderBy("block", "line").collect()] == lines
    of = lambda rows: {(r["serp_id"], r["query_id"], *r["docs"], *r["clicks"]) for r in to_serps(parse(rows)[0]).collect()}
    assert of(rows) == of(numbered_lines(spark, str(tmp_path / "plain"))) and len(of(rows)) == 1666


def test_a_read_counts_in_passing(spark, log):
    counts = Observation("counts")
    read_click_log(spark, log, counts=counts)
    assert counts.get == {"n_lines": 12, "n_queries": 4, "n_clicks": 5, "n_rejected": 3}


@pytest.mark.parametrize("n,expected", [(0, 0), (3, 2), (5, 4), (10, 8), (11, 9), (13, 10)])
def test_train_size(n, expected):
    assert prepare.n_train(n) == expected


def test_split_with_gaps(spark):
    ids = [3, 9, 10, 500, 501, 502, 9000, 9001, 100_000, 100_001, 5_000_000]
    frame = spark.createDataFrame([(i,) for i in ids], "serp_id long")
    train, test = prepare.split(frame)
    assert [r[0] for r in train.orderBy("serp_id").collect()] == ids[:9]
    assert [r[0] for r in test.orderBy("serp_id").collect()] == ids[9:]
    train, _ = prepare.split(frame, by="serp_id % 2")
    assert train.count() == prepare.n_train(5) + prepare.n_train(6)


def test_filter_drops_unseen(spark):
    schema = "serp_id long, query_id int, docs array<int>, clicks array<int>"
    train = spark.createDataFrame([(1, 1, list(range(10)), [0] * 10)], schema)
    test = spark.createDataFrame([(2, 2, list(range(10)), [0] * 10), (3, 1, list(range(20, 30)), [0] * 10), (4, 1, [9, *range(30, 39)], [0] * 10)], schema)
    assert [r["serp_id"] for r in prepare.filter_test(train, test).collect()] == [4]


@pytest.mark.parametrize(
    "clicks,last,previous",
    [("0000000000", 10, [9] * 10), ("1000000000", 0, [9] + [0] * 9), ("0010100000", 4, [9, 9, 9, 2, 2, 4, 4, 4, 4, 4])],
)
def test_click_arrays(spark, clicks, last, previous):
    row = spark.createDataFrame([([int(c) for c in clicks],)], "clicks array<int>").select(last_click(F.col("clicks")), previous_clicks(F.col("clicks"))).first()
    assert (row[0], row[1]) == (last, previous)


def test_aliased_slots(spark):
    rows = spark.sql("select r as rank, p as previous from (select explode(sequence(0, 9)) r), (select explode(sequence(0, 9)) p) where p < r or p = 9")
    found = rows.select(slot(F.col("rank"), F.col("previous")).alias("s"), slot(F.col("rank"), F.col("previous"), exact=True).alias("e"))
    assert found.agg(F.count_distinct("s"), F.count_distinct("e")).first()[:] == (47, 55)


def test_value(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (0.0, 0.0), (5.0, 4.0)], "n double, d double")
    assert [r[0] for r in rows.select(value(F.col("n"), F.col("d"))).collect()] == [0.5, 0.999999, 0.999999, 0.999999]


def test_options_are_checked():
    RunOptions()
    for wrong in ({"model": "xyz"}, {"partition_type": 6}, {"test_share": 1.5}, {"iterations": 0}):
        with pytest.raises(ValueError):
            RunOptions(**wrong)


def test_lines_and_pages_are_moved_once(spark, tmp_path):
    """Clicks meet their pages in one group, and pages of the test are told by their lists: neither is joined by the pages' number."""
    path = write_click_log(serps_from_orders(spark, SF).where("serp_id < 200"), str(tmp_path / "log"))
    serps, _ = read_click_log(spark, path)
    assert serps._jdf.queryExecution().executedPlan().toString().count("Join") == 1  # the first numbers of blocks
    train, test = prepare.split(written(serps, "serps"))
    assert "hashpartitioning(serp_id" not in prepare.filter_test(train, test)._jdf.queryExecution().executedPlan().toString()
