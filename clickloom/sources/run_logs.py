"""Logs of training runs and utilisation traces as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.plans.storage import written

NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
#: Metric names and the labels that stand before their numbers in a log.
LABELS = {
    "iteration_time": "Average time per iteration: ",
    "computation_time": "computation in each iteration: ",
    "update_time": "update in each iteration: ",
    "synchronization_time": "synchronization in each iteration: ",
    "training_time": "Total time of training: ",
    "evaluation_time": "Evaluation time: ",
    "parsing_time": "Total pre-processing time: ",
    "h2d_time": "Average Host to Device parameter transfer time: ",
    "d2h_time": "Average Device to Host parameter transfer time: ",
    "perplexity": "Perplexity is: ",
    "log_likelihood": "Total Log likelihood is: ",
}
#: Columns found in the path of a log.
PATH = {
    "model": r"model[_=](\d+)/", "device": r"model[_=]\d+/(?:device=)?([^/]+)/", "nodes": r"nodes[_=](\d+)", "sessions": r"sessions[_=](\d+)", "partitioning": r"partitioning[_=](\d*)"
}


def read_run_logs(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """One row per log below ``path``: what the path tells, and the last number after each label (null without one).

    A log is a file.  With ``packed`` files hold many logs, as a file each is too dear for many short runs: a line is the path of its log, a tab and
    the log's line, and the lines of a log stand in order in one file.  Lines without a tab belong to no log.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("line")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), place)
    if packed:
        tab = F.instr("value", "\t")
        lines = lines.where(tab > 0).select(F.substring("value", tab + 1, F.length("value")).alias("value"), F.substring("value", F.lit(1), tab - 1).alias("file"), "line")
    found = [
        F.max_by(
            F.regexp_extract("value", "\\Q" + label + "\\E\\s*" + NUMBER, 1).try_cast("double"),
            F.when(F.col("value").contains(label), F.col("line")),
        ).alias(name)
        for name, label in LABELS.items()
    ]
    decoded = F.col("file") if packed else F.url_decode(F.regexp_replace("file", r"\+", "%2B"))
    keys = [F.regexp_extract(decoded, pattern, 1).alias(name) for name, pattern in PATH.items()]
    numbers = [F.col(n).try_cast("long").alias(n) if n != "device" else F.col(n) for n in PATH]
    return lines.groupBy("file").agg(*found).select("*", *keys).select("file", *numbers, *LABELS)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Utilisation traces: CSV files below ``path`` with a header and blanks around the cells; the last line of each, which is cut off, goes.

    All columns are text.  Files may differ in their headers: columns are those of all headers, in the order of files, and null where a file lacks one.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")
    )
    lines = written(lines, "trace")
    ends = lines.groupBy("file").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.min_by("value", "line").alias("header"))
    # one row for each different header
    headers = [r["header"] for r in ends.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").collect()]
    if not headers:
        return spark.createDataFrame([], "value string")
    named = [[x.strip() for x in header.split(",")] for header in headers]
    names = list(dict.fromkeys(x for header in named for x in header))
    cells = [f"c{i}" for i in range(max(map(len, named)))]
    row = F.from_csv("value", ", ".join(f"{c} string" for c in cells), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    own = F.transform(F.split("header", ","), lambda x: F.trim(x))
    column = lambda name: F.get(F.array(*[F.col(f"row.{c}") for c in cells]), F.array_position("own", name).cast("int") - 1).alias(name)
    inner = lines.join(ends, "file").where((F.col("line") > F.col("first")) & (F.col("line") < F.col("last")))
    return inner.select(row.alias("row"), own.alias("own")).select(*map(column, names))
