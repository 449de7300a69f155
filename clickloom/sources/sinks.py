"""Parameter exports and the metrics report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.lists import filled, to_pages, values_of_lists, written_lists
from clickloom.operators.models import ATTRACT, SATISFY
from clickloom.operators.score import measures, perplexity_by_rank, score_cases
from clickloom.plans.em import Fitted
from clickloom.plans.storage import written

SIX = "%.6f"


def public_export(fitted: Fitted, exact: bool = False) -> DataFrame:
    """(rank, examination or continuation) with six decimals, and with ``exact`` numerator and denominator."""
    more = ["num", "den"] if exact else []
    return fitted.public_table().select(F.col("slot").alias("rank"), F.format_string(SIX, "value").alias(fitted.model.public_name), *more)


def private_export(fitted: Fitted, kind: int = ATTRACT, train: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(query, document, value) with six decimals: one row per pair, or per training impression if ``train`` is given."""
    name = {ATTRACT: "attractiveness", SATISFY: "satisfaction"}[kind]
    rows, more = fitted.private(kind), ["num", "den"] if exact else []
    shown = [F.col("doc_id").alias("document"), F.format_string(SIX, "value").alias(name), *more]
    if train is None:
        return rows.select(F.col("query_id").alias("query"), *shown)
    # impressions of a list are put together once, and pages get them from there; impressions themselves are never joined
    lists = written_lists(train)
    cells = lists.select("list_id", "query_id", F.posexplode("docs").alias("rank", "doc_id")).join(rows.hint("merge"), ["query_id", "doc_id"])
    values = lists.join(cells.groupBy("list_id").agg(F.collect_list(F.struct(*shown)).alias("shown")).hint("merge"), "list_id")
    return to_pages(train, lists, values, "shown").select(F.col("query_id").alias("query"), F.inline("shown"))


def write_parameters(fitted: Fitted, prefix: str, train: DataFrame | None = None, exact: bool = False, in_order: bool = False) -> list[str]:
    """CSV folders ``{prefix}_{name}.csv``; nothing is written for an empty prefix.

    With ``train`` a row per impression instead of one per pair, which with ``in_order`` follow the pages' arrival (``write_in_order``).
    """
    if not prefix:
        return []
    public = f"{prefix}_{fitted.model.public_name}.csv"
    public_export(fitted, exact).orderBy("rank").coalesce(1).write.mode("overwrite").option("header", True).csv(public)  # at most 100 rows
    paths = [public]
    for kind in fitted.model.kinds:
        table = private_export(fitted, kind, train, exact)
        paths.append(f"{prefix}_{table.columns[2]}.csv")
        if train is not None and in_order:
            write_in_order(fitted, train, paths[-1], kind)
        else:
            table.write.mode("overwrite").option("header", True).csv(paths[-1])
    return paths


def write_in_order(fitted: Fitted, train: DataFrame, path: str, kind: int = ATTRACT) -> str:
    """One line per impression, in the order of pages and ranks, below one header line.

    Pages are dealt into ranges of their number and sorted within them, so the part files joined by name are the file; no task holds
    more than a range.
    """
    name = {ATTRACT: "attractiveness", SATISFY: "satisfaction"}[kind]
    line = lambda x: F.concat_ws(", ", F.col("query_id"), x["docs"], F.format_string(SIX, x["v"]))
    lists = written_lists(train)
    values = filled(values_of_lists(lists, fitted.theta)).withColumn("v", F.col("a" if kind == ATTRACT else "s"))
    values = values.withColumn("lines", F.transform(F.arrays_zip("docs", "v"), line))  # once for each list
    pages = to_pages(train, lists, values, "lines").select("serp_id", "lines")
    head = train.sparkSession.createDataFrame([(None, [f"query, document, {name}"])], "serp_id long, lines array<string>")
    ordered = head.unionByName(pages).repartitionByRange(F.asc_nulls_first("serp_id")).sortWithinPartitions(F.asc_nulls_first("serp_id"))
    ordered.select(F.explode("lines").alias("value")).write.mode("overwrite").text(path)
    return path


def report(serps: DataFrame, fitted: Fitted) -> DataFrame:
    """(metric, value): log-likelihood, perplexity, and perplexity at each rank."""
    cases = written(score_cases(serps, fitted), "scores")
    ranks = perplexity_by_rank(cases).select(F.concat(F.lit("perplexity at rank "), "rank").alias("metric"), F.col("perplexity").alias("value"))
    total = measures(cases, fitted.model.name)
    return total.selectExpr("stack(2, 'log likelihood', log_likelihood, 'perplexity', perplexity) as (metric, value)").unionByName(ranks)
