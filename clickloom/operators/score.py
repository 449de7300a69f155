"""Scores of pages under a trained model, and the measures over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.config import RANKS
from clickloom.operators.lists import ListBlock, list_values, page_lists, with_values
from clickloom.operators.models import block, ranks
from clickloom.plans.em import Fitted
from clickloom.plans.storage import written


def score(serps: DataFrame, fitted: Fitted) -> DataFrame:
    """(serp_id, conditional, full): for each rank the probability of its flag given the flags above, and given none."""
    model, g = fitted.model, np.array(fitted.public)
    pages = with_values(serps, fitted.theta).select("serp_id", "clicks", "a", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, a, s = (block(batch.column(i)) for i in (1, 2, 3))
            parts = [ranks(model.conditional(a, s, c, g)), ranks(model.full(a, s, c, g))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names=["serp_id", "conditional", "full"])

    return pages.mapInArrow(run, "serp_id long, conditional array<double>, full array<double>")


def score_cases(serps: DataFrame, fitted: Fitted) -> DataFrame:
    """(conditional, full, n): the distinct pages (list and clicks) and how often each comes, from the dictionary of their lists.

    Measures need no more than that, and no row of a page is shuffled twice for it.
    """
    model, g = fitted.model, np.array(fitted.public)
    lists = written(page_lists(serps), "lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = ListBlock(batch)
            for _, row, _, clicks, n in own.chunks():
                parts = [ranks(f(own.a[row], own.s[row], clicks, g)) for f in (model.conditional, model.full)]
                yield pa.RecordBatch.from_arrays([*parts, pa.array(n.astype(np.int64))], names=["conditional", "full", "n"])

    return list_values(lists, fitted.theta).mapInArrow(run, "conditional array<double>, full array<double>, n long")


def predict(serps: DataFrame, fitted: Fitted) -> DataFrame:
    """(serp_id, rank, p): PBM and UBM the chance of a click, CCM and DBN the chance of the flag shown."""
    scored = score(serps, fitted).join(serps.select("serp_id", "clicks"), "serp_id")
    rows = scored.select("serp_id", F.posexplode("conditional").alias("rank", "q"), "clicks")
    if fitted.model.name in ("ccm", "dbn"):
        return rows.select("serp_id", "rank", F.col("q").alias("p"))
    return rows.select("serp_id", "rank", F.when(F.get("clicks", F.col("rank")) == 1, F.col("q")).otherwise(1 - F.col("q")).alias("p"))


def _times(scored: DataFrame):
    return F.col("n") if "n" in scored.columns else F.lit(1).cast("long")


def log_likelihood(scored: DataFrame) -> DataFrame:
    """One row: mean over pages of the mean log conditional probability; minus infinity where a probability is 0.

    ``scored`` holds pages, or cases with their numbers ``n``.
    """
    total = F.aggregate("conditional", F.lit(0.0), lambda acc, p: acc + F.ln(p))  # null where ln(0) is
    pages = F.sum(_times(scored))
    mean = F.when(F.count(total) == F.count("*"), F.sum(total * _times(scored)) / (RANKS * pages)).when(F.count("*") > 0, F.lit(float("-inf")))
    return scored.agg(mean.alias("log_likelihood"), F.coalesce(pages, F.lit(0)).alias("n_serps"))


def perplexity_by_rank(scored: DataFrame) -> DataFrame:
    """(rank, perplexity): 2 to minus the mean log2 full probability; infinity where a probability is 0."""
    rows = scored.select(F.posexplode("full").alias("rank", "p"), _times(scored).alias("n"))
    exponent = -F.sum(F.log2("p") * F.col("n")) / F.sum("n")
    mean = F.when(F.count(F.log2("p")) == F.count("*"), F.pow(F.lit(2.0), exponent)).otherwise(F.lit(float("inf")))
    return rows.groupBy("rank").agg(mean.alias("perplexity"))


def perplexity(scored: DataFrame) -> DataFrame:
    """One row: mean of the perplexities of the ranks."""
    return perplexity_by_rank(scored).agg(F.avg("perplexity").alias("perplexity"))


def evaluate(serps: DataFrame, fitted: Fitted) -> DataFrame:
    """(model, log_likelihood, perplexity, n_serps); distinct pages are scored once and written."""
    return measures(written(score_cases(serps, fitted), "scores"), fitted.model.name)


def measures(scored: DataFrame, name: str) -> DataFrame:
    """``evaluate`` of pages or cases that are scored already."""
    mean = perplexity(scored).first()["perplexity"]
    return log_likelihood(scored).select(F.lit(name).alias("model"), "log_likelihood", F.lit(mean).cast("double").alias("perplexity"), "n_serps")
