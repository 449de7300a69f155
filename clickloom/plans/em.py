"""Expectation-Maximisation over click statistics.

A round is: join the private parameters to the statistics, form posteriors, sum them by key, add the prior (1, 2).
One aggregate serves private and public parameters.  The new table is written to the shared
folder, which cuts the lineage; the public values (at most 100) are read back as literals.  Where a model carries its cases (PBM, UBM) a round is a map over
the pairs instead, with neither a join nor a shuffle.

A fit may start from the parameters of another one, note its finished rounds in a folder and go on from there after a loss of the driver,
and be added up from fits of parts of the pages.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.clicks import value
from clickloom.operators.models import PRIOR_DEN, PRIOR_NUM, PUBLIC, ClickModel
from clickloom.operators.prepare import query_doc_pairs
from clickloom.plans.storage import fresh, written

KEY = ["kind", "query_id", "doc_id"]
WHICH = {"all": "true", "public": f"kind = {PUBLIC}", "private": f"kind <> {PUBLIC}"}


@dataclass
class Fitted:
    """A trained model: its parameter table (kind, query_id, doc_id, num, den) and public values."""

    model: ClickModel
    theta: DataFrame
    public: list[float]

    def private(self, kind: int = 0) -> DataFrame:
        """(query_id, doc_id, num, den, value) of one private table."""
        rows = self.theta.where(F.col("kind") == kind)
        return rows.select("query_id", "doc_id", "num", "den", value(F.col("num"), F.col("den")).alias("value"))

    def public_table(self) -> DataFrame:
        """(slot, num, den, value); cells that no page met keep the prior."""
        spark = self.theta.sparkSession
        every = spark.range(self.model.public).select(F.col("id").cast("int").alias("slot"))
        rows = self.theta.where(F.col("kind") == PUBLIC).select(F.col("doc_id").alias("slot"), "num", "den")
        filled = every.join(rows, "slot", "left").na.fill({"num": PRIOR_NUM, "den": PRIOR_DEN})
        return filled.withColumn("value", value(F.col("num"), F.col("den")))

    def parameters(self, which: str = "all") -> DataFrame:
        """The parameter table, or its ``public`` or ``private`` part."""
        return self.theta.where(WHICH[which])

    def with_parameters(self, source: DataFrame, which: str = "all") -> Fitted:
        """This model with the parameters ``which`` replaced by those of the table ``source``."""
        rest = self.theta.where(f"not ({WHICH[which]})")
        theta = source.where(WHICH[which]).select(*self.theta.columns).unionByName(rest)
        return replace(self, theta=theta, public=_public_values(self.model, theta))


def initial(model: ClickModel, train: DataFrame, start: Fitted | None = None) -> DataFrame:
    """Prior (1, 2) for every pair of the training pages; with ``start`` its parameters, and the prior for pairs that it lacks."""
    kinds = F.explode(F.array(*map(F.lit, model.kinds))).alias("kind")
    prior = query_doc_pairs(train).select(kinds, "query_id", "doc_id", F.lit(PRIOR_NUM).alias("num"), F.lit(PRIOR_DEN).alias("den"))
    if start is None:
        return prior
    return start.theta.unionByName(prior.join(start.theta, KEY, "left_anti"))


def _summed(posteriors: DataFrame) -> DataFrame:
    return posteriors.groupBy(KEY).agg((F.sum("num") + PRIOR_NUM).alias("num"), (F.sum("den") + PRIOR_DEN).alias("den"))


def m_step(posteriors: DataFrame) -> DataFrame:
    """Sums by key and the prior.  Pairs that carry their cases are sums already; shares of public cells among them wait for ``_shared``."""
    if "cells" not in posteriors.columns:
        return _summed(posteriors)
    prior = lambda x: F.when(F.col("kind") == PUBLIC, 0.0).otherwise(x)
    return posteriors.withColumns({"num": F.col("num") + prior(PRIOR_NUM), "den": F.col("den") + prior(PRIOR_DEN)})


def _public_values(model: ClickModel, theta: DataFrame) -> list[float]:
    public = [PRIOR_NUM / PRIOR_DEN] * model.public
    for r in theta.where(F.col("kind") == PUBLIC).select("doc_id", value(F.col("num"), F.col("den")).alias("v")).collect():
        public[r["doc_id"]] = r["v"]
    return public


def opening(model: ClickModel, train: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """What the first round reads beside parameters: the statistics, or the pairs that carry them."""
    statistics = model.statistics(train)
    return model.carried(statistics, start) if model.carries else statistics


def one_round(model: ClickModel, first: DataFrame, last: DataFrame, public: list[float]) -> DataFrame:
    """The table after that of the ``last`` round; ``first`` is the opening."""
    return m_step(model.advance(last, public) if model.carries else model.posteriors(first, last, public))


def _shared(model: ClickModel, table: DataFrame) -> DataFrame:
    """The public parameters of a round's table."""
    rows = table.where(F.col("kind") == PUBLIC).select(*KEY, "num", "den")
    return _summed(rows) if model.carries else rows


class Progress:
    """The finished rounds of a fit: rows (round, fit, path) below ``folder``, each written after the tables that it names.

    Round 0 names the statistics.  ``fit`` tells model, options, training pages and start; another one is refused.
    """

    SCHEMA = "round int, fit string, path string"

    def __init__(self, spark: SparkSession, folder: str, fit: str):
        self.spark, self.folder, self.fit = spark, folder, fit
        try:
            rows = spark.read.schema(self.SCHEMA).parquet(f"{folder}/rounds").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if {r["fit"] for r in rows} - {fit}:
            raise ValueError(f"{folder} holds rounds of another fit")
        self.paths = {r["round"]: r["path"] for r in rows}

    def table(self, number: int, compute) -> DataFrame:
        """The table of a round: read if it is finished, else computed, written and noted."""
        if number in self.paths:
            return self.spark.read.parquet(self.paths[number])
        path = fresh(self.spark, f"round-{number}", self.folder)
        found = written(compute(), "", path)
        self.spark.createDataFrame([(number, self.fit, path)], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/rounds")
        self.paths[number] = path
        return found

    def last(self, most: int) -> int:
        """The last round, of ``most`` at most, up to which all are finished."""
        return next(k for k in range(most + 1) if k == most or k + 1 not in self.paths)


def _identity(model: ClickModel, train: DataFrame, start: Fitted | None) -> str:
    """Model, options, and order-free sums over the training pages and the start."""
    total = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    parts = [model.name, model.carries, sorted(vars(model).items()), *total(train.select("serp_id", "query_id", "docs", "clicks"))]
    return " ".join(map(str, [*parts, *(total(start.theta.select(*KEY, "num", "den")) if start else ())]))


def fit(model: ClickModel, train: DataFrame, iterations: int = 50, start: Fitted | None = None, folder: str | None = None) -> Fitted:
    """``iterations`` rounds; there is no test for convergence.

    ``start``: the rounds go on from these parameters; pairs of it that ``train`` lacks keep them.  ``folder``, in shared
    storage: finished rounds are kept there, and a fit of the same pages that finds some goes on after the last.
    """
    before = initial(model, train, start)
    progress = Progress(train.sparkSession, folder, _identity(model, train, start)) if folder else None
    keep = progress.table if progress else lambda number, compute: written(compute(), f"round-{number}")
    first = keep(0, lambda: opening(model, train, start.theta if start else None))
    table, public = first if model.carries else before, start.public if start else [PRIOR_NUM / PRIOR_DEN] * model.public
    done = progress.last(iterations) if progress else 0
    if done:
        table = keep(done, None)
        public = _public_values(model, _shared(model, table))
    for k in range(done + 1, iterations + 1):
        table = keep(k, lambda table=table, public=public: one_round(model, first, table, public))
        public = _public_values(model, _shared(model, table))
    if not iterations:
        return Fitted(model, before, public)
    theta = table
    if model.carries:
        shared = written(_shared(model, table), "public")  # a table whose size Spark knows, so that joins broadcast the lesser side
        theta = table.where(F.col("kind") != PUBLIC).select(*KEY, "num", "den").unionByName(shared)
        if start is None:  # every pair of the pages has posteriors
            return Fitted(model, theta, public)
    # keys that no posterior met (satisfaction of documents never clicked, pairs of the start alone) keep what they had
    missing = before.join(theta, KEY, "left_anti").where(F.col("kind") != PUBLIC)
    return Fitted(model, theta.unionByName(missing), public)


def added(tables: list[DataFrame]) -> DataFrame:
    """Parameter tables of fits of disjoint parts of the pages as one: sums, less the prior of each table beyond the first."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    more = F.count("*") - 1
    return rows.groupBy(KEY).agg((F.sum("num") - more * PRIOR_NUM).alias("num"), (F.sum("den") - more * PRIOR_DEN).alias("den"))


def merge(replicas: list[Fitted]) -> Fitted:
    """One model of replicas trained apart, one round each since they last agreed, on disjoint parts of the pages."""
    theta = written(added([r.theta for r in replicas]), "merged")
    return Fitted(replicas[0].model, theta, _public_values(replicas[0].model, theta))


def fit_replicas(model: ClickModel, parts: list[DataFrame], iterations: int = 50) -> Fitted:
    """Rounds on disjoint parts of the pages, added up after each round: equals ``fit`` of all pages."""
    statistics = [written(model.statistics(part), "statistics") for part in parts]
    before = added([initial(model, part) for part in parts])
    theta, public = before, [PRIOR_NUM / PRIOR_DEN] * model.public
    for _ in range(iterations):
        theta = written(added([m_step(model.posteriors(s, theta, public)) for s in statistics]), "theta")
        public = _public_values(model, theta)
    return Fitted(model, theta.unionByName(before.join(theta, KEY, "left_anti")), public)
