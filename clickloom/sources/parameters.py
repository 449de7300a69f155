"""Trained parameters read back from their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.models import ATTRACT, PRIOR_DEN, PUBLIC, SATISFY, THETA, make_model
from clickloom.plans.em import Fitted
from clickloom.plans.storage import written

PRIVATE_NAMES = {ATTRACT: "attractiveness", SATISFY: "satisfaction"}


def read_parameters(spark: SparkSession, prefix: str, kind: str | int, **options) -> Fitted:
    """The model whose exports begin with ``prefix``.

    Exact exports give numerators and denominators back; others only values of six decimals, which are held as parts of the prior's
    weight: enough to score and to go on training, but not to be merged.  A pair that several impressions list counts once.
    """
    model = make_model(kind, **options)
    fitted = Fitted(model, spark.createDataFrame([], THETA), [0.5] * model.public)
    tables = [_table(spark, f"{prefix}_{model.public_name}.csv", PUBLIC, model.public_name)]
    tables += [_table(spark, f"{prefix}_{PRIVATE_NAMES[k]}.csv", k, PRIVATE_NAMES[k]) for k in model.kinds]
    theta = tables[0]
    for table in tables[1:]:
        theta = theta.unionByName(table)
    return fitted.with_parameters(written(theta, "theta"))


def _table(spark: SparkSession, path: str, kind: int, name: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    exact = {"num", "den"} <= set(rows.columns)
    num = F.col("num") if exact else F.col(name).cast("double") * PRIOR_DEN
    query = F.lit(None) if kind == PUBLIC else F.col("query")
    doc = F.col("rank") if kind == PUBLIC else F.col("document")
    return rows.select(
        F.lit(kind).alias("kind"), query.cast("int").alias("query_id"), doc.cast("int").alias("doc_id"), num.cast("double").alias("num"),
        (F.col("den") if exact else F.lit(PRIOR_DEN)).cast("double").alias("den"),
    ).distinct()
