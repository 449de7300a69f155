"""Scoring of a stream of result pages with a model that is trained already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.score import score
from clickloom.plans.em import Fitted


def score_stream(serps: DataFrame, fitted: Fitted, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Scores each micro-batch of (serp_id, query_id, docs, clicks) and appends (serp_id, log_likelihood, batch) to the table ``name``.

    The parameters are static, so a batch is scored as a table is; rewritten batches carry
    their number, by which a reader can tell a repeated batch.
    """
    total = F.aggregate("conditional", F.lit(0.0), lambda acc, p: acc + F.ln(p))

    def write(batch: DataFrame, number: int) -> None:
        scored = score(batch, fitted).select("serp_id", (total / F.size("conditional")).alias("log_likelihood"), F.lit(number).alias("batch"))
        scored.write.mode("append").saveAsTable(name)

    writer = serps.writeStream.foreachBatch(write).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
