"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of their input; every stage works on all rows its predecessor kept.

* toxicity: rows scored toxic go.
* near_dedup: of each group of near-duplicates one row stays.
* decontamination: rows that hold a benchmark item go.
* secret_scan: live-looking secrets are masked in the text; no row goes.
* packing: one row per piece of a document in its training sequence.

Defined cases: a null or empty text passes all stages but near_dedup like any other (there all such texts are one group), is packed as its end id
alone, and is never masked; a null id takes part everywhere and stays in near_dedup only where its group has no id; of repeated rows one stays;
without labels nothing is toxic, without a benchmark nothing is contaminated; extra columns stay until packing; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm.common import staged, table
from clickloom.llm.decontaminate import drop_contaminated
from clickloom.llm.packing import pack_documents
from clickloom.llm.secret_scan import mask_secrets
from clickloom.llm.simhash import drop_near_duplicates
from clickloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Boosted trees, latent retrieval and column generation have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
