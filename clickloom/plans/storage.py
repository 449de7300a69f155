"""Tables that cut the lineage of iterations, below the checkpoint folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which driver and executors share.

    Where none is set a temporary folder serves local sessions; on a cluster that would be a folder of each machine, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def fresh(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path that nothing was written to, below the shared folder or ``folder``."""
    return f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (or to ``path``) and read it back: cuts lineage and computes it once."""
    path = path or fresh(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
