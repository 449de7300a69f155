"""Small helpers shared by the text operators.

Every operator takes DataFrames and returns DataFrames.  Intermediate tables are
written as Parquet below the checkpoint folder of the session, which on a
cluster is a folder that driver and executors share, so a lost executor costs
the tasks it ran and no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.plans.storage import shared_dir, written as staged  # noqa: F401

#: The white space of the word rules: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 1, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone, as the word rules ask."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The white-space separated words of ``text`` as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Catalyst may copy an expression into each place that names it; a lambda's
    argument is computed once.
    """
    return F.transform(F.array(value), body)[0]
