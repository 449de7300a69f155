"""The document lists that pages show, as a dictionary.

A list (query, ten documents) is shown by many pages and by at most 2**10 different click patterns.  So pages are counted once into rows
(list_id, query_id, rank, doc_id) with the list's cases (click mask, number of pages) at rank 0: a list that a third of
all pages show is ten rows like any other.  Parameters reach it by one join on (query, document) and one group by list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import RANKS
from clickloom.functions.clicks import value
from clickloom.plans.storage import written

ATTRACT, SATISFY, PUBLIC = 0, 1, 2
#: A list that more than one in so many pages show is split; fewer than so many lists are.
HOT = 1000
#: So many lists of ten documents, or fewer, are broadcast with what belongs to them: some 10 MB at most.
FEW = 10_000
#: Cases that NumPy works on at once.
CASES_AT_ONCE = 1 << 15


def click_mask(clicks: Column) -> Column:
    """Ten flags as bits, rank 0 the lowest."""
    return sum((F.when(F.get(clicks, F.lit(r)) == 1, 1 << r).otherwise(0) for r in range(RANKS)), F.lit(0))


def page_lists(pages: DataFrame) -> DataFrame:
    """(list_id, query_id, rank, doc_id, cases): the dictionary of ``pages`` with the numbers of their click patterns.

    Ids are given anew each time this is computed; write the table before its rows are joined with each other.
    """
    cases = pages.groupBy("query_id", "docs", click_mask(F.col("clicks")).alias("mask")).agg(F.count("*").alias("n"))
    lists = cases.groupBy("query_id", "docs").agg(F.collect_list(F.struct("mask", "n")).alias("cases"))  # 2**10 patterns at most
    lists = lists.withColumn("list_id", F.monotonically_increasing_id())  # before ranks are told apart
    rows = lists.select("list_id", "query_id", F.posexplode("docs").alias("rank", "doc_id"), "cases")
    return rows.withColumn("cases", F.when(F.col("rank") == 0, F.col("cases")))


def list_values(lists: DataFrame, theta: DataFrame) -> DataFrame:
    """(query_id, cells, cases) of each list: its (rank, kind, document, value), and 0.5 of kind -1 for pairs without a value."""
    private = theta.where(F.col("kind") != PUBLIC).select("query_id", "doc_id", "kind", value(F.col("num"), F.col("den")).alias("value"))
    known = lists.join(private, ["query_id", "doc_id"], "left").withColumn("kind", F.coalesce("kind", F.lit(-1)))
    cell = F.struct("rank", "kind", "doc_id", F.coalesce("value", F.lit(0.5)).alias("value"))
    first = F.when((F.col("rank") == 0) & (F.col("kind") <= ATTRACT), F.col("cases"))
    return known.groupBy("list_id", "query_id").agg(F.collect_list(cell).alias("cells"), F.flatten(F.collect_list(first)).alias("cases")).drop("list_id")


class ListBlock:
    """A batch of ``list_values`` as arrays: documents, attractiveness and satisfaction [lists, 10], and the cases of all lists in turn."""

    def __init__(self, batch: pa.RecordBatch):
        self.query, n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.num_rows
        cells, cases = batch.column(1), batch.column(2)
        row = np.repeat(np.arange(n), cells.value_lengths().to_numpy())
        rank, kind, doc, val = (x.to_numpy(zero_copy_only=False) for x in cells.flatten().flatten())
        self.docs, self.a, self.s = np.zeros((n, RANKS), np.int64), np.full((n, RANKS), 0.5), np.full((n, RANKS), 0.5)
        self.docs[row, rank] = doc
        for own, table in ((ATTRACT, self.a), (SATISFY, self.s)):
            table[row[kind == own], rank[kind == own]] = val[kind == own]
        self.mask, self.n = (x.to_numpy(zero_copy_only=False) for x in cases.flatten().flatten())
        self.ends = np.cumsum(cases.value_lengths().to_numpy())

    def chunks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(lists, list of each case, first case of each list, clicks [cases, 10], numbers of pages) of neighbouring lists."""
        low = 0
        while low < len(self.ends):
            before = int(self.ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(self.ends, before + CASES_AT_ONCE, "right")))
            sizes = np.diff(self.ends[low:high], prepend=before)
            cases = slice(before, int(self.ends[high - 1]))
            clicks = (self.mask[cases, None] >> np.arange(RANKS)) & 1
            yield slice(low, high), np.repeat(np.arange(low, high), sizes), np.cumsum(sizes) - sizes, clicks, self.n[cases].astype(float)
            low = high


def written_lists(pages: DataFrame) -> DataFrame:
    """(query_id, docs, n, list_id): the distinct lists of ``pages`` and on how many of them each comes."""
    counted = pages.groupBy("query_id", "docs").agg(F.count("*").alias("n"))
    return written(counted.withColumn("list_id", F.monotonically_increasing_id()), "lists")


def values_of_lists(lists: DataFrame, theta: DataFrame) -> DataFrame:
    """``written_lists`` with the arrays ``a`` and ``s`` of its documents' values; null for unseen pairs, or in place of an array without any."""
    cells = lists.select("list_id", "query_id", F.posexplode("docs").alias("rank", "doc_id"))
    private = theta.where(F.col("kind") != PUBLIC).select("query_id", "doc_id", "kind", value(F.col("num"), F.col("den")).alias("v"))
    known = cells.join(private.hint("merge"), ["query_id", "doc_id"])  # cells are more than their file tells, so none is broadcast
    of = lambda kind, name: F.array(*[F.max(F.when((F.col("rank") == r) & (F.col("kind") == kind), F.col("v"))) for r in range(RANKS)]).alias(name)
    return lists.join(known.groupBy("list_id").agg(of(ATTRACT, "a"), of(SATISFY, "s")), "list_id", "left")


def filled(values: DataFrame) -> DataFrame:
    """``values_of_lists`` with 0.5 for unseen pairs."""
    of = lambda name: F.coalesce(F.transform(name, lambda x: F.coalesce(x, F.lit(0.5))), F.array_repeat(F.lit(0.5), RANKS))
    return values.withColumns({name: of(name) for name in ("a", "s")})


def to_pages(pages: DataFrame, lists: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """``pages`` with the ``columns`` that ``values`` gives to each of their ``lists``.

    Up to ``FEW`` lists are broadcast, unless broadcasts are switched off, so that no page is shuffled.  Of more, a list on more than one in ``HOT`` pages is dealt over several
    tasks: such lists, fewer than ``HOT``, are broadcast to salt their pages.
    """
    size = lists.agg(F.sum("n").alias("pages"), F.count("*").alias("lists")).first()
    if size["lists"] <= FEW and pages.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1":
        return pages.join(F.broadcast(values.select("query_id", "docs", *columns)), ["query_id", "docs"])
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") * HOT / size["pages"])).cast("int")
    values = values.select("query_id", "docs", *columns, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hot = lists.where(F.col("n") * HOT > size["pages"]).select("query_id", "docs", salts.alias("salts"))
    salt = F.pmod(F.xxhash64("serp_id"), F.coalesce("salts", F.lit(1))).cast("int")
    keyed = pages.join(F.broadcast(hot), ["query_id", "docs"], "left").withColumn("salt", salt).drop("salts")
    return keyed.join(values.hint("merge"), ["query_id", "docs", "salt"]).drop("salt")


def with_values(pages: DataFrame, theta: DataFrame) -> DataFrame:
    """``pages`` (serp_id, query_id, docs, ...) with the arrays ``a`` and ``s`` of its documents' values; 0.5 for unseen pairs.

    Values are joined to the distinct lists and these to the pages.
    """
    lists = written_lists(pages)
    return to_pages(pages, lists, filled(values_of_lists(lists, theta)), "a", "s")
