"""Train and test sets: split by arrival, drop what training has not seen, count keys and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.operators.lists import to_pages, written_lists
from clickloom.plans.numbering import numbered
from clickloom.plans.storage import written


def n_train(n: int, test_share: float = 0.2) -> int:
    """Pages that train: n * (1 - share), halves rounded up; 0 of none."""
    return 0 if n == 0 else int(n * (1 - test_share) - 0.5) + 1


def split(serps: DataFrame, test_share: float = 0.2, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Head and tail of the pages in arrival order.

    The place of the cut is found by counting, not by a global sort: pages are ranked within ranges of
    ``serp_id``.  With ``by`` each value of that expression is split by itself; pages without a value test.
    """
    if by is not None:
        keyed = serps.withColumn("__by", F.expr(by))
        last = _nth_ids(keyed, test_share)
        marked = keyed.join(last, "__by", "left").withColumn("__train", F.coalesce(F.col("serp_id") <= F.col("__last"), F.lit(False)))
        return (marked.where("__train").select(*serps.columns), marked.where("not __train").select(*serps.columns))
    last = _nth_id(serps, n_train(serps.count(), test_share))
    if last is None:
        return serps, serps.where(F.lit(False))
    return serps.where(F.col("serp_id") <= last), serps.where(F.col("serp_id") > last)


def _nth_id(serps: DataFrame, n: int):
    """The n-th least serp_id: counts in ever finer equal ranges, a few rows to the driver each time."""
    low, high = serps.agg(F.min("serp_id"), F.max("serp_id")).first()
    if low is None or n < 1:
        return None
    before = 0
    while low < high:
        step = max(1, (high - low + 1024) // 1024)
        part = F.floor((F.col("serp_id") - low) / step)
        counts = dict(serps.where(F.col("serp_id").between(low, high)).groupBy(part.alias("p")).count().collect())
        for p in sorted(counts):
            if before + counts[p] >= n:
                low, high = low + p * step, min(high, low + (p + 1) * step - 1)
                break
            before += counts[p]
        if step == 1:
            break
    return low


def _nth_ids(keyed: DataFrame, test_share: float) -> DataFrame:
    """(__by, __last): for each value the serp_id of its last training page, by counts in ever finer ranges of the ids.

    A round keeps, for each value, the range that holds the page; no value's pages come together in one task.
    """
    cut = (F.count("*") * (1 - test_share) - 0.5).cast("long") + 1
    state = written(
        keyed.groupBy("__by").agg(F.min("serp_id").alias("low"), F.max("serp_id").alias("high"), cut.alias("left")).where("__by is not null and left > 0"), "cuts"
    )
    step = F.greatest(F.lit(1), F.floor((F.col("high") - F.col("low")) / 1024) + 1)
    while state.where("low < high").limit(1).count():
        inside = keyed.select("__by", "serp_id").join(state.withColumn("step", step), "__by").where(F.col("serp_id").between(F.col("low"), F.col("high")))
        part = F.floor((F.col("serp_id") - F.col("low")) / F.col("step")).alias("part")
        counts = inside.groupBy("__by", "low", "high", "left", "step", part).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("__by").orderBy("part"))  # 1,025 parts of a value at most
        chosen = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        low = F.col("low") + F.col("part") * F.col("step")
        state = written(
            chosen.select("__by", low.alias("low"), F.least("high", low + F.col("step") - 1).alias("high"), (F.col("left") - F.col("upto") + F.col("n")).alias("left")), "cuts"
        )
    return state.select("__by", F.col("low").alias("__last"))


def query_doc_pairs(serps: DataFrame) -> DataFrame:
    """Distinct (query_id, doc_id)."""
    return serps.select("query_id", F.explode("docs").alias("doc_id")).distinct()


def dense_ids(serps: DataFrame) -> DataFrame:
    """(query_id, doc_id, id): pairs numbered from 0 in the order in which the pages first show them, by arrival and rank."""
    shown = serps.select("serp_id", "query_id", F.posexplode("docs").alias("rank", "doc_id"))
    first = shown.groupBy("query_id", "doc_id").agg(F.min(F.struct("serp_id", "rank")).alias("first"))
    return numbered(first.select("query_id", "doc_id", "first.serp_id", "first.rank"), ["serp_id", "rank"], "id").select("query_id", "doc_id", "id")


def filter_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test pages that show at least one document which training saw under the same query.

    A page of an unseen query shows none, so it goes as well.  Pairs decide, by a semi-join, about the
    distinct lists of documents, and these about the pages that show them.
    """
    lists = written_lists(test)
    shown = lists.select("list_id", "query_id", F.explode("docs").alias("doc_id"))
    kept = shown.join(query_doc_pairs(train), ["query_id", "doc_id"], "left_semi").select("list_id").distinct()
    return to_pages(test, lists, lists.join(kept, "list_id", "left_semi")).select(*test.columns)


def bucket_statistics(train: DataFrame, test: DataFrame, buckets: int = 8) -> DataFrame:
    """Pages and pairs by bucket of the query: (bucket, n_train, n_test, n_pairs)."""
    bucket = (F.col("query_id") % buckets).alias("bucket")
    sizes = train.select(bucket, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(bucket, F.lit(0).alias("a"), F.lit(1).alias("b")))
    pages = sizes.groupBy("bucket").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"))
    pairs = query_doc_pairs(train).groupBy(bucket).agg(F.count("*").alias("n_pairs"))
    return pages.join(pairs, "bucket", "left").na.fill(0, ["n_pairs"])
