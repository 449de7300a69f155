"""Search click logs: the whitespace-delimited text format, and the same log derived from order tables.

A result page (``serp``) is (serp_id, query_id, docs, clicks): ten documents and ten
click flags in rank order, numbered by arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.config import RANKS
from clickloom.plans.storage import written

QUERY_TOKENS, CLICK_TOKENS = 15, 4


def numbered_lines(spark: SparkSession, path: str, block_lines: int = 1 << 17) -> DataFrame:
    """(block, line, value): lines of text files in reading order.

    ``block`` is the file, the place in it where a task began to read, and the number of ``block_lines`` lines that the task read before;
    ``line`` counts on from there.  So a file that only one task can read (gzip) makes many blocks, and as many files as
    tasks can share later.  Numbers come from one read that is written out, so all later steps see the same ones.
    """
    line = F.monotonically_increasing_id()  # the low 33 bits count the lines of a task
    part = F.floor(line.bitwiseAND(F.lit((1 << 33) - 1)) / block_lines).cast("int")
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), part.alias("part"))
    return written(spark.read.text(path).select(block.alias("block"), line.alias("line"), "value"), "lines", maxRecordsPerFile=block_lines)


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions and rejected lines of (block, line, value)."""
    rows = typed(lines)
    return rows.where("reason is null").drop("reason", "value"), rows.where("reason is not null").select("line", "value", "reason")


def typed(lines: DataFrame) -> DataFrame:
    """(block, line, session_id, query_id, docs, doc_id, value, reason): each line as an action, or the reason why it is none.

    The number of tokens alone tells a query (15) from a click (4); the type letter is not
    read.  Numbers must be whole 32-bit numbers; lines with others are rejected.
    """
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    number = lambda i: F.get("tokens", F.lit(i)).try_cast("int")
    rows = lines.select("block", "line", "value", tokens.alias("tokens"))
    docs = F.transform(F.slice("tokens", 6, RANKS), lambda x: x.try_cast("int"))
    read = rows.select(
        "block",
        "line",
        "value",
        F.size("tokens").alias("n"),
        number(0).alias("session_id"),
        F.when(F.size("tokens") == QUERY_TOKENS, number(3)).alias("query_id"),
        F.when(F.size("tokens") == QUERY_TOKENS, docs).alias("docs"),
        F.when(F.size("tokens") == CLICK_TOKENS, number(3)).alias("doc_id"),
    )
    good_query = (F.col("n") == QUERY_TOKENS) & F.col("query_id").isNotNull() & ~F.exists("docs", lambda x: x.isNull())
    good_click = (F.col("n") == CLICK_TOKENS) & F.col("doc_id").isNotNull()
    good = F.col("session_id").isNotNull() & (good_query | good_click)
    reason = F.when(F.col("session_id").isNull(), "first token is no number").when(~F.col("n").isin(QUERY_TOKENS, CLICK_TOKENS), "number of tokens").otherwise("a token is no number")
    ok = F.coalesce(good, F.lit(False))
    kept = [F.when(ok, F.col(c)).alias(c) for c in ("session_id", "query_id", "docs", "doc_id")]
    return read.select("block", "line", *kept, F.when(~ok, F.col("value")).alias("value"), F.when(~ok, reason).alias("reason"))


def to_serps(actions: DataFrame, max_sessions: int = -1) -> DataFrame:
    """Result pages with their clicks.

    A click belongs to the query line last read, whatever its session id, and marks the first rank that
    shows its document.  A page is emitted when the next query line comes, so the
    last one of the log is not, unless ``max_sessions`` pages were emitted before.  Clicks
    before any query have no page and go.

    Pages are numbered without a global sort: counts by block (one row per task that read the
    log) give each block its first number.
    """
    is_query = F.col("query_id").isNotNull().cast("long")
    counts = actions.groupBy("block").agg(F.sum(is_query).alias("n"), F.min("line").alias("first"))  # a block's first line is its number
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("block", "first", before.alias("before"))
    within = Window.partitionBy("first").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = actions.join(F.broadcast(offsets), "block").select("first", "line", "query_id", "docs", "doc_id", "before")
    numbered = numbered.withColumn("serp_id", F.col("before") + F.sum(is_query).over(within))
    emitted = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) - 1).alias("n")).first()["n"]
    limit = emitted if max_sessions == -1 else min(emitted, max_sessions)
    numbered = numbered.where((F.col("serp_id") >= 1) & (F.col("serp_id") <= limit))
    page = F.max(F.when(F.col("query_id").isNotNull(), F.struct("query_id", "docs"))).alias("page")  # one of each number
    pages = numbered.groupBy("serp_id").agg(page, F.collect_set("doc_id").alias("clicked")).select("serp_id", "page.*", "clicked")
    flags = F.transform(
        "docs",
        lambda d, i: (F.array_contains("clicked", d) & (F.array_position("docs", d) == i + 1)).cast("int"),
    )
    return pages.select("serp_id", "query_id", "docs", flags.alias("clicks"))


def read_click_log(spark: SparkSession, path: str, max_sessions: int = -1, counts: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(serps, rejected) of a text log.

    ``counts`` is told ``n_lines``, ``n_queries``, ``n_clicks`` and ``n_rejected`` as the lines are parsed, without a further pass.
    """
    rows = typed(numbered_lines(spark, path))
    if counts is not None:
        n = [F.count(F.lit(1)).alias("n_lines"), F.count("query_id").alias("n_queries"), F.count("doc_id").alias("n_clicks"), F.count("reason").alias("n_rejected")]
        rows = rows.observe(counts, *n)
    rows = written(rows, "actions")
    return to_serps(rows.where("reason is null").drop("value", "reason"), max_sessions), rows.where("reason is not null").select("line", "value", "reason")


def impressions(serps: DataFrame) -> DataFrame:
    """(serp_id, query_id, rank, doc_id, click), ranks from 0."""
    return serps.select("serp_id", "query_id", F.posexplode("docs").alias("rank", "doc_id"), "clicks").select(
        "serp_id", "query_id", "rank", "doc_id", F.get("clicks", F.col("rank")).alias("click")
    )


def serps_from_orders(spark: SparkSession, sf_dir: str, queries: int = 40, docs: int = 50, sparse: bool = False) -> DataFrame:
    """A click log derived from ``orders`` and ``lineitem`` by whole-number rules; arrival order is the order key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if sparse:
        queries, docs = 1500, 5000
    clicked = (
        items.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("serp_id")).agg(F.collect_set(F.col("l_linenumber") - 1).alias("clicked"))
    )
    turn = F.col("serp_id") % 16 * 9 if sparse else F.col("serp_id") % 4
    ranks = F.sequence(F.lit(0), F.lit(RANKS - 1))
    shown = F.transform(ranks, lambda r: ((F.col("query_id") * 7 + r * 3 + turn) % docs).cast("int"))
    pages = orders.select(F.col("o_orderkey").alias("serp_id"), (F.col("o_custkey") % queries).cast("int").alias("query_id"))
    flags = F.transform(ranks, lambda r: F.coalesce(F.array_contains("clicked", r), F.lit(False)).cast("int"))
    return pages.select("serp_id", "query_id", shown.alias("docs")).join(clicked, "serp_id", "left").select("serp_id", "query_id", "docs", flags.alias("clicks"))


def as_lines(serps: DataFrame) -> DataFrame:
    """(value): the text log of result pages, in arrival order: a query line, then its clicks by rank."""
    page = F.concat_ws(" ", "serp_id", F.lit(0), F.lit("Q"), "query_id", F.lit(0), F.array_join(F.transform("docs", lambda d: d.cast("string")), " "))
    hits = F.filter(F.transform("docs", lambda d, i: F.when(F.get("clicks", i) == 1, d)), lambda d: d.isNotNull())
    clicks = F.transform(hits, lambda d: F.concat_ws(" ", F.col("serp_id"), F.lit(1), F.lit("C"), d))
    return serps.orderBy("serp_id").select(F.explode(F.concat(F.array(page), clicks)).alias("value"))  # pages are sorted, not their lines


def write_click_log(serps: DataFrame, path: str, compression: str = "none") -> str:
    as_lines(serps).write.option("compression", compression).text(path)
    return path
