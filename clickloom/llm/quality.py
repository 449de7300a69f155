"""Quality rules: surface counts and a hashed n-gram likelihood ratio, in native functions only.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  Unigrams and bigrams are hashed
into ``buckets`` cells.  Two smoothed multinomials over the cells are learned:
one from trusted documents (``quality = 1``), one from the whole raw corpus.
The score of a document is the mean log ratio of its n-grams, and a document
is kept when it passes the base rules and its score is at least ``threshold``;
no draw is involved.

The raw counts cover all documents.  The trusted side is a sample of at most
``max_trusted`` labelled ids (the smallest hashes of the id), which bounds the
broadcast that marks trusted documents to ``16 * max_trusted`` bytes.

Defined cases: a null or empty text has no words, zero counts, score 0 and
fails the base rules; repeated rows count each time and give a row each; an
empty table gives an empty result; without trusted documents the score is 0
for all.  Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, words

NOT_SYMBOLS = "[^#*$%&|<>]+"


def _window_keys(w: Column, bits: Column) -> Column:
    """One long for each three-word window: bits of its 64-bit hash above, its place below.

    The place takes as many bits as the text needs.  Windows count as equal when
    the hash bits above are (under 1e-6 for a false match in a text of 20,000 words).
    """
    return F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
    )


def _repeat_words(keys: Column, bits: Column) -> Column:
    """Words that lie in a window found twice or more, from the sorted window keys: equal windows are neighbours."""

    def same(x: Column, i: Column) -> Column:
        return F.call_function("shiftright", x.bitwiseXOR(F.get(keys, i)), bits) == 0

    def covered(_: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        found = F.filter(keys, lambda x, i: F.coalesce(same(x, i + 1), F.lit(False)) | F.coalesce(same(x, i - 1), F.lit(False)))
        places = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask)))
        steps = lambda p: F.transform(
            F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))),
            lambda x, i: F.least(F.lit(3).cast("long"), F.get(p, i + 1) - x),
        )
        return let(places, lambda p: F.aggregate(steps(p), F.lit(3).cast("long"), lambda a, x: a + x))

    # most texts repeat no window: one look at each next neighbour settles them
    none = F.size(F.filter(keys, lambda x, i: same(x, i + 1))) == 0
    return F.when(none, F.lit(0).cast("long")).otherwise(let(F.lit(0), covered))


def _cell(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _cells(w: Column, buckets: int) -> Column:
    """Cells of the unigrams and bigrams of an array of words."""
    pairs = F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
    return F.concat(
        F.transform(w, lambda x: _cell(F.xxhash64(x), buckets)),
        F.transform(pairs, lambda x, i: _cell(F.xxhash64(x, F.get(w, i + 1)), buckets)),
    )


def _sum_of_ratios(w: Column, ratios: Column, buckets: int) -> Column:
    """Sum of the log ratios over the same unigrams and bigrams."""
    of = lambda h: F.get(ratios, _cell(h, buckets))
    each = F.transform(
        w,
        lambda x, i: F.when(i + 1 < F.size(w), of(F.xxhash64(x)) + of(F.xxhash64(x, F.get(w, i + 1)))).otherwise(of(F.xxhash64(x))),
    )
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def trusted_ids(labels: DataFrame, max_trusted: int = 50_000) -> DataFrame:
    """At most ``max_trusted`` distinct ids labelled quality 1, by the smallest hash of the id."""
    return (
        labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("trusted_id"))
        .distinct()
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(max_trusted)
    )


def cell_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 14, smoothing: float = 1.0) -> DataFrame:
    """(cell, ratio) for each of the ``buckets`` cells: log p(cell | trusted) - log p(cell | corpus)."""
    marked = (
        docs.select(F.col("doc_id").cast("long").alias("id"), "text")
        .join(F.broadcast(trusted), F.col("id") == F.col("trusted_id"), "left")
        .select(F.col("trusted_id").isNotNull().cast("long").alias("t"), let(words(F.col("text")), lambda w: _cells(w, buckets)).alias("cells"))
    )
    counts = marked.select("t", F.explode("cells").alias("cell")).groupBy("cell").agg(F.sum("t").alias("t"), F.count("*").alias("r"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("cell"))
    filled = staged(every.join(counts, "cell", "left").na.fill(0), "cells")
    nt, nr = filled.agg(F.sum("t"), F.sum("r")).first()
    if not nt:
        return filled.select("cell", F.lit(0.0).alias("ratio"))
    share = lambda c, n: F.log((F.col(c) + smoothing) / (n + smoothing * buckets))
    return filled.select("cell", (share("t", nt) - share("r", nr)).alias("ratio"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = -0.045,
    buckets: int = 1 << 14,
    smoothing: float = 1.0,
    max_trusted: int = 50_000,
) -> DataFrame:
    """Counts, likelihood ratio and verdict of each document of ``docs`` (doc_id, text)."""
    ratios = cell_ratios(docs, trusted_ids(labels, max_trusted), buckets, smoothing)
    # `buckets` numbers reach the plan as one literal array
    by_cell = [x["ratio"] for x in ratios.orderBy("cell").collect()]
    model = F.split(F.lit(",".join(f"{x:.9g}" for x in by_cell)), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, n, bits, keys = F.col("w"), F.col("n_words"), F.col("bits"), F.col("keys")
    # columns that are used more than once stand in a projection of their own and are computed once
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        words(F.col("text")).alias("w"),
        F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    keyed = counted.select(
        "*",
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.bin(F.size(w).cast("long"))).alias("bits")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "bits",
        F.sort_array(_window_keys(w, bits)).alias("keys"),
        _sum_of_ratios(w, model, buckets).alias("sum"),
    )
    scored = keyed.select("*", _repeat_words(keys, bits).alias("n_repeat_words"))
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    score = F.when(n == 0, F.lit(0.0)).otherwise(F.col("sum") / F.greatest(2 * n - 1, F.lit(1)))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.round(score, 9) >= threshold)).alias("kept"),
        score.alias("score"),
    )
