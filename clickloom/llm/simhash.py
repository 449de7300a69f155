"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A text's fingerprint holds, for each of 64 bits, the majority over the XXH64
hashes of its four-word shingles.  Two fingerprints that differ in at most
four bits differ in at most four of their eight bytes, so they agree
in four byte positions at least: that is the guaranteed minimum number of matches.

* Exact copies collapse first: the index holds distinct fingerprints only.
* The index posts a fingerprint under sets of byte positions with their bytes.
  Posting single bytes would make each list a 256th of the corpus.  The posted
  sets are chosen so that any four positions contain one of them: 20 sets of
  three positions (Turan's system for 8 points), or, beyond ``2**24``
  distinct fingerprints, all 70 sets of four.  The choice changes the cost alone.
* Two fingerprints of a list are a candidate pair.  Their shared positional bytes
  are tallied, pairs under four matches go, and the rest are verified by the number
  of differing bits.
* A list longer than ``long_list`` (a dense family of near copies) isn't paired.
  Two fingerprints differ in at most four bits exactly when both lie within two bits of a
  common word, so each member posts its 2,081 words at two bits or fewer, and each word links
  its members (2,081 at most) to the least of them: the same links, in a number that is linear in the list.
* Joins are sort-merge joins by hint. Spark takes an exploded table for little larger than the one it is made of, and a
  written one for as large as its compressed files, and would broadcast millions of such rows through the driver.

Links are between distinct fingerprints; components are taken over those, and
every document gets the component of its fingerprint.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like
any other; a text of one to three words is one shingle; null ids take no part in naming a component;
repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .components import components

BITS = 64
SEED = 42
DISTANCE = 4


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit majority fingerprint of one text, unsigned."""
    # bytes.lower() and bytes.split() know A-Z and the six ASCII white spaces alone, as the contract asks
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    else:
        joined = b" ".join(w)
        ends = list(accumulate([len(x) + 1 for x in w]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    packed = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):  # a very long text needs no more memory than a block
        ones += np.unpackbits(packed[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _of_batch(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def _fingerprints(text: Column) -> Column:
    return F.pandas_udf(_of_batch, "long")(text.cast("string"))


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the eight byte positions such that any four positions contain one."""
    if size == 4:
        return list(combinations(range(8), 4))
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    sets = {c for p in parts for c in combinations(p, 3)}
    for i, p in enumerate(parts):
        sets |= {tuple(sorted((*two, one))) for two in combinations(p, 2) for one in parts[(i + 1) % 3]}
    return sorted(sets)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(positions: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


def shared_bytes(x: Column) -> Column:
    """The tally of equal positional bytes, from the exclusive or of two fingerprints."""
    terms = [(x.bitwiseAND(F.lit(_mask((p,)))) == 0).cast("int") for p in range(8)]
    return sum(terms[1:], terms[0])


def links(fingerprints: DataFrame, long_list: int = 256) -> DataFrame:
    """(a, b): a link for pairs of distinct ``fp`` values within four bits.

    In short lists each such pair comes up; in long lists enough of them to leave all components whole.
    """
    n = fingerprints.count()
    masks = F.array(*[F.lit(_mask(p)) for p in position_sets(3 if n <= 1 << 24 else 4)])
    postings = fingerprints.select("fp", F.posexplode(masks).alias("set", "mask")).select(
        "fp", "set", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes")
    )
    sizes = postings.groupBy("set", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    listed = staged(postings.join(sizes.hint("merge"), ["set", "bytes"]), "postings")
    short = listed.where(F.col("n") <= long_list)
    left = short.select("set", "bytes", F.col("fp").alias("a"))
    right = short.select("set", "bytes", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    paired = (
        left.join(right.hint("merge"), ["set", "bytes"])
        .where("a < b")
        .where(shared_bytes(x) >= 8 - DISTANCE)
        .where(F.bit_count(x) <= DISTANCE)
        .select("a", "b")
    )
    dense = listed.where(F.col("n") > long_list).select("fp").distinct()
    near_by = [0, *(1 << i for i in range(BITS)), *((1 << i) | (1 << j) for i, j in combinations(range(BITS), 2))]
    words = F.array(*[F.lit(_signed(x)) for x in near_by])
    near = dense.select("fp", F.explode(words).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    starred = near.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("word")).alias("b")).where("a <> b")
    return paired.union(starred)


def _components(prints: DataFrame) -> DataFrame:
    """(fp, family, component_id) for each distinct fingerprint of (fp, doc_id).

    The family is the least fingerprint of the component, component_id its least doc_id.
    """
    least = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = components(links(least.select("fp")))
    named = least.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    named = staged(named.select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(names.hint("merge"), "component").select("fp", F.col("component").alias("family"), "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text)."""
    prints = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprints(F.col("text")).alias("fp")), "prints")
    return prints.join(_components(prints).hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns: the row of the least doc_id.

    Of rows that share that id the one with the least text hash stays, and of
    repeated rows one.  Rows with a null id come last in a component, so one stays
    only where its component has no id.  Components are found from ids and
    hashes alone; the texts are shuffled once, to the surviving keys.
    """
    key = [F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0)).alias("id"), F.col("row.doc_id").isNull().alias("none")]
    key.append(F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("hash"))
    rows = docs.select(F.struct("*").alias("row")).select("row", *key)
    prints = staged(rows.select("id", "none", "hash", _fingerprints(F.col("row.text")).alias("fp")), "prints")
    named = _components(prints.select("fp", F.when(~F.col("none"), F.col("id")).alias("doc_id")))
    # the least key of each fingerprint first, so that a hot fingerprint is one row before the join
    least = prints.groupBy("fp").agg(F.min(F.struct("none", "id", "hash")).alias("key"))
    kept = least.join(named.hint("merge"), "fp").groupBy("family").agg(F.min("key").alias("key")).select("key.*")
    first = Window.partitionBy("id", "none", "hash").orderBy(F.lit(0))
    return (
        rows.join(kept, ["id", "none", "hash"], "left_semi")
        .withColumn("n", F.row_number().over(first))
        .where("n = 1")
        .select("row.*")
    )
