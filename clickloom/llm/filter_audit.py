"""Audit of five document filters in every order, by contractions of contingency tensors.

1. One pass over the texts tells for each row which of the filters A to D it fails and the digest of its text; words, capitals and
   symbols are counted on the bytes.
2. Rows are counted by (id, digest, part), get their label, and are counted by (digest, part, label); the count of those with the
   least id is kept apart.  The least id of a digest over all parts then tells how many rows fail E, so a text that a third of
   the rows share never comes together.
3. What is left is a count for each part, pattern of failed filters and label: per part three tensors 2x2x2x2x2 (all rows, good
   rows, toxic rows).  A step of an order is a contraction that takes "pass" on the axes of earlier filters, "fail" on its own and
   "all" on the others; all 600 steps are one ``einsum``.

Filters fail: A under 200 words, B fewer distinct words than half the words, C more than 3 capitals A-Z in 100 code points, D any of
``#$%&*|``, E a text that a smaller id has anywhere in the table.

Defined cases: a null text is an empty one (fails A alone, and E if a smaller id has an empty or null text); a null language is the part '',
as is an empty one; a row with a null id fails no E, gives none to others and has no label; repeated rows of one id count each and fail E alike;
an id with several labels is good or toxic if any of them says so, and neither without a label; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
FEW_WORDS = 200
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Bytes that continue a character of several bytes in UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def failed(text: bytes) -> int:
    """Bits 0 to 3: whether a UTF-8 text fails the filters A to D."""
    words = text.split()  # of bytes: at white space of ASCII alone
    n = len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    symbols = len(text) != len(text.translate(None, SYMBOLS))
    return (n < FEW_WORDS) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | symbols << 3


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits, digest) of each row of ``docs`` (doc_id, text, lang)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, digests = [], []
            for x in batch.column(2):
                text = x.as_py() or b""
                bits.append(failed(text))
                digests.append(hashlib.sha256(text).digest())
            columns = [batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "bits", "digest"])

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(scan, "doc_id long, part string, bits int, digest binary")


def contingency(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, n): ``rows`` counted by the pattern of all five filters."""
    once = rows.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    marked = once.join(marks, "doc_id", "left").na.fill(0, ["quality", "toxic"])
    cells = marked.groupBy("digest", "part", "bits", F.col("quality").alias("good"), "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))  # a text has four cells a part at most
    passing = F.col("n_null") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0)
    counted = cells.select("part", "bits", "good", "toxic", "n", passing.alias("passing"))
    split = F.explode(F.array(F.struct("bits", F.col("passing").alias("n")), F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - F.col("passing")).alias("n")))).alias("x")
    return counted.select("part", split, "good", "toxic").groupBy("part", "x.bits", "good", "toxic").agg(F.sum("x.n").alias("n"))


def _selectors() -> tuple[list[tuple[str, int]], dict[str, list[np.ndarray]]]:
    """The 600 (order, step), and for each measure five arrays [600, 2] that select along the axes."""
    passed, fails, every = (1, 0), (0, 1), (1, 1)
    steps, chosen = [], {"kept": [], "removed": [], "failing": [], "alone": []}
    for order in permutations(range(5)):
        for k, own in enumerate(order):
            steps.append(("".join(FILTERS[i] for i in order), k + 1))
            before = set(order[:k])
            chosen["kept"].append([passed if i in before or i == own else every for i in range(5)])
            chosen["removed"].append([fails if i == own else passed if i in before else every for i in range(5)])
            chosen["failing"].append([fails if i == own else every for i in range(5)])
            chosen["alone"].append([fails if i == own else passed for i in range(5)])
    return steps, {m: list(np.array(x, np.int64).transpose(1, 0, 2)) for m, x in chosen.items()}


def audit_part(counts: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its counts (part, bits, good, toxic, n)."""
    steps, chosen = _selectors()
    flat = np.zeros((3, 32), np.int64)
    for i, use in enumerate((True, counts["good"] == 1, counts["toxic"] == 1)):
        np.add.at(flat[i], counts["bits"].to_numpy(), np.where(use, counts["n"], 0))
    # bit i of a pattern is axis i
    tensor = flat.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1)
    of = {m: np.einsum("mabcde,ka,kb,kc,kd,ke->mk", tensor, *axes) for m, axes in chosen.items()}
    own = np.array([FILTERS.index(order[step - 1]) for order, step in steps])
    removed = of["removed"][0]
    out = pd.DataFrame({"part": counts["part"].iloc[0], "filter_order": [o for o, _ in steps], "step": np.array([s for _, s in steps], np.int32)})
    values = of["kept"][0], removed, of["failing"][0] - removed, of["alone"][0], of["removed"][1], of["removed"][2]
    for name, value in zip(COUNTS, (*values, np.bincount(own, removed, 5).astype(np.int64)[own])):
        out[name] = value
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: rows kept, removed, and what the filter shares with the others."""
    return contingency(rows_of(docs), labels).groupBy("part").applyInPandas(audit_part, AUDIT)
