"""Totals of hashed keys over all blocks of a table, without one row for each key.

Rows are dealt into blocks and written once, bucketed by block, so that later passes find a block where it lies.  A
block sends its sorted distinct keys with their counts to key ranges, one message for each range.  A range adds the
counts up and answers each block with the totals in the order of its keys; so answers need no keys.  Keys are hashes and
ranges cut their values evenly, so no range is hot: a frequent key is one entry for each block.  The number of ranges
follows the size of the input, so at most blocks times ranges messages are sent, of which those without a key are not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Spark takes no more than 100,000 buckets.
MOST_BUCKETS = 50_000
MESSAGE = pa.schema(
    [("family", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())]
)
SENT = "family int, range long, block long, n long, keys binary, counts binary, more binary"
REPLY = pa.schema([("family", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("types", pa.int64())])
ANSWERED = "family int, range long, block long, n long, counts binary, types long"


def bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """``blocks`` written in buckets of its column ``block`` and read back, so that grouping by it moves no row.

    Of very many blocks several share a bucket.  The name in the catalog goes again at once; the files stay below the shared folder.
    """
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    writer = blocks.write.bucketBy(min(max(1, buckets), MOST_BUCKETS), "block").option("compression", "zstd")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def in_blocks(rows: DataFrame, n_rows: int, n_bytes: int, block_bytes: int) -> DataFrame:
    """``rows`` with the column ``block``, bucketed by it; a block holds about ``block_bytes`` of neighbouring rows."""
    rid, each = F.monotonically_increasing_id(), max(1, block_bytes * n_rows // max(1, n_bytes))
    block = F.xxhash64(F.shiftright(rid, 33), F.floor(rid.bitwiseAND(F.lit((1 << 33) - 1)) / each))
    return bucketed(rows.withColumn("block", block), n_bytes // block_bytes)


def followed(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys of contexts (or tokens) followed by tokens."""
    x = (context * np.uint64(0x9E3779B97F4A7C15)) ^ ((token << np.uint64(31)) | (token >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def to_bytes(values: np.ndarray) -> bytes:
    """Non-negative integers as planes of equally significant bytes; planes of zeros at the end are left out."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = np.nonzero(planes.any(axis=1))[0]
    return planes[: used[-1] + 1 if len(used) else 0].tobytes()


def from_bytes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def ranked(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of each key among them, and where each distinct key first stands.

    Sorts keys with their places in one number, which is several times as fast as an argsort; leading bits decide where both
    do not fit, and the few keys that these leave out of order are sorted again.
    """
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = n.bit_length()
    lost, width = max(0, bits + low - 64), np.uint64(low)
    packed = (keys >> np.uint64(lost)) << width | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1]) if lost else ()
    if len(wrong) > 1000:
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    else:
        lead = found >> np.uint64(lost)
        for a, b in {(np.searchsorted(lead, lead[i], "left"), np.searchsorted(lead, lead[i], "right")) for i in wrong}:
            order[a:b] = order[a:b][np.argsort(keys[order[a:b]], kind="stable")]
        found = keys[order] if len(wrong) else found
    new = np.concatenate([[True], found[1:] != found[:-1]])
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return found[new], place, order[new]


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def messages(block: int, family: int, keys: np.ndarray, counts: np.ndarray, more: np.ndarray | None, bits: int, ranges: int) -> Iterator[tuple]:
    """Sorted distinct keys of so many bits, cut into ranges, with one or two counts each."""
    if not len(keys):
        return
    of = keys // np.uint64(-(-(1 << bits) // ranges)) if ranges > 1 else np.zeros(len(keys), np.uint64)
    ends = [*np.flatnonzero(of[1:] != of[:-1]) + 1, len(keys)]
    for at, end in zip([0, *map(int, ends[:-1])], map(int, ends)):
        steps = np.diff(keys[at:end], prepend=np.uint64(0))
        yield family, int(of[at]), block, end - at, to_bytes(steps), to_bytes(counts[at:end]), None if more is None else to_bytes(more[at:end])


def opened(table: pa.Table, column: str) -> list[np.ndarray]:
    """The numbers of each message of a range."""
    return [from_bytes(x.as_py(), n) for x, n in zip(table.column(column), table.column("n").to_pylist())]


def places(table: pa.Table) -> tuple[int, np.ndarray]:
    """How many distinct keys a range holds, and the place of each entry of its messages among them."""
    distinct, place, _ = ranked(np.concatenate([np.cumsum(x) for x in opened(table, "keys")]))
    return len(distinct), place


def answers(table: pa.Table, values: np.ndarray, types: int = 0) -> pa.Table:
    """Answers the messages of a range with ``values``, one for each entry; ``types`` goes with the first answer."""
    rows, at = [], 0
    for family, r, block, n in zip(*(table.column(c).to_pylist() for c in ("family", "range", "block", "n"))):
        rows.append((family, r, block, n, to_bytes(values[at : at + n]), 0 if at else types))
        at += n
    return rows_of(rows, REPLY)


def totals(table: pa.Table) -> pa.Table:
    """Answers with the total count of each key, and tells how many keys have one."""
    n, place = places(table)
    total = np.bincount(place, np.concatenate(opened(table, "counts")).astype(np.float64), n)
    return answers(table, total[place], int((total > 0).sum()))


def exchanged(sent: DataFrame, answer=totals) -> DataFrame:
    """The answers of all ranges to the messages ``sent``."""
    return sent.groupBy("family", "range").applyInArrow(answer, ANSWERED)


def received(table: pa.Table, family: int) -> np.ndarray:
    """The answers to a block, in the order of the keys of ``family`` that it sent."""
    part = table.filter(pc.equal(table.column("family"), family)).sort_by("range")
    return np.concatenate([np.zeros(0), *opened(part, "counts")])
