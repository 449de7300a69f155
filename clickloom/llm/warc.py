"""WARC archives as a chunked record table.

A record (header, payload, closing lines) is streamed as rows of at most ``chunk``
bytes of payload: record identifier, chunk number, bytes, and what the reader needs to
check it on the way: the payload bytes and a running CRC-32 up to and with the chunk.  The
last chunk carries the SHA-256 of the payload.  Joining the bytes of all rows in
the order of record and chunk gives a valid WARC 1.1 stream.

Reading parses headers from chunk 0 and feeds the payload of each chunk to an
incremental digest, so a record of any size needs one chunk of memory.  Records
of one chunk are checked where they lie; only chunks of longer records are shuffled (by
record identifier) and sorted (by chunk).

A record's block is an HTTP response: a header and, but for revisits, the payload.  Revisits name the record and the
payload that they refer to.

Records with equal payloads of at least ``least_bytes`` bytes: the one with the least
page_id is the response, the others revisit it.

Defined cases: null html is an empty payload; rows with a null page_id are responses
of their own and never revisited; rows that repeat a page_id and its payload are all responses if that
page_id is the least, as no record can revisit itself; a null url is an empty target; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

CHUNKS = "record_id string, chunk int, last boolean, data binary, payload_so_far long, crc_so_far long, digest string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CRLF = b"\r\n"
END = CRLF + CRLF


def classify(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(record_id, page_id, url, html, digest, refers_to, refers_record): the last two are set for records that revisit another."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).alias("size"),
        F.monotonically_increasing_id().alias("row"),  # repeated rows are records of their own
    )
    name = F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), "url", "digest", F.col("row").cast("string")), 256)
    part = lambda at, n: F.substring(name, at, n)
    # a UUID of version 8 (made from a hash)
    record_id = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))
    # written, so that records keep their ids however often a part of the input is read again
    rows = staged(rows.withColumn("record_id", record_id), "records")
    # the first record of each payload that occurs more than once: one row a payload, summed before the shuffle
    first = staged(
        rows.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct("page_id", "record_id")).alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("first.page_id < last"),
        "payloads",
    )
    # payloads on over a thousandth of the pages, of which there are fewer than a thousand, are broadcast; other rows meet theirs by digest
    often = F.col("n") * 1000 > F.lit(rows.count())
    hot = F.broadcast(first.where(often).select("digest", F.col("first").alias("hot")))
    rest = first.where(~often).select(F.col("digest").alias("key"), "first")
    keyed = rows.join(hot, "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.col("record_id")))
    joined = keyed.join(rest, "key", "left").withColumn("first", F.coalesce("hot", "first"))
    revisits = F.col("first.page_id") < F.col("page_id")
    return joined.select(
        "record_id", "page_id", "url", "html", "digest",
        F.when(revisits, F.col("first.page_id")).alias("refers_to"), F.when(revisits, F.col("first.record_id")).alias("refers_record"),
    )


def _header(record_id: str, page_id, url: str, size: int, digest: str, refers_to, refers_record) -> bytes:
    """The header of a record and that of the HTTP response in it; a revisit names the payload that its response holds."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{refers_record}>", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]).encode("utf-8", "replace") + END + http


def write_records(pages: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """The chunk table of classified pages."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            names = ["record_id", "chunk", "last", "data", "payload_so_far", "crc_so_far", "digest"]
            columns = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            htmls, others = batch.column(0), zip(*(c.to_pylist() for c in batch.columns[1:]))
            for html, (record_id, page_id, url, digest, first, record) in zip(htmls, others):
                payload = memoryview(html.as_buffer() if first is None else b"")
                head = _header(record_id, page_id, url, len(html.as_buffer()), digest, first, record)
                at, crc, number = 0, 0, 0
                while True:
                    part = payload[at : at + chunk]
                    at, crc = at + len(part), zlib.crc32(part, crc)
                    last = at >= len(payload)
                    rows.append((record_id, number, last, head * (not number) + bytes(part) + END * last, at, crc, digest if last else None))
                    held, number = held + len(part), number + 1
                    if held >= 1 << 22:
                        yield flush()
                        rows, held = [], 0
                    if last:
                        break
        if rows:
            yield flush()

    columns = [F.col("html").cast("binary").alias("html"), "record_id", "page_id", "url", "digest", "refers_to", "refers_record"]
    return pages.select(*columns).mapInArrow(stream, CHUNKS)


def parse_header(data: bytes) -> tuple[dict[str, str], int, int]:
    """Header fields of a record, the place where its payload begins, and the payload's length there and as told by HTTP."""
    end = data.index(END)
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = end + len(END)
    inner = data.index(END, block)
    http = dict(x.split(": ", 1) for x in data[block:inner].decode("utf-8", "replace").split("\r\n")[1:])
    fields["X-Payload-Length"] = http["Content-Length"]
    start = inner + len(END)
    return fields, start, int(fields["Content-Length"]) - (start - block)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of record and chunk number to one row per record; digests grow chunk by chunk."""
    fields, size, seen, crc, digest = {}, 0, 0, 0, hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for number, last, data, so_far, crc_so_far, told in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4, 5, 6))):
            start = 0
            if number == 0:
                fields, start, size = parse_header(data)
                seen, crc, digest = 0, 0, hashlib.sha256()
            part = memoryview(data)[start : start + size - seen]
            seen, crc = seen + len(part), zlib.crc32(part, crc)
            digest.update(part)
            if (seen, crc) != (so_far, crc_so_far):
                raise ValueError(f"chunk {number} of {fields.get('WARC-Record-ID')} is damaged or missing")
            if last:
                page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                full, found = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if seen != size or found != told or first is None and found != digest.hexdigest():
                    raise ValueError(f"record {fields.get('WARC-Record-ID')} does not match its digest")
                out.append((page and int(page), full, found, fields["WARC-Type"], first and int(first)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table, with every digest computed anew and held against the stored ones."""
    whole = chunks.where("chunk = 0 and last").mapInArrow(_read, RECORDS)
    longer = chunks.where("not (chunk = 0 and last)").repartition("record_id").sortWithinPartitions("record_id", "chunk")
    return whole.union(longer.mapInArrow(_read, RECORDS))


def archive_pages(pages: DataFrame, least_bytes: int = 100, chunk: int = 1 << 16) -> DataFrame:
    """Write a record per page, read the archive back, and return what it holds."""
    return read_records(staged(write_records(classify(pages, least_bytes), chunk), "warc"))
