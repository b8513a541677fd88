"""WARC archives as a chunked record table.

Every page is a record of rows (record id, chunk number): oversized payloads go on in continuation
records of at most `chunk_bytes`, so neither writer nor reader allocates a record as a whole beyond
the row that Spark hands over. Digests are carried chunk by chunk.

Of pages with equal payloads the one with the largest id is a `response`, the others are `revisit`
records that refer to it. Payloads below `min_bytes` are always responses.

The archives are text files of Spark's own sink: one value per chunk, with the line end that closes
a record. Readers cut at the version line; the writer ends a chunk inside any payload bytes that look
like that line, so it never occurs in a block. Files are gzip-compressed, which makes one task read a
file from its start: chunks of a record meet in order without a shuffle.

Null payloads count as empty. A null id is written as the word null. Repeated rows are repeated
records. Empty tables give no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import saved

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, chunk_no int, value string"
RECORDS = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def decisions(df: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """id, hex (SHA-1 of the payload), refers_to: one row per input row.

    The hot payload meets its winner in a join of two written tables, which Spark splits by size."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    each = saved(df.select(F.col(id_col).alias("id"), F.sha1(payload).alias("hex"), F.octet_length(payload).cast("long").alias("size")), "warc-digests")
    best = saved(each.where(F.col("size") >= min_bytes).groupBy("hex", "size").agg(F.max("id").alias("best"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "warc-winners")
    found = each.join(best, ["hex", "size"], "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("best")), F.col("best"))
    return found.select("id", "hex", refers.alias("refers_to"))


def _cut(data: memoryview, start: int, size: int) -> int:
    """Where a chunk from `start` ends: before a UTF-8 sequence that would be split, inside a version line."""
    end = min(start + size, len(data))
    while end < len(data) and end > start + 1 and data[end] & 0xC0 == 0x80:
        end -= 1
    at = bytes(data[start : end + len(VERSION)]).find(VERSION.encode())
    return end if at < 0 else min(end, start + at + 5)


def record_chunks(df: DataFrame, id_col: str, uri_col: str, payload_col: str, chunk_bytes: int = 1 << 20, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """The chunk table: record_id, chunk_no and the value (headers and block) of each chunk, in file order."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"), F.sha1(payload).alias("hex"))
    choice = saved(decisions(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, payload_col, min_bytes).distinct(), "warc-choice")
    rows = pages.join(choice, pages.id.eqNullSafe(choice.id) & (pages.hex == choice.hex)).select(pages.id, "uri", "payload", pages.hex, "refers_to")

    def body(batches):
        for batch in batches:
            ids, chunks, values = [], [], []
            total = 0
            for page, uri, text, hexed, refers in zip(batch.column("id").to_pylist(), batch.column("uri").to_pylist(), batch.column("payload"), batch.column("hex").to_pylist(), batch.column("refers_to").to_pylist()):
                record = f"urn:x-page:{'null' if page is None else page}"
                data = memoryview(text.as_buffer() or b"")
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "").replace(VERSION, VERSION.replace("/", "%2F"))
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n"
                head = f"WARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\n"
                start = number = 0
                while number == 0 or start < len(data):
                    end = _cut(data, start, chunk_bytes) if refers is None else len(data)
                    block = ("" if number else http) + (str(data[start:end], "utf-8") if refers is None else "")
                    lines = [VERSION, f"WARC-Type: {'revisit' if refers is not None else 'continuation' if number else 'response'}", f"WARC-Record-ID: <{record}{f'/{number}' if number else ''}>"]
                    if number or (refers is None and end < len(data)):
                        lines.append(f"WARC-Segment-Number: {number + 1}")
                    if number:
                        lines.append(f"WARC-Segment-Origin-ID: <{record}>")
                        if end == len(data):
                            lines.append(f"WARC-Segment-Total-Length: {len(http) + len(data)}")
                    if refers is not None:
                        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers}>"]
                    if not number:
                        lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
                    lines.append(f"Content-Length: {len(block.encode())}")
                    ids.append(record)
                    chunks.append(number)
                    values.append("\r\n".join(lines[:1]) + "\r\n" + head + "\r\n".join(lines[1:]) + "\r\n\r\n" + block + "\r\n")
                    start, number, total = end, number + 1, total + end - start
                    if total > 8 * chunk_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(chunks, pa.int32()), pa.array(values)], names=["record_id", "chunk_no", "value"])
                        ids, chunks, values, total = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(chunks, pa.int32()), pa.array(values)], names=["record_id", "chunk_no", "value"])

    return rows.mapInArrow(body, CHUNKS)


def write_archives(chunks: DataFrame, path: str) -> None:
    """Writes chunk rows, in the order of their partitions, as gzip-compressed WARC files."""
    chunks.select("value").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, uri, record_type, refers_to, payload_bytes and payload_digest; both
    are taken from the payload as it is streamed, for revisits from the record's own headers."""

    def body(batches):
        now: dict | None = None

        def row():
            if now["record_type"] == "response":
                now["payload_digest"] = base64.b32encode(now.pop("sha").digest()).decode()
                if now["payload_bytes"] != now.pop("expected"):
                    raise ValueError(f"{now['page_id']}: the record is cut off")
            return {k: now[k] for k in names}

        for batch in batches:
            out = []
            for value in batch.column("value").to_pylist():
                if not value:
                    continue
                top, _, block = value.partition("\r\n\r\n")
                field = dict(line.split(": ", 1) for line in top.split("\r\n"))
                block = block.encode()[: int(field["Content-Length"])]
                if field["WARC-Type"] != "continuation":
                    if now:
                        out.append(row())
                    http, _, block = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    page, refers = field["WARC-Record-ID"][1:-1].rsplit(":", 1)[1], field.get("WARC-Refers-To")
                    now = {"page_id": None if page == "null" else int(page), "uri": field["WARC-Target-URI"], "record_type": field["WARC-Type"], "refers_to": refers and int(refers[1:-1].rsplit(":", 1)[1]), "payload_bytes": size, "payload_digest": field["WARC-Payload-Digest"][5:]}
                    if field["WARC-Type"] == "response":
                        now |= {"sha": hashlib.sha1(), "payload_bytes": 0, "expected": size}
                if now["record_type"] == "response":
                    now["sha"].update(block)
                    now["payload_bytes"] += len(block)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([row()], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(RECORDS)
    schema, names = to_arrow_schema(kind), kind.names
    lines = spark.read.option("lineSep", f"{VERSION}\r\n").text(path)
    return lines.mapInArrow(body, kind)
