"""WARC archives: write captures as records, read archives back, and assemble transactions.

A capture is three records: a request, a response (or a revisit of an equal payload) and a metadata record.
The request and the metadata name the response in ``WARC-Concurrent-To``; assembly joins on that identifier
and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import with_least
from tidemark.session import checkpoint_dir

ARCHIVE_BYTES = 32 << 20        # a file is closed once it holds this much
RECORD = ("record_id string, type string, url string, date string, concurrent_to string, refers_to string, "
          "payload_digest string, fields map<string,string>, payload binary, payload_bytes bigint")
_END = b"\r\n\r\n"


def with_digest(pages: DataFrame, key: str = "page_id", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """``pages`` plus payload, payload_sha1 (hex) and original: the largest key of an equal payload.

    Payloads under ``least_bytes`` have no original.  Keys that are null are ignored unless all are.
    """
    full = pages.withColumn("payload", F.encode(F.coalesce(html, F.lit("")), "UTF-8")).withColumn("payload_sha1", F.sha1("payload")).withColumn(
        "_own", F.when(F.octet_length("payload") >= least_bytes, F.col(key)))
    return with_least(full, "payload_sha1", "_own", "original", best=F.max).drop("_own")


def _record(kind: str, record_id: str, url: str, date: str, body: bytes, content_type: str, extra: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": url} | extra
    head |= {"Content-Type": content_type, "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {_flat(v)}\r\n" for k, v in head.items())
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + _END) + packer.flush()


def _flat(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _capture_id(part: str, key, row: int, kind: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{key}/{row}/{kind}')}"


def write_archives(captures: DataFrame, folder: str, key: str = "page_id", url: str = "url",
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write gzip members to ``folder``; returns (file, captures, bytes).  ``captures`` comes from ``with_digest``.

    A capture whose key is not its ``original`` is a revisit and carries no payload.  A file is written under its
    attempt's name and renamed when whole, so a repeated task leaves the same files.  ``folder`` is any URI
    that the executors share.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        out, files, rows, row = bytearray(), [], 0, 0

        def close() -> None:
            name = f"{root}/part-{part:06d}-{len(files):04d}.warc.gz"
            held = f"{root}/_{attempt}-{part:06d}-{len(files):04d}"
            with store.open_output_stream(held) as sink:
                sink.write(bytes(out))
            store.move(held, name)
            files.append((name, rows, len(out)))

        for batch in batches:
            for number, link, payload, digest, original in zip(*(c.to_pylist() for c in batch.columns)):
                answer = _capture_id(f"{part}", number, row, "response")
                link, label = link or "", "" if number is None else str(number)
                revisit = original is not None and number != original
                host = urlsplit(link).netloc if re.match(r"[a-z]+://[^\[\]]*$", link) else ""
                ask = f"GET {_flat(link)} HTTP/1.1\r\nHost: {_flat(host)}\r\n\r\n".encode()
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                told = {"WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"}
                if revisit:
                    told |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                             "WARC-Refers-To-Key": str(original)}
                notes = f"key: {label}\r\npayload-bytes: {len(payload)}\r\n".encode()
                out += _record("request", _capture_id(f"{part}", number, row, "request"), link, date, ask,
                               "application/http;msgtype=request", {"WARC-Concurrent-To": f"<{answer}>"})
                out += _record("revisit" if revisit else "response", answer, link, date, head + (b"" if revisit else payload),
                               "application/http;msgtype=response", told)
                out += _record("metadata", _capture_id(f"{part}", number, row, "metadata"), link, date, notes,
                               "application/warc-fields", {"WARC-Concurrent-To": f"<{answer}>"})
                rows, row = rows + 1, row + 1
                if len(out) >= ARCHIVE_BYTES:
                    close()
                    out, rows = bytearray(), 0
        if rows:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()),
             pa.array([f[2] for f in files], pa.int64())], names=["file", "captures", "bytes"])

    return captures.select(key, url, "payload", "payload_sha1", "original").mapInArrow(
        run, "file string, captures bigint, bytes bigint")


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of one archive: gzip members, or plain text."""
    view, start = memoryview(content), 0
    while start < len(content):
        if content[start:start + 2] == b"\x1f\x8b":
            reader = zlib.decompressobj(31)
            parts, at = [], start
            while not reader.eof and at < len(content):
                parts.append(reader.decompress(view[at:at + (1 << 16)]))
                at += 1 << 16
            start = min(at, len(content)) - len(reader.unused_data)
            record = b"".join(parts)
            yield from _plain(record)
        else:
            yield from _plain(content[start:])
            return


def _plain(text: bytes) -> Iterator[dict]:
    at = 0
    while (head_end := text.find(_END, at)) >= 0:
        lines = text[at:head_end].decode("utf-8", "replace").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = int(fields.get("Content-Length", "0"))
        body = text[head_end + 4:head_end + 4 + size]
        at = head_end + 4 + size + 4
        kind = fields.get("WARC-Type")
        payload = body
        if kind in ("request", "response", "revisit"):
            payload = body[body.find(_END) + 4:]
        bare = lambda name: (fields.get(name) or "").strip("<>") or None
        notes = {}
        if kind == "metadata":
            notes = dict(x.split(": ", 1) for x in body.decode("utf-8", "replace").split("\r\n") if ": " in x)
        yield {"record_id": bare("WARC-Record-ID"), "type": kind, "url": fields.get("WARC-Target-URI"), "date": fields.get("WARC-Date"),
               "concurrent_to": bare("WARC-Concurrent-To"), "refers_to": fields.get("WARC-Refers-To-Key"),
               "payload_digest": (fields.get("WARC-Payload-Digest") or "").removeprefix("sha1:") or None,
               "fields": notes, "payload": payload if kind == "response" else None,
               "payload_bytes": len(payload) if kind == "response" else None}


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of every archive under ``folder``; one file of bounded size is in memory at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ", 1)[0] for x in RECORD.split(", ")]
        kinds = [pa.map_(pa.string(), pa.string()) if n == "fields" else pa.binary() if n == "payload"
                 else pa.int64() if n == "payload_bytes" else pa.string() for n in names]

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([list(r[n].items()) if n == "fields" else r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in parse_records(content.as_py()):
                    rows.append(record)
                    held += len(record["payload"] or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: record_id, url, type, payload, payload_bytes, payload_digest, refers_to, and
    ``request`` and ``metadata`` as structs (null when no record names the response).

    Records that name no known response are dropped.  If several name the same one, the least record id counts.
    """
    answers = records.where(F.col("type").isin("response", "revisit")).drop("concurrent_to", "fields")
    part = lambda kind, value: records.where(F.col("type") == kind).groupBy("concurrent_to").agg(
        F.min_by(value, "record_id").alias(kind)).withColumnRenamed("concurrent_to", "record_id")
    return answers.join(part("request", F.struct("record_id", "url", "date")), "record_id", "left").join(
        part("metadata", F.struct("record_id", "fields")), "record_id", "left")


def captures_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                        least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a fresh folder in the shared checkpoint folder, read it back, and assemble.

    One row per page: ``key``, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.
    Null html is an empty payload, a null url an empty one.  Rows of the largest key of an equal payload are
    responses, all of them if rows repeat, and so are rows whose key is null when all are.
    """
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    ready = with_digest(pages, key, html, least_bytes)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)                   # so that an empty table reads back as no captures
    write_archives(ready, folder, key, url).write.format("noop").mode("overwrite").save()
    kind = dict(pages.dtypes)[key]
    number = F.expr(f"try_cast(metadata.fields['key'] AS {kind})")
    size = F.col("metadata.fields")["payload-bytes"].cast("long")
    return assemble(read_archives(spark, folder)).select(
        number.alias(key), "url", "payload", F.coalesce("payload_bytes", size).alias("payload_bytes"), "payload_digest",
        F.col("type").alias("record_type"), F.expr(f"try_cast(refers_to AS {kind})").alias("refers_to"))
