"""WARC archives of pages, and reading them back with segmented records put together again.

A record is a gzip member of its own. A payload travels as an HTTP response with chunked transfer
framing; a block longer than ``SEGMENT`` bytes is cut into a first record and ``continuation``
records, which may lie in later files. The reader parses each file by itself, groups segments by
the identifier of their origin, orders them by number, checks that none lacks and that their bytes
add up to the stated total, and only then takes the framing off.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.llm.common import new_name, scratch_path, store_at
from funclab.plans.settle import lookup_join, settle

SEGMENT = 64 * 1024
CHUNK = 8 * 1024
FILE_BYTES = 256 * 1024 * 1024
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
_DATE = "2020-01-01T00:00:00Z"
_FILES = "file string, n_records long, n_bytes long"
_RECORDS = (
    "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)
_RAW = "origin string, number int, total long, head string, block binary"


def _head(fields) -> bytes:
    clean = [f"{k}: {str(v).translate({10: 32, 13: 32})}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(clean) + "\r\n\r\n").encode()


def chunked(payload: bytes, size=CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; an error where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def records(page_id, url, payload: bytes, digest, refers_to, refers_url, segment=SEGMENT):
    """The records of one page: a revisit, a response, or a response and its continuations."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    kind = "response" if refers_url is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        fields[4:4] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Target-URI", refers_url),
            ("WARC-Refers-To-Date", _DATE),
            ("X-Refers-To-Page-ID", refers_to),
        ]
        block = f"{status}Content-Length: {len(payload)}\r\n\r\n".encode()
        yield _head([*fields, ("Content-Length", len(block))]) + block + b"\r\n\r\n"
        return
    block = f"{status}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= segment:
        yield _head([*fields, ("Content-Length", len(block))]) + block + b"\r\n\r\n"
        return
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, piece in enumerate(pieces, 1):
        if k > 1:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                ("WARC-Date", _DATE),
                ("WARC-Target-URI", url),
                ("WARC-Segment-Origin-ID", own),
            ]
        total = ("WARC-Segment-Total-Length", len(block) if k == len(pieces) else None)
        yield _head([*fields, ("WARC-Segment-Number", k), total, ("Content-Length", len(piece))]) + piece + b"\r\n\r\n"


def _write_files(where, segment, file_bytes):
    def write(batches):
        import pyarrow as pa

        store, folder = store_at(where)
        out, name, n, size, done = None, None, 0, 0, []
        for batch in batches:
            for page_id, url, html, digest, refers_to, refers_url in zip(*(c for c in batch.columns)):
                payload = (html.as_py() or "").encode()
                for record in records(
                    page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py(), refers_url.as_py(), segment
                ):
                    if out is not None and size >= file_bytes:
                        out.close()
                        done.append((name, n, size))
                        out = None
                    if out is None:
                        name, n, size = f"pages-{new_name()}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    data = gzip.compress(record, 2, mtime=0)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            done.append((name, n, size))
        kinds = [pa.string(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(list(zip(*done)) or [()] * 3, kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "n_records", "n_bytes"])

    return write


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and, for a repeated payload, the first page's id and URL.

    The first page is the one with the smallest id; a row that repeats it is a response too. A null
    id is never first where another id has the payload, and is then a revisit of that.
    """
    text = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(text, 256).alias("digest"))
    long_ = rows.filter(F.octet_length(text) >= REVISIT_BYTES)
    first = long_.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    )
    first = first.filter("n > 1 and first is not null").select(
        "digest", F.col("first.page_id").alias("first_id"), F.coalesce("first.url", F.lit("")).alias("first_url")
    )
    rows = lookup_join(rows, settle(first), ["digest"], "left", spread="page_id")
    again = F.expr("first_id is not null and not (page_id <=> first_id)")
    return rows.select(
        "page_id", "url", "html", "digest", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url")
    )


def write_archives(pages: DataFrame, where=None, segment=SEGMENT, file_bytes=FILE_BYTES) -> tuple[str, DataFrame]:
    """Write a record for each page; gives the folder and the table of files.

    A null page text is empty, null ids and URLs are left out of a record's head, and other columns
    are not read. Files carry names of their own and count only once Spark has committed the table.
    """
    spark = pages.sparkSession
    where = where or scratch_path(spark, "warc")
    store, folder = store_at(where)
    store.create_dir(folder, recursive=True)
    with_revisits(pages).mapInArrow(_write_files(where, segment, file_bytes), _FILES).write.parquet(f"{where}/files")
    return where, spark.read.schema(_FILES).parquet(f"{where}/files")


def parse(stream):
    """Heads and blocks of the records in an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block


def decode(head: dict, block: bytes):
    """A row of a whole record; an error where the payload does not have the stated digest."""
    http, _, body = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in http.decode().lower().split("\r\n")[1:])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    number = lambda name: int(head[name]) if name in head else None
    if head["warc-type"] == "revisit":
        return number("x-page-id"), "revisit", number("x-refers-to-page-id"), int(http["content-length"]), digest, None
    payload = unchunked(body) if http.get("transfer-encoding") == "chunked" else body
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload does not have its digest")
    return number("x-page-id"), "response", None, len(payload), digest, payload


def assemble(parts):
    """A whole record from (number, total, head, block) of its segments, in any order."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing or doubled")
    block = b"".join(p[3] for p in parts)
    if parts[-1][1] != len(block):
        raise ValueError("segments do not add up to the stated length")
    return decode(parts[0][2], block)


def _read_files(where, with_payload):
    def read(batches):
        import json

        import pyarrow as pa

        names = [c.split()[0] for c in f"{_RECORDS}, {_RAW}".split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        store, folder = store_at(where)
        for b in batches:
            for file in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in parse(stream):
                        if "warc-segment-number" in head:
                            origin = head.get("warc-segment-origin-id", head["warc-record-id"])
                            total = head.get("warc-segment-total-length")
                            rows.append((None,) * 6 + (origin, int(head["warc-segment-number"]), total and int(total), json.dumps(head), block))
                            held += len(block)
                        else:
                            row = decode(head, block)
                            rows.append((row if with_payload else row[:5] + (None,)) + (None,) * 5)
                            held += len(row[5] or b"") * with_payload
                        if held > 8_000_000 or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return read


def _assemble_group(with_payload):
    def put(key, table):
        import json

        import pandas as pd

        parts = [(int(n), None if pd.isna(t) else int(t), json.loads(h), b) for n, t, h, b in zip(table["number"], table["total"], table["head"], table["block"])]
        row = assemble(parts)
        frame = pd.DataFrame([row if with_payload else row[:5] + (None,)], columns=[c.split()[0] for c in _RECORDS.split(", ")])
        return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return put


def read_archives(where: str, files: DataFrame, with_payload=True) -> DataFrame:
    """A row for each page record: id, type, page referred to, and the payload's size, digest and bytes.

    Each file is a task of its own: the number of partitions is given, so that adaptive execution
    does not merge them for the little that the names weigh. Segments alone are shuffled, and a
    group holds one payload. A record without a page id, or with a type that is null, keeps the null.
    """
    rows = files.select("file").repartitionByRange(max(1, files.count()), "file").mapInArrow(_read_files(where, with_payload), f"{_RECORDS}, {_RAW}")
    split = scratch_path(files.sparkSession, "records")
    rows.write.parquet(split)
    rows = files.sparkSession.read.schema(f"{_RECORDS}, {_RAW}").parquet(split)
    whole = rows.filter("origin is null").select(*(c.split()[0] for c in _RECORDS.split(", ")))
    parts = rows.filter("origin is not null").select("origin", "number", "total", "head", "block")
    return whole.unionByName(parts.groupBy("origin").applyInPandas(_assemble_group(with_payload), _RECORDS))
