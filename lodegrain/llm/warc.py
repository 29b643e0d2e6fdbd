"""WARC archives with resolved revisits: headers are shuffled by payload digest, copies become revisit records, payloads stay in place."""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodegrain.llm.common import materialise, meet

#: Fixed values of the WARC 1.1 and RFC 4648 standards.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Records of an archive file at most, by the bytes of each (below which bound), so that a file holds 128 MB before compression, or one record.
FILE_RECORDS = ((64 << 10, 2000), (512 << 10, 250), (4 << 20, 31), (32 << 20, 4), (None, 1))
#: A batch of parsed records holds about this many payload bytes.
BATCH_BYTES = 4 << 20

RECORD_SCHEMA = "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string, fault string"


def digest_of(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: each 10 hex digits are 40 bits, or 8 letters."""
    code = F.sha1(payload.cast("binary"))
    parts = [F.translate(F.lpad(F.conv(F.substring(code, 1 + 10 * i, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32) for i in range(4)]
    return F.concat(*parts)


def record_uri(page_id: Column, digest: Column) -> Column:
    """A stable urn:uuid of page and payload."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """records(page_id, url, payload) with payload_digest, payload_bytes, record_type and refers_to.

    Of records with equal payloads of at least min_bytes bytes, the one with the largest page_id is the response and
    the others revisit it; smaller payloads are all responses. Null payloads are empty ones. Rows repeated whole, page_id
    included, are all responses if theirs is the largest page_id. Null page_ids are below every number; a payload
    that only null page_ids hold is a response each time. Further columns are dropped.

    Only headers (page_id, url and digest) are shuffled, and only digests of several records come back to the payloads, which stay where they are: the digests are
    broadcast if a count says that they may, else a digest's records are dealt over several tasks.
    """
    body = F.coalesce(F.col("payload"), F.lit(""))
    known = records.select("page_id", "url", body.alias("payload"), digest_of(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    headers = records.where(F.octet_length(body) >= min_bytes).select("page_id", "url", digest_of(body).alias("payload_digest"))
    shared = headers.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_original"), F.max_by("url", "page_id").alias("_url")).where("_n > 1 and _original is not null")
    shared = materialise(shared.select("payload_digest", "_original", "_url"), "shared")
    revisits = F.col("_original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_original"))
    return meet(known, shared, "payload_digest", "page_id", "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisits, F.col("_original")).alias("refers_to"), F.when(revisits, F.col("_url")).alias("refers_to_url"),
    )


def write_archives(records: DataFrame, path: str, date: datetime.datetime | None = None) -> None:
    """Write resolved records as gzipped WARC files, with fresh headers, to a folder that need not exist.

    Spark's text writer puts the bytes: its line separator is the two line ends that close a record, so the files are
    committed like any table's and a lost executor's files are written again. Long records go to files with fewer of them, by a write of their own; while the first
    write runs it counts them, so a table without long records is read once.
    """
    stamp = F.lit((date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ"))
    is_revisit = F.col("record_type") == "revisit"
    clean = lambda c: F.regexp_replace(c, "[\r\n]+", " ")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    field = lambda name, value: F.concat(F.lit(name + ": "), value)
    head = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", record_uri(F.col("page_id"), F.col("payload_digest"))),
        field("WARC-Date", stamp),
        field("WARC-Target-URI", clean(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("Page-Id", F.col("page_id").cast("string")),
        F.when(is_revisit, field("WARC-Profile", F.lit(PROFILE))),
        F.when(is_revisit, field("WARC-Refers-To", record_uri(F.col("refers_to"), F.col("payload_digest")))),
        F.when(is_revisit, field("WARC-Refers-To-Target-URI", clean(F.col("refers_to_url")))),
        F.when(is_revisit, field("Refers-To-Page-Id", F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", length.cast("string")),
    )
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    bounds = [least for least, _ in FILE_RECORDS[:-1]]
    rank = sum(((length >= b).cast("int") for b in bounds), F.lit(0))
    sized = records.withColumn("_rank", rank)
    observed = Observation()
    counted = sized.observe(observed, *(F.count_if(F.col("_rank") == i).alias(f"n{i}") for i in range(1, len(FILE_RECORDS))))
    for i, (_, most) in enumerate(FILE_RECORDS):
        if i == 0 or observed.get[f"n{i}"]:
            own = (sized if i else counted).where(F.col("_rank") == i).select(F.concat(head, F.lit(CRLF + CRLF), block).alias("value"))
            own.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", most).mode("append" if i else "errorifexists").text(path)


def parse_stream(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC byte stream."""
    held, end = bytearray(), False

    def need(n: int) -> bool:
        nonlocal end
        while len(held) < n and not end:
            part = next(chunks, None)
            if part is None:
                end = True
            else:
                held.extend(part)
        return len(held) >= n

    while True:
        while need(2) and held[:2] == b"\r\n":
            del held[:2]
        if not held:
            return
        while (stop := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                raise ValueError("a WARC record ends inside its headers")
        lines = bytes(held[:stop]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        if not need(stop + 4 + n):
            raise ValueError("a WARC record ends inside its block")
        block = bytes(held[stop + 4 : stop + 4 + n])
        del held[: stop + 4 + n]
        yield fields, block


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, or of a plain file, in pieces."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    whole, start = memoryview(data), 0
    while start < len(whole):
        d = zlib.decompressobj(31)
        while not d.eof and start < len(whole):
            yield d.decompress(whole[start : start + step])
            start += min(step, len(whole) - start)
        start -= len(d.unused_data)


def record_row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """One row of RECORD_SCHEMA. For responses, length and digest come from the payload as read and are held against the headers."""
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    kind, digest, size = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(told.get("content-length", len(payload)))
    fault = None
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        fault = "digest" if digest and found != digest else "length" if size != len(payload) else None
        digest, size = found, len(payload)
    number = lambda k: int(fields[k]) if k in fields else None
    return number("page-id"), fields.get("warc-target-uri"), fields.get("warc-record-id"), kind, size, digest, number("refers-to-page-id"), payload.decode("utf-8", "replace") if payloads and kind == "response" else None, fault


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of every archive in a folder. A record whose payload contradicts its headers has a fault; a torn file raises."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for fields, block in parse_stream(inflate(data.as_py())):
                    rows.append(record_row(fields, block, payloads))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD_SCHEMA)
