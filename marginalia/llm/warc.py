"""Web archives without repeated payloads: revisit records refer to the first response."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import lookup, materialize, shared_dir, unwrapped, wrapped

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive, about; records are not cut.
ARCHIVE_BYTES = 8 << 20
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def payload_digest(payload: Column) -> Column:
    """Base32 of the SHA-1 of a string's UTF-8 bytes: 40 hex digits, five at a time, make 32 letters."""
    hexed = F.sha1(payload.cast("binary"))
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolve_revisits(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """Every row of pages with payload_bytes, payload_digest, record_type, refers_to and refers_to_url.

    Of the rows with one payload of at least `least` bytes, the smallest key's is the response and the others revisit it; smaller
    payloads are responses. Null text is the empty payload. Columns of these names that pages has are replaced; all others pass
    through. A null key is never the smallest where there is another. Rows that repeat the response's key are responses too; an
    empty table gives none. Only headers (key, url and digest) are shuffled to find the groups; they are added up before the
    shuffle, so a payload that a third of all pages share costs no more than another."""
    body = F.coalesce(F.col(html), F.lit(""))
    headed = wrapped(pages, _key=F.col(key), _url=F.col(url), payload_bytes=F.octet_length(body).cast("long"), payload_digest=payload_digest(body))
    first = F.min(F.when(F.col("_key").isNotNull(), F.struct("_key", "_url"))).alias("_first")
    firsts = headed.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    joined = lookup(headed, materialize(firsts, "firsts"), "payload_digest", F.xxhash64("_key", "_url"))
    again = F.col("_first").isNotNull() & ~F.col("_first._key").eqNullSafe(F.col("_key"))
    said = joined.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first._key")), "refers_to_url": F.when(again, F.col("_first._url"))})
    return unwrapped(said, "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_url")


def _record_id(*named: Column) -> Column:
    """A UUID that follows from what it names."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("\r")) for c in named]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(resolved: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str | Column = "2024-01-01T00:00:00Z") -> None:
    """Write the rows of resolve_revisits as WARC 1.1 files under path: an HTTP head with the full payload for responses, the head
    alone for revisits, fresh WARC headers for both, and one warcinfo record that all name. Record ids follow from key, url and
    digest: rows that agree in all three are the same record, written as often as they occur. One text record is one WARC record,
    and the line separator is the two line ends that close it. Line ends in a url are percent-encoded, so that no header can be
    forged. date: when the pages were fetched, one for all or a column."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")
    again = F.col("record_type") == "revisit"
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))
    some = lambda c, text: F.when(c.isNull(), F.lit("")).otherwise(text)
    info = "<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, path)) + ">"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    body = F.concat(head, F.when(again, F.lit("")).otherwise(F.coalesce(F.col(html), F.lit(""))))
    when = F.lit(date) if isinstance(date, str) else date
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col(key), F.col(url), F.col("payload_digest"))), line("WARC-Date", when), line("WARC-Warcinfo-ID", F.lit(info)),
        some(F.col(url), line("WARC-Target-URI", clean(F.col(url)))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), some(F.col(key), line("X-Page-Key", F.col(key).cast("string"))),
        F.when(again, F.concat(
            line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("refers_to_url"), F.col("payload_digest"))), some(F.col("refers_to_url"), line("WARC-Refers-To-Target-URI", clean(F.col("refers_to_url")))),
            line("WARC-Profile", F.lit(_PROFILE)), line("X-Refers-To-Page-Key", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body)
    about = "software: marginalia\r\nformat: WARC File Format 1.1\r\n"
    mean = resolved.select(F.avg("payload_bytes")).first()[0] or 0
    started = date if isinstance(date, str) else resolved.agg(F.min(when)).first()[0] or "2024-01-01T00:00:00Z"
    own = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {info}\r\nWARC-Date: {started}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}{_END}{about}"
    rows = resolved.select(record.alias("value")).unionByName(resolved.sparkSession.range(1, numPartitions=1).select(F.lit(own).alias("value")))
    rows.write.option("lineSep", _END).option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (mean + 800)))).text(path)


def parse_archive(content: bytes) -> Iterator[tuple]:
    """The responses and revisits of one archive, by their Content-Length: rows of RECORDS. Other records are passed over."""
    at = 0
    number = lambda s: None if s is None else int(s)
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        block = content[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        kind = head["WARC-Type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
        again = kind == "revisit"
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if again else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield (number(head.get("X-Page-Key")), head.get("WARC-Target-URI"), kind, number(head.get("X-Refers-To-Page-Key")), digest, stated if again else len(payload), None if again else payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under path, one row each (RECORDS): digests and sizes of responses are computed anew from their payloads. Keys
    are whole numbers."""

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                columns = list(zip(*parse_archive(content.as_py()), strict=True)) or [[]] * 7
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORDS)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Resolve, write to the shared folder, and read the archives back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve_revisits(pages, **options), path)
    return read_archives(spark, path)
