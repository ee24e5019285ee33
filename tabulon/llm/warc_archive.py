"""Content-addressed WARC archive.

Payload bytes are stored once, in ``response`` records of gzipped WARC/1.1 files, under their
SHA-256 digest. The exact header block of every record, responses and revisits, is kept apart in a
Parquet table. Reading parses the WARC files by Content-Length, verifies each payload against
its digest, and joins header blocks with payloads by digest to give the records back.

A record's id names its page and payload, so a revisit's header alone says which page it refers
to. Every original record, to the byte, is its header block, a blank line, and its content: the
HTTP head, and for a response the payload of its digest.

A third of all records may share one payload. The first page of each payload is found by a
minimum with partial sums on the map side, revisits are found once, from narrow rows (whose hot
digest Spark's skew join can split), and the payloads themselves only move by page id. Files hold
at most FILE_BYTES of content, unless one record alone is larger.

Defined results: a null html is an empty payload; payloads under ``min_bytes`` are always
responses; rows that repeat a page id with the same payload are each treated alike (all
responses if that id is the least); a null page id is never referred to and its record is a
response; a null url leaves the target header out, and blanks and control characters in a url are
percent-encoded; an empty table writes no record; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import materialise, shared_dir, table

MIN_BYTES = 100
#: Bytes of content in one WARC file at most: a file is parsed whole by one task.
FILE_BYTES = 1 << 28
#: Records in one file at most.
FILE_RECORDS = 4096
DATE = "2024-01-01T00:00:00Z"

_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
         octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes
  FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest
"""


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    """A tag URI: the same page and payload always get the same one, and it can be read back."""
    return F.concat(F.lit("tag:archive,2024:page/"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit("/sha256/"), digest)


def field(header: Column, name: str) -> Column:
    """A field of a header block; null where it has none."""
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def referred_page(header: Column) -> Column:
    """The page that a revisit's header refers to."""
    return F.regexp_extract(field(header, "WARC-Refers-To"), r"page/(-?[0-9]+)/", 1).try_cast("bigint")


def _target(url: Column) -> Column:
    """A url with its blanks and control characters percent-encoded."""
    coded = lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(F.transform(F.split(url, ""), coded), "")).otherwise(url)


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier page has."""
    narrow = pages.select("page_id", F.sha2(_payload(), 256).alias("digest"), F.octet_length(_payload()).alias("n")).where(
        (F.col("n") >= min_bytes) & F.col("page_id").isNotNull()
    )
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last")).where("refers_to < _last")
    later = narrow.select("page_id", "digest").join(first.select("digest", "refers_to"), "digest").where("page_id > refers_to")
    return later.dropDuplicates(["page_id", "digest"])


def records(pages: DataFrame, later: DataFrame, *, date: str = DATE, content: bool = True) -> DataFrame:
    """page_id, digest, record_type, the exact header block, the payload's size and (with
    ``content``) the payload of every record; without it no payload is moved. later are the
    ``revisits``."""
    digest, size = F.sha2(_payload(), 256), F.octet_length(_payload())
    payload = [_payload().alias("payload")] if content else []
    whole = pages.select("page_id", "url", digest.alias("digest"), size.alias("_size"), *payload)
    later = later.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    joined = whole.join(later, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    target = _target(F.col("url"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(_CRLF))
    body = F.col("_size") + len(_HTTP)
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), _record_id(F.col("refers_to"), F.col("digest")), F.lit(">")))),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, len(_HTTP)).otherwise(body).cast("string")),
    )
    return joined.select("page_id", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), header.alias("header"), "_size", *(["payload"] if content else []))


def size_classes(largest: int, file_bytes: int, file_records: int) -> list[tuple[int, int | None, int]]:
    """(least size, size that is too much, records in a file) so that no file passes ``file_bytes``."""
    out, low, n = [], 0, file_records
    while True:
        high = max(file_bytes // n, low + 1)
        if largest < high or n == 1:
            return [*out, (low, None, n)]
        out.append((low, high, n))
        low, n = high, max(1, n // 16)


def write_archive(pages: DataFrame, path: str, *, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write path/warc (records with each payload once) and path/headers (every exact header block)."""
    later = materialise(revisits(pages, min_bytes), "warc-revisits")
    records(pages, later, content=False).drop("_size").write.option("compression", "zstd").parquet(f"{path}/headers")
    responses = records(pages, later).where("record_type = 'response'")
    record = F.concat("header", F.lit(_CRLF + _HTTP), "payload")
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for low, high, n in size_classes(largest, file_bytes, file_records):
        some = responses.where((F.col("_size") >= low) & (F.lit(True) if high is None else F.col("_size") < high))
        # a record ends with two line ends, which the writer puts after each row
        writer = some.select(record.alias("value")).write.mode("append").option("lineSep", _CRLF * 2)
        writer.option("compression", "gzip").option("maxRecordsPerFile", n).text(f"{path}/warc")


_HEAD = re.compile(rb"WARC/1\.1\r\n(?:[^\r\n]+\r\n)*\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of every record of a WARC file."""
    at = 0
    while at < len(data):
        head = _HEAD.match(data, at)
        if head is None:
            raise ValueError(f"no WARC record at byte {at}")
        lines = head[0].decode().split(_CRLF)[1:-2]
        fields = dict(line.split(": ", 1) for line in lines)
        end = head.end() + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, data[head.end() : end]
        at = end + 4


def read_payloads(spark: SparkSession, path: str, *, content: bool = True) -> DataFrame:
    """digest, verified length and (with ``content``) bytes of every stored payload.

    A payload whose bytes do not have the digest that its record names is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for fields, block in parse(gzip.decompress(data.as_buffer())):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest = hashlib.sha256(payload).hexdigest()
                    if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
                    rows.append((digest, len(payload), payload if content else None))
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["digest", "payload_bytes", "payload"]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/warc").select("content")
    return files.mapInArrow(run, "digest string, payload_bytes bigint, payload binary")


def read_archive(spark: SparkSession, path: str, *, content: bool = True) -> DataFrame:
    """Every original record: what its header says, the header block, and the payload found by its digest."""
    stored = read_payloads(spark, path, content=content).dropDuplicates(["digest"])
    headers = spark.read.parquet(f"{path}/headers").select(
        "page_id", "digest", field(F.col("header"), "WARC-Type").alias("record_type"), referred_page(F.col("header")).alias("refers_to"), "header"
    )
    return headers.join(stored, "digest", "left")


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the bytes of every original record, from its header block and its payload."""
    found = read_archive(spark, path)
    head = F.concat("header", F.lit(_CRLF + _HTTP)).cast("binary")
    end = F.lit(_CRLF * 2).cast("binary")
    return found.select("page_id", F.when(F.col("record_type") == "revisit", F.concat(head, end)).otherwise(F.concat(head, "payload", end)).alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    found = read_archive(spark, path, content=False)
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
