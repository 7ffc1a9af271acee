"""WARC archives with revisit records, written and read by Spark.

Every page is a record. Headers (page, digest, length; no payload) are folded to one row
per payload digest before they are shuffled: of equal payloads of at least ``min_bytes``
bytes the page with the largest id keeps its payload in a response record. Headers join
their group's response, and pages join their header to be written: response records with
their payload, revisit records that refer to the response, all with fresh headers.
Every record is a gzip member of its own, and Spark's text writer writes the archives, with an
empty gzip member as the separator of its lines, to any file system it knows. Such a file is
a plain sequence of members for any reader, and Spark can split it: archives are read back
record by record, so no file has to fit into a task; the digest of every payload is checked.

Defined results: a null payload is empty, and empty payloads are equal; a null url has no
header line; rows that repeat an id and its payload are one record each, all of the same
type; an empty table gives an archive without records and no rows. Two payloads count as
equal if their SHA-1, length and XXH64 agree. Other columns are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmerge.llm.common import stored, whole_text
from plotmerge.session import shared_dir

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one archive file, at most.
RECORDS = 50_000
#: Own header fields: the page's id, and the payload's length, which a revisit lacks.
PAGE_FIELD, BYTES_FIELD = "X-Page-Id", "X-Payload-Length"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"
#: An empty gzip member, between two records.
MARK = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_LINES = {"lineSep": MARK.decode("latin-1"), "encoding": "ISO-8859-1"}


def base32_of_sha1(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 20 bits (5 hex digits) are 4 letters."""
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(_BASE32), at, F.lit(1)))
    return F.concat(*letters)


def plan(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, sha1, bytes, check, response): which page holds the payload of each header."""
    payload = whole_text(html_col)
    headers = stored(pages.select(
        F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("bytes"), F.xxhash64(payload).alias("check"),
    ).distinct(), "warc-headers")
    same = ["sha1", "bytes", "check"]
    best = headers.where(F.col("bytes") >= min_bytes).groupBy(*same).agg(F.max("id").alias("response"))
    return headers.join(best, same, "left").select(
        "id", *same, F.when(F.col("id") < F.col("response"), F.col("response")).alias("response")
    )


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", page.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_bytes: int = 0) -> DataFrame:
    """One column ``value``: each page's whole record but for its last line end."""
    given = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
        whole_text(html_col).alias("html"),
    ).withColumns({"page_sha1": F.sha1("html"), "page_check": F.xxhash64("html")})
    header = stored(plan(pages, id_col, html_col, min_bytes), "warc-plan")
    mine = (
        F.col("page").eqNullSafe(F.col("id")) & (F.col("page_sha1") == F.col("sha1"))
        & (F.col("page_check") == F.col("check"))
    )
    digest = base32_of_sha1(F.col("sha1"))
    revisit = F.col("response").isNotNull()
    # Signs that end or split a header line are written as in a URI.
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(_END + _END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    fields = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"), F.col("sha1"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("response"), F.col("sha1")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit(f"{PAGE_FIELD}: "), F.col("id").cast("string")),
        F.concat(F.lit(f"{BYTES_FIELD}: "), F.col("bytes").cast("string")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return given.join(header, mine).select(
        F.concat(F.concat_ws(_END, *fields), F.lit(_END + _END), block, F.lit(_END)).alias("value")
    )


def member(record: bytes) -> bytes:
    """A record as a gzip member that does not hold the separator."""
    found = (gzip.compress(record, level, mtime=0) for level in (6, 1, 0))
    return next(m for m in found if MARK not in m)


def write(value: DataFrame, path: str) -> None:
    """Write records to archives under ``path``, each record a gzip member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [member(record.as_py() + _END.encode()) for record in batch["value"]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])

    members = value.select(F.col("value").cast("binary")).mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string")).write.options(**_LINES).option("maxRecordsPerFile", RECORDS).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if line.strip() != VERSION.encode():
            raise ValueError(f"not a record: {line[:80]!r}")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "surrogateescape")
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends inside a record")
        yield fields, block


def _row(fields: dict[str, str], block: bytes) -> tuple:
    page = fields.get(PAGE_FIELD.lower())
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields[BYTES_FIELD.lower()])
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != fields["warc-payload-digest"].removeprefix("sha1:") or len(payload) != size:
            raise ValueError(f"the payload of page {page} is not what its header says")
    return (page and int(page), size, digest, fields["warc-type"], fields["warc-record-id"],
            fields.get("warc-refers-to"))


_KINDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
          "record_type": pa.string(), "record_id": pa.string(), "refers_to_record": pa.string()}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch["value"]:
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                    rows += [_row(fields, block) for fields, block in parse(stream)]
            columns = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True)], list(_KINDS)
            )

    found = spark.read.options(**_LINES).option("pathGlobFilter", "part-*").text(path)
    return found.select(F.col("value").cast("binary")).mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string,"
        " record_id string, refers_to_record string",
    )


def resolve(found: DataFrame) -> DataFrame:
    """Records with ``refers_to``: the page whose response record a revisit refers to."""
    originals = found.where("record_type = 'response'").groupBy("record_id").agg(
        F.max("page_id").alias("refers_to")
    ).withColumnRenamed("record_id", "original")
    return found.join(originals, F.col("refers_to_record") == F.col("original"), "left").drop(
        "record_id", "refers_to_record", "original"
    )


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, id_col: str = "page_id",
            url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write deduplicated archives and return what they hold, read back."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "llm-warc")
    write(records(pages, id_col, url_col, html_col, min_bytes), path)
    return resolve(stored(read(spark, path), "warc-read"))
