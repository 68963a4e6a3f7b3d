"""Content-addressed WARC archives.

``archive`` turns pages into WARC records.  Payload bytes are stored once, under their strong digest
(SHA-256, with the length; both computed from the bytes again on reading); record headers are stored
apart, byte for byte.  Records with equal payloads of at least ``min_revisit`` bytes become one
``response``, that of the largest page id, and ``revisit`` records that refer to it.  ``reconstruct``
joins headers with payloads into the original records, ``write_files`` puts them into ``.warc`` files and
``read_files`` parses such files.

Sizes.  The response of a group is a maximum by digest, added up before the shuffle; no group is gathered.
Files are written by Spark's text writer with the end of a record as line separator, a bounded number of
records each, and parsed one file at a time.

Defined cases: a null payload is empty; small payloads are all responses; of rows with one page id and one
payload the one that is read last is the response; a null page id counts as smaller than all others, and
a null url as empty (line ends in urls are percent-coded); an empty table gives empty archives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlift.session import stage

MIN_REVISIT = 1000
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Records in one file, and bytes of one part of the archive to aim at.
FILE_RECORDS, PART_BYTES = 2_000, 32 << 20


def _with_digests(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")).withColumns({
        "payload_bytes": F.length("payload").cast("bigint"), "sha256": F.sha2("payload", 256),
    })


def headers(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One row per page (page_id, url, html): record id and type, digest and the record's header block.

    The header block is everything before the payload: WARC fields, an empty line and the HTTP header.
    """
    rows = stage(_with_digests(pages).select(
        "page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        "payload_bytes", F.sha1("payload").alias("sha1"), "sha256", F.monotonically_increasing_id().alias("row"),
    ), "records")  # written once: the row numbers are fixed from here on
    own = F.struct(F.coalesce("page_id", F.lit(-(1 << 63)).cast("bigint")).alias("page_id"), F.col("row"))
    first = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("sha256", "payload_bytes").agg(F.max(own).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = rows.join(stage(first.drop("n"), "groups"), ["sha256", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    uuid = lambda row: F.format_string("<urn:uuid:%s>", F.regexp_replace(F.md5(F.concat(F.lit("record "), row.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    marked = marked.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"), "record_id": uuid(F.col("row")),
        "refers_to_record": F.when(revisit, uuid(F.col("first.row"))),
        "refers_to": F.when(revisit & (F.col("first.page_id") > -(1 << 63)), F.col("first.page_id")),
    })
    http = F.concat(F.lit(_HTTP), F.col("payload_bytes").cast("string"), F.lit(_END))
    block = F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), line("WARC-Target-URI", F.col("url")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), line("X-Payload-SHA256", F.col("sha256")), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", F.col("refers_to_record")), F.lit(f"WARC-Profile: {_PROFILE}\r\n"),
            F.when(F.col("refers_to").isNotNull(), line("X-Refers-To-Page-ID", F.col("refers_to").cast("string"))).otherwise(""),
        )).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", block.cast("string")), F.lit("\r\n"), http,
    )
    return marked.select("record_id", "record_type", "sha256", "payload_bytes", header.alias("header"))


def archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Writes ``path/headers`` (one row per record) and ``path/payloads`` (one row per different payload)."""
    own = headers(pages, min_revisit)
    own.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/headers")
    key = ["sha256", "payload_bytes"]
    many = own.sparkSession.read.parquet(f"{path}/headers").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    # only payloads that come again need a shuffle; which do is a written table, so that its size is known
    payloads = _with_digests(pages).select(*key, "payload").join(stage(many, "again"), key, "left")
    alone, again = payloads.where("n is null").drop("n"), payloads.where("n is not null").drop("n")
    alone.unionByName(again.dropDuplicates(key)).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/payloads")


def reconstruct(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The original records (record_id, record): each header block with its payload, revisits without one.

    With ``verify`` every payload is held against its digest and length; a damaged one stops the job.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    if verify:
        sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.length("payload") == F.col("payload_bytes"))
        payloads = payloads.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), "sha256")).cast("binary")))
    whole = headers.where("record_type <> 'revisit'").join(payloads, ["sha256", "payload_bytes"], "left").select(
        "record_id", F.concat(F.encode("header", "utf-8"), F.coalesce("payload", F.raise_error(F.concat(F.lit("payload missing: "), "sha256")).cast("binary"))).alias("record"),
    )
    return whole.unionByName(headers.where("record_type = 'revisit'").select("record_id", F.encode("header", "utf-8").alias("record")))


def write_files(reconstructed: DataFrame, path: str, compression: str = "gzip") -> None:
    """``.warc`` files: records in sequence, each ended by two line ends."""
    text = reconstructed.select(F.decode("record", "utf-8").alias("value"))
    text.write.mode("errorifexists").option("lineSep", _END).option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELD = re.compile(rb"^([A-Za-z0-9-]+): ?(.*?)\r$", re.MULTILINE)
_READ = "page_id bigint, record_id string, record_type string, refers_to bigint, payload_digest string, told_length bigint, payload binary"


def _parse(data: bytes) -> Iterator[tuple]:
    """The records of one file."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at) + 4
        fields = {k.lower(): v.decode() for k, v in _FIELD.findall(data, at, end)}
        body = end + int(fields[b"content-length"])
        head = data.index(b"\r\n\r\n", end) + 4  # the HTTP header
        if data[body:body + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has a wrong length")
        number = lambda name, f=fields: int(f[name]) if name in f else None
        payload = data[head:body] if fields[b"warc-type"] != "revisit" else None
        digest = fields[b"warc-payload-digest"].removeprefix("sha1:")
        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {fields[b'warc-record-id']} doesn't hold what its digest says")
        yield number(b"x-page-id"), fields[b"warc-record-id"], fields[b"warc-type"], number(b"x-refers-to-page-id"), digest, number(b"x-payload-length"), payload
        at = body + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ``.warc`` files under ``path``; payloads are held against their digests."""
    schema = StructType.fromDDL(_READ)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                if found := list(_parse(data)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=schema.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, schema)


def round_trip(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archives ``pages`` under ``path`` and returns what the written files say: page_id, payload_bytes,
    payload_digest (SHA-1 of the whole payload, also for revisits), record_type, refers_to."""
    spark = pages.sparkSession
    archive(pages, path, min_revisit)
    write_files(reconstruct(spark, path), f"{path}/warc")
    read = read_files(spark, f"{path}/warc")
    return read.select("page_id", F.coalesce(F.length("payload").cast("bigint"), "told_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
