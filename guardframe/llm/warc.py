"""A content-addressed archive of WARC records.

Three tables: ``payloads`` holds every distinct payload once under its SHA-256, ``records`` the
exact header bytes of every record with its payload's digest, and a record is the join of the two.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardframe.operators.joins import lookup
from guardframe.sources.scratch import materialize, scratch_path

#: The date all records carry: a fixed value, since the pages have none.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Folders of the archive's tables."""
    payloads: str
    records: str


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [b"" if x is None else x for x in batch.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            *(c for name, c in zip(batch.schema.names, batch.columns) if name != "payload"),
            pa.array([hashlib.sha256(x).digest() for x in payloads], pa.binary()),
            pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in payloads], pa.string()),
            pa.array([len(x) for x in payloads], pa.int64()),
        ], names=[*(n for n in batch.schema.names if n != "payload"), "key", "sha1", "size"])


def _clean(column: str):
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x00-\x1f\x7f]+", " ")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *,
          least_bytes: int = 0) -> Archive:
    """Archive a record per page; its payload is the page's html in UTF-8, empty for null.

    Of records with equal payloads of at least ``least_bytes``, that with the smallest id is the
    response and the others revisit it; smaller payloads are responses each. Pages that share the
    smallest id are all responses. A page without id counts as larger than all ids, and revisits
    or, if no page has one, all are responses. Null urls are empty; further columns are ignored.

    Only digests are grouped, so a payload that a third of the pages share is one partial sum per
    task, and its pages look their response up where they lie; html moves once, by page, to store
    the first copy of every payload.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    known = materialize(own.mapInArrow(
        _digest, "page_id long, url string, key binary, sha1 string, size long"), "digests")
    first = materialize(known.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("times")), "first")
    records = lookup(known, first, "key", "times").withColumn(
        "response", (F.col("size") < least_bytes) | F.col("page_id").eqNullSafe(F.col("first")))
    mark = F.concat(F.lit("<urn:guardframe:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
        line("WARC-Record-ID", mark),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _clean("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(F.col("response"), F.lit("")).otherwise(F.concat(
            line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            line("WARC-Refers-To", F.concat(F.lit("<urn:guardframe:page:"), F.col("first").cast("string"), F.lit(">"))))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("response"), F.col("size")).otherwise(0).cast("string")),
        F.lit("\r\n"))
    spark = pages.sparkSession
    out = Archive(scratch_path(spark, "warc-payloads"), scratch_path(spark, "warc-records"))
    records.select("key", header.cast("binary").alias("header")).write.parquet(out.records)
    # of repeated rows of the first id, one is stored; a missing id is some number here
    some = F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id")
    wanted = first.select(F.col("first").alias("page_id"), "key").select(some, "key")
    again = Window.partitionBy("page_id", "key").orderBy(F.lit(0))
    own.select(some, "payload").mapInArrow(_keyed, "page_id long, key binary, payload binary") \
        .join(wanted, ["page_id", "key"]).withColumn("nth", F.row_number().over(again)).where("nth = 1") \
        .select("key", "payload").write.parquet(out.payloads)
    return out


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [hashlib.sha256(x).digest() for x in batch.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), pa.array(keys, pa.binary()), batch.column("payload")],
            names=["page_id", "key", "payload"])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "sha1", "size"]
    for batch in batches:
        rows = []
        for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist()):
            if hashlib.sha256(payload).digest() != key:
                raise ValueError(f"payload {key.hex()} is not what was stored")
            rows.append((key, base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)))
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.string(), pa.int64()))], names=names)


def _records(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.schema("key binary, header binary").parquet(archive.records)


def _payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.schema("key binary, payload binary").parquet(archive.payloads)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records, read back: (page_id, url, record_type, refers_to, payload_bytes, payload_digest).

    Every stored payload is hashed again and must match its key. Every header must name the digest of
    its payload, and the length of the record's block, that of the payload in a response and 0 in a
    revisit; size and digest are those of the bytes that were read. A record without its payload, or
    with another header, ends the job with an error. These small values stand for the payloads in the
    join that makes the records (``rebuild``), so no html is shuffled; the records of a payload that
    many share stay where they are.
    """
    header = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)", 1)
    page = lambda name: F.regexp_extract(field(name), r"page:(-?\d+)>", 1).try_cast("long")
    records = _records(spark, archive).select(
        "key", page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest").alias("digest"), field("Content-Length").try_cast("long").alias("length"))
    verified = _payloads(spark, archive).mapInArrow(_verified, "key binary, sha1 string, size long")
    times = _records(spark, archive).groupBy("key").agg(F.count("*").alias("times"))
    found = materialize(times.join(verified, "key", "left"), "verified")
    block = F.when(F.col("record_type") == "response", F.col("size")).when(F.col("record_type") == "revisit", F.lit(0))
    named = (F.col("digest") == F.concat(F.lit("sha1:"), "sha1")) & (F.col("length") == block)
    wrong = F.raise_error(F.concat(F.lit("the header of a record does not fit its payload "), F.lower(F.hex("key"))))
    return lookup(records, found, "key", "times").select(
        "page_id", "url", "record_type", "refers_to", F.col("size").alias("payload_bytes"),
        F.when(named, F.col("sha1")).otherwise(wrong.cast("string")).alias("payload_digest"))


def rebuild(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records as bytes, (header, payload, record): headers joined to their payloads.

    A revisit's record is its header alone; its payload is that of the response.
    """
    revisit = F.decode("header", "UTF-8").contains("WARC-Type: revisit")
    end = F.lit(b"\r\n\r\n")
    return _records(spark, archive).join(_payloads(spark, archive), "key").select(
        "header", "payload", F.when(revisit, F.concat("header", end)).otherwise(F.concat("header", "payload", end)).alias("record"))
