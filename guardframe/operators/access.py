"""Guarded reads, deletes and inserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.functions.jsondoc import redact_json
from guardframe.operators.redaction import redact_with_flag
from guardframe.operators.request_sets import Collection, answer_reads, deleted_rows, read_results, with_conditions
from guardframe.rules import READ_LIMIT
from guardframe.sources.scratch import materialize
from guardframe.sources.snapshots import PLACE, Snapshots


def guarded_read(
    df: DataFrame,
    predicate: Column | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    order_by: list[str] | None = None,
    limit: int = READ_LIMIT,
) -> DataFrame:
    """Filter, project and bound a collection, then redact what is left of it.

    Each row tells whether anything in it was redacted. Ordering by a key makes the bounded result
    repeatable; only the rows that pass the bound are redacted.
    """
    rows = df if predicate is None else df.where(predicate)
    if order_by:
        rows = rows.orderBy(*order_by)
    # the bound leaves one partition; naming it keeps the masks above the bound, which would
    # otherwise move below it and turn the top-k into a sort of the whole collection
    rows = rows.limit(limit).coalesce(1)
    if include:
        rows = rows.select(*include)
    if exclude:
        rows = rows.drop(*exclude)
    if "_id" in rows.columns:
        rows = rows.withColumn("_id", F.col("_id").cast("string"))
    return redact_with_flag(rows)


def read_summary(rows: DataFrame) -> DataFrame:
    """Document count and redaction flag of one guarded read."""
    return rows.agg(
        F.count("*").alias("document_count"),
        F.coalesce(F.bool_or("redaction_applied"), F.lit(False)).alias("redaction_applied"),
    )


def gated_read(audited: DataFrame, collections: dict[str, Collection], limit: int = READ_LIMIT) -> DataFrame:
    """Run all reads that the audit allows; every read with its outcome, document count and redaction flag.

    A request reads the collection and filter that it was audited for, and nothing else.
    """
    reads = materialize(audited.where(F.col("op") == "read"), "audited")
    return read_results(reads, materialize(answer_reads(reads, collections, limit), "gated_read"))


def gated_delete(audited: DataFrame, name: str, table: Snapshots) -> DataFrame:
    """Run all deletes on the collection ``name`` that the audit allows; every delete with its outcome and row count.

    Requests run in the order of their ids, so a row counts for the first that matches it. All are one change
    to ``table``, which is either made or not. Deletes on other collections count no rows here.
    """
    asked = materialize(audited.where(F.col("op") == "delete"), "audited")
    found = materialize(deleted_rows(asked, name, table.placed(), PLACE), "gated_delete")
    table.delete_places(found)
    deletes = with_conditions(asked).select("request_id", F.when(
        (F.col("outcome") == "delete_allowed") & ~F.col("readable"), "unsupported_filter").otherwise(F.col("outcome")).alias("outcome"))
    counts = found.groupBy("request_id").agg(F.count("*").alias("deleted"))
    return deletes.join(counts, "request_id", "left").select(
        "request_id", "outcome", F.coalesce("deleted", F.lit(0)).alias("deleted"))


def _digest() -> Column:
    """What tells insert requests apart: the same request, run again, has the same digest."""
    return F.sha2(F.concat_ws(":", F.col("request_id").cast("string"), F.col("document")), 256)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """Digests of the requests that a sink holds; None before its first write."""
    try:
        return spark.read.schema("request_id long, document string").parquet(path).select(_digest().alias("_digest"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def insert_results(audited: DataFrame) -> DataFrame:
    """The answer to every approved insert: the new document's id and its redacted echo.

    The id is a digest of request and document, so a request that is run again gets the same one.
    """
    return audited.where((F.col("op") == "insert") & (F.col("outcome") == "approved")).select(
        "request_id", "collection", F.substring(_digest(), 1, 24).alias("inserted_id"),
        redact_json("document").alias("document"))


def insert_split(audited: DataFrame, accepted_path: str, quarantine_path: str) -> None:
    """Append approved insert requests to their collections and the others to quarantine, each once.

    The audited rows are written once to the shared folder, so screening does not run twice and a
    lost executor cannot make the two outputs disagree. Refused requests that raised no alert (bad
    JSON, unknown collection) are in neither output, as they hold nothing to store or to review.

    Request ids and documents in a sink are its ledger: requests that it holds are left out by an anti-join, so a
    run that is repeated stores nothing, and one that stopped between or within the writes is completed.
    """
    columns = ["request_id", "collection", "document", "security_alert", "outcome",
               "event_type", "flagged_categories"]
    staged = materialize(
        audited.where((F.col("op") == "insert")
                      & ((F.col("outcome") == "approved") | F.col("security_alert"))).select(*columns)
        .withColumn("_digest", _digest()).dropDuplicates(["_digest"]),
        "insert_split",
    )

    def new(rows: DataFrame, path: str) -> DataFrame:
        stored = _stored(rows.sparkSession, path)
        return rows if stored is None else rows.join(stored, "_digest", "left_anti")

    approved = new(staged.where(~F.col("security_alert")), accepted_path).select("request_id", "collection", "document")
    # the collection gate has bounded the number of folders
    approved.write.mode("append").partitionBy("collection").parquet(accepted_path)
    new(staged.where("security_alert"), quarantine_path).select(
        "request_id", "collection", "document", "event_type", "flagged_categories"
    ).write.mode("append").parquet(quarantine_path)
