"""Screening, audit and counters as Structured Streaming jobs.

All of them run the batch functions on a stream. Sinks that are fed by ``foreachBatch`` write each
micro-batch to a folder of its own number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from guardframe.functions.pii import redact
from guardframe.operators.audit import audit, violations
from guardframe.operators.screening import screen
from guardframe.rules import DEFAULT_THRESHOLD

POLL = "2500 milliseconds"


def read_stream(
    spark: SparkSession, path: str, schema, pattern: str | None = None,
    max_files: int | None = 1000, max_bytes: str | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream; ``pattern`` selects files by name.

    A micro-batch takes at most ``max_files`` files or, if given, ``max_bytes`` of them, so a
    backlog is worked off in batches.
    """
    reader = spark.readStream.schema(schema).format("parquet")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    elif max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _trigger(writer, once: bool):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)


def screened_and_redacted(texts: DataFrame, text_col: str, threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """Verdict on the raw text, and the redacted text; works on batches and streams alike."""
    return screen(texts, text_col, threshold).withColumn(text_col, redact(F.col(text_col)))


def stream_screen(
    texts: DataFrame, text_col: str, path: str, checkpoint: str, once: bool = False,
    threshold=DEFAULT_THRESHOLD,
) -> StreamingQuery:
    """Screen and redact a stream of texts into a parquet sink."""
    writer = (
        screened_and_redacted(texts, text_col, threshold)
        .writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, once).start()


def stream_audit(
    requests: DataFrame, known: list[str], audited_path: str, violations_path: str,
    checkpoint: str, once: bool = False,
) -> StreamingQuery:
    """Audit a stream of requests; blocked ones also go to a sink of violation records.

    The violations are read back from the batch just written, so each request is screened once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{audited_path}/batch_id={batch_id}"
        audit(batch, known).write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.parquet(target)
        violations(written).write.mode("overwrite").parquet(f"{violations_path}/batch_id={batch_id}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, once).start()


def counter_events(audited: DataFrame) -> DataFrame:
    """One row per thing to count: the request, its block, its screening, and its categories."""
    def entry(kind: str, name, keep):
        return F.when(keep, F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    singles = F.array(
        entry("request", F.lit("processed"), ~F.col("op").eqNullSafe(F.lit("moderate"))),
        entry("request", F.lit("blocked"), F.col("security_alert")),
        entry("engine", F.col("engine"), F.col("engine").isNotNull()),
    )
    flagged = F.transform(
        F.when(F.col("event_type").isNotNull(), F.col("flagged_categories")).otherwise(F.array().cast("array<string>")),
        lambda name: F.struct(F.lit("category").alias("kind"), name.alias("name")),
    )
    return audited.select(F.explode(F.concat(F.array_compact(singles), flagged)).alias("e")).select("e.*")


def running_counts(audited: DataFrame) -> DataFrame:
    """Counts per kind and name; the key space is closed, so the state stays small."""
    return counter_events(audited).groupBy("kind", "name").agg(F.count("*").alias("n"))


def stream_counters(
    requests: DataFrame, known: list[str], path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Running counters in update mode: each batch writes the counters it changed.

    The state stays in as many tasks as it has partitions; only its few changed rows meet in one file.
    """
    def write(changed: DataFrame, batch_id: int) -> None:
        changed.repartition(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        running_counts(audit(requests, known)).writeStream.outputMode("update")
        .foreachBatch(write).option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, once).start()


def latest_counters(spark: SparkSession, path: str) -> DataFrame:
    """The current value of every counter that ``stream_counters`` has written."""
    return spark.read.parquet(path).groupBy("kind", "name").agg(F.max_by("n", "batch_id").alias("n"))
