"""State of a stream that is kept as small tables: running counters, and latencies over the last requests.

A micro-batch reads the table of the batch before it, folds itself in and writes the table of its own
number. A batch that is run again starts from the same table and replaces what it wrote, so every row
counts once. Older tables are dropped, so folders are bounded however long the stream runs. One
checkpoint belongs to one path: a stream with a new checkpoint counts batches from zero again.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from guardframe.operators.audit import audit
from guardframe.operators.telemetry import rolling_latency
from guardframe.rules import LATENCY_RING
from guardframe.streaming.jobs import _trigger, running_counts


class FoldedTable:
    """Tables ``batch=N`` below ``path``; the one with the highest number is the current one.

    The last ``keep`` complete ones stay, for readers that have begun and for a batch that is run again.
    A table whose write was broken off has no ``_SUCCESS`` file and is not seen.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        if keep < 2:
            raise ValueError("a batch that is run again needs the table before it")
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._at = lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the complete tables, in order; one listing of the folder."""
        if not self._fs.exists(self._at()):
            return []
        names = [entry.getPath().getName() for entry in self._fs.listStatus(self._at())]
        numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        return [n for n in numbers if self._fs.exists(self._at(f"batch={n}", "_SUCCESS"))]

    def _load(self, number: int, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/batch={number}")

    def before(self, batch_id: int, schema: T.StructType | str) -> DataFrame | None:
        """The table that batch ``batch_id`` starts from; none for the first."""
        earlier = [n for n in self.batches() if n < batch_id]
        return self._load(earlier[-1], schema) if earlier else None

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Write the table of a batch, then drop those that nothing starts from any more."""
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        for number in [n for n in self.batches() if n <= batch_id][:-self.keep]:
            self._fs.delete(self._at(f"batch={number}"), True)

    def current(self, schema: T.StructType | str) -> DataFrame:
        """The table of the newest batch; no rows before the first."""
        numbers = self.batches()
        return self._load(numbers[-1], schema) if numbers else self.spark.createDataFrame([], schema)


COUNTERS = "kind string, name string, n bigint"


def fold_counters(audited: DataFrame, batch_id: int, table: FoldedTable) -> None:
    """Add the counts of a batch of audited requests; the key space is closed, so the table is small."""
    counts = running_counts(audited)
    before = table.before(batch_id, COUNTERS)
    if before is not None:
        counts = counts.unionByName(before).groupBy("kind", "name").agg(F.sum("n").alias("n"))
    table.write(counts.coalesce(1), batch_id)


def live_counters(
    requests: DataFrame, known: list[str], path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Running counters in one table, see ``counters``; needs no state store."""
    table = FoldedTable(requests.sparkSession, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        fold_counters(audit(batch, known), batch_id, table)

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, once).start()


def counters(spark: SparkSession, path: str) -> DataFrame:
    """The current value of every counter that ``live_counters`` keeps."""
    return FoldedTable(spark, path).current(COUNTERS)


class RollingRing:
    """The average latency of the last ``ring`` requests for each request of a stream, in the order of event time.

    ``order_by`` identifies a request and starts with its event time. Requests wait until one has been
    seen that is ``delay`` younger; then they leave in order, by ``rolling_latency`` over them and the
    ``ring - 1`` requests that left before. So as long as no request is more than ``delay`` out of
    order, the rows are those of ``rolling_latency`` over the whole stream. One that comes after a
    younger one has left cannot be put in its place; it goes to ``late`` and is in no average.

    Below ``path``: ``rolled`` and ``late`` with a folder per batch, and ``state`` with the waiting
    requests and the ring. A request without event time sorts first: it leaves at once, if nothing has left yet.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, order_by: list[str],
                 delay: timedelta = timedelta(minutes=1), ring: int = LATENCY_RING, block_rows: int = 100_000):
        self.spark, self.path, self.order_by = spark, path.rstrip("/"), order_by
        self.delay, self.ring, self.block_rows = delay, ring, block_rows
        self.columns = [*order_by, "latency_ms"]
        self.table = FoldedTable(spark, f"{self.path}/state")
        self.schema = T.StructType([*[T.StructField(c, schema[c].dataType) for c in self.columns],
                                    T.StructField("_left", T.BooleanType())])

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch and let out what has waited long enough."""
        self._step(batch.select(*self.columns, F.lit(False).alias("_left")), batch_id, everything=False)

    def flush(self) -> None:
        """Let out all that waits, as a batch after the last. If the stream goes on, its next batch replaces this one."""
        numbers = self.table.batches()
        if numbers:
            self._step(self.spark.createDataFrame([], self.schema), numbers[-1] + 1, everything=True)

    def _step(self, new: DataFrame, batch_id: int, everything: bool) -> None:
        before = self.table.before(batch_id, self.schema)
        rows = new if before is None else new.unionByName(before)
        rows = rows.persist()  # a source is read once a batch; lost parts are worked out again
        try:
            self._let_out(rows, batch_id, everything)
        finally:
            rows.unpersist()

    def _let_out(self, rows: DataFrame, batch_id: int, everything: bool) -> None:
        key, time = F.struct(*self.order_by), F.col(self.order_by[0])
        seen = rows.agg(F.max(time).alias("newest"), F.max(F.when(F.col("_left"), key)).alias("last")).first()
        after = F.lit(True)
        if seen["last"] is not None:
            last = F.struct(*[F.lit(value).cast(self.schema[c].dataType).alias(c) for c, value in seen["last"].asDict().items()])
            after = key > last
        due = F.lit(True) if everything or seen["newest"] is None else F.coalesce(time <= F.lit(seen["newest"] - self.delay), F.lit(True))
        leaving = rows.where(F.col("_left") | (after & due))
        rolled = rolling_latency(leaving, self.order_by, self.ring, self.block_rows, store=f"{self.path}/sorted")
        rolled.where(after).write.mode("overwrite").parquet(f"{self.path}/rolled/batch_id={batch_id}")
        late = rows.where(~F.col("_left") & ~after).drop("_left")
        late.write.mode("overwrite").parquet(f"{self.path}/late/batch_id={batch_id}")
        newest = [F.desc(c) for c in self.order_by]
        # at least one row stays, which tells what has left
        tail = leaving.withColumn("_left", F.lit(True)).orderBy(*newest).limit(max(self.ring - 1, 1))
        self.table.write(tail.unionByName(rows.where(~F.col("_left") & after & ~due)), batch_id)

    def _read(self, name: str, schema: T.StructType | str) -> DataFrame:
        if not self.table.batches():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def rolled(self) -> DataFrame:
        """The requests that have left, with ``rolling_avg``."""
        return self._read("rolled", T.StructType([*self.schema.fields[:-1], T.StructField("rolling_avg", T.DoubleType())]))

    def late(self) -> DataFrame:
        """The requests that came too late for their place."""
        return self._read("late", T.StructType(self.schema.fields[:-1]))


def stream_rolling_latency(requests: DataFrame, ring: RollingRing, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Feed a stream of requests with ``latency_ms`` to a ring."""
    writer = requests.writeStream.foreachBatch(ring.write).option("checkpointLocation", checkpoint)
    return _trigger(writer, once).start()


def once_per_request(requests: DataFrame, within: str = "1 hour", key: str = "request_id") -> DataFrame:
    """A stream of requests without those that repeat the ``key`` of one that arrived before, up to ``within`` earlier.

    Time is that of arrival, so no request is ever too late to be kept, and the state holds the keys of
    the last ``within`` only. Requests without a key are all kept.
    """
    stamped = requests.select(
        "*",
        F.current_timestamp().alias("_arrived"),
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.uuid()).alias("_key"),
    )
    return stamped.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_key"]).drop("_arrived", "_key")

