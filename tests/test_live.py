from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from guardframe.operators.audit import audit, violations
from guardframe.operators.telemetry import rolling_latency, with_latency
from guardframe.plans import inputs
from guardframe.sources.scratch import scratch_path
from guardframe.streaming import jobs, live

ORDER = ["started_at", "request_id"]


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _stream(spark, path):
    return jobs.read_stream(spark, path, spark.read.parquet(path).schema, max_files=1)


@pytest.fixture(scope="module")
def audited(spark, sf_dir):
    path = scratch_path(spark, "audited")
    audit(inputs.requests_from(inputs.table(spark, sf_dir, "events")), inputs.KNOWN).write.parquet(path)
    return spark.read.parquet(path)


def test_counters_stay_one_table(spark, sf_dir, audited):
    path, out = scratch_path(spark, "events"), scratch_path(spark, "out")
    inputs.table(spark, sf_dir, "events").repartition(5).write.parquet(path)
    requests = inputs.requests_from(_stream(spark, path))
    live.live_counters(requests, inputs.KNOWN, f"{out}/n", f"{out}/c", once=True).awaitTermination()
    assert _rows(live.counters(spark, f"{out}/n")) == _rows(jobs.running_counts(audited))
    assert live.FoldedTable(spark, f"{out}/n").batches() == [2, 3, 4]
    # a restart finds nothing new and counts nothing twice
    live.live_counters(requests, inputs.KNOWN, f"{out}/n", f"{out}/c", once=True).awaitTermination()
    assert _rows(live.counters(spark, f"{out}/n")) == _rows(jobs.running_counts(audited))


def test_batch_run_again_counts_once(spark, audited):
    table = live.FoldedTable(spark, scratch_path(spark, "n"))
    halves = [audited.where("crc32(cast(request_id as string)) % 2 = 0"), audited.where("crc32(cast(request_id as string)) % 2 = 1")]
    for part, number in [(0, 0), (1, 1), (1, 1)]:
        live.fold_counters(halves[part], number, table)
    assert _rows(table.current(live.COUNTERS)) == _rows(jobs.running_counts(audited))
    live.fold_counters(audited.limit(0), 2, table)
    assert _rows(table.current(live.COUNTERS)) == _rows(jobs.running_counts(audited))


def test_counters_of_nothing(spark, audited):
    table = live.FoldedTable(spark, scratch_path(spark, "n"))
    assert table.current(live.COUNTERS).count() == 0
    live.fold_counters(audited.limit(0), 0, table)
    assert table.current(live.COUNTERS).count() == 0 and table.batches() == [0]


def test_broken_table_is_not_seen(spark, audited):
    table = live.FoldedTable(spark, scratch_path(spark, "n"))
    live.fold_counters(audited, 0, table)
    live.fold_counters(audited, 1, table)
    table._fs.delete(table._at("batch=1", "_SUCCESS"), False)
    assert _rows(table.current(live.COUNTERS)) == _rows(jobs.running_counts(audited))
    live.fold_counters(audited, 1, table)
    twice = jobs.running_counts(audited).withColumn("n", F.col("n") * 2)
    assert _rows(table.current(live.COUNTERS)) == _rows(twice)


def _ring(spark, schema, **options):
    return live.RollingRing(spark, scratch_path(spark, "ring"), schema, **{"order_by": ORDER, **options})


def test_ring_in_five_batches_equals_the_whole(spark, sf_dir):
    timed = with_latency(inputs.requests_from(inputs.table(spark, sf_dir, "events")))
    span = timed.agg(F.unix_micros(F.min("started_at")).alias("a"), F.unix_micros(F.max("started_at")).alias("b")).first()
    fifth = (span.b - span.a) // 5 + 1
    # a request arrives up to a tenth of the span after its time
    arrival = F.unix_micros("started_at") + F.crc32(F.col("request_id").cast("string")) % (fifth // 2)
    batches = timed.withColumn("_batch", F.least(F.floor((arrival - span.a) / fifth), F.lit(4)))
    ring = _ring(spark, timed.schema, delay=timedelta(microseconds=fifth // 2), ring=20, block_rows=50)
    whole = rolling_latency(timed, ORDER, 20)
    for i in range(5):
        ring.write(batches.where(F.col("_batch") == i), i)
        if i == 2:
            ring.flush()  # is replaced by the next batch
            ring.write(batches.where(F.col("_batch") == i), i)
    assert ring.rolled().count() < timed.count() and len(ring.table.batches()) <= 3
    ring.flush()
    assert _rows(ring.rolled().drop("batch_id")) == _rows(whole)
    assert ring.late().count() == 0


def _at(second, request, latency):
    return (datetime(2026, 5, 27, 12, 0, second) if second is not None else None, request, latency)


def _latencies(spark, *rows):
    return spark.createDataFrame(list(rows), "started_at timestamp, request_id string, latency_ms bigint")


def test_late_requests_are_set_aside(spark):
    schema = _latencies(spark).schema
    ring = _ring(spark, schema, delay=timedelta(seconds=10), ring=2)
    ring.write(_latencies(spark, _at(0, "a", 10), _at(5, "b", 20), _at(30, "c", 40)), 0)
    assert {r.request_id: r.rolling_avg for r in ring.rolled().collect()} == {"a": 10.0, "b": 15.0}
    # before b: too late; after b, though older than the newest: in its place; without time: too late
    ring.write(_latencies(spark, _at(3, "d", 1), _at(7, "e", 60), _at(None, "f", 1)), 1)
    ring.flush()
    assert {r.request_id: r.rolling_avg for r in ring.rolled().collect()} == {"a": 10.0, "b": 15.0, "e": 40.0, "c": 50.0}
    assert {r.request_id for r in ring.late().collect()} == {"d", "f"}


@pytest.mark.parametrize("size", [1, 3])
def test_ring_of_odd_batches(spark, size):
    schema = _latencies(spark).schema
    ring = _ring(spark, schema, delay=timedelta(0), ring=size)
    assert ring.rolled().count() == 0
    ring.write(_latencies(spark), 0)
    ring.write(_latencies(spark, _at(None, "a", 4), _at(1, "b", None)), 1)
    ring.write(_latencies(spark), 2)
    ring.write(_latencies(spark, _at(1, "c", 8)), 3)
    expected = {1: {"a": 4.0, "b": None, "c": 8.0}, 3: {"a": 4.0, "b": 4.0, "c": 6.0}}[size]
    assert {r.request_id: r.rolling_avg for r in ring.rolled().collect()} == expected


def test_violations_once_for_repeated_requests(spark, sf_dir, audited):
    path, out = scratch_path(spark, "events"), scratch_path(spark, "out")
    events = inputs.table(spark, sf_dir, "events")
    # the same files come three times, in batches of their own, and each holds some rows twice
    for _ in range(3):
        events.unionByName(events.where("event_id % 3 = 0")).coalesce(1).write.mode("append").parquet(path)
    requests = live.once_per_request(inputs.requests_from(_stream(spark, path)))
    jobs.stream_audit(requests, inputs.KNOWN, f"{out}/a", f"{out}/v", f"{out}/c", once=True).awaitTermination()
    assert _rows(spark.read.parquet(f"{out}/v").drop("batch_id")) == _rows(violations(audited))
    assert _rows(spark.read.parquet(f"{out}/a").drop("batch_id")) == _rows(audited)


def test_requests_without_id_are_all_kept(spark):
    path, out = scratch_path(spark, "ids"), scratch_path(spark, "out")
    spark.createDataFrame([(None, 1), (None, 1), ("a", 1), ("a", 2), ("", 3)], "request_id string, x int").coalesce(1).write.parquet(path)
    once = live.once_per_request(_stream(spark, path))
    once.writeStream.format("parquet").option("path", f"{out}/s").option("checkpointLocation", f"{out}/c").trigger(
        availableNow=True).start().awaitTermination()
    ids = [r.request_id for r in spark.read.parquet(f"{out}/s").collect()]
    assert sorted(map(str, ids)) == ["", "None", "None", "a"]
