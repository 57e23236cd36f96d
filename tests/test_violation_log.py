from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from guardframe.operators.audit import violations_latest
from guardframe.sources.scratch import scratch_path
from guardframe.sources.violation_log import RECORD, ViolationLog

START = datetime(2026, 1, 1)


def _record(i, time):
    return (i, "EVENT", f"details {i}", None if i % 2 else "text", ["a", "b"][: i % 3], time)


def _year(spark, per_day=5):
    rows = [_record(d * per_day + i, START + timedelta(days=d, hours=4 * i)) for d in range(60) for i in range(per_day)]
    return spark.createDataFrame(rows, RECORD)


@pytest.fixture()
def log(spark):
    return ViolationLog(spark, scratch_path(spark, "log"))


def _ids(df):
    return [r.request_id for r in df.collect()]


def test_newest_reads_the_newest_days_only(spark, log):
    records = _year(spark)
    log.append(records, "0")
    assert len(log.days()) == 60 and log.days()[0] == "2026-03-01"
    for n in (1, 5, 12, 300, 1000):
        assert _ids(log.newest(n)) == _ids(violations_latest(records).limit(n))
    files = {f.split("/_day=")[1].split("/")[0] for f in log.newest(7).inputFiles()}
    assert files == {"2026-03-01", "2026-02-28"}


def test_batches_are_stored_once(spark, log):
    records = _year(spark)
    log.append(records.where("request_id % 2 = 0"), "a")
    for _ in range(3):
        log.append(records.where("request_id % 2 = 1"), "b")
    assert sorted(_ids(log.read())) == list(range(300))
    assert log.read().columns == records.columns and log.read(["2026-01-01"]).count() == 5


def test_edges(spark, log):
    assert log.days() == [] and _ids(log.newest(3)) == [] and log.read().columns == _year(spark).columns
    log.append(_year(spark).limit(0), "none")
    assert _ids(log.newest(3)) == []
    # ties go to the larger request; a record without time is the oldest; the day is that of UTC
    noon = START + timedelta(hours=12)
    log.append(spark.createDataFrame([_record(1, noon), _record(3, noon), _record(2, None), _record(4, noon)], RECORD), "x")
    assert _ids(log.newest(9)) == [4, 3, 1, 2] and _ids(log.newest(0)) == []
    assert log.days() == ["2026-01-01", "none"]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        late = spark.range(1).select(F.lit(9).cast("bigint").alias("request_id"), *[
            F.lit(None).cast("string").alias(c) for c in ("event_type", "details", "flagged_text")],
            F.array().cast("array<string>").alias("categories"), F.timestamp_seconds(F.lit(1767225599)).alias("timestamp"))
        log.append(late, "y")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert log.days() == ["2026-01-01", "2025-12-31", "none"]


def test_hot_day_is_several_files(spark, log):
    rows = spark.range(20_000).select(
        F.col("id").alias("request_id"), F.lit("E").alias("event_type"), F.lit("d").alias("details"), F.lit("t").alias("flagged_text"),
        F.array(F.lit("c")).alias("categories"), F.timestamp_seconds(F.lit(1767225600) + F.col("id") % 3).alias("timestamp"))
    # small partitions are merged again unless this is off
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log.append(rows, "0")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(log.read().inputFiles()) > 2 and log.read().count() == 20_000
