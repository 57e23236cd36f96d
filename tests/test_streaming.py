import pytest
from pyspark.sql import functions as F

from guardframe.operators.audit import audit, violations
from guardframe.plans import inputs
from guardframe.plans.queries import QUERIES
from guardframe.sources.scratch import scratch_path
from guardframe.streaming import jobs


def _split(spark, sf_dir, name, parts):
    """The table in several files, so that a stream needs several batches."""
    path = scratch_path(spark, name)
    inputs.table(spark, sf_dir, name).repartition(parts).write.parquet(path)
    return path


def _stream(spark, path):
    schema = spark.read.parquet(path).schema
    return jobs.read_stream(spark, path, schema, max_files=1)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_screen_stream_equals_batch(spark, sf_dir):
    path, out = _split(spark, sf_dir, "documents", 3), scratch_path(spark, "out")
    query = jobs.stream_screen(inputs.screen_input(_stream(spark, path)), "text", f"{out}/s", f"{out}/c", once=True)
    query.awaitTermination()
    batch = jobs.screened_and_redacted(inputs.screen_input(spark.read.parquet(path)), "text")
    assert _rows(spark.read.parquet(f"{out}/s")) == _rows(batch)


def test_audit_stream_equals_batch(spark, sf_dir):
    path, out = _split(spark, sf_dir, "events", 3), scratch_path(spark, "out")
    requests = inputs.requests_from(_stream(spark, path))
    jobs.stream_audit(requests, inputs.KNOWN, f"{out}/a", f"{out}/v", f"{out}/c", once=True).awaitTermination()
    batch = audit(inputs.requests_from(spark.read.parquet(path)), inputs.KNOWN)
    assert _rows(spark.read.parquet(f"{out}/a").drop("batch_id")) == _rows(batch)
    assert _rows(spark.read.parquet(f"{out}/v").drop("batch_id")) == _rows(violations(batch))
    assert spark.read.parquet(f"{out}/a").select("batch_id").distinct().count() == 3


def test_counters_run_over_batches(spark, sf_dir):
    path, out = _split(spark, sf_dir, "events", 3), scratch_path(spark, "out")
    requests = inputs.requests_from(_stream(spark, path))
    jobs.stream_counters(requests, inputs.KNOWN, f"{out}/n", f"{out}/c", once=True).awaitTermination()
    batch = jobs.running_counts(audit(inputs.requests_from(spark.read.parquet(path)), inputs.KNOWN))
    assert _rows(jobs.latest_counters(spark, f"{out}/n")) == _rows(batch)
    total = jobs.latest_counters(spark, f"{out}/n").where("name = 'processed'").first().n
    # moderation requests are screenings, not processed queries
    assert total == inputs.table(spark, sf_dir, "events").where("event_id % 17 <> 9").count()
    assert spark.read.parquet(f"{out}/n").where(F.col("name") == "processed").count() == 3


@pytest.mark.parametrize("name", ["stream_screen", "stream_audit", "stream_counters", "live_counters", "stream_rolling100",
                                  "stream_violations_once"])
def test_tables_in_several_files_are_streamed(spark, sf_dir, tmp_path, name):
    for given in ("documents", "events"):
        rows = inputs.table(spark, sf_dir, given)
        rows.repartition(3).write.parquet(f"{tmp_path}/{given}.parquet")
    want = _rows(QUERIES[name](spark, sf_dir))
    assert want and _rows(QUERIES[name](spark, str(tmp_path))) == want


def test_partitioned_tables_are_streamed(spark, sf_dir, tmp_path):
    inputs.table(spark, sf_dir, "documents").write.partitionBy("lang").parquet(f"{tmp_path}/documents.parquet")
    assert _rows(QUERIES["stream_screen"](spark, str(tmp_path))) == _rows(QUERIES["stream_screen"](spark, sf_dir))
