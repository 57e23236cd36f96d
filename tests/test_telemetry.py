import pytest
from pyspark.sql import functions as F

from guardframe.operators import telemetry as T
from guardframe.sources import tables


@pytest.mark.parametrize("n, ring, block", [(0, 5, 10), (7, 100, 100), (1000, 100, 100), (1000, 7, 64), (500, 1, 1)])
def test_rolling_latency_crosses_blocks(spark, n, ring, block):
    # ids in another order than time, and many equal times
    df = spark.range(n).select(
        F.col("id").alias("request_id"), (F.col("id") * 7919 % 251).alias("ts"),
        (F.xxhash64("id") % 1000).alias("latency_ms"))
    got = [(r.request_id, r.rolling_avg) for r in
           T.rolling_latency(df, ["ts", "request_id"], ring, block).orderBy("ts", "request_id").collect()]
    ordered = df.orderBy("ts", "request_id").collect()
    values = [r.latency_ms for r in ordered]
    want = [(r.request_id, sum(values[max(0, i - ring + 1):i + 1]) / len(values[max(0, i - ring + 1):i + 1]))
            for i, r in enumerate(ordered)]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_rolling_latency_has_no_single_task_window(spark):
    df = spark.range(100).select(F.col("id").alias("ts"), F.col("id").alias("latency_ms"))
    plan = T.rolling_latency(df, ["ts"], 10, 20)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    # the one without a key numbers the sort partitions, after they are reduced to a row each
    assert plan.index("Window [avg") < plan.index("Window [sum") < plan.index("Aggregate [_part")


def test_latency_is_truncated(spark):
    row = spark.sql("SELECT timestamp'2026-01-01 00:00:00' AS a, timestamp'2026-01-01 00:00:01.9999' AS b")
    assert row.select(T.latency_ms(F.col("a"), F.col("b"))).first()[0] == 1999


def test_averages(spark):
    df = spark.range(1, 251).select(F.col("id").alias("ts"), F.col("id").alias("latency_ms"))
    assert T.avg_latency(df).first()[0] == 125
    assert T.avg_latency(df.where("ts < 0")).first()[0] == 0
    assert T.last_latency(df, ["ts"]).first().asDict() == {"avg_last": 200.5, "n_last": 100}


def _records(spark):
    return spark.createDataFrame(
        [(["Hate"],), (["Hate", "Privacy"],), (["Hate", "unheard of"],), ([],)], "categories array<string>")


def test_triggers_and_shares(spark):
    triggers = T.category_triggers(_records(spark), tables.static_rules(spark))
    counts = {r.category: r.triggers for r in triggers.collect()}
    assert len(counts) == 12 and counts["Hate"] == 3 and counts["Privacy"] == 1 and sum(counts.values()) == 4
    share = {r.category: r.percent for r in T.category_share(triggers).collect()}
    assert share["Hate"] == 100 and share["Privacy"] == 33 and share["Sexual content"] == 0
    none = T.category_share(T.category_triggers(_records(spark).limit(0), tables.static_rules(spark)))
    assert {r.percent for r in none.collect()} == {0}


def test_stats_row(spark):
    audited = spark.createDataFrame([
        ("read", True, True, "fallback", None, 10), ("delete", True, False, None, None, 20),
        ("read", False, False, "fallback", True, 31), ("insert", False, False, "empty_input", False, 40),
        (None, False, False, "model", None, 41), ("moderate", False, True, "model", None, 26),
    ], "op string, security_alert boolean, screen_blocked boolean, engine string, redaction_applied boolean, latency_ms bigint")
    counts = tables.collection_counts({"b": spark.range(2), "a": spark.range(1)})
    row = T.stats_row(audited, counts).first().asDict()
    assert row.pop("document_counts") == {"a": 1, "b": 2}
    assert row == {
        "queries_processed": 5, "blocked_requests": 2, "total_redactions": 1, "reported_blocked": 4,
        "avg_latency_ms": 28, "total_inferences": 5, "local_model_hits": 2, "fallback_hits": 2,
        "empty_inputs": 1, "active_engine": "fallback"}
    assert T.blocked_total(audited).first().asDict() == {"reported_blocked": 4, "blocked_requests": 2}
