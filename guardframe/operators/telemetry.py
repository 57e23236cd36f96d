"""Counters, latencies and category statistics over audited requests.

Expected columns: those of ``audit`` plus, for reads that were run, ``redaction_applied``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardframe.rules import ENGINE_EMPTY, ENGINE_KEYWORDS, ENGINE_MODEL, LATENCY_RING
from guardframe.sources.scratch import materialize


def latency_ms(started: Column, finished: Column) -> Column:
    """Whole milliseconds between two timestamps, truncated."""
    micros = F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.floor(micros / 1000).cast("bigint")


def with_latency(requests: DataFrame) -> DataFrame:
    return requests.withColumn("latency_ms", latency_ms(F.col("started_at"), F.col("finished_at")))


def _processed() -> list[Column]:
    return [
        # moderation requests count as screenings only
        F.count_if(~F.col("op").eqNullSafe(F.lit("moderate"))).alias("queries_processed"),
        F.count_if(F.col("security_alert")).alias("blocked_requests"),
        F.count_if(F.coalesce(F.col("redaction_applied"), F.lit(False))).alias("total_redactions"),
    ]


def _average() -> Column:
    return F.coalesce(F.floor(F.avg("latency_ms")), F.lit(0)).cast("bigint").alias("avg_latency_ms")


def _inferences() -> list[Column]:
    engine = F.col("engine")
    return [
        F.count("engine").alias("total_inferences"),
        F.count_if(engine == ENGINE_MODEL).alias("local_model_hits"),
        F.count_if(engine == ENGINE_KEYWORDS).alias("fallback_hits"),
        F.count_if(engine == ENGINE_EMPTY).alias("empty_inputs"),
    ]


def _reported_blocked() -> Column:
    # a request blocked for its content counts twice: as a request and as a screening
    both = F.count_if(F.col("security_alert")) + F.count_if(F.col("screen_blocked"))
    return both.alias("reported_blocked")


def request_counters(audited: DataFrame) -> DataFrame:
    """Requests processed, requests blocked, and reads with anything redacted."""
    return audited.agg(*_processed())


def avg_latency(requests: DataFrame) -> DataFrame:
    """Average latency, truncated; zero when there are no requests."""
    return requests.agg(_average())


def blocked_total(audited: DataFrame) -> DataFrame:
    """The reported total of blocked attacks next to the plain number of blocked requests."""
    return audited.agg(
        _reported_blocked(), F.count_if(F.col("security_alert")).alias("blocked_requests")
    )


def last_latency(requests: DataFrame, order_by: list[str], ring: int = LATENCY_RING) -> DataFrame:
    """Average latency of the last requests only."""
    newest = [F.desc(c) for c in order_by]
    return requests.orderBy(*newest).limit(ring).agg(
        F.avg("latency_ms").alias("avg_last"), F.count("*").alias("n_last")
    )


def rolling_latency(
    requests: DataFrame,
    order_by: list[str],
    ring: int = LATENCY_RING,
    block_rows: int = 100_000,
    store: str | None = None,
) -> DataFrame:
    """For each request, the average latency of the last ``ring`` requests up to it.

    The ring runs over all requests, which as one window would put every row into one task.
    Instead the rows are numbered by a range sort and cut into blocks of equal size; each block
    also gets the last ``ring - 1`` rows of the one before, and the window runs within blocks. The
    sort is written out once, so that the numbers cannot change if a part is worked out again; it goes to
    ``store``, replacing what is there, or to a folder of its own. ``order_by`` must identify a request.
    """
    if not 1 <= ring <= block_rows:
        raise ValueError("ring must be between 1 and block_rows")
    ranged = (
        requests.select(*order_by, "latency_ms")
        .repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # the id holds the partition in its upper bits and the row within it in the lower 33
    rows = materialize(ranged, "rolling_latency", store).select(
        *order_by, "latency_ms",
        F.shiftright("_at", 33).alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg((F.max("_row") + 1).alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    # one row per sort partition, whatever the number of requests
    numbered = rows.join(F.broadcast(starts), "_part").select(
        *order_by, "latency_ms", (F.col("_start") + F.col("_row")).alias("_n")
    )
    block = F.floor(F.col("_n") / block_rows).cast("bigint")
    in_tail = F.col("_n") % block_rows > block_rows - ring
    spread = numbered.select(
        "*",
        block.alias("_own"),
        F.explode(F.when(in_tail, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"),
    )
    last = Window.partitionBy("_block").orderBy("_n").rowsBetween(-(ring - 1), 0)
    return (
        spread.withColumn("rolling_avg", F.avg("latency_ms").over(last))
        .where(F.col("_block") == F.col("_own"))
        .select(*order_by, "latency_ms", "rolling_avg")
    )


def category_triggers(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations per known category, with zeros; unknown categories are dropped."""
    counts = (
        records.select(F.explode("categories").alias("category")).groupBy("category")
        .agg(F.count("*").alias("n"))
    )
    known = rules.select("category").distinct()
    return known.join(counts, "category", "left").select(
        "category", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("triggers")
    )


def category_share(triggers: DataFrame) -> DataFrame:
    """Each category's count as a rounded percentage of the largest one."""
    # one row per rule, so a single window over all of them is small
    largest = F.greatest(F.max("triggers").over(Window.partitionBy()), F.lit(1))
    percent = F.floor(100.0 * F.col("triggers") / largest + 0.5).cast("bigint")
    return triggers.select("category", "triggers", percent.alias("percent"))


def stats_row(audited: DataFrame, counts: DataFrame, active_engine: str = ENGINE_KEYWORDS) -> DataFrame:
    """All counters, the average latency and the inventory as one row.

    The two one-row parts are stacked and folded, which needs no join.
    """
    telemetry = audited.agg(
        *_processed(), _reported_blocked(), _average(), *_inferences()
    ).withColumn("active_engine", F.lit(active_engine))
    # one entry per collection name
    inventory = counts.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("collection", "documents"))))
        .alias("document_counts")
    )
    stacked = telemetry.unionByName(inventory, allowMissingColumns=True)
    return stacked.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in stacked.columns])
