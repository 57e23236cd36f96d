"""The registered queries: each takes a session and a folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.functions import jsondoc, pii, text
from guardframe.operators import access, audit, redaction, request_sets, screening, telemetry, token_bound
from guardframe.plans import inputs
from guardframe.plans.inputs import KNOWN, table
from guardframe.rules import CATEGORIES
from guardframe.sources import generate, snapshots, tables, violation_log
from guardframe.sources.scratch import materialize, scratch_path
from guardframe.streaming import jobs, live

Query = Callable[[SparkSession, str], DataFrame]
BASE_TIME = "2026-05-27 12:00:00"


# --- screening --------------------------------------------------------------------------

def _screen_input(spark, sf_dir):
    return inputs.screen_input(inputs.spread_table(spark, sf_dir, "documents"))


def _screened(spark, sf_dir, threshold=0.5):
    return screening.screen(_screen_input(spark, sf_dir), "text", threshold)


def _flat(df, *keys):
    """The verdict struct as plain columns."""
    verdict = F.col("screen")
    return df.select(
        *keys,
        verdict["safe"].alias("safe"),
        F.array_join(verdict["flagged_categories"], "|").alias("flagged"),
        verdict["max_probability"].alias("max_probability"),
        verdict["engine"].alias("engine"),
    )


def _category_columns(values, name="c"):
    return [values[i].alias(f"{name}{i}") for i in range(len(CATEGORIES))]


def screen_empty(spark, sf_dir):
    stripped = text.strip_text(F.concat(F.lit(" \n\t"), F.col("text"), F.lit("\x1f　")))
    return _screen_input(spark, sf_dir).select(
        "doc_id", F.length(stripped).cast("bigint").alias("n_stripped"),
        screening.is_empty_text(F.col("text")).alias("is_empty"),
    )


def category_matches(spark, sf_dir):
    counted = screening.match_counts(_screen_input(spark, sf_dir), "text")
    return counted.select("doc_id", *_category_columns(F.col("matches")))


def category_scores(spark, sf_dir):
    scores = F.map_values(F.col("screen.probabilities"))
    return _screened(spark, sf_dir).select("doc_id", scores.alias("s")).select(
        "doc_id", *_category_columns(F.col("s"), "s"))


def flagged_categories(spark, sf_dir):
    # a threshold per row: 0.0 to 1.0 in steps of 0.05
    threshold = (F.col("doc_id") % 21) / 20.0
    return _screened(spark, sf_dir, threshold).select(
        "doc_id", F.array_join("screen.flagged_categories", "|").alias("flagged"))


def screen_verdict(spark, sf_dir):
    return _flat(_screened(spark, sf_dir, 0.7), "doc_id").drop("flagged")


def screen_text(spark, sf_dir):
    return _flat(_screened(spark, sf_dir), "doc_id")


def stub_model():
    """Logits from text lengths, so that SQL can repeat them; fails on every 97th length."""
    def predict(texts: np.ndarray) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        if (lengths % 97 == 0).any():
            raise ValueError("no prediction for this text")
        return np.stack([(lengths * (k + 3) % 17 - 8) / 4.0 for k in range(len(CATEGORIES))], axis=1)

    return predict


def score_with_model(spark, sf_dir):
    scored = screening.score_with_model(_screen_input(spark, sf_dir), "text", stub_model)
    return _flat(scored, "doc_id").withColumn("max_probability", F.round("max_probability", 9))


def score_with_model_bounded(spark, sf_dir):
    def bound(sought):
        return token_bound.first_tokens(sought, inputs.stub_pieces, longest=3)
    scored = screening.score_with_model(
        _screen_input(spark, sf_dir), "text", stub_model, bound=bound, by_length=True)
    return _flat(scored, "doc_id").withColumn("max_probability", F.round("max_probability", 9))


def score_override(spark, sf_dir):
    scores = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("doc_id") + i) % 10) / 10.0)
    given = F.map_from_arrays(screening.category_array(), scores).alias("given")
    scored = _screen_input(spark, sf_dir).select("doc_id", "text", given)
    fixed = screening.override_scores(scored, "text", "given")
    return fixed.select("doc_id", F.map_values("given").alias("s")).select(
        "doc_id", *_category_columns(F.col("s"), "s"))


def scores_long(spark, sf_dir):
    return screening.scores_long(_screened(spark, sf_dir), ["doc_id"])


def screen_counters(spark, sf_dir):
    return screening.screen_counters(_screened(spark, sf_dir))


# --- redaction --------------------------------------------------------------------------

def _documents(spark, sf_dir):
    return inputs.redact_input(inputs.spread_table(spark, sf_dir, "documents"))


def _masked(mask):
    return lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", mask(F.col("text")).alias("text"))


def redact_text(spark, sf_dir):
    return redaction.redact_columns(_documents(spark, sf_dir), "text")


def redaction_flag(spark, sf_dir):
    flagged = redaction.redact_with_flag(_documents(spark, sf_dir))
    return flagged.select("doc_id", "redaction_applied")


def redaction_count(spark, sf_dir):
    return redaction.redaction_count(redaction.redact_with_flag(_documents(spark, sf_dir)))


def _flat_people(df):
    return df.select(
        "_id", "account_balance", "password_hash",
        F.col("contact.email").alias("email"), F.col("contact.phone").alias("phone"),
        F.col("contact.API_Token").alias("api_token"),
        F.array_join("cards", "|").alias("cards"),
        F.col("attrs")["secret_note"].alias("secret_note"), F.col("attrs")["note"].alias("note"),
        F.col("devices")[0]["line"].alias("line"), F.col("devices")[0]["token_no"].cast("string").alias("token_no"),
    )


def mask_sensitive_keys(spark, sf_dir):
    return _flat_people(redaction.mask_sensitive_keys(inputs.nested_people(spark, sf_dir)))


def redact_document(spark, sf_dir):
    return _flat_people(redaction.redact_document(inputs.nested_people(spark, sf_dir)))


def redact_json(spark, sf_dir):
    people = inputs.nested_people(spark, sf_dir)
    as_text = people.select("_id", F.to_json(F.struct(*people.columns[1:])).alias("doc"))
    clean = as_text.select("_id", jsondoc.redact_json("doc").alias("doc"))
    paths = {"password_hash": "$.password_hash", "email": "$.contact.email", "phone": "$.contact.phone",
             "api_token": "$.contact.API_Token", "card": "$.cards[0]", "secret_note": "$.attrs.secret_note",
             "note": "$.attrs.note", "token_no": "$.devices[0].token_no",
             "account_balance": "$.account_balance"}
    got = [F.get_json_object("doc", path).alias(name) for name, path in paths.items()]
    return clean.select("_id", *got).withColumn("account_balance", F.col("account_balance").cast("double"))


# --- sources, reads and writes ----------------------------------------------------------

def collection_counts(spark, sf_dir):
    return tables.Catalogue(spark, sf_dir).counts()


def read_collection(spark, sf_dir):
    return tables.Catalogue(spark, sf_dir).read("customer")


def _guarded(spark, sf_dir):
    return access.guarded_read(
        inputs.people(spark, sf_dir),
        (F.col("status") == "active") & (F.col("account_balance") < 5000.0),
        include=["_id", "name", "email", "phone", "credit_card", "password_hash", "account_balance"],
        order_by=["_id"],
    )


def guarded_read_summary(spark, sf_dir):
    return access.read_summary(_guarded(spark, sf_dir))


def filter_eq(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).select(
        "l_orderkey", "l_linenumber", "l_quantity")


def filter_range(spark, sf_dir):
    bought = inputs.purchases(spark, sf_dir)
    return bought.where(F.col("amount") < 50000.0).select("transaction_id", "amount", "status")


def project_include(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")


def project_exclude(spark, sf_dir):
    return inputs.people(spark, sf_dir).drop("_id", "ssn", "password_hash")


def limit_50(spark, sf_dir):
    return inputs.purchases(spark, sf_dir).select("transaction_id", "amount").orderBy(
        F.desc("amount"), "transaction_id").limit(50)


def append_insert(spark, sf_dir):
    bought, path = inputs.purchases(spark, sf_dir), scratch_path(spark, "append_insert")
    tables.append_documents(bought.where(F.col("status") == "failed"), path)
    tables.append_documents(bought.where(F.col("status") != "failed"), path)
    return tables.read_collection(spark, path, schema=bought.schema)


def replace_table(spark, sf_dir):
    path = scratch_path(spark, "replace_table")
    tables.replace_documents(inputs.people(spark, sf_dir).select("user_id", "status"), path)
    bought = inputs.purchases(spark, sf_dir)
    tables.replace_documents(bought, path)
    return tables.read_collection(spark, path, schema=bought.schema)


def seed_if_empty(spark, sf_dir):
    path, people = scratch_path(spark, "seed_if_empty"), inputs.people(spark, sf_dir)
    tables.seed_if_empty(people.where(F.lit(False)), path)
    tables.seed_if_empty(people, path)
    tables.seed_if_empty(people.withColumn("role", F.lit("late")), path)
    return tables.read_collection(spark, path, schema=people.schema)


def guarded_delete(spark, sf_dir):
    bought, path = inputs.purchases(spark, sf_dir), scratch_path(spark, "guarded_delete")
    deleted = tables.guarded_delete(
        bought, (F.col("status") == "failed") & (F.col("amount") < 100000.0), path)
    kept = tables.read_collection(spark, path, schema=bought.schema)
    return kept.select("transaction_id", "amount", "status", F.lit(deleted).cast("bigint").alias("deleted_count"))


def _collections(spark, sf_dir):
    return {"users": request_sets.Collection(inputs.people(spark, sf_dir), "_id"),
            "transactions": request_sets.Collection(inputs.purchases(spark, sf_dir), "transaction_id")}


def request_reads(spark, sf_dir):
    """The documents of every allowed read, told by their digests."""
    answers = request_sets.answer_reads(inputs.filtered_requests(spark, sf_dir), _collections(spark, sf_dir))
    return answers.select("request_id", "collection", "nth", "redaction_applied", *[
        F.get_json_object("document", f"$.{c}").alias(c) for c in ("_id", "user_id", "credit_card", "status")])


def gated_read(spark, sf_dir):
    return access.gated_read(inputs.filtered_requests(spark, sf_dir), _collections(spark, sf_dir))


def gated_delete(spark, sf_dir):
    """Every delete request, and what is left of the transactions after all."""
    table_ = snapshots.Snapshots(spark, scratch_path(spark, "gated_delete"))
    table_.append(inputs.purchases(spark, sf_dir), "first")
    done = access.gated_delete(inputs.filtered_requests(spark, sf_dir), "transactions", table_)
    return done.withColumn("kept", F.lit(table_.read().count()).cast("bigint"))


def snapshot_delete(spark, sf_dir):
    """Two appends, one of them repeated, and a delete by positions."""
    table_, bought = snapshots.Snapshots(spark, scratch_path(spark, "snapshot_delete")), inputs.purchases(spark, sf_dir)
    for batch, status in (("a", "failed"), ("b", "completed"), ("a", "failed")):
        table_.append(bought.where(F.col("status") == status), batch)
    deleted = table_.delete((F.col("status") == "failed") & (F.col("amount") < 100000.0))
    return table_.read().select("transaction_id", "amount", "status", F.lit(deleted).cast("bigint").alias("deleted_count"))


def insert_again(spark, sf_dir):
    """All inserts twice over: the second run stores nothing."""
    accepted, quarantine = scratch_path(spark, "accepted"), scratch_path(spark, "quarantine")
    for _ in range(2):
        access.insert_split(inputs.audited_requests(spark, sf_dir), accepted, quarantine)
    sinks = [spark.read.schema("request_id long").parquet(path).agg(F.count("*").alias("rows"), F.sum("request_id").alias("ids"))
             .select(F.lit(sink).alias("sink"), "rows", "ids") for sink, path in (("accepted", accepted), ("quarantine", quarantine))]
    return sinks[0].unionAll(sinks[1])


def rules_lookup(spark, sf_dir):
    return tables.rules_lookup(inputs.derive(table(spark, sf_dir, "part"), inputs.RULES), "position")


def _base_time():
    return F.to_timestamp(F.lit(BASE_TIME))


def gen_users(spark, sf_dir):
    return generate.gen_users(table(spark, sf_dir, "customer"), "c_custkey")


def gen_transactions(spark, sf_dir):
    n_users = table(spark, sf_dir, "customer").count()
    return generate.gen_transactions(table(spark, sf_dir, "orders"), n_users, _base_time(), "o_orderkey")


def gen_logs(spark, sf_dir):
    return generate.gen_logs(table(spark, sf_dir, "events"), _base_time(), "event_id")


# --- request audit ----------------------------------------------------------------------

def _requests(spark, sf_dir, op=None):
    requests = inputs.requests_from(inputs.spread_table(spark, sf_dir, "events"))
    return requests.where(F.col("op") == op) if op else requests


def audit_collection(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "request_id", "collection", audit.known_collection(F.col("collection"), KNOWN).alias("known"))


def audit_json(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "request_id",
        audit.bad_json(F.col("query")).alias("bad_query"),
        audit.bad_json(F.col("projection")).alias("bad_projection"),
        (~jsondoc.is_json(F.col("document"))).alias("bad_document"),
        jsondoc.is_json_object(F.col("document")).alias("document_is_object"),
    )


def audit_operators(spark, sf_dir):
    query = audit.given(F.col("query"))
    canonical = _requests(spark, sf_dir, "read").select(
        "request_id", query.alias("query"), jsondoc.canonical_json(query).alias("canonical"))
    return canonical.select(
        "request_id",
        jsondoc.prohibited_operator(F.col("query"), F.col("canonical")).alias("operator"))


def string_leaves(spark, sf_dir):
    valid = _requests(spark, sf_dir).where(jsondoc.is_json(F.col("document")))
    return valid.select("request_id", jsondoc.string_leaves(F.col("document")).alias("leaves"))


def _decisions(op):
    def query(spark, sf_dir):
        return audit.audit(_requests(spark, sf_dir, op), KNOWN).select(
            "request_id", "outcome", "security_alert", "event_type",
            F.array_join("flagged_categories", "|").alias("flagged"), "engine")
    return query


def insert_split(spark, sf_dir):
    accepted, quarantine = scratch_path(spark, "accepted"), scratch_path(spark, "quarantine")
    access.insert_split(inputs.audited_requests(spark, sf_dir), accepted, quarantine)
    kinds = "request_id long, document string, collection string"
    stored = spark.read.schema(kinds).parquet(accepted).select(
        F.lit("accepted").alias("sink"), "request_id", "collection",
        jsondoc.redact_json("document").alias("document"), F.lit(None).cast("string").alias("event_type"))
    kinds = "request_id long, collection string, document string, event_type string"
    held = spark.read.schema(kinds).parquet(quarantine).select(
        F.lit("quarantine").alias("sink"), "request_id", "collection", "document", "event_type")
    both = stored.unionByName(held)
    return both.withColumn("document", F.regexp_replace("document", "[ \n]", ""))


def insert_results(spark, sf_dir):
    return access.insert_results(inputs.audited_requests(spark, sf_dir))


def _violations(spark, sf_dir):
    return audit.violations(inputs.audited_requests(spark, sf_dir))


def _flat_violations(df):
    return df.select("request_id", "event_type", "details", "flagged_text",
                     F.array_join("categories", "|").alias("categories"),
                     text.iso_utc(F.col("timestamp")).alias("timestamp"))


def violations(spark, sf_dir):
    return _flat_violations(_violations(spark, sf_dir))


def violations_latest(spark, sf_dir):
    # the log is stored first: a range sort reads its input twice, once for the bounds
    log = materialize(_violations(spark, sf_dir), "violation_log")
    return audit.violations_latest(log).select(
        "request_id", "event_type", text.iso_utc(F.col("timestamp")).alias("timestamp"))


def violations_newest(spark, sf_dir):
    log = violation_log.ViolationLog(spark, scratch_path(spark, "violation_log"))
    log.append(_violations(spark, sf_dir), "0")
    return _flat_violations(log.newest(100))


# --- telemetry --------------------------------------------------------------------------

def request_counters(spark, sf_dir):
    return telemetry.request_counters(inputs.responses(spark, sf_dir))


def _timed(spark, sf_dir):
    return telemetry.with_latency(inputs.requests_from(table(spark, sf_dir, "events")))


def latency_ms(spark, sf_dir):
    return _timed(spark, sf_dir).select("request_id", "latency_ms")


def avg_latency(spark, sf_dir):
    return telemetry.avg_latency(_timed(spark, sf_dir))


def latency_rolling100(spark, sf_dir):
    rolled = telemetry.rolling_latency(_timed(spark, sf_dir), ["started_at", "request_id"])
    return rolled.select("request_id", "latency_ms", "rolling_avg")


def latency_last100(spark, sf_dir):
    return telemetry.last_latency(_timed(spark, sf_dir), ["started_at", "request_id"])


def _triggers(spark, sf_dir):
    return telemetry.category_triggers(_violations(spark, sf_dir), tables.static_rules(spark))


def category_share(spark, sf_dir):
    return telemetry.category_share(_triggers(spark, sf_dir))


def stats_row(spark, sf_dir):
    row = telemetry.stats_row(inputs.responses(spark, sf_dir), collection_counts(spark, sf_dir))
    counts = F.transform(F.map_entries("document_counts"),
                         lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return row.withColumn("document_counts", F.array_join(counts, "|"))


def blocked_total(spark, sf_dir):
    return telemetry.blocked_total(inputs.audited_requests(spark, sf_dir))


# --- streams ----------------------------------------------------------------------------

def _stream(spark, sf_dir, name):
    """A table as a stream: the files of its folder or, where it is one file, that file.

    A source lists folders only, and a name pattern holds for the files in them, not for the folder's own name.
    """
    schema = table(spark, sf_dir, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return jobs.read_stream(spark, f"{sf_dir}/{name}.parquet", schema)
    return jobs.read_stream(spark, sf_dir, schema, f"{name}.parquet")


def stream_screen(spark, sf_dir):
    path = scratch_path(spark, "stream_screen")
    texts = inputs.screen_input(_stream(spark, sf_dir, "documents"))
    query = jobs.stream_screen(texts, "text", f"{path}/sink", f"{path}/checkpoint", once=True)
    query.awaitTermination()
    return _flat(spark.read.parquet(f"{path}/sink"), "doc_id", "text")


def stream_audit(spark, sf_dir):
    path = scratch_path(spark, "stream_audit")
    requests = inputs.requests_from(_stream(spark, sf_dir, "events"))
    query = jobs.stream_audit(requests, KNOWN, f"{path}/audited", f"{path}/violations",
                              f"{path}/checkpoint", once=True)
    query.awaitTermination()
    return _flat_violations(spark.read.parquet(f"{path}/violations"))


def stream_counters(spark, sf_dir):
    path = scratch_path(spark, "stream_counters")
    requests = inputs.requests_from(_stream(spark, sf_dir, "events"))
    query = jobs.stream_counters(requests, KNOWN, f"{path}/counts", f"{path}/checkpoint", once=True)
    query.awaitTermination()
    return jobs.latest_counters(spark, f"{path}/counts")


def live_counters(spark, sf_dir):
    path = scratch_path(spark, "live_counters")
    requests = inputs.requests_from(_stream(spark, sf_dir, "events"))
    live.live_counters(requests, KNOWN, f"{path}/counts", f"{path}/checkpoint", once=True).awaitTermination()
    return live.counters(spark, f"{path}/counts")


def stream_rolling100(spark, sf_dir):
    path = scratch_path(spark, "stream_rolling100")
    timed = telemetry.with_latency(inputs.requests_from(_stream(spark, sf_dir, "events")))
    ring = live.RollingRing(spark, f"{path}/ring", timed.schema, ["started_at", "request_id"])
    live.stream_rolling_latency(timed, ring, f"{path}/checkpoint", once=True).awaitTermination()
    ring.flush()
    return ring.rolled().select("request_id", "latency_ms", "rolling_avg")


def stream_violations_once(spark, sf_dir):
    path = scratch_path(spark, "stream_violations_once")
    # a source that gives every request twice
    events = _stream(spark, sf_dir, "events").unionByName(_stream(spark, sf_dir, "events"))
    requests = live.once_per_request(inputs.requests_from(events))
    query = jobs.stream_audit(requests, KNOWN, f"{path}/audited", f"{path}/violations",
                              f"{path}/checkpoint", once=True)
    query.awaitTermination()
    return _flat_violations(spark.read.parquet(f"{path}/violations"))


QUERIES: dict[str, Query] = {
    "screen_empty": screen_empty,
    "category_matches": category_matches,
    "category_scores": category_scores,
    "flagged_categories": flagged_categories,
    "screen_verdict": screen_verdict,
    "screen_text": screen_text,
    "score_override": score_override,
    "score_with_model": score_with_model,
    "score_with_model_bounded": score_with_model_bounded,
    "scores_long": scores_long,
    "screen_counters": screen_counters,
    "mask_email": _masked(pii.mask_email),
    "mask_card": _masked(pii.mask_card),
    "mask_ssn": _masked(pii.mask_ssn),
    "mask_phone": _masked(pii.mask_phone),
    "redact_text": redact_text,
    "mask_sensitive_keys": mask_sensitive_keys,
    "redact_document": redact_document,
    "redaction_flag": redaction_flag,
    "redact_json": redact_json,
    "redaction_count": redaction_count,
    "collection_counts": collection_counts,
    "read_collection": read_collection,
    "guarded_read": _guarded,
    "guarded_read_summary": guarded_read_summary,
    "filter_eq": filter_eq,
    "filter_range": filter_range,
    "project_include": project_include,
    "project_exclude": project_exclude,
    "limit_50": limit_50,
    "append_insert": append_insert,
    "replace_table": replace_table,
    "seed_if_empty": seed_if_empty,
    "guarded_delete": guarded_delete,
    "request_reads": request_reads,
    "gated_read": gated_read,
    "gated_delete": gated_delete,
    "snapshot_delete": snapshot_delete,
    "rules_lookup": rules_lookup,
    "gen_users": gen_users,
    "gen_transactions": gen_transactions,
    "gen_logs": gen_logs,
    "audit_collection": audit_collection,
    "audit_json": audit_json,
    "audit_operators": audit_operators,
    "string_leaves": string_leaves,
    "audit_read": _decisions("read"),
    "audit_insert": _decisions("insert"),
    "audit_delete": _decisions("delete"),
    "insert_split": insert_split,
    "insert_again": insert_again,
    "insert_results": insert_results,
    "violations": violations,
    "violations_latest": violations_latest,
    "violations_newest": violations_newest,
    "request_counters": request_counters,
    "latency_ms": latency_ms,
    "avg_latency": avg_latency,
    "latency_rolling100": latency_rolling100,
    "latency_last100": latency_last100,
    "category_triggers": _triggers,
    "category_share": category_share,
    "stats_row": stats_row,
    "blocked_total": blocked_total,
    "stream_screen": stream_screen,
    "stream_audit": stream_audit,
    "stream_counters": stream_counters,
    "live_counters": live_counters,
    "stream_rolling100": stream_rolling100,
    "stream_violations_once": stream_violations_once,
}
