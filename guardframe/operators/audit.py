"""Audit of a table or stream of read, insert, delete and moderation requests.

A moderation request is a free text in ``document`` that is screened without gates and leaves no
violation. Requests of any other kind, or of none, are refused. Gates are tried in a fixed order and the first that fails decides. Known gaps of the policy are
kept: deletes are not scanned for prohibited operators, only drops of core collections are
protected (not deletes), and an empty delete filter is refused after screening.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.functions.jsondoc import (
    canonical_json,
    document_text,
    is_empty_filter,
    is_json,
    prohibited_operator,
    starts_object,
    string_leaves,
)
from guardframe.functions.text import text_array
from guardframe.operators.screening import screen
from guardframe.rules import (
    DELETE_DETAILS,
    DELETE_EVENT,
    DELETE_TEXT,
    DROP_DETAILS,
    DROP_EVENT,
    DROP_PROTECTED,
    DROP_TEXT,
    INSERT_DETAILS,
    INSERT_EVENT,
    OPERATOR_DETAILS,
    OPERATOR_EVENT,
    POLICY_CATEGORIES,
    QUERY_DETAILS,
    QUERY_EVENT,
    WRITE_DETAILS,
    WRITE_EVENT,
    WRITE_PROTECTED,
    WRITE_TEXT,
)

REQUESTS_SCHEMA = (
    "request_id bigint, op string, collection string, query string, projection string,"
    " document string, drop_collection boolean, threshold double,"
    " started_at timestamp, finished_at timestamp"
)


#: The kinds of request; others are refused.
KINDS = ["read", "insert", "delete", "moderate"]


def known_collection(collection: Column, known: list[str]) -> Column:
    """Collection gate; ``known`` is the catalog's list of names."""
    return F.coalesce(collection.isin(known), F.lit(False))


def given(text: Column, default: str = "{}") -> Column:
    """An absent or empty query is the default."""
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(text)


def bad_json(text: Column) -> Column:
    """JSON gate for an optional text."""
    return ~is_json(given(text))


def delete_payload(collection: Column, query: Column, drop: Column) -> Column:
    """The text that is screened for a delete or drop."""
    return F.format_string(DELETE_TEXT, collection, query, F.when(drop, "True").otherwise("False"))


def audit(requests: DataFrame, known: list[str]) -> DataFrame:
    """Add the decision on each request.

    ``outcome`` names the gate that decided or the approval; ``security_alert`` marks blocks, which
    also have ``event_type``, ``details``, ``flagged_text`` and ``flagged_categories``. ``engine``
    is set where the text was screened. Requests are screened once, whatever their kind.
    """
    op = F.col("op")
    drop = F.coalesce(F.col("drop_collection"), F.lit(False))
    uses_query = op.isin("read", "delete")
    is_known = known_collection(F.col("collection"), known)
    # each text is parsed once, and only where a gate asks for it
    parsed = requests.select(
        "*",
        is_known.alias("_known"),
        F.when(is_known & uses_query, canonical_json(given(F.col("query")))).alias("_query"),
        F.when(is_known & (op == "insert"), is_json(F.col("document"))).alias("_document_json"),
    )
    policy = parsed.select(
        "*",
        F.when(op == "read", prohibited_operator(F.col("query"), F.col("_query"))).alias("_operator"),
        F.when(op == "insert", F.col("collection").isin(WRITE_PROTECTED))
        .when(op == "delete", drop & F.col("collection").isin(DROP_PROTECTED))
        .otherwise(False).alias("_protected"),
    )
    moderate = op == "moderate"
    gate = (
        F.when(~F.coalesce(op.isin(KINDS), F.lit(False)), "unknown_operation")
        .when(moderate, F.lit(None))
        .when(~F.col("_known"), "unknown_collection")
        .when(F.col("_protected"), "protected")
        .when(uses_query & F.col("_query").isNull(), "bad_query_json")
        .when(F.col("_operator").isNotNull(), "prohibited_operator")
        .when((op == "read") & bad_json(F.col("projection")), "bad_projection_json")
        .when((op == "insert") & ~F.col("_document_json"), "bad_document_json")
        .when((op == "insert") & ~starts_object(F.col("document")), "document_not_object")
    )
    gated = policy.select("*", gate.alias("_gate"))
    text = F.when(
        F.col("_gate").isNull(),
        F.when(moderate, F.coalesce("document", F.lit("")))
        .when(op == "read", document_text(given(F.col("query"))))
        .when(op == "insert", string_leaves(F.col("document")))
        .when(op == "delete",
              delete_payload(F.col("collection"), document_text(given(F.col("query"))), drop)),
    )
    texts = gated.select("*", text.alias("_text"))
    screened = screen(texts, "_text", F.coalesce(F.col("threshold"), F.lit(0.5)), "_screen")
    return _decide(screened, requests.columns, op, drop)


def _decide(screened: DataFrame, keep: list[str], op: Column, drop: Column) -> DataFrame:
    gate, verdict = F.col("_gate"), F.col("_screen")
    was_screened = F.col("_text").isNotNull()
    unsafe = was_screened & ~verdict["safe"]
    moderate = F.coalesce(op == "moderate", F.lit(False))
    attack = unsafe & ~moderate
    operator, protected = gate == "prohibited_operator", gate == "protected"

    def by_op(read, insert, delete):
        return F.when(op == "read", read).when(op == "insert", insert).when(op == "delete", delete)

    event = (
        F.when(operator, OPERATOR_EVENT)
        .when(protected, by_op(None, WRITE_EVENT, DROP_EVENT))
        .when(attack, by_op(QUERY_EVENT, INSERT_EVENT, DELETE_EVENT))
    )
    collection = F.col("collection")
    details = (
        F.when(operator, F.format_string(OPERATOR_DETAILS, F.col("_operator")))
        .when(protected, by_op(None, F.format_string(WRITE_DETAILS, collection),
                               F.format_string(DROP_DETAILS, collection)))
        .when(attack, by_op(F.format_string(QUERY_DETAILS, collection),
                            F.format_string(INSERT_DETAILS, collection),
                            F.format_string(DELETE_DETAILS, collection)))
    )
    flagged_text = (
        F.when(operator, F.col("query"))
        .when(protected, by_op(None, F.format_string(WRITE_TEXT, F.col("document")),
                               F.format_string(DROP_TEXT, collection)))
        .when(attack, F.col("_text"))
    )
    categories = (
        F.when(operator | protected, text_array(POLICY_CATEGORIES))
        .when(unsafe, verdict["flagged_categories"])
    )
    outcome = (
        F.when(operator | protected | attack, "blocked")
        .when(gate.isNotNull(), gate)
        .when(moderate, F.when(unsafe, "flagged").otherwise("passed"))
        .when(op == "read", "allowed")
        .when(op == "insert", "approved")
        .when(op == "delete", F.when(drop, "drop_allowed")
              .when(is_empty_filter(F.col("_query")), "empty_filter_refused")
              .otherwise("delete_allowed"))
    )
    return screened.select(
        *keep,
        outcome.alias("outcome"),
        F.coalesce(operator | protected | attack, F.lit(False)).alias("security_alert"),
        event.alias("event_type"),
        details.alias("details"),
        flagged_text.alias("flagged_text"),
        categories.alias("flagged_categories"),
        F.when(was_screened, verdict["engine"]).alias("engine"),
        unsafe.alias("screen_blocked"),
    )


def violations(audited: DataFrame) -> DataFrame:
    """One record per blocked request."""
    return audited.where(F.col("event_type").isNotNull()).select(
        "request_id", "event_type", "details", "flagged_text",
        F.col("flagged_categories").alias("categories"),
        F.col("finished_at").alias("timestamp"),
    )


def violations_latest(records: DataFrame) -> DataFrame:
    """The violation log, newest first."""
    return records.orderBy(F.desc("timestamp"), F.desc("request_id"))
