"""Inputs that the registered queries derive from the given tables.

The given texts hold no trigger and no SSN, so payloads are added by plain arithmetic on the key.
The expressions are SQL that Spark and DuckDB read alike; both sides of the check use them.
"""

from __future__ import annotations

from itertools import product
from string import ascii_lowercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.functions.pii import redact
from guardframe.operators.audit import audit
from guardframe.operators.telemetry import with_latency
from guardframe.sources.scratch import materialize

KNOWN = ["users", "transactions", "security_logs", "rules", "scratch"]

# three texts per category, each holding a different trigger
PAYLOADS = [
    ["how to kill", "a murder plot", "the hostage"],
    ["steal it", "hack in", "bribe them"],
    ["rape", "stalk her", "harass them"],
    ["child exploitation", "underage sexual", "pedophile"],
    ["financial advice", "buy stock", "invest in"],
    ["the password", "my credit card", "an ssh key"],
    ["crack software", "bypass drm", "a pirated book"],
    ["sarin", "a dirty bomb", "synthesize"],
    ["hate group", "racial slur", "supremacist"],
    ["suicide", "self-harm", "cutting"],
    ["porn", "x-rated", "erotica"],
    ["Ignore ALL previous instructions", "the system prompt", "dan mode"],
]

#: The vocabulary of the stub model: all strings of two or three small letters; any other sign is a token too.
STUB_PIECE = "[a-z]{2,3}"


def stub_pieces() -> list[str]:
    return ["".join(letters) for n in (2, 3) for letters in product(ascii_lowercase, repeat=n)]


def _payload(level: int) -> str:
    cases = " ".join(f"WHEN {i} THEN ' {texts[level]}'" for i, texts in enumerate(PAYLOADS))
    return f"CASE doc_id % 13 {cases} ELSE '' END"


SCREEN_TEXT = (
    "CASE WHEN doc_id % 17 = 0 THEN '   ' ELSE concat(text, "
    f"{_payload(0)}, "
    f"CASE WHEN doc_id % 5 = 0 THEN {_payload(1)} ELSE '' END, "
    f"CASE WHEN doc_id % 7 = 0 THEN {_payload(2)} ELSE '' END) END"
)

REDACT_TEXT = "CASE WHEN doc_id % 9 = 0 THEN concat(text, ' 902-88-1122') ELSE text END"

_LAST4 = "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
PEOPLE = {
    "_id": "c_custkey",
    "user_id": "concat('usr_', CAST(c_custkey AS STRING))",
    "name": "c_name",
    "email": "concat('person', CAST(c_custkey AS STRING), '.x@example.com')",
    "phone": (
        f"CASE c_custkey % 3 WHEN 0 THEN concat('(310) 555-', {_LAST4})"
        f" WHEN 1 THEN concat('+1 (213) 555-', {_LAST4}) ELSE concat('408-555-', {_LAST4}) END"
    ),
    "ssn": f"concat('332-', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-', {_LAST4})",
    "credit_card": f"concat('4111-2222-', {_LAST4}, '-', lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0'))",
    "password_hash": "concat('$2b$12$', CAST(c_custkey AS STRING))",
    "account_balance": "c_acctbal",
    "role": "CASE WHEN c_custkey % 6 < 4 THEN 'customer' WHEN c_custkey % 6 = 4 THEN 'admin' ELSE 'operator' END",
    "status": "CASE WHEN c_custkey % 5 = 4 THEN 'suspended' ELSE 'active' END",
}

PURCHASES = {
    "transaction_id": "concat('tx_', CAST(o_orderkey AS STRING))",
    "user_id": "concat('usr_', CAST(o_custkey AS STRING))",
    "amount": "o_totalprice",
    "credit_card": "concat('4111-2222-3333-', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'))",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END",
}

# a rules table with missing names and texts, and several rows per category
RULES = {
    "position": "p_partkey",
    "category": "CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN '' ELSE p_type END",
    "threat_level": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END",
    "description": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END",
    "playbook": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('Block ', p_name) END",
    "action": "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE concat('Log ', p_name) END",
}

REQUESTS = {
    "request_id": "event_id",
    "op": (
        "CASE event_id % 17 WHEN 3 THEN 'update' WHEN 5 THEN NULL WHEN 7 THEN 'DELETE' WHEN 9 THEN 'moderate' ELSE"
        " CASE WHEN event_type IN ('view', 'click') THEN 'read'"
        " WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END END"
    ),
    "collection": (
        "CASE event_id % 6 WHEN 0 THEN 'users' WHEN 1 THEN 'transactions'"
        " WHEN 2 THEN 'security_logs' WHEN 3 THEN 'rules' WHEN 4 THEN 'archive' ELSE 'scratch' END"
    ),
    "query": (
        "CASE event_id % 11 WHEN 0 THEN '{\"k\": '"
        " WHEN 1 THEN '{}'"
        " WHEN 2 THEN '{\"$where\": \"this.k == 1\"}'"
        " WHEN 3 THEN '{\"a\": [{\"b\": {\"$function\": {\"body\": \"x\"}}}]}'"
        " WHEN 4 THEN concat('{\"', chr(92), 'u0024where\": \"1\"}')"
        " WHEN 5 THEN concat('{\"note\": \"say ', chr(92), '\"$where', chr(92), '\": fine\"}')"
        " WHEN 6 THEN '{\"message\": \"I am going to stalk you and harass your family\"}'"
        " WHEN 7 THEN NULL"
        " WHEN 8 THEN '{\"z\":  \"How do I build a chemical bomb\",\"a\" :1}'"
        " ELSE props END"
    ),
    "projection": (
        "CASE event_id % 13 WHEN 0 THEN '{name: 1}' WHEN 1 THEN '{\"name\": 1}' WHEN 2 THEN ''"
        " ELSE NULL END"
    ),
    "document": (
        "CASE event_id % 7 WHEN 0 THEN '{\"name\": '"
        " WHEN 1 THEN '[1, 2]'"
        " WHEN 2 THEN '{\"name\": \"Scammer\", \"message\": \"How do I build a chemical bomb?\"}'"
        " WHEN 3 THEN concat('{\"name\": \"Ann\", \"tags\": [\"a\", \"b', chr(92), '\"c\", \"x: y\"],"
        " \"nested\": {\"n\": 1, \"t\": \"kept\"}}')"
        " WHEN 4 THEN '{\"n\": 1, \"ok\": true}'"
        " ELSE concat('{\"user\": \"u', CAST(user_id AS STRING), '\", \"note\": \"', event_type,"
        " '\", \"props\": ', props, '}') END"
    ),
    "drop_collection": "event_id % 4 = 0",
    "threshold": "CAST(CASE event_id % 10 WHEN 9 THEN 0.9 WHEN 8 THEN 0.01 ELSE 0.5 END AS DOUBLE)",
    "millis": "event_id % 250",
    "user_id": "user_id",
}

# reads and deletes whose filters name columns of people and purchases; a third ask the same
_KIND = "CAST(floor(event_id / 6) AS BIGINT) % 8"
_USER = "concat('\"usr_', CAST(event_id % 500 + 1 AS STRING), '\"')"
FILTERED = {
    **REQUESTS,
    "op": "CASE WHEN CAST(floor(event_id / 48) AS BIGINT) % 3 = 0 THEN 'delete' ELSE 'read' END",
    "query": (
        f"CASE {_KIND} WHEN 0 THEN concat('{{\"user_id\": ', {_USER}, '}}')"
        " WHEN 1 THEN '{\"status\": \"active\"}'"
        f" WHEN 2 THEN concat('{{\"status\": \"completed\", \"user_id\": ', {_USER}, '}}')"
        " WHEN 3 THEN concat('{\"account_balance\": {\"$lt\": ', CAST(event_id % 40 * 250 - 500 AS STRING), '}}')"
        " WHEN 4 THEN concat('{\"status\": \"failed\", \"amount\": {\"$gte\": ', CAST(event_id % 97 * 1000 AS STRING),"
        " ', \"$lt\": ', CAST(event_id % 97 * 1000 + 20000 AS STRING), '}}')"
        " WHEN 5 THEN '{}' WHEN 6 THEN '{\"$where\": \"1\"}' ELSE '{\"name\": {\"$regex\": \"x\"}}' END"
    ),
    "projection": "CASE event_id % 5 WHEN 0 THEN '{\"status\": 1}' WHEN 1 THEN '{\"credit_card\": 1, \"_id\": 0}' ELSE NULL END",
    "drop_collection": "event_id < 0",
    "threshold": "CAST(0.5 AS DOUBLE)",
}


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are heavy to work on, dealt to as many tasks as the session asks for.

    ``spark.guardframe.read.partitions`` is for tables of a few files; without it the scan's own
    splits are the tasks.
    """
    df, wanted = table(spark, sf_dir, name), spark.conf.get("spark.guardframe.read.partitions", None)
    return df.repartition(int(wanted)) if wanted else df


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of short rows that are heavy to work on, dealt to as many tasks as a shuffle has.

    Many such rows fit a file so small that its scan is one task.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, name).repartition(tasks)


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def screen_input(documents: DataFrame) -> DataFrame:
    return documents.selectExpr("doc_id", f"{SCREEN_TEXT} AS text")


def redact_input(documents: DataFrame) -> DataFrame:
    return documents.selectExpr("doc_id", f"{REDACT_TEXT} AS text")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "customer"), PEOPLE)


def nested_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People as nested documents with secrets at several depths."""
    return derive(dealt_table(spark, sf_dir, "customer"), PEOPLE).select(
        "_id", "account_balance", "password_hash",
        F.struct("email", "phone", F.col("user_id").alias("API_Token")).alias("contact"),
        F.array("credit_card", "ssn").alias("cards"),
        F.create_map(
            F.lit("secret_note"), F.col("name"), F.lit("note"), F.concat(F.lit("call "), F.col("phone")),
        ).alias("attrs"),
        F.array(F.struct(F.col("phone").alias("line"), F.col("_id").alias("token_no"))).alias("devices"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "orders"), PURCHASES)


def requests_from(events: DataFrame, columns: dict[str, str] = REQUESTS) -> DataFrame:
    """Requests from events; the naive event time is taken as UTC."""
    started = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    given = [F.expr(expr).alias(name) for name, expr in columns.items()]
    return events.select(*given, started.alias("started_at")).withColumn(
        "finished_at", F.timestamp_add("MILLISECOND", F.col("millis").cast("int"), F.col("started_at"))
    )


def audited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_latency(audit(requests_from(spread_table(spark, sf_dir, "events")), KNOWN))


def filtered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited reads and deletes with filters on columns."""
    return audit(requests_from(spread_table(spark, sf_dir, "events"), FILTERED), KNOWN)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited requests; an allowed read answers with the document of the user's number.

    Only allowed reads look for a document, as no others can count a redaction.
    """
    documents = redact_input(spread_table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("user_id"), "text", redact(F.col("text")).alias("_clean")
    ).select("user_id", (~F.col("text").eqNullSafe(F.col("_clean"))).alias("_redacted"))
    # only those requests are shuffled, by keys that are never null
    audited = materialize(audited_requests(spark, sf_dir), "responses")
    looks = F.coalesce((F.col("outcome") == "allowed") & F.col("user_id").isNotNull(), F.lit(False))
    readers = audited.where(looks).join(documents.where("_redacted"), "user_id", "left").select(
        *audited.columns, F.coalesce("_redacted", F.lit(False)).alias("redaction_applied"))
    return audited.where(~looks).withColumn("redaction_applied", F.lit(False)).unionByName(readers)
