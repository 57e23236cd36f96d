"""Whole tables of requests against a plain reading of each."""

import json
import random

import pytest
from pyspark.sql import functions as F

from guardframe.operators import audit, request_sets
from guardframe.operators.joins import lookup
from guardframe.operators.request_sets import Collection, answer_reads, deleted_rows, read_results, with_conditions

KNOWN = ["users", "transactions", "empty"]


def requests(spark, rows):
    fields = [f.split(" ")[0] for f in audit.REQUESTS_SCHEMA.split(", ")]
    data = [tuple({"request_id": i, "op": "read", "collection": "users"} .get(f) if f not in r else r[f] for f in fields) for i, r in enumerate(rows)]
    return audit.audit(spark.createDataFrame(data, audit.REQUESTS_SCHEMA), KNOWN)


def fits(query, row):
    for field, wanted in json.loads(query or "{}").items():
        value = row.get(field)
        if isinstance(wanted, dict):
            for op, bound in wanted.items():
                if value is None or isinstance(value, bool) or isinstance(value, str) != isinstance(bound, str):
                    return False
                if not {"$lt": value < bound, "$lte": value <= bound, "$gt": value > bound, "$gte": value >= bound}[op]:
                    return False
        elif value is None or wanted is None:
            if value is not wanted:
                return False
        elif isinstance(value, bool) != isinstance(wanted, bool) or isinstance(value, str) != isinstance(wanted, str) or value != wanted:
            return False
    return True


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["ann", "bo", None, "hot", "hot", "hot"]), rng.choice([None, 1.5, -2.0, 30.0, float(k)]), k % 3 == 0, f"p{k}@x.org")
            for k in range(700)]
    df = spark.createDataFrame(rows, "_id long, name string, amount double, active boolean, email string")
    return df, [dict(zip(df.columns, r)) for r in rows]


QUERIES = [
    None, "", "{}", '{"name": "ann"}', '{"name": "hot"}', '{"name": null}', '{"_id": 77}', '{"_id": 77.0}', '{"_id": "77"}',
    '{"active": true, "name": "hot"}', '{"amount": {"$lt": 2}}', '{"amount": {"$gte": 30, "$lt": 400.5}, "name": "hot"}', '{"amount": null}',
    '{"name": {"$gt": "b"}, "active": false}', '{"nothing": 1}', '{"nothing": null, "_id": {"$lte": 3}}', '{"nothing": {"$lt": 1}}', '{"active": "true"}',
    '{"name": {"$lt": 5}}', '{"amount": {"$gt": "a"}}',
]


def test_every_read_is_answered(spark, people):
    df, plain = people
    audited = requests(spark, [dict(query=q) for q in QUERIES * 3] + [dict(query="{}", collection="empty"), dict(query="{}", collection="nowhere")])
    got = {}
    for r in answer_reads(audited, {"users": Collection(df, "_id")}).collect():
        got.setdefault(r["request_id"], []).append((r["nth"], json.loads(r["document"])["_id"]))
    for i, q in enumerate(QUERIES * 3):
        wanted = [str(r["_id"]) for r in plain if fits(q, r)][:50]
        assert sorted(got.get(i, [])) == list(enumerate(wanted, 1)), q
    assert max(got) < len(QUERIES) * 3


def test_a_read_of_another_collection_gets_nothing_of_this_one(spark, people):
    audited = requests(spark, [dict(query='{"user_id": "nobody"}', collection="transactions"), dict(query="{}", collection="transactions"),
                               dict(query='{"$where": "1"}'), dict(query='{"name": {"$regex": "x"}}'), dict(query='{"a": [1]}'), dict(op="delete")])
    answers = answer_reads(audited, {"users": Collection(people[0], "_id")})
    assert answers.collect() == []
    assert [tuple(r)[1:] for r in read_results(audited, answers).orderBy("request_id").collect()] == [
        ("allowed", 0, False), ("allowed", 0, False), ("blocked", 0, False), ("unsupported_filter", 0, False), ("unsupported_filter", 0, False)]


def test_documents_are_projected_and_redacted(spark, people):
    audited = requests(spark, [dict(query='{"_id": 3}', projection=p) for p in (None, '{"email": 1}', '{"_id": 0, "email": 1}', '{"email": 0, "name": 0}')])
    answers = answer_reads(audited, {"users": Collection(people[0], "_id")})
    got = {r["request_id"]: json.loads(r["document"]) for r in answers.collect()}
    row = people[1][3]
    assert got[1] == {"_id": "3", "email": "p***3@x.org"} and got[2] == {"email": "p***3@x.org"}
    assert got[0] == {k: v for k, v in {**row, "_id": "3", "email": "p***3@x.org"}.items() if v is not None}
    assert got[3] == {k: v for k, v in {**row, "_id": "3"}.items() if v is not None and k not in ("email", "name")}
    assert {r["request_id"]: r["redaction_applied"] for r in answers.collect()} == {0: True, 1: True, 2: True, 3: False}


def test_deletes_run_in_order(spark, people):
    df, plain = people
    queries = ['{"name": "ann"}', '{"amount": {"$lt": 2}}', "{}", '{"name": "ann"}', '{"active": true}']
    audited = requests(spark, [dict(op="delete", query=q) for q in queries] + [dict(op="delete", query='{"name": "bo"}', collection="transactions")])
    got = {r["_id"]: r["request_id"] for r in deleted_rows(audited, "users", df, ["_id"]).collect()}
    wanted = {r["_id"]: min(i for i in (0, 1, 4) if fits(queries[i], r)) for r in plain if any(fits(queries[i], r) for i in (0, 1, 4))}
    assert got == wanted
    assert deleted_rows(audited.where("request_id = 2"), "users", df, ["_id"]).collect() == []


def test_conditions(spark):
    texts = ['{"a": 1, "b": {"$lt": 2}}', "[1]", "3", '{"a": {"b": 1}}', '{"a": {}}', '{"$or": 1}', "{bad", '{"a": {"$lt": null}}']
    df = spark.createDataFrame([(t,) for t in texts], "query string")
    assert [r["readable"] for r in with_conditions(df).collect()] == [True] + [False] * 7


def test_rows_without_requests(spark, people):
    audited = requests(spark, [dict(op="read")]).limit(0)
    assert answer_reads(audited, {"users": Collection(people[0], "_id")}).collect() == []


def test_lookup_equals_a_join_with_hot_and_null_keys(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 9000).alias("key"), "id")
    table = rows.where("key % 2 = 1").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    own = lambda df: sorted(map(tuple, df.select("key", "id", "first").collect()))
    assert own(lookup(rows, table, "key", "n")) == own(rows.join(table.drop("n"), "key"))
    assert request_sets.SALTS > 1
