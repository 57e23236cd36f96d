import compare
import pytest
from pyspark.sql import functions as F

from guardframe.functions.text import iso_utc, without_credentials
from guardframe.operators import access
from guardframe.sources import generate, tables
from guardframe.sources.scratch import scratch_path
from guardframe.sources.seeds import CORE_USERS, USERS_SCHEMA


def _core_users(spark):
    return spark.createDataFrame(CORE_USERS, USERS_SCHEMA)


def test_read_of_one_user_is_redacted(spark):
    rows = access.guarded_read(_core_users(spark), F.col("user_id") == "usr_9918")
    row = rows.first()
    assert row.credit_card == "****-****-****-4444" and row.ssn == "***-**-****"
    assert row.email == "s***r@cyberdyne.org" and row.password_hash == "********"
    assert row.account_balance == 14250.75 and row.redaction_applied
    assert access.read_summary(rows).first().asDict() == {"document_count": 1, "redaction_applied": True}


def test_read_projections_bound_and_id(spark):
    df = spark.range(200).select(F.col("id").alias("_id"), F.lit("plain").alias("a"), F.lit(1).alias("b"))
    rows = access.guarded_read(df, F.col("_id") >= 100, exclude=["b"], order_by=["_id"])
    assert rows.columns == ["_id", "a", "redaction_applied"]
    assert [r._id for r in rows.orderBy(F.col("_id").cast("int")).collect()] == [str(i) for i in range(100, 150)]
    empty = access.guarded_read(df, F.col("_id") < 0, include=["a"])
    assert access.read_summary(empty).first().asDict() == {"document_count": 0, "redaction_applied": False}


def test_read_pushes_filter_and_columns_and_redacts_last(spark, sf_dir):
    orders = tables.read_collection(spark, f"{sf_dir}/orders.parquet")
    rows = access.guarded_read(orders, F.col("o_totalprice") < 5e4, include=["o_orderkey", "o_orderstatus"],
                               order_by=["o_orderkey"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_totalprice,50000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    assert plan.index("RLIKE") < plan.index("TakeOrderedAndProject(limit=50") and "Sort [" not in plan


def test_missing_values_match_no_range_and_survive_deletes(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "id int, amount double")
    assert [r.id for r in df.where(F.col("amount") < 10).collect()] == [1]
    path = scratch_path(spark, "deleted")
    assert tables.guarded_delete(df, F.col("amount") < 10, path) == 1
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3]
    with pytest.raises(ValueError):
        tables.guarded_delete(df, None, path)
    for predicate, gone in ((F.lit(True), 3), (F.lit(False), 0), (F.lit(None).cast("boolean"), 0)):
        path = scratch_path(spark, "constant")
        assert tables.guarded_delete(df, predicate, path) == gone
        assert spark.read.schema(df.schema).parquet(path).count() == 3 - gone


def test_writes(spark):
    path = scratch_path(spark, "writes")
    one, two = spark.range(3), spark.range(3, 5)
    assert tables.is_absent_or_empty(spark, path)
    assert tables.seed_if_empty(one.where("id < 0"), path)
    assert tables.seed_if_empty(one, path)
    assert not tables.seed_if_empty(two, path)
    tables.append_documents(two, path)
    assert spark.read.parquet(path).count() == 5
    tables.replace_documents(two, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]


def test_json_lines(spark):
    path = scratch_path(spark, "json")
    tables.append_documents(spark.range(2), path, fmt="json")
    assert not tables.seed_if_empty(spark.range(9), path, fmt="json")
    assert tables.read_collection(spark, path, "json", "id bigint").count() == 2


def test_collection_counts(spark):
    counts = tables.collection_counts({"a": spark.range(3), "b": spark.range(0)})
    assert {r.collection: r.documents for r in counts.collect()} == {"a": 3, "b": 0}


def test_rules_lookup(spark):
    schema = "position int, category string, threat_level string, description string, playbook string, action string"
    table = spark.createDataFrame([
        (1, "Hate", "LOW", "old", "old", None), (2, "Hate", None, "new", None, "act"),
        (3, None, "x", "x", "x", "x"), (4, "", "x", "x", "x", "x"), (5, "Own", "HIGH", None, "play", "act"),
    ], schema)
    got = {r.category: tuple(r)[1:] for r in tables.rules_lookup(table, "position").collect()}
    assert got == {"Hate": ("new", "", "act"), "Own": ("", "HIGH", "play")}
    static = tables.rules_lookup(table.where("position < 0"), "position").collect()
    assert {tuple(r) for r in static} == {tuple(r) for r in tables.static_rules(spark).select(
        "category", "description", "threat_level", "playbook").collect()}
    # rows without a category do not bring the static rules back
    assert tables.rules_lookup(table.where("category IS NULL"), "position").count() == 0


def test_generated_tables(spark):
    base = F.lit("2026-05-27 12:00:00").cast("timestamp")
    users = generate.gen_users(spark.range(5000)).cache()
    bought = generate.gen_transactions(spark.range(20000), 5000, base)
    logs = generate.gen_logs(spark.range(3000), base)
    assert users.count() == users.select("user_id").distinct().count() == 5004
    assert bought.count() == bought.select("transaction_id").distinct().count() == 20003
    assert logs.count() == logs.select("log_id").distinct().count() == 3002
    matched = bought.join(users, ["user_id", "credit_card"])
    assert matched.count() == 20003
    assert bought.select("user_id").distinct().count() > 4500
    share = {r.role: r["count"] / 5004 for r in users.groupBy("role").count().collect()}
    assert abs(share["customer"] - 4 / 6) < 0.03 and abs(share["admin"] - 1 / 6) < 0.03
    span = bought.where("transaction_id NOT IN ('tx_88190', 'tx_88191', 'tx_88192')").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    assert "2026-04-26T12:01:00Z" <= span.lo < "2026-04-28" and "2026-05-27" < span.hi <= "2026-05-27T12:00:00Z"
    assert users.where("user_id NOT IN ('usr_3310', 'usr_8820')").where("account_balance < -100 OR account_balance > 185000").count() == 0
    assert users.where(~F.col("ssn").rlike(r"^\d{3}-\d{2}-\d{4}$")).count() == 0


def test_picks_at_any_size(spark):
    ids = spark.range(200_000).select((F.col("id") * 977).alias("id"))
    far = ids.select(generate.pick("id", 21, 200_000_000).alias("u")).agg(F.max("u"), F.min("u"), F.avg("u")).first()
    assert far[0] > 199_000_000 and far[1] < 1_000_000 and abs(far[2] - 1e8) < 1e6
    pair = generate.gen_users(spark.createDataFrame([(5,), (5 + 2147483647,)], "id long")).orderBy(F.desc("user_id"))
    assert pair.where("user_id in ('usr_10005', 'usr_2147493652')").select("ssn", "name").distinct().count() == 2
    low = ids.select((generate.pick("id", 14, 18510001) < 9255000).cast("int").alias("low")).agg(F.avg("low")).first()[0]
    assert abs(low - 0.5) < 0.01


def test_listing(spark, sf_dir):
    assert tables.list_collections(spark, sf_dir) == sorted(compare.TABLES)


def test_text_helpers(spark):
    row = spark.sql("SELECT timestamp'2026-05-20 10:30:00' AS a, timestamp'2026-05-20 10:30:00.25' AS b,"
                    " 'db://user:secret@host/x' AS uri").select(
        iso_utc(F.col("a")), iso_utc(F.col("b")), without_credentials(F.col("uri"))).first()
    assert tuple(row) == ("2026-05-20T10:30:00Z", "2026-05-20T10:30:00.250000Z", "host/x")


def test_catalogue_lists_folders_only(spark):
    path = scratch_path(spark, "lake")
    spark.range(3).repartition(3).write.parquet(f"{path}/b.parquet")
    spark.range(1).write.parquet(f"{path}/a.parquet")
    spark.range(1).write.parquet(f"{path}/deep/c.parquet")
    spark.range(1).write.json(f"{path}/d.json")
    found = tables.Catalogue(spark, path)
    assert found.names == ["a", "b"] and tables.Catalogue(spark, path, "json").names == ["d"]
    assert {(r.collection, r.documents) for r in found.counts().collect()} == {("a", 1), ("b", 3)}
    assert found.read("b").count() == 3 and tables.Catalogue(spark, path, "json").read("d", "id bigint").count() == 1
    for name in ("c", "deep", "../lake/a", ""):
        with pytest.raises(ValueError):
            found.read(name)
    assert tables.Catalogue(spark, f"{path}/deep").names == ["c"]
    empty = tables.Catalogue(spark, f"{path}/d.json")
    assert empty.names == [] and empty.counts().count() == 0 and empty.counts().columns == ["collection", "documents"]
