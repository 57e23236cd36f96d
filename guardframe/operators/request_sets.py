"""Whole tables of requests, run as a set: every allowed read answered, every allowed delete counted.

A filter is read as conditions on columns: equality with a string, number, boolean or null, and the
bounds ``$lt``, ``$lte``, ``$gt`` and ``$gte``. Requests that ask the same are answered once. Rows
meet the filters by a join on the values of all columns that a filter compares for equality; bounds
are checked within. A filter without equality has to see all rows of its collection, which are dealt
into blocks for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.operators.audit import given
from guardframe.operators.joins import lookup
from guardframe.operators.redaction import redact_with_changes
from guardframe.rules import READ_LIMIT
from guardframe.sources.scratch import materialize

BOUNDS = ["$lt", "$lte", "$gt", "$gte"]
#: Rows of one value are dealt to so many keys, so a value that a third of all rows hold is no single task.
SALTS = 16


@dataclass
class Collection:
    """A collection and the column that orders it; answers hold its first rows in that order."""

    rows: DataFrame
    order: str


def _value(v: Column) -> Column:
    """A JSON scalar as comparable text: its kind, then what it holds. Numbers are compared as doubles."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double") + F.lit(0.0)
    return (
        F.when(v.isNull() | (kind == "VOID"), "z")
        .when(kind == "STRING", F.concat(F.lit("s"), F.try_variant_get(v, "$", "string")))
        .when(kind == "BOOLEAN", F.concat(F.lit("b"), F.try_variant_get(v, "$", "string")))
        .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.concat(F.lit("n"), number.cast("string")))
    )


def _held(name: str, dtype: T.DataType) -> Column:
    """A column's value in the same form; columns that hold no scalar compare with nothing."""
    col = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        text = F.concat(F.lit("s"), col)
    elif isinstance(dtype, T.BooleanType):
        text = F.concat(F.lit("b"), col.cast("string"))
    elif isinstance(dtype, T.NumericType):
        text = F.concat(F.lit("n"), (col.cast("double") + F.lit(0.0)).cast("string"))
    else:
        return F.when(col.isNull(), "z")
    return F.coalesce(text, F.lit("z"))


def with_conditions(requests: DataFrame, query: str = "query") -> DataFrame:
    """Add what a filter asks for: ``equal`` (map of column to value), ``bounds`` (column, op, value) and ``readable``.

    ``readable`` is false for anything but an object of the conditions above; an absent or empty query is an empty object.
    """
    parsed = requests.withColumn("_v", F.try_parse_json(given(F.col(query)))).withColumn(
        "_fields", F.when(F.schema_of_variant("_v").startswith("OBJECT"),
                          F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))))
    is_object = lambda e: F.coalesce(F.schema_of_variant(e["value"]).startswith("OBJECT"), F.lit(False))
    within = lambda e: F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>"))
    single = F.filter("_fields", lambda e: ~is_object(e))
    nested = F.filter("_fields", is_object)
    out = parsed.withColumn("equal", F.map_from_entries(F.transform(
        single, lambda e: F.struct(e["key"].alias("key"), _value(e["value"]).alias("value"))))).withColumn(
        "bounds", F.array_sort(F.flatten(F.transform(nested, lambda e: F.transform(within(e), lambda b: F.struct(
            e["key"].alias("column"), b["key"].alias("op"), _value(b["value"]).alias("value")))))))
    fine = F.col("_fields").isNotNull() & F.forall(F.map_values("equal"), lambda v: v.isNotNull()) \
        & F.forall("bounds", lambda b: b["op"].isin(BOUNDS) & F.coalesce(b["value"].rlike("^[sn]"), F.lit(False))) \
        & ~F.exists(nested, lambda e: F.size(within(e)) == 0) \
        & ~F.exists("_fields", lambda e: e["key"].startswith("$"))
    return out.withColumn("readable", F.coalesce(fine, F.lit(False))).drop("_v", "_fields")


def _kind(dtype: T.DataType) -> str | None:
    return "s" if isinstance(dtype, T.StringType) else "n" if isinstance(dtype, T.NumericType) else None


def matches(filters: DataFrame, rows: DataFrame, keep: list[Column]) -> DataFrame:
    """Pairs of a filter and a row that it lets through: all columns of ``filters`` but the conditions, and ``keep``.

    ``filters`` has ``equal`` and ``bounds``, best each only once. A column that the collection lacks is null
    in every row, so only equality with null matches it. Bounds are kept by values of their own kind.
    """
    spark = rows.sparkSession
    own = [c for c in filters.columns if c not in ("equal", "bounds")]
    kinds = {f.name: _kind(f.dataType) for f in rows.schema.fields if _kind(f.dataType)}
    kind_of = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]) if kinds else F.lit(None).cast("map<string,string>")
    can = F.forall("bounds", lambda b: F.coalesce(kind_of[b["column"]] == F.substring(b["value"], 1, 1), F.lit(False)))
    names = F.array_sort(F.map_keys("equal"))
    asked = materialize(filters.where(can).withColumn("_names", names).withColumn(
        "_key", F.to_json(F.transform("_names", lambda n: F.col("equal")[n]))), "filters")
    # the sets of columns that filters compare, and the columns that they bound, not their values
    shape = asked.agg(F.collect_set("_names").alias("sets"), F.array_distinct(F.flatten(F.collect_set("bounds.column"))).alias("bounded")).first()
    held = {f.name: _held(f.name, f.dataType) for f in rows.schema.fields}
    if not shape["sets"]:
        return rows.where(F.lit(False)).select(*[F.lit(None).cast(filters.schema[c].dataType).alias(c) for c in own], *keep)
    keys = [F.struct(F.array(*[F.lit(n) for n in some]).cast("array<string>").alias("_names"), F.to_json(F.array(
        *[held.get(n, F.lit("z")) for n in some]).cast("array<string>")).alias("_key")) for some in shape["sets"]]
    limits, passed = [], F.lit(True)
    for i, name in enumerate(shape["bounded"]):
        for op in BOUNDS:
            given_ = F.get(F.filter("bounds", lambda b: (b["column"] == name) & (b["op"] == op)), 0)["value"]
            limits.append(F.substring(given_, 2, 1 << 30).try_cast("double" if kinds[name] == "n" else "string").alias(f"_{op}{i}"))
            value, limit = F.col(f"_value{i}"), F.col(f"_{op}{i}")
            kept = {"$lt": value < limit, "$lte": value <= limit, "$gt": value > limit, "$gte": value >= limit}[op]
            passed = passed & (limit.isNull() | kept)
    values = [F.col(f"`{n}`").cast("double" if kinds[n] == "n" else "string").alias(f"_value{i}") for i, n in enumerate(shape["bounded"])]
    blocks = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # filters without equality meet every row: their collection is dealt into blocks
    n_salts = F.when(F.size("_names") == 0, blocks).otherwise(SALTS).cast("long")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t and "variant" not in t])
    keyed = rows.select(*keep, *values, hashed.alias("_hash"), F.inline(F.array(*keys))).withColumn("_salt", F.pmod("_hash", n_salts)).drop("_hash")
    spread = asked.select(*own, "_names", "_key", *limits).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), n_salts - 1)))
    pairs = keyed.join(spread, ["_names", "_key", "_salt"]).where(passed)
    return pairs.select(*own, *[c for c in keyed.columns if c not in ("_names", "_key", "_salt") and not c.startswith("_value")])


def _shown(name: str, projection: Column) -> Column:
    """Whether a projection keeps a column; ``_id`` stays unless it is excluded."""
    wanted = F.from_json(F.when(projection == "", "{}").otherwise(projection), "map<string,string>")
    including = F.coalesce(F.exists(F.map_entries(wanted), lambda e: (e["key"] != "_id") & ~e["value"].isin("0", "false")), F.lit(False))
    own = wanted[name]
    return F.when(own.isNotNull(), ~own.isin("0", "false")).otherwise(F.lit(name == "_id") | ~including)


def _readable(audited: DataFrame, op: str, outcome: str) -> DataFrame:
    """Requests of a kind and outcome with their conditions, if these can be read.

    Each step is stored: a filter on a decision or a condition would work both out again, below them.
    """
    decided = materialize(audited.where(F.col("op") == op).select("request_id", "collection", "query", "projection", "outcome"), "decided")
    return materialize(with_conditions(decided.where(F.col("outcome") == outcome)), "conditions").where("readable")


def answer_reads(audited: DataFrame, collections: dict[str, Collection], limit: int = READ_LIMIT) -> DataFrame:
    """The documents of every allowed read: (request_id, collection, nth, document, redaction_applied).

    ``audited`` comes from the audit, so a request only reads the collection that it was audited for. A request
    has its collection's first ``limit`` matching rows, redacted, as JSON text in its projection; null fields are
    left out. Requests whose filter is not readable, and those on a collection that is not given, have no rows.
    """
    filter_ = F.to_json(F.struct(F.array_sort(F.map_entries("equal")).alias("e"), "bounds"))
    reads = materialize(_readable(audited, "read", "allowed").select(
        "request_id", "collection", "equal", "bounds", F.coalesce("projection", F.lit("")).alias("projection"),
        F.sha2(F.concat_ws("\n", "collection", filter_), 256).alias("filter"))
        .withColumn("ask", F.sha2(F.concat_ws("\n", "filter", "projection"), 256)), "reads")
    asks = materialize(reads.groupBy("ask").agg(F.count("*").alias("times"), *[
        F.any_value(c).alias(c) for c in ("collection", "filter", "projection")]), "asks")
    filters = reads.groupBy("filter").agg(*[F.any_value(c).alias(c) for c in ("collection", "equal", "bounds")])
    answers = []
    for name, own in collections.items():
        rows = own.rows
        found = matches(filters.where(F.col("collection") == name).select("filter", "equal", "bounds"), rows,
                        [F.col(f"`{c}`").alias(f"_row_{c}") for c in rows.columns])
        first = Window.partitionBy("filter").orderBy(f"_row_{own.order}")
        best = materialize(found.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= limit), "answers")
        # every filter has ``limit`` rows at most, whatever the number of projections
        documents = best.join(asks.where(F.col("collection") == name).select("ask", "filter", "projection"), "filter").select(
            F.struct("ask", "projection", F.col("_nth").alias("nth")).alias("_at"),
            *[F.col(f"`_row_{c}`").cast("string" if c == "_id" else rows.schema[c].dataType).alias(c) for c in rows.columns])
        shown = documents.withColumn("_shown", F.filter(F.array(*[F.when(_shown(c, F.col("_at.projection")), c) for c in rows.columns]),
                                                        lambda c: c.isNotNull()))
        clean = redact_with_changes(shown, "_changes", keep=("_at", "_shown"))
        document = F.struct(*[F.when(F.array_contains("_shown", c), F.col(f"`{c}`")).alias(c) for c in rows.columns])
        answers.append(clean.select(
            "_at.ask", "_at.nth", F.arrays_overlap("_changes", "_shown").alias("redaction_applied"), F.to_json(document).alias("document")))
    whole = reduce(DataFrame.unionByName, answers).groupBy("ask").agg(
        F.sort_array(F.collect_list(F.struct("nth", "document", "redaction_applied"))).alias("documents"))
    table = materialize(whole.join(asks.select("ask", "times"), "ask"), "answered")
    return lookup(reads.select("request_id", "collection", "ask"), table, "ask", "times").select(
        "request_id", "collection", F.explode("documents").alias("d")).select("request_id", "collection", "d.*")


def read_results(audited: DataFrame, answers: DataFrame) -> DataFrame:
    """Every read with its outcome, number of documents and redaction flag; refused ones have none.

    An allowed read whose filter is not readable is ``unsupported_filter``.
    """
    reads = with_conditions(audited.where(F.col("op") == "read")).select(
        "request_id", F.when((F.col("outcome") == "allowed") & ~F.col("readable"), "unsupported_filter").otherwise(F.col("outcome")).alias("outcome"))
    counts = answers.groupBy("request_id").agg(
        F.count("*").alias("document_count"), F.bool_or("redaction_applied").alias("redaction_applied"))
    return reads.join(counts, "request_id", "left").select(
        "request_id", "outcome", F.coalesce("document_count", F.lit(0)).alias("document_count"),
        F.coalesce("redaction_applied", F.lit(False)).alias("redaction_applied"))


def deleted_rows(audited: DataFrame, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a collection that allowed deletes remove: (*keys, request_id).

    ``keys`` tell rows apart. Requests run in the order of their ids, so a row goes to the first that matches it.
    """
    deletes = _readable(audited, "delete", "delete_allowed").where(F.col("collection") == name)
    filters = materialize(deletes.withColumn("_ask", F.to_json(F.struct(F.array_sort(F.map_entries("equal")).alias("e"), "bounds"))).groupBy("_ask").agg(
        F.min("request_id").alias("request_id"), F.any_value("equal").alias("equal"), F.any_value("bounds").alias("bounds")).drop("_ask"), "deletes")
    return matches(filters, rows, [F.col(k) for k in keys]).groupBy(*keys).agg(F.min("request_id").alias("request_id"))
