"""Collections as DataFrames: reading, counting, writing, and the rules table."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.rules import STATIC_RULES


def read_collection(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None
) -> DataFrame:
    """Read a collection; give JSON lines a schema to save the inference pass."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def list_collections(spark: SparkSession, path: str, fmt: str = "parquet") -> list[str]:
    """Names of the collections in a folder: its entries that are called ``name.parquet``, in order.

    One listing of the folder itself through the file system that Spark reads from; the files of a
    collection are not listed, however many they are.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [entry.getPath().getName() for entry in entries]
    return sorted(n.removesuffix(f".{fmt}") for n in names if n.endswith(f".{fmt}") and not n.startswith((".", "_")))


class Catalogue:
    """The collections of a folder, listed once: what may be asked for, what it holds, and how much.

    ``names`` is the list of known collections that ``audit`` takes, so its gate, the inventory and the
    reads agree on what exists.
    """

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        self.names = list_collections(spark, self.path, fmt)

    def read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        """A collection; a name that was not listed is refused, whatever lies at its path."""
        if name not in self.names:
            raise ValueError(f"there is no collection {name!r}")
        return read_collection(self.spark, f"{self.path}/{name}.{self.fmt}", self.fmt, schema)

    def counts(self) -> DataFrame:
        """Name and number of documents of every collection; no rows for an empty folder."""
        if not self.names:
            return self.spark.createDataFrame([], "collection string, documents bigint")
        return collection_counts({name: self.read(name) for name in self.names})


def collection_counts(collections: dict[str, DataFrame]) -> DataFrame:
    """Name and number of documents per collection (parquet answers from its footers)."""
    counts = [
        df.agg(F.count("*").alias("documents")).select(F.lit(name).alias("collection"), "documents")
        for name, df in collections.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def append_documents(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add one or many documents to a collection."""
    df.write.mode("append").format(fmt).save(path)


def replace_documents(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a collection; ``df`` must not read from ``path`` itself."""
    df.write.mode("overwrite").format(fmt).save(path)


def is_absent_or_empty(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    try:
        return spark.read.format(fmt).load(path).isEmpty()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return True
        raise


def seed_if_empty(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write ``df`` only where the collection is absent or has no documents."""
    if not is_absent_or_empty(df.sparkSession, path, fmt):
        return False
    replace_documents(df, path, fmt)
    return True


def guarded_delete(
    df: DataFrame, predicate: Column | None, target: str, fmt: str = "parquet"
) -> int:
    """Write the documents that do not match to ``target``; return how many were left out.

    A null predicate value keeps the document. Without a predicate the request is refused. The
    matches are counted first, by a scan that the predicate is pushed into.
    """
    if predicate is None:
        raise ValueError("a delete without a filter would remove every document")
    matched = F.coalesce(predicate, F.lit(False))
    deleted = df.where(matched).count()
    replace_documents(df.where(~matched), target, fmt)
    return deleted


RULES_SCHEMA = "category string, threat_level string, description string, playbook string"


def _static_rules() -> Column:
    """The twelve built-in rules as rows that a single row gives out."""
    names = [c.split(" ")[0] for c in RULES_SCHEMA.split(", ")]
    return F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in STATIC_RULES]))


def static_rules(spark: SparkSession) -> DataFrame:
    """The twelve built-in rules."""
    return spark.range(1, numPartitions=1).select(_static_rules())


def rules_lookup(rules: DataFrame, position: str) -> DataFrame:
    """Category, description, threat level and action from a rules table.

    ``playbook`` is preferred over ``action``, missing texts become empty, rows without a category
    are dropped and the row with the highest ``position`` wins. A table with no rows at all is
    replaced by the static rules.
    """
    def text(*names):
        present = [F.col(name) for name in names if name in rules.columns]
        return F.coalesce(*present, F.lit(""))

    own = (
        rules.where(F.col("category") != "")
        .groupBy("category")
        .agg(F.max_by(
            F.struct(
                text("description").alias("description"),
                text("threat_level").alias("threat_level"),
                text("playbook", "action").alias("action"),
            ),
            F.col(position),
        ).alias("rule"))
        .select("category", "rule.description", "rule.threat_level", "rule.action")
    )
    # one row says whether the table has any; if not, it gives out the static ones
    fallback = rules.limit(1).agg((F.count("*") == 0).alias("absent")).where("absent").select(_static_rules()).select(
        "category", "description", "threat_level", F.col("playbook").alias("action"))
    return own.unionByName(fallback)
