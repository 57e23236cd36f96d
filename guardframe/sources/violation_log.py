"""A log of violations by day, that answers for the newest ones from the newest days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns that ``operators.audit.violations`` gives.
RECORD = (
    "request_id bigint, event_type string, details string, flagged_text string, categories array<string>, timestamp timestamp"
)
_PLACE = ["_day", "_batch"]
_NO_DAY = "none"


class ViolationLog:
    """Records below ``path`` in folders ``_day=D/_batch=B``.

    A batch that is appended again replaces its own folders, so it is stored once if it has the same
    days. Days are those of UTC; records without a time are in a folder of their own, which counts as
    the oldest.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str = RECORD):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def append(self, records: DataFrame, batch: str) -> None:
        """Store the records of a batch.

        Rows are dealt by day and a salt before they are written, so a day is a few files and a hot day
        is not one task.
        """
        day = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("timestamp").cast("timestamp_ntz")), "yyyy-MM-dd")
        salt = F.pmod(F.xxhash64(*records.columns), F.lit(8))
        placed = records.select("*", F.coalesce(day, F.lit(_NO_DAY)).alias("_day"), F.lit(batch).alias("_batch"))
        (
            placed.repartition("_day", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_PLACE).parquet(self.path)
        )

    def days(self) -> list[str]:
        """Days with records, newest first; one listing of the top folder."""
        if not self._fs.exists(self._root):
            return []
        names = [entry.getPath().getName() for entry in self._fs.listStatus(self._root)]
        days = sorted((n.removeprefix("_day=") for n in names if n.startswith("_day=")), reverse=True)
        return [d for d in days if d != _NO_DAY] + [d for d in days if d == _NO_DAY]

    def read(self, days: list[str] | None = None) -> DataFrame:
        """The records of some days, or of all; only the folders of those days are listed and read."""
        days = self.days() if days is None else days
        if not days:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true")
        return reader.parquet(*[f"{self.path}/_day={d}" for d in days])

    def newest(self, n: int) -> DataFrame:
        """The ``n`` newest records, newest first, ties to the larger request.

        Days are taken from the newest on until they hold enough, by the row counts in the footers of
        their files; older days are not touched, and nothing is sorted but the first ``n``.
        """
        taken, found = [], 0
        for day in self.days():
            if found >= n:
                break
            taken.append(day)
            found += self.read([day]).count()
        return self.read(taken).orderBy(F.desc_nulls_last("timestamp"), F.desc("request_id")).limit(n)
