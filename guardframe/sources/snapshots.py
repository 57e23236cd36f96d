"""A collection as a series of snapshots: appends add files, deletes add positions, nothing is rewritten.

A snapshot is one small file that names the folders of rows, the folders of deleted positions, the
batches that were appended, and the schema. It is written aside and renamed to its number, so readers
see all of a change or nothing, and of two writers that start from the same snapshot one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that tell where a row lies.
PLACE = ["_folder", "_file", "_position"]
_PLACE_SCHEMA = "_folder string, _file string, _position long"


class Snapshots:
    """A collection below ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(conf)
        self._rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename

    def current(self) -> dict:
        """The newest snapshot; that of a new collection has no rows and no schema."""
        log = self._at("_snapshots")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not numbers:
            return {"version": 0, "data": [], "deletes": [], "batches": [], "schema": None}
        stream = self._fs.open(self._at("_snapshots", f"{max(numbers):020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, before: dict, **changed) -> None:
        after = {**before, **changed, "version": before["version"] + 1}
        aside = self._at("_snapshots", f"_{uuid.uuid4().hex}")
        stream = self._fs.create(aside)
        stream.write(json.dumps(after).encode())
        stream.close()
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE  # fails where the number is taken
        self._rename(aside, self._at("_snapshots", f"{after['version']:020d}.json"), options)

    def append(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Add rows; a batch that a snapshot names already is not added again. Rows of a failed append are in no snapshot."""
        before = self.current()
        if batch is not None and batch in before["batches"]:
            return False
        if before["schema"] and T.StructType.fromJson(before["schema"]).simpleString() != rows.schema.simpleString():
            raise ValueError("the rows have other columns than the collection")
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._commit(before, data=[*before["data"], folder], schema=json.loads(rows.schema.json()),
                     batches=[*before["batches"], *([] if batch is None else [batch])])
        return True

    def put(self, rows: DataFrame, batch: str, instead: list[str] | None = None) -> None:
        """Add the rows of a batch in place of those that earlier puts of it, or of the batches ``instead``, have added.

        Old and new rows change places in one rename, so a put that breaks off leaves the old ones.
        """
        before = self.current()
        if before["schema"] and T.StructType.fromJson(before["schema"]).simpleString() != rows.schema.simpleString():
            raise ValueError("the rows have other columns than the collection")
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        named = before.get("put", {})
        left = {b: f for b, f in named.items() if b != batch and b not in (instead or ())}
        gone = set(named.values()) - set(left.values())
        self._commit(before, data=[*[f for f in before["data"] if f not in gone], folder],
                     schema=json.loads(rows.schema.json()), put={**left, batch: folder})

    def _deleted(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(_PLACE_SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def placed(self, snapshot: dict | None = None) -> DataFrame:
        """The rows with the place of each: folder, file and position in it."""
        now = snapshot or self.current()
        if not now["data"]:
            return self.spark.createDataFrame([], _PLACE_SCHEMA)
        schema = T.StructType.fromJson(now["schema"])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in now["data"]]).select(
            *[F.col(f"`{f.name}`") for f in schema.fields],
            F.element_at(F.split("_metadata.file_path", "/"), -2).alias("_folder"),
            F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_position"))
        return rows.join(self._deleted(now["deletes"]), PLACE, "left_anti") if now["deletes"] else rows

    def read(self) -> DataFrame:
        return self.placed().drop(*PLACE)

    def delete_places(self, places: DataFrame) -> int:
        """Leave out the rows at these places, which come from ``placed``; returns how many there were.

        Only their positions are written. Places that are deleted already count again, so take them from a fresh read.
        """
        before = self.current()
        folder = f"deletes/{uuid.uuid4().hex}"
        places.select(*PLACE).distinct().sortWithinPartitions(*PLACE).write.parquet(f"{self.path}/{folder}")
        gone = self._deleted([folder]).count()  # of what was written, not of a second scan
        if gone:
            self._commit(before, deletes=[*before["deletes"], folder])
        return gone

    def delete(self, predicate: Column | None) -> int:
        """Leave out the rows that match; a null predicate value keeps a row, and no predicate is refused."""
        if predicate is None:
            raise ValueError("a delete without a filter would remove every document")
        return self.delete_places(self.placed().where(F.coalesce(predicate, F.lit(False))))

    def compact(self, share: float = 0.3) -> int:
        """Write folders anew of whose rows more than ``share`` is deleted; returns how many. Others keep their files."""
        before = self.current()
        if not before["deletes"]:
            return 0
        deleted = self._deleted(before["deletes"])
        gone = {r["_folder"]: r["count"] for r in deleted.groupBy("_folder").count().collect()}  # a row per append
        sizes = {f: self.spark.read.parquet(f"{self.path}/{f}").count() for f in before["data"] if f.removeprefix("data/") in gone}
        worn = [f for f, n in sizes.items() if gone[f.removeprefix("data/")] > share * n]
        if not worn:
            return 0
        names = [f.removeprefix("data/") for f in worn]
        data, deletes = f"data/{uuid.uuid4().hex}", f"deletes/{uuid.uuid4().hex}"
        self.placed({**before, "data": worn}).drop(*PLACE).write.parquet(f"{self.path}/{data}")
        deleted.where(~F.col("_folder").isin(names)).write.parquet(f"{self.path}/{deletes}")
        self._commit(before, data=[*[f for f in before["data"] if f not in worn], data], deletes=[deletes])
        return len(worn)
