import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from guardframe.sources.scratch import scratch_path
from guardframe.sources.snapshots import Snapshots


def files(path):
    return {os.path.basename(f): (os.path.getsize(f), os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/data/*/part-*")}


def ids(table):
    return sorted(r["id"] for r in table.read().collect())


def test_appends_deletes_and_what_they_write(spark):
    path = scratch_path(spark, "snap")
    table = Snapshots(spark, path)
    rows = spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.when(F.col("id") % 2 == 0, 1).alias("even"))
    assert table.read().collect() == []
    assert table.append(rows.repartition(4), "first") and not table.append(rows, "first")
    before = files(path)
    assert table.delete(F.col("id") == 77) == 1
    assert files(path) == before and sum(n for n, _ in before.values()) > 2_000_000
    written = sum(os.path.getsize(f) for f in glob.glob(f"{path}/deletes/*/part-*"))
    assert 0 < written < 4096
    assert table.delete(F.col("even") == 1) == 50_000 and table.delete(F.col("id") == 77) == 0
    assert ids(table) == [k for k in range(1, 100_000, 2) if k != 77]
    assert table.append(spark.range(5, 8).select("id", F.lit("x").alias("text"), F.lit(None).cast("int").alias("even")), "second")
    assert ids(table)[:4] == [1, 3, 5, 5]
    # a folder that is mostly gone is written anew, the other keeps its files
    kept = [k for k in files(path) if k not in before]
    assert table.compact(0.5) == 1 and table.compact(0.5) == 0
    assert set(kept) <= set(files(path)) and len(ids(table)) == 50_000 - 1 + 3
    assert len(table.current()["data"]) == 2 and table.current()["batches"] == ["first", "second"]


def test_one_of_two_writers_fails_and_leaves_no_trace(spark):
    path = scratch_path(spark, "race")
    table, other = Snapshots(spark, path), Snapshots(spark, path)
    table.append(spark.range(3), "a")
    stale = other.current()
    table.append(spark.range(3, 5), "b")
    other.current = lambda: stale
    with pytest.raises(Exception, match="(?i)exist"):
        other.append(spark.range(100, 103), "c")
    with pytest.raises(Exception, match="(?i)exist"):
        other.delete(F.col("id") == 1)
    assert ids(table) == [0, 1, 2, 3, 4] and table.current()["batches"] == ["a", "b"]
    del other.current
    assert other.append(spark.range(100, 101), "c") and ids(table) == [0, 1, 2, 3, 4, 100]


def test_a_crash_before_the_rename_changes_nothing(spark, monkeypatch):
    path = scratch_path(spark, "crash")
    table = Snapshots(spark, path)
    table.append(spark.range(3), "a")
    monkeypatch.setattr(table, "_rename", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.append(spark.range(3, 6), "b")
    again = Snapshots(spark, path)
    assert ids(again) == [0, 1, 2]
    assert again.append(spark.range(3, 6), "b") and ids(again) == [0, 1, 2, 3, 4, 5]


def test_refused(spark):
    table = Snapshots(spark, scratch_path(spark, "refused"))
    table.append(spark.range(2))
    with pytest.raises(ValueError):
        table.delete(None)
    with pytest.raises(ValueError):
        table.append(spark.range(2).withColumn("more", F.lit(1)))
    for predicate, left in ((F.lit(None).cast("boolean"), 2), (F.lit(False), 2), (F.lit(True), 0)):
        assert table.delete(predicate) == 2 - left and len(ids(table)) == left
    assert json.loads(json.dumps(table.current()))["version"] == 2


def test_a_batch_is_put_in_place_of_itself(spark):
    table = Snapshots(spark, scratch_path(spark, "put"))
    rows = lambda *numbers: spark.createDataFrame([(n,) for n in numbers], "n long")
    found = lambda: sorted(r["n"] for r in table.read().collect())
    table.append(rows(0))
    table.put(rows(1, 2), "a")
    table.put(rows(3), "b")
    table.put(rows(4), "a")
    assert found() == [0, 3, 4]
    with pytest.raises(Exception, match="lost"):
        table.put(rows(9).select(F.raise_error(F.lit("lost")).cast("long").alias("n")), "b")
    assert found() == [0, 3, 4]
    table.put(rows(7), "c", ["a", "b"])
    assert found() == [0, 7]
    assert table.delete(F.col("n") == 7) == 1 and found() == [0]
    with pytest.raises(ValueError):
        table.put(spark.range(1), "d")
