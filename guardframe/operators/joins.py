"""Joins that stay even where one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is looked up by broadcast; there are at most so many of them.
MOST_HEAVY = 2048


def lookup(rows: DataFrame, table: DataFrame, key: str, times: str) -> DataFrame:
    """Inner join of ``rows`` to ``table``, which has each key once and the number of its rows as ``times``.

    Keys with a large share of the rows, of which there can be ``MOST_HEAVY`` at most, are broadcast,
    so that their rows stay where they are; the others are few each and are shuffled. Null keys match nothing.
    ``table`` is read several times, so store it first. Keys should be of a bounded size.
    """
    total = table.agg(F.sum(times)).first()[0] or 0
    heavy = table[times] > total // MOST_HEAVY
    few = F.broadcast(table.where(heavy).drop(times).withColumn("_heavy", F.lit(True)))
    seen = rows.join(few, key, "left")
    own = [c for c in table.columns if c not in (key, times)]
    settled = seen.where("_heavy").drop("_heavy")
    rest = seen.where("_heavy is null").drop("_heavy", *own)
    return settled.unionByName(rest.join(table.where(~heavy).drop(times), key))
