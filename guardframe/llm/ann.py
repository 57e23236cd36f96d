"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are quantised to int8 with a scale and a rounding error each. A task multiplies a tile,
some queries by some candidates, in whole numbers; scales and errors turn every product into an
interval that holds the true inner product. Only candidates whose interval reaches the k-th best
lower end are computed again in double precision, so the tile's k best are exact. The tiles' lists
are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.sources.scratch import materialize

#: Rows of a tile on either side, and queries multiplied at a time.
TILE_QUERIES, TILE_ROWS, STRIP = 8192, 8192, 256


def usable(vector: str | Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127, their scales, and the length of the rounding error and of the whole.

    The numbers are kept as float32, in which products of up to a thousand of them are exact.
    """
    scale = np.abs(vectors).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    whole = np.rint(vectors / scale[:, None])
    error = np.linalg.norm(vectors - whole * scale[:, None], axis=1)
    kind = np.float32 if vectors.shape[1] <= 1000 else np.float64
    return whole.astype(kind), scale, error, np.linalg.norm(whole * scale[:, None], axis=1)


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    out = np.zeros(len(rows))
    for k, value in enumerate(query):
        out += rows[:, k] * value
    return out


@np.errstate(over="ignore", invalid="ignore")
def tile(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int,
         strip: int = STRIP) -> list[tuple[int, list[int], list[float]]]:
    """The k best rows of each query, itself left out: (query, row ids, scores), best first.

    Equal rows are computed once; of each lot, the k + 1 smallest ids can be among the answers.
    A product without a value comes last, as minus infinity.
    """
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    keyed = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, first, lot = np.unique(keyed, return_index=True, return_inverse=True)
    distinct = rows[first]
    by_lot = np.argsort(lot, kind="stable")
    starts = np.searchsorted(lot[by_lot], np.arange(len(first) + 1))
    whole, scale, error, size = quantise(distinct)
    q_whole, q_scale, q_error, q_size = quantise(queries)
    out = []
    for at in range(0, len(queries), strip):
        to = min(len(queries), at + strip)
        near = (q_whole[at:to] @ whole.T) * q_scale[at:to, None] * scale
        # |q.r - q'.r'| <= |q'||r - r'| + |q - q'||r'| + |q - q'||r - r'|, and a little for rounding
        slack = (q_size[at:to, None] + q_error[at:to, None]) * error + q_error[at:to, None] * size
        slack += 1e-6 * (np.abs(near) + slack) + 1e-300
        vast = ~np.isfinite(near) | ~np.isfinite(slack)  # beyond double precision: always computed again
        near[vast], slack[vast] = 0, np.inf
        low = near - slack
        # the query itself takes one place at most, so k + 1 lots hold k answers
        n = min(k + 1, low.shape[1])
        bar = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n]
        for j in range(at, to):
            good = np.flatnonzero(near[j - at] + slack[j - at] >= bar[j - at])
            found = []
            for g, score in zip(good.tolist(), exact(queries[j], distinct[good]).tolist()):
                ids = row_ids[by_lot[starts[g]:min(starts[g + 1], starts[g] + k + 1)]]
                score = -score if score == score else float("inf")
                found.extend((score, int(i)) for i in ids if i != query_ids[j])
            best = heapq.nsmallest(k, found)
            if best:
                out.append((int(query_ids[j]), [i for _, i in best], [-s for s, _ in best]))
    return out


def _tiles(k: int):
    """Tasks hold the rows of one tile after the other, sorted by tile, queries first."""
    schema = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def solve(sides: dict[bool, list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        found = []
        if sides[True] and sides[False]:
            ids, vectors = (np.concatenate([x[n] for x in sides[False]]) for n in (0, 1))
            queries, asked = (np.concatenate([x[n] for x in sides[True]]) for n in (0, 1))
            found = tile(asked, queries, vectors, ids, k)
        columns = list(zip(*found)) if found else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, {True: [], False: []}
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy()
            vectors = batch.column("vector")
            flat = vectors.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())])
            starts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]])) if len(tiles) else []
            for lo, hi in zip(starts, [*starts[1:], len(tiles)]):
                if tiles[lo] != now:
                    if now is not None:
                        yield solve(sides)
                    now, sides = tiles[lo], {True: [], False: []}
                # a tile's vectors have one width
                block = flat[ends[lo]:ends[hi]].reshape(hi - lo, -1)
                for side in (True, False):
                    own = asks[lo:hi] == side
                    if own.any():
                        sides[side].append((ids[lo:hi][own], block[own]))
        if now is not None:
            yield solve(sides)
    return run


def _merge(k: int):
    """Merge a query's sorted lists, which follow each other, and number the best k."""
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("id", pa.int64()), ("score", pa.float64())])

    def best(query: int, lists: list[list[tuple[float, int]]]) -> list[tuple]:
        return [(query, n + 1, i, -s) for n, (s, i) in enumerate(islice(heapq.merge(*lists), k))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, []
        for batch in batches:
            rows = []
            for query, ids, scores in zip(*(batch.column(n).to_pylist() for n in ("query_id", "ids", "scores"))):
                if query != now and now is not None:
                    rows += best(now, lists)
                    lists = []
                now = query
                lists.append([(-s, i) for s, i in zip(scores, ids)])
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if now is not None:
            columns = list(zip(*best(now, lists)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", *,
            tile_queries: int = TILE_QUERIES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Each query's k rows of largest inner product: (query_id, rank, id, score), exact.

    A row with the query's id is no answer. Nearest first, ties to the smaller id; all rows if
    there are fewer than k. A query is searched among the rows of its own width. Vectors that are null, empty,
    all zero, or that hold a null or non-finite component take no part, nor do rows
    without id. Repeated ids among the rows are answers each; a repeated query is answered once, by the least of its vectors.
    Further columns are ignored.

    A tile is a key of about ``tile_queries`` by ``tile_rows`` vectors, so a task's memory and work
    do not depend on the data; equal vectors are one row within a tile.
    """
    def sides(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")) \
            .where(F.col("id").isNotNull() & usable("vector"))

    asked, given = sides(queries).groupBy("id").agg(F.min("vector").alias("vector")), sides(rows)
    count = lambda df, size, name: df.groupBy(F.size("vector").alias("width")).agg(
        F.ceil(F.count("*") / size).cast("int").alias(name))
    # a row for every width
    grid = materialize(count(given, tile_rows, "across").join(count(asked, tile_queries, "down"), "width"), "grid")
    n_tiles = grid.agg(F.sum(F.col("across").cast("long") * F.col("down"))).first()[0] or 1

    def spread(df: DataFrame, asks: bool) -> DataFrame:
        own, other = ("down", "across") if asks else ("across", "down")
        mine = F.pmod(F.xxhash64("id"), F.col(own))
        name = mine * F.col("across") + F.col("j") if asks else F.col("j") * F.col("across") + mine
        return df.withColumn("width", F.size("vector")).join(F.broadcast(grid), "width").withColumn(
            "j", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(
            (F.shiftleft(F.col("width").cast("long"), 40) + name).alias("tile"), F.lit(asks).alias("asks"), "id", "vector")

    tiles = spread(asked, True).unionAll(spread(given, False))
    lists = tiles.repartition(min(n_tiles, 100_000), "tile").sortWithinPartitions("tile").mapInArrow(
        _tiles(k), "query_id long, ids array<long>, scores array<double>")
    return materialize(lists, "tiles").repartition("query_id").sortWithinPartitions("query_id").mapInArrow(
        _merge(k), "query_id long, rank int, id long, score double")
