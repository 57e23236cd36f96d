"""Hard negatives by exact whole-number inner products, scored with the method of the Four Russians.

A vector's whole numbers are cut into bit planes, and each plane into bytes of eight dimensions. For
an anchor, a table of 256 entries per eight dimensions holds the sums of all subsets of its numbers
there. The byte of a row's plane is an index into that table: the entries found for a plane add up
to the inner product with that plane, and planes are put together by shifts. Tasks hold a tile, some
anchors by some rows; one pass over the tiles ranks the positives, a second one the negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardframe.sources.scratch import materialize

#: Rows of a tile on either side, and anchors and rows that are scored at a time.
TILE_ANCHORS, TILE_ROWS, ANCHORS, STRIP = 8192, 8192, 128, 1024


def takes_part(vector: Column) -> Column:
    """Not null, and no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def planes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number of two's complement bits of every row, and the rows' planes: (rows, 64, bytes).

    A plane has one bit per dimension, eight to a byte, the first dimension in the lowest bit.
    Only a row's own number of planes is meant; those above repeat the sign.
    """
    top = np.where(numbers < 0, ~numbers, numbers).max(axis=1, initial=0)
    bits = np.array([int(t).bit_length() + 1 for t in top.tolist()], np.int32)
    most = int(bits.max(initial=1))
    flat = [np.packbits(((numbers >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(most)]
    return bits, np.stack(flat, axis=1)


def whole(packed: np.ndarray, width: int) -> np.ndarray:
    """The numbers of rows whose planes are given: (rows, planes, bytes) to (rows, width)."""
    out = np.zeros((len(packed), width), np.int64)
    most = packed.shape[1]
    for p in range(most):
        plane = np.unpackbits(packed[:, p], axis=1, bitorder="little")[:, :width].astype(np.int64)
        out += -(plane << p) if p == most - 1 else plane << p
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Sums of all subsets of eight dimensions: (bytes, 256, anchors), in the narrowest type that holds a plane's sum."""
    n, width = anchors.shape
    groups = -(-width // 8)
    most = int(np.abs(anchors).sum(axis=1).max(initial=0))
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    padded = np.zeros((n, groups * 8), kind)
    padded[:, :width] = anchors
    eights = padded.T.reshape(groups, 8, n)
    out = np.zeros((groups, 256, n), kind)
    for bit in range(8):  # every subset with this bit is one without it and the number
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + eights[:, bit, None]
    return out


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products of rows, whose planes are given, with anchors, whose tables are: (rows, anchors)."""
    groups, _, n = tables.shape
    rows, most, _ = packed.shape
    # every plane's sum is less than the largest of its type, and planes weigh 2 ** most at most
    kind = np.int32 if tables.dtype == np.int16 and most <= 16 else np.int64
    out = np.empty((rows, n), kind)
    for at in range(0, rows, STRIP):
        index = packed[at:at + STRIP].astype(np.intp)
        looked, total = (np.empty((len(index), n), tables.dtype) for _ in range(2))
        acc = np.zeros((len(index), n), kind)
        for p in range(most - 1, -1, -1):
            total[:] = 0
            for g in range(groups):
                np.take(tables[g], index[:, p, g], axis=0, out=looked, mode="clip")
                total += looked
            acc <<= 1
            if p == most - 1:  # the sign
                acc -= total
            else:
                acc += total
        out[at:at + STRIP] = acc
    return out


def first(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, largest first, ties to the smaller id; ``ids`` ascend."""
    if len(values) > k:
        bar = np.partition(values, len(values) - k)[len(values) - k]
        places = np.flatnonzero(values >= bar)
    else:
        places = np.arange(len(values))
    return places[np.argsort(-values[places].astype(np.int64), kind="stable")][:k]


def _pack(scale: float):
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("bits", pa.int32()), ("planes", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = (batch.column(n) for n in ("id", "label", "vector"))
            ids, labels = ids.to_numpy(), labels.to_numpy()
            widths = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                numbers = np.floor(flat[starts[own][:, None] + np.arange(width)] * scale)
                # with a longer one, a score need not fit 64 bits
                fits = np.sqrt((numbers / 2.0**31) ** 2 @ np.ones(width)) < 1
                own, numbers = own[fits], numbers[fits].astype(np.int64)
                bits, packed = planes(numbers)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[own]), pa.array(labels[own]), pa.array(np.full(len(own), width, np.int32)), pa.array(bits),
                    pa.array([packed[i, :b].tobytes() for i, b in enumerate(bits.tolist())], pa.binary())], schema=schema)
    return run


class Tile:
    """Anchors and rows that meet in a task, each side by number of planes; rows in order of their ids."""

    def __init__(self, width: int, asks: list[tuple], rows: list[tuple]):
        self.asks = sorted(asks, key=lambda r: r[0])
        groups = -(-width // 8)
        block = lambda rs, bits: np.frombuffer(b"".join(r[3] for r in rs), np.uint8).reshape(len(rs), bits, groups)
        self.numbers = np.zeros((len(asks), width), np.int64)
        for bits in {r[2] for r in asks}:
            own = [i for i, r in enumerate(self.asks) if r[2] == bits]
            self.numbers[own] = whole(block([self.asks[i] for i in own], bits), width)
        rows = sorted(rows, key=lambda r: r[0])
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        self.bits = np.array([r[2] for r in rows], np.int64)
        self.blocks = {}
        for bits in set(self.bits.tolist()):
            own = np.flatnonzero(self.bits == bits)
            self.blocks[bits] = own, block([rows[i] for i in own.tolist()], bits)

    def scored(self, asks: list[int], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Every asked anchor with its scores of the marked rows; other rows' values mean nothing."""
        for at in range(0, len(asks), ANCHORS):
            some = asks[at:at + ANCHORS]
            tables = subset_sums(self.numbers[some])
            table = np.zeros((len(self.ids), len(some)), np.int64)
            for own, packed in self.blocks.values():
                wanted = rows[own]
                if wanted.any():
                    table[own[wanted]] = scores(tables, packed[wanted])
            table = np.ascontiguousarray(table.T)
            yield from zip(some, table)


def positives_of(tile: Tile, k: int) -> Iterator[tuple]:
    """(anchor, row, score) of each anchor's k first other rows of its label."""
    by_label: dict[int, list[int]] = {}
    for i, ask in enumerate(tile.asks):
        by_label.setdefault(ask[1], []).append(i)
    for label, asks in by_label.items():
        same = tile.labels == label
        places = np.flatnonzero(same)
        for i, values in tile.scored(asks, same) if len(places) else ():
            others = places[tile.ids[places] != tile.asks[i][0]]
            for j in others[first(values[others], tile.ids[others], k)].tolist():
                yield tile.asks[i][0], int(tile.ids[j]), int(values[j])


def negatives_of(tile: Tile, k: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, number of the positive, row, score) of each positive's k first rows of other labels within the bounds."""
    everything = np.ones(len(tile.ids), bool)
    for i, values in tile.scored(list(range(len(tile.asks))), everything):
        anchor, label, _, _, positives = tile.asks[i]
        places = np.flatnonzero((tile.labels != label) & (tile.ids != anchor))
        own, ids = values[places], tile.ids[places]
        for positive in positives:
            least, most = -(-low * positive["score"] // 100), high * positive["score"] // 100
            if least <= most:
                inside = np.flatnonzero((own >= least) & (own <= most))
                for j in inside[first(own[inside], ids[inside], k)].tolist():
                    yield anchor, positive["nth"], int(ids[j]), int(own[j])


def _tiles(solve: Callable[[Tile], Iterator[tuple]], schema: pa.Schema):
    """Tasks hold the rows of one tile after the other, sorted by tile."""
    columns = ["asks", "id", "label", "bits", "planes", "positives"]

    def done(width: int, asks: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
        found = list(solve(Tile(width, asks, rows))) if asks and rows else []
        lists = list(zip(*found)) if found else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(lists, schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks, rows = None, [], []
        for batch in batches:
            names = zip(batch.column("width").to_pylist(), batch.column("tile").to_pylist())
            for name, (asking, *row) in zip(names, zip(*(batch.column(c).to_pylist() for c in columns))):
                if name != now:
                    if now is not None:
                        yield done(now[0], asks, rows)
                    now, asks, rows = name, [], []
                (asks if asking else rows).append(tuple(row))
        if now is not None:
            yield done(now[0], asks, rows)
    return run


def hard_negatives(anchors: DataFrame, rows: DataFrame, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0, tile_anchors: int = TILE_ANCHORS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Rows of other labels that score nearly as high as a positive:
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as ``floor(scale * x)``; scores are inner products of these, exact. Higher
    scores come first, ties by smaller id. An anchor's positives are its first ``positives`` other rows
    of the same label. For each, the first ``negatives`` rows of other labels are returned whose score
    is ``low`` to ``high`` percent of the positive's; a positive below zero has none.

    Rows without id or label, with a null vector, or with a null or non-finite component take no part;
    nor do those with whole numbers of length 2 ** 31 or more, as their scores need not fit 64 bits. Zero and empty vectors
    do take part. Vectors of different widths have no score. Repeated rows count each; rows with an anchor's id
    are no answers to it, and of anchors that repeat an id the least by label, then planes, asks. Empty tables give no rows; further
    columns are ignored.

    A tile is a key of about ``tile_anchors`` by ``tile_rows`` vectors whatever their labels, so neither a
    frequent label nor many equal vectors make a task larger.
    """
    def sides(df: DataFrame) -> DataFrame:
        vector = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector")) \
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & takes_part(F.col("vector"))) \
            .mapInArrow(_pack(scale), "id long, label long, width int, bits int, planes binary")

    given = materialize(sides(rows), "packed")
    least = F.min(F.struct("label", "width", "bits", "planes"))
    asked = materialize(sides(anchors).groupBy("id").agg(least.alias("r")).select("id", "r.*"), "anchors")
    count = lambda df, size, name: df.groupBy("width").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = materialize(count(given, tile_rows, "across").join(count(asked, tile_anchors, "down"), "width"), "grid")
    n_tiles = grid.agg(F.sum(F.col("across").cast("long") * F.col("down"))).first()[0] or 1

    def spread(df: DataFrame, asks: bool) -> DataFrame:
        own, other = ("down", "across") if asks else ("across", "down")
        mine = F.pmod(F.xxhash64("id"), F.col(own))
        name = mine * F.col("across") + F.col("j") if asks else F.col("j") * F.col("across") + mine
        found = F.col("positives") if asks and "positives" in df.columns else F.lit(None).cast("array<struct<nth:int,id:long,score:long>>")
        return df.join(F.broadcast(grid), "width").withColumn("j", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(
            "width", name.cast("long").alias("tile"), F.lit(asks).alias("asks"), "id", "label", "bits", "planes", found.alias("positives"))

    def over_tiles(asked: DataFrame, solve: Callable[[Tile], Iterator[tuple]], fields: list[str]) -> DataFrame:
        met = spread(asked, True).unionAll(spread(given, False)).repartition(min(n_tiles, 100_000), "width", "tile")
        return met.sortWithinPartitions("width", "tile").mapInArrow(
            _tiles(solve, pa.schema([(f, pa.int64()) for f in fields])), ", ".join(f"{f} long" for f in fields))

    best = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    ranked = over_tiles(asked, lambda tile: positives_of(tile, positives), ["id", "found", "score"]) \
        .withColumn("nth", F.row_number().over(best("id"))).where(F.col("nth") <= positives)
    lists = materialize(ranked.groupBy("id").agg(F.sort_array(F.collect_list(
        F.struct("nth", F.col("found").alias("id"), "score"))).alias("positives")), "positives")
    found = over_tiles(asked.join(lists, "id"), lambda tile: negatives_of(tile, negatives, low, high), ["id", "nth", "found", "score"]) \
        .withColumn("rank", F.row_number().over(best("id", "nth"))).where(F.col("rank") <= negatives)
    one = F.explode("positives")
    return found.join(lists.select("id", one.alias("p")).select("id", F.col("p.nth").cast("long").alias("nth"), "p.id", "p.score").toDF(
        "id", "nth", "positive_id", "positive_score"), ["id", "nth"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
