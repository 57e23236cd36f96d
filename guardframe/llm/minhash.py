"""Near-duplicate documents by circulant MinHash.

One permutation scatters the shingles over a ring of cells, a second one numbers the cells.
Coordinate k of a signature is the smallest number among a document's cells after turning the
numbering by k places, so two permutations give all coordinates. Equal bands of coordinates make
candidates, and every candidate is confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardframe.llm.common import space_words
from guardframe.llm.components import components
from guardframe.sources.scratch import materialize

RING = 1 << 20
BANDS, ROWS = 24, 5
#: Coordinates of which one bit is kept, and standard deviations below the expected agreement at
#: the bar at which a candidate is not confirmed (a link is lost there with probability 1e-7).
BITS, DEVIATIONS = 512, 5.2
SEED = 20240611
#: Slots of the bit map that leaves out rows, a fixed 4 MB.
MARKS = 1 << 25
#: Buckets of more members are compared in tiles of at most so many members and shingles a side.
LARGE, TILE_MEMBERS, TILE_GRAMS = 64, 1024, 2_000_000
#: Rounds that compare every member of a bucket with one of them before all others are.
STARS = 4

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    found = space_words(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), len(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = _mix((out * _M1) ^ (h[k:k + n] + _M3))
    return np.unique(out)


class Signer:
    """Signatures of shingle sets over one pair of permutations."""

    def __init__(self, bands: int, rows: int, seed: int = SEED, ring: int = RING):
        size = max(BITS, bands * rows)
        numbers = np.random.default_rng(seed).permutation(ring).astype(np.uint32)
        turned = np.concatenate([numbers, numbers[:size]])
        self.windows = np.lib.stride_tricks.sliding_window_view(turned, size)[:ring]
        self.bands, self.rows, self.ring = bands, rows, np.uint64(ring - 1)
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _M2)
        self.seed = np.uint64(seed)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        cells = np.unique(_mix(hashes ^ self.seed) & self.ring).astype(np.int64)
        least = self.windows[cells[:256]].min(axis=0)
        for at in range(256, len(cells), 256):
            np.minimum(least, self.windows[cells[at:at + 256]].min(axis=0), out=least)
        return least

    def bits(self, signature: np.ndarray) -> np.ndarray:
        """One bit of every coordinate, packed into 64-bit numbers."""
        one = (signature[:BITS] * np.uint32(0x9E3779B1) >> np.uint32(15)) & np.uint32(1)
        return np.packbits(one.astype(np.uint8)).view(np.int64)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        bands = signature[:self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        out = self.salt.copy()
        for k in range(self.rows):
            out = _mix((out * _M1) ^ (bands[:, k] + _M3))
        return out.view(np.int64)


_SIGNED = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                     ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
_SIGNED_DDL = "id long, n_shingles long, digest binary, bands array<long>, bits array<long>"


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            ids, sizes, digests, keys, bits = [], [], [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                hashes = shingle_set(text.as_py(), words)
                ids.append(key.as_py())
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                found = signer.signature(hashes) if len(hashes) and ids[-1] is not None else None
                keys.append(None if found is None else signer.band_keys(found))
                bits.append(None if found is None else signer.bits(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip((ids, sizes, digests, keys, bits), _SIGNED)], schema=_SIGNED)
    return run


def _sets(words: int, marks: np.ndarray):
    """Shingle sets of the rows whose slot is marked."""
    schema = pa.schema([("id", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((marks[slots >> 6] >> (slots & 63)) & 1 == 1))
            grams = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(grams, pa.list_(pa.int64()))], schema=schema)
    return run


def _slot(column: str):
    return F.pmod(F.xxhash64(column), F.lit(MARKS))


def _sets_of(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, grams) of the wanted ids, without moving texts.

    A bit map of fixed size goes to the tasks and leaves out most other rows where they lie; the
    join behind it is exact.
    """
    wanted = wanted.distinct()
    bits = wanted.select(_slot("id").alias("slot")).select(
        F.expr("slot div 64").alias("cell"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    found = bits.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(MARKS // 64, np.int64)
    marks[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    sets = texts.where("id is not null").withColumn("slot", _slot("id")).mapInArrow(_sets(words, marks), "id long, grams array<long>")
    return materialize(sets.join(wanted, "id", "left_semi"), "sets")


def _fits(a: str, b: str, percent: int):
    """Sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _alike(a: str, b: str, percent: int):
    """Bits agree as often as those of similar sets do, but for chance."""
    equal = (1 + percent / 100) / 2
    most = int(BITS * (1 - equal) + DEVIATIONS * math.sqrt(BITS * equal * (1 - equal)))
    unequal = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(BITS // 64)), F.lit(0))
    return unequal <= most


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    sets = _sets_of(texts, pairs.select(F.col("a").alias("id")).distinct().unionAll(pairs.select("b").distinct()), words)
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return materialize(
        pairs.select("a", "b").join(right, "b").join(left, "a")
        .select("a", "b", both.alias("common"), (F.size("ga") + F.size("gb") - both).alias("either"))
        .where(F.col("common") * 100 >= F.col("either") * percent).select("a", "b"), "links")


def _star(live: DataFrame, order) -> DataFrame:
    """In buckets that still hold several classes: the first member in an order, with all of other classes."""
    first = (
        live.groupBy("key").agg(F.min(F.struct(order.alias("order"), "rid", "n", "root")).alias("p"),
                                F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high").select("key", F.col("p.rid").alias("prid"), F.col("p.n").alias("pn"),
                                    F.col("p.root").alias("proot")))
    return live.join(first, "key").where("root <> proot").select(
        F.least("rid", "prid").alias("a"), F.greatest("rid", "prid").alias("b"), "n", "pn")


def tile_links(ids: np.ndarray, roots: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, grams: np.ndarray,
               percent: int) -> list[tuple[int, int]]:
    """Links that join what the pairs of a tile join: enough of them to connect all that they connect.

    Members are told by block; unless there is one block only, pairs lie across the two. Sets lie
    one behind the other in ``grams``. Pairs of one root are left out.
    """
    many = len(ids)
    _, column, holders = np.unique(grams, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(many), sizes)
    shared = holders[column] > 1  # a shingle of one member is in no intersection
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    common = np.zeros((many, many), np.float32)
    width = max(1, min(4096, int(column.max(initial=0)) + 1))
    for first in range(0, int(column.max(initial=-1)) + 1, width):
        low, high = np.searchsorted(column, (first, first + width))
        held = np.zeros((many, width), np.float32)
        held[row[low:high], column[low:high] - first] = 1
        common += held @ held.T
    either = sizes[:, None] + sizes - common
    good = (100 * common >= percent * either) & (roots[:, None] != roots)
    if blocks.min() != blocks.max():
        good &= blocks[:, None] != blocks
    up = {r: r for r in roots.tolist()}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r
    out = []
    for i, j in np.argwhere(np.triu(good, 1)).tolist():
        a, b = top(int(roots[i])), top(int(roots[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _tiles(live: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of different classes of large buckets, tile by tile."""
    sets = _sets_of(texts, live.select(F.col("rid").alias("id")), words)
    blocks = F.ceil(F.greatest(F.col("members") / TILE_MEMBERS, F.col("grams") / TILE_GRAMS)).cast("int")
    own = live.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    own = own.select("key", "rid", "root", "blocks", "block").join(sets.withColumnRenamed("id", "rid"), "rid")
    own = own.select("key", "rid", "root", "block", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    own = own.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
                     "rid", "root", "block", "grams")

    def links(members: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(members).combine_chunks()
        grams = table.column("grams").combine_chunks()
        grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
        found = tile_links(
            *(table.column(c).to_numpy() for c in ("rid", "root", "block")),
            np.diff(grams.offsets.to_numpy()).astype(np.int64), grams.flatten().to_numpy(), percent)
        columns = list(zip(*found)) if found else [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high"))))
            starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            for k, end in zip(starts, starts[1:] + [len(names)]):
                if names[k] != now:
                    if members:
                        yield links(members)
                    now, members = names[k], []
                members.append(batch.slice(k, end - k))
        if members:
            yield links(members)
    tile = ["key", "low", "high"]
    return materialize(own.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "a long, b long").distinct(), "tiles")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of near-duplicates: one row (id, n_shingles, component_id, kept) per input row.

    Two documents are linked when ``100 * common >= percent * all`` over their sets of distinct
    word shingles; a text with fewer words is one shingle, and one without words is linked with
    nothing. ``component_id`` is the smallest id reachable over links. Rows that repeat an id are
    returned each; under different texts, a link of one of them counts for the id. Rows without id
    are returned with a null class, not kept, and link nothing. Further columns are ignored.

    Equal sets are folded first, so a group of copies costs one aggregate. Then every bucket's
    members are compared with one of them, in up to STARS rounds with other choices, leaving out
    pairs that are in one class already; what then still lies in one bucket but in different
    classes is compared with each other, in large buckets by tiles of bounded size. A pair at the bar of 80 % is missed by all 24 bands of 5
    with probability 5e-5, at 85 % with 8e-7. One bit of each of 512 coordinates sorts out the
    candidates that are far from the bar.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(_sign(words, bands, rows), _SIGNED_DDL), "signed")
    classes = materialize(
        signed.where("id is not null and digest is not null").groupBy("digest")
        .agg(F.min(F.struct("id", "n_shingles", "bands", "bits")).alias("first"))
        .select("digest", F.col("first.id").alias("rid"), F.col("first.n_shingles").alias("n"),
                F.col("first.bands").alias("bands"), F.col("first.bits").alias("bits")), "classes")
    bits = classes.select("rid", "bits")
    buckets = classes.select(F.explode("bands").alias("key"), "rid", "n")
    shared = materialize(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    live = materialize(buckets.join(shared, "key").withColumn("root", F.col("rid")), "live")

    def near(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(_fits("n", "pn", percent)).select("a", "b").distinct()
        return materialize(
            pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
            .where(_alike("bits_a", "bits_b", percent)).select("a", "b"), "near")

    links = roots = None
    for turn in range(STARS):
        order = F.lit(0) if turn == 0 else F.xxhash64("rid", F.lit(turn))
        more = _confirm(near(_star(live, order)), texts, words, percent)
        found = not more.isEmpty()
        if found:
            links = more if links is None else materialize(links.unionAll(more), "links")
            roots = components(links)
            live = live.drop("root").join(roots.toDF("rid", "top"), "rid", "left").withColumn(
                "root", F.coalesce("top", "rid")).select("key", "rid", "n", "size", "root")
        if turn == 0:
            live = live.where("size > 2")
        split = live.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        live = materialize(live.join(split.select("key"), "key", "left_semi"), "live")
        if turn and not found:
            break

    sizes = live.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("grams"))
    live = materialize(live.drop("size").join(sizes, "key"), "live")
    small = live.where(F.col("members") <= LARGE).join(bits, "rid")
    other = small.select("key", *(F.col(c).alias(f"{c}_b") for c in ("rid", "n", "root", "bits")))
    open_pairs = small.join(other, "key").where(
        (F.col("rid") < F.col("rid_b")) & (F.col("root") != F.col("root_b")) & _fits("n", "n_b", percent)
        & _alike("bits", "bits_b", percent)).select(F.col("rid").alias("a"), F.col("rid_b").alias("b")).distinct()
    more = _confirm(materialize(open_pairs, "open"), texts, words, percent)
    large = live.where(F.col("members") > LARGE)
    if not large.isEmpty():
        more = more.unionAll(_tiles(large, texts, words, percent))
    if not more.isEmpty():
        links = more if links is None else links.unionAll(more)
        roots = components(links)

    grouped = classes.select("digest", "rid")
    if roots is not None:
        grouped = grouped.join(roots.toDF("rid", "root"), "rid", "left").withColumn("rid", F.coalesce("root", "rid"))
    grouped = grouped.select("digest", F.col("rid").alias("class"))
    lone = F.when(F.col("digest").isNull(), F.col("id"))
    return (
        signed.select("id", "n_shingles", "digest").join(grouped, "digest", "left")
        .select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("class", lone)).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))))
