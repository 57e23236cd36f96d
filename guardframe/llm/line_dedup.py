"""Removal of lines that repeat across documents, found by two Bloom filters.

A first pass over the texts sets bits for the hashes of their lines: one filter holds the bits that
were hit at least once, the other those hit at least twice. Partial filters of tasks are merged by
shards of the bit range, where a bit set in two parts is one hit twice. The second filter has a
fixed size and is broadcast; it has every line that two documents share, and few others. Only lines
that it reports are shuffled, as digests, to settle which of them repeat and where they come first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardframe.llm.common import LOWER
from guardframe.operators.joins import lookup
from guardframe.sources.scratch import materialize

#: Bits of either filter, and of a shard, as powers of two: 64 MiB whatever the input, in 512 shards.
#: Past some 500 million lines the filter fills up and more lines than the repeated ones are shuffled.
BITS, SHARD_BITS = 29, 20
#: Hashes that a task gathers before it sends its bits.
GATHER = 4_000_000
#: A key is a line without white space at its ends, A-Z lower-cased; shorter ones are no keys.
LEAST = 10


def keys_of(text: bytes, least: int = LEAST) -> list[bytes | None]:
    """The key of every line, or None where it has fewer than ``least`` code points."""
    return [
        key if len(key) >= 4 * least or len(key) >= least and (key.isascii() or len(key.decode()) >= least) else None
        for key in map(bytes.strip, text.translate(LOWER).split(b"\n"))
    ]


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of every 64-bit hash, one row each."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask]).astype(np.int64)


def _hashes(texts: Iterable[bytes | None], least: int) -> Iterator[int]:
    """Hashes of a document's different keys, document by document."""
    for text in texts:
        if text:
            for key in set(keys_of(text, least)):
                if key is not None:
                    yield xxhash.xxh3_64_intdigest(key)


def _bits(bits: int, shard_bits: int, least: int):
    """Partial filters of a task: per shard, the offsets of its bits and which of them were hit twice."""
    schema = pa.schema([("shard", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def send(gathered: list[int]) -> pa.RecordBatch:
        hit, times = np.unique(positions(np.array(gathered, np.uint64), bits), return_counts=True)
        shard, offset, again = hit >> shard_bits, (hit & ((1 << shard_bits) - 1)).astype("<u4"), times > 1
        names, starts = np.unique(shard, return_index=True)
        ends = [*starts[1:], len(hit)]
        return pa.RecordBatch.from_arrays([
            pa.array(names, pa.int32()),
            pa.array([offset[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            pa.array([offset[a:b][again[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        ], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[int] = []
        for batch in batches:
            gathered.extend(_hashes(batch.column("text").to_pylist(), least))
            if len(gathered) >= GATHER:
                yield send(gathered)
                gathered = []
        if gathered:
            yield send(gathered)
    return run


def _merged(shard_bits: int):
    """The bits of a shard that were hit twice, as a compressed bit map; parts of a shard follow each other."""
    schema = pa.schema([("shard", pa.int32()), ("twice", pa.binary())])

    def close(shard: int, twice: np.ndarray) -> pa.RecordBatch:
        packed = [zlib.compress(np.packbits(twice).tobytes(), 1)] if twice.any() else []
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * len(packed), pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for batch in batches:
            for shard, first, again in zip(*(batch.column(n).to_pylist() for n in ("shard", "once", "twice"))):
                if shard != now:
                    if now is not None:
                        yield close(now, twice)
                    now, once, twice = shard, np.zeros(1 << shard_bits, bool), np.zeros(1 << shard_bits, bool)
                at = np.frombuffer(first, "<u4")
                twice[at] |= once[at]
                once[at] = True
                twice[np.frombuffer(again, "<u4")] = True
        if now is not None:
            yield close(now, twice)
    return run


class Suspects:
    """The broadcast filter of bits hit twice; unpacked once in a task."""

    def __init__(self, shards: dict[int, bytes], bits: int, shard_bits: int):
        self.bits = bits
        size = (1 << shard_bits) // 8
        self.table = np.zeros(((1 << bits) + 7) // 8, np.uint8)
        for shard, packed in shards.items():
            self.table[shard * size:(shard + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)

    def among(self, keys: list[bytes]) -> list[bytes]:
        """Those keys whose bits were all hit twice."""
        at = positions(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), self.bits)
        held = ((self.table[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0)
        return [key for key, yes in zip(keys, held.tolist()) if yes]


def _split(shards, bits: int, shard_bits: int, least: int, wanted: bool):
    """Documents with suspected lines and those lines' digests, or documents without any and their lines' number."""
    fields = [("id", pa.int64()), ("text", pa.binary())]
    schema = pa.schema([*fields, ("suspects", pa.list_(pa.binary()))] if wanted else [*fields, ("n_lines", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Suspects(shards.value, bits, shard_bits)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                text = text or b""
                lines = [] if key is None else [k for k in dict.fromkeys(keys_of(text, least)) if k is not None]
                found = held.among(lines) if lines else []
                if bool(found) == wanted:
                    rows.append((key, text, [hashlib.sha256(k).digest() for k in found] if wanted else text.count(b"\n") + 1))
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _without(least: int):
    """Texts without the lines whose digest is in the row's list."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.binary()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, drops in zip(*(batch.column(n).to_pylist() for n in ("id", "text", "drops"))):
                lines, gone = text.split(b"\n"), set(drops or ())
                kept = lines if not gone else [
                    line for line, k in zip(lines, keys_of(text, least))
                    if k is None or hashlib.sha256(k).digest() not in gone]
                rows.append((key, b"\n".join(kept), len(lines), len(lines) - len(kept)))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def repeated_filter(texts: DataFrame, least: int = LEAST, bits: int = BITS, shard_bits: int = SHARD_BITS) -> dict[int, bytes]:
    """The bits hit twice, by shard: at most ``2 ** bits / 8`` bytes, compressed. ``texts`` has id and binary text."""
    parts = texts.where("id is not null").select("text").mapInArrow(
        _bits(bits, shard_bits, least), "shard int, once binary, twice binary")
    merged = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _merged(shard_bits), "shard int, twice binary")
    return {r["shard"]: r["twice"] for r in merged.collect()}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                least: int = LEAST, bits: int = BITS, shard_bits: int = SHARD_BITS) -> DataFrame:
    """Texts without the lines that an earlier document has: (id, text, n_lines, n_dropped).

    Lines end at \\n. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z
    lower-cased. Keys of at least ``least`` code points that two documents have, by id, lose all
    their lines but those in the document of the smallest id, where repeats within stay. All other
    lines stay as they are, and in order.

    A null or empty text is one empty line and comes back empty. Rows without id stay whole and count
    for nothing. Rows that share an id are one document: a line that only they have stays in all of
    them. An empty table gives no rows; further columns are ignored. Texts of any length are read whole.

    Filters have ``2 ** bits`` bits. However full they are, no repeated line escapes them, and lines
    reported wrongly are found to occur once. Lines in a large part of the documents are counted before they
    are shuffled, and looked up without a shuffle.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    shards = docs.sparkSession.sparkContext.broadcast(repeated_filter(texts, least, bits, shard_bits))
    dirty = materialize(texts.mapInArrow(
        _split(shards, bits, shard_bits, least, True), "id long, text binary, suspects array<binary>"), "suspects")
    suspects = dirty.select("id", F.explode("suspects").alias("line"))
    firsts = suspects.groupBy("line").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("times")).where("first < last").drop("last")
    drops = lookup(suspects, materialize(firsts, "repeats"), "line", "times").where("id > first") \
        .groupBy("id").agg(F.collect_set("line").alias("drops"))
    kept = dirty.select("id", "text").join(drops, "id", "left").mapInArrow(
        _without(least), "id long, text binary, n_lines long, n_dropped long")
    clean = texts.mapInArrow(_split(shards, bits, shard_bits, least, False), "id long, text binary, n_lines long") \
        .withColumn("n_dropped", F.lit(0).cast("long"))
    return clean.unionByName(kept).withColumn("text", F.col("text").cast("string"))
