"""Packing token sequences by a configuration linear program over their lengths.

A configuration is a multiset of lengths that fits one sequence. The program covers the demand of
every length by as few configurations as it can. It is solved over the length histogram, at most
``capacity`` numbers whatever the corpus, by multiplicative weights: prices fall as lengths get
covered, and a knapsack dynamic program finds the best configuration at the current prices. The
solution is rounded down and what remains is packed best fit, largest first, into the room that
configurations leave and into new sequences. Where small pieces are scarce, prices by tokens spend
them on each other; so, unless the volume of the pieces proves the plan good, the program is also run at
prices that put pieces of more than half a sequence first. Every run is tried with its later rounds
left out, and the fewest sequences win. Any prices give a bound that no packing can beat: the
demand's price over that of the best configuration.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardframe.llm.tokens import Encoder
from guardframe.sources.scratch import materialize

CAPACITY, END_ID = 1024, 2
#: Most rounds of the multiplicative weights, how far a round may cover a length at once, how fast
#: a price falls with the covered share, and how much more than in proportion a long piece is worth.
#: The last two together change a full sequence's price by less than one token's.
ROUNDS, STEP, RATE, LONG = 4000, 0.5, 3e-4, 5e-4
#: A plan this near the bound by volume, as a share of it, is taken without the second run.
NEAR = 0.002

Pattern = tuple[int, dict[int, int]]  # how often, and how many of each length


def knapsack(prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths that fits the capacity at the highest total price.

    ``prices[n]`` is the price of length n; lengths of price 0 are not used.
    """
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    backward = np.zeros(capacity + 1)  # best[c - 1], ..., best[0] at its end
    for c in range(1, capacity + 1):
        backward[capacity + 1 - c] = best[c - 1]
        worth = backward[capacity + 1 - c:] + prices[1:c + 1]
        n = int(worth.argmax())
        if prices[n + 1] > 0 and worth[n] > best[c - 1]:
            best[c], took[c] = worth[n], n + 1
        else:
            best[c] = best[c - 1]
    found: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if took[c]:
            found[int(took[c])] += 1
            c -= int(took[c])
        else:
            c -= 1
    return dict(found)


def _worths(capacity: int) -> list[np.ndarray]:
    """What a length is worth before any of it is covered: by its tokens, and with large ones first."""
    sizes = np.arange(capacity + 1, dtype=float)
    by_size = sizes * (1 + LONG * sizes / capacity)
    return [by_size, by_size + capacity * (2 * sizes > capacity)]


def fractional(
    demand: np.ndarray, capacity: int, rounds: int = ROUNDS, worth: np.ndarray | None = None
) -> list[tuple[float, dict[int, int]]]:
    """Configurations with weights that cover the demand, no length too often, in the order they were found.

    A price is a length's worth (its tokens, a little more for long ones, which are the harder to place
    later) times a weight that shrinks with every share of its demand that gets covered.
    """
    wanted = demand.astype(float)
    covered = np.zeros(len(demand))
    worth = _worths(capacity)[0] if worth is None else worth
    out = []
    for _ in range(rounds):
        left = wanted - covered
        usable = left >= 1
        if not usable.any():
            break
        share = covered / np.maximum(wanted, 1)
        found = knapsack(np.where(usable, worth * np.exp(-RATE * share), 0), capacity)
        most = min(min(max(STEP * wanted[n], k), left[n]) / k for n, k in found.items())
        most = int(most) or most
        for n, k in found.items():
            covered[n] += most * k
        out.append((most, found))
    return out


def least(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 100) -> int:
    """A number of sequences that no packing can do with less than; it may be some way below the fewest possible.

    For any prices, the demand's total price over that of the best configuration is such a number.
    Multiplicative weights look for good prices: those of lengths that the best configuration holds fall.
    """
    demand = np.zeros(capacity + 1)
    for n, many in histogram.items():
        demand[n] = many
    if not demand.any():
        return 0
    sizes = np.arange(capacity + 1, dtype=float)
    large = np.where(2 * sizes > capacity, 2.0, np.where(2 * sizes == capacity, 1.0, 0.0))
    best = 0.0
    for start in (sizes, large, sizes / capacity + large):
        prices = np.where(demand > 0, start, 0)
        for _ in range(rounds):
            found = knapsack(prices, capacity)
            top = sum(prices[n] * k for n, k in found.items())
            if top <= 0:
                break
            bound = demand @ prices / top
            best = max(best, bound)
            # how often the configuration would cover each length, were it all of the packing
            cover = {n: bound * k / demand[n] for n, k in found.items()}
            for n, often in cover.items():
                prices[n] *= np.exp(-0.05 * often / max(cover.values()))
    # the scale is that of sums of doubles
    return int(np.ceil(best * (1 - 1e-9)))


def best_fit(demand: np.ndarray, capacity: int, begun: Iterable[Pattern] = ()) -> list[Pattern]:
    """Best fit decreasing over counts of equal lengths, into sequences that are begun and new ones.

    Sequences of equal content are one entry.
    """
    spaces: dict[int, list[Pattern]] = defaultdict(list)
    known: list[int] = []  # spaces in order

    def put(space: int, many: int, content: dict[int, int]) -> None:
        if many:
            if space not in spaces or not spaces[space]:
                if space not in known:
                    bisect.insort(known, space)
            spaces[space].append((many, content))

    for many, content in begun:
        put(capacity - sum(n * k for n, k in content.items()), many, content)
    for n in range(len(demand) - 1, 0, -1):
        left = int(demand[n])
        while left:
            at = bisect.bisect_left(known, n)
            while at < len(known) and not spaces[known[at]]:
                del known[at]
            if at < len(known):
                space = known[at]
                many, content = spaces[space].pop()
            else:
                space, content = capacity, {}
                many = -(-left // (space // n))
            each = space // n
            whole = min(many, left // each)
            put(space - each * n, whole, content | {n: content.get(n, 0) + each})
            left -= whole * each
            if whole < many:
                rest = min(left, each)
                if rest:
                    put(space - rest * n, 1, content | {n: content.get(n, 0) + rest})
                    left -= rest
                put(space, many - whole - bool(rest), content)
    return [p for found in spaces.values() for p in found]


def _rounded(weighted: list[tuple[float, dict[int, int]]], demand: np.ndarray, capacity: int) -> list[Pattern]:
    """Whole configurations, and the rest of the demand by best fit."""
    rest = demand.copy()
    chosen: dict[tuple, float] = defaultdict(float)
    for weight, found in weighted:
        chosen[tuple(sorted(found.items(), reverse=True))] += weight
    out: list[Pattern] = []
    for found, weight in chosen.items():
        many = min([int(weight + 1e-9), *(int(rest[n]) // k for n, k in found)])
        if many:
            out.append((many, dict(found)))
            for n, k in found:
                rest[n] -= many * k
    return best_fit(rest, capacity, out)


def _stops(weighted: list[tuple[float, dict[int, int]]], capacity: int) -> list[int]:
    """After how many rounds a run is tried: none, all, where sequences stop to be full, and between."""
    full = next((i for i, (_, found) in enumerate(weighted) if sum(n * k for n, k in found.items()) < capacity), len(weighted))
    return sorted({0, full, len(weighted), *(len(weighted) * i // 8 for i in range(1, 8))})


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[Pattern]:
    """Configurations and how often to use each; together they hold every length exactly.

    Never more sequences than best fit decreasing needs, which is the program with all rounds left out.
    """
    demand = np.zeros(capacity + 1, np.int64)
    for n, many in histogram.items():
        demand[n] = many
    best, fewest = [], 0

    def offer(tried: list[Pattern]) -> None:
        nonlocal best, fewest
        many = sum(m for m, _ in tried)
        if not best or many < fewest:
            best, fewest = tried, many

    for worth in _worths(capacity):
        weighted = fractional(demand, capacity, rounds, worth)
        for stop in _stops(weighted, capacity):
            offer(_rounded(weighted[:stop], demand, capacity))
        if fewest * capacity <= (1 + NEAR) * int(demand @ np.arange(capacity + 1)) + capacity - 1:
            return best
    return best


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document: full ones, behind a shorter first one."""
    if size <= capacity:
        return [(0, size)]
    first = size % capacity
    return [(0, first)] * bool(first) + [(at, capacity) for at in range(first, size, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(capacity: int, end_id: int, vocabulary: str | None, ranks: str | None, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(vocabulary, ranks), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    row = (key.as_py(), k, start, length, zlib.crc32(own), part, seen[length])
                    row += (np.frombuffer(own, "<u4").astype(np.int32),) * with_ids
                    seen[length] += 1
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _places(patterns: list[Pattern], capacity: int):
    """For the r-th piece of a length: its sequence and offset, by searching the patterns' shares."""
    shares = []
    used: dict[int, int] = defaultdict(int)
    base = 0
    for many, found in patterns:
        offset = 0
        for n, k in sorted(found.items(), reverse=True):
            shares.append((n, used[n], k, base, offset))
            used[n] += many * k
            offset += n * k
        base += many
    shares.sort()
    n, since, each, first, offset = (np.array(x, np.int64) for x in zip(*shares)) if shares else [np.empty(0, np.int64)] * 5
    ends = np.searchsorted(n, np.arange(capacity + 2))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(lengths), np.int64)
            for size in np.unique(lengths):
                low, high = ends[size], ends[size + 1]
                own = lengths == size
                at[own] = low + np.searchsorted(since[low:high], ranks[own], "right") - 1
            inside = ranks - since[at]
            sequence = first[at] + inside // each[at]
            place = offset[at] + inside % each[at] * lengths
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(sequence), pa.array(place)],
                names=[batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY,
         end_id: int = END_ID, vocabulary: str | None = None, ranks: str | None = None,
         rounds: int = ROUNDS, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the program finds.

    A document is its token ids and then ``end_id``; null text is empty. Longer documents are cut
    into full pieces behind a shorter first one. One row per piece: doc_id, piece (from 0), start
    (the document's ids before it), length, ids_crc32 (over the ids as little-endian unsigned
    32-bit numbers), sequence_id, offset, and the ids themselves if ``with_ids``. Places in a
    sequence are gapless from 0. Rows with null or repeated ids are packed like others; further
    columns are ignored; no documents give no rows.

    Only the length histogram reaches the driver. Pieces are numbered within their length by
    prefix sums over (input split, length) counts, so no length meets in one task.
    """
    kind = _PIECES + ", ids array<int>" * with_ids
    pieces = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(_pieces(capacity, end_id, vocabulary, ranks, with_ids), kind), "pieces")
    counts = materialize(
        pieces.where(F.col("length") < capacity).groupBy("length", "part").agg(F.count("*").alias("many")), "counts")
    histogram = {r["length"]: r["many"] for r in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    patterns = plan(histogram, capacity, rounds)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    since = counts.select("length", "part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("since"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    placed = (
        pieces.where(F.col("length") < capacity).join(since, ["length", "part"])
        .select(*names, (F.col("since") + F.col("nth")).alias("rank"))
        .mapInArrow(_places(patterns, capacity), kinds + ", sequence_id long, offset long"))
    # a full piece is a sequence of its own; its number is negative and made of split and place
    full = pieces.where(F.col("length") == capacity).select(
        *names, (-F.shiftleft(F.col("part").cast("long"), 40) - F.col("nth") - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full).select(
        *names[:5], "sequence_id", "offset", *["ids"] * with_ids)
