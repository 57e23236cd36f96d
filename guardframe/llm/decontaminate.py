"""Benchmark passages in training documents: rare word pairs as seeds, then local alignment.

Seeds are pairs of words that stand next or next but one in an item. One pass over the documents
counts in how many each pair occurs; every item leaves out its commonest pairs, but no more than an
alignment at the bar can do without. A second pass aligns the item with the words around the places
that have the seeds such an alignment must have, so none is lost. Both passes read the documents
where they lie; test items travel in blocks of bounded size, and documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of an item that is searched, and bytes of test text in a block.
SEED_WORDS, BLOCK_BYTES = 3, 1 << 20
#: Alignment scores per word (the bounds in ``Items`` hold for these), and the share of an item's full score that counts as a leak.
MATCH, MISMATCH, GAP, LEAK = 2, -1, -1, 0.4

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
               for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and signs beyond ASCII, A-Z lower-cased; none for null."""
    return [] if text is None else text.encode().translate(_WORDS).split()


def best_end(window: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best score, and its last row and column plus one."""
    steps = np.arange(len(item)) * -GAP
    above = np.zeros(len(item) + 1, np.int64)
    best = (0, 0, 0)
    for row, word in enumerate(window):
        here = np.where(item == word, MATCH, MISMATCH) + above[:-1]
        np.maximum(here, above[1:] + GAP, out=here)
        np.maximum(here, 0, out=here)
        above[1:] = np.maximum.accumulate(here + steps) - steps
        at = int(above[1:].argmax())
        if above[at + 1] > best[0]:
            best = (int(above[at + 1]), row + 1, at + 1)
    return best


def align(window: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score and the rows it covers, start and end."""
    score, end, column = best_end(window, item)
    if not score:
        return 0, 0, 0
    _, back, _ = best_end(window[:end][::-1], item[:column][::-1])
    return score, end - back, end


class Items:
    """A block of test items as word numbers, with their pairs of words that stand next or next but one.

    An alignment that reaches the bar of an item of n words has m <= n matches and loses at most
    2m - 2 share n points. Between neighbouring matches that stand at most two words apart on either
    side it loses max(distances) - 1, between others two points or more; so two points for every
    neighbouring pair less what it loses make 2 share n - 2 at least, in at most 3n - 2 share n words.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], size: int, share: float):
        self.ids = [i for i, found in items if len(found) >= size]
        found = [w for _, w in items if len(w) >= size]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for own in found for w in own}))}
        self.base = np.int64(len(self.number) + 1)
        self.words = [self.numbers(own) for own in found]
        lengths = np.array([len(own) for own in found], np.int64)
        self.need = MATCH * share * lengths - MATCH
        self.reach = np.ceil(3 * lengths - MATCH * share * lengths).astype(np.int64) + 1
        self.every = np.unique(np.concatenate([self.keys(own, d) for own in self.words for d in (1, 2)])) \
            if found else np.empty(0, np.int64)
        self.use(np.zeros(len(self.every), np.int64))

    def numbers(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, found, repeat(0)), np.int64, len(found))

    def keys(self, numbers: np.ndarray, distance: int) -> np.ndarray:
        """The pair that starts at each word; 0 where one of its words is in no item."""
        one, other = numbers[:-distance], numbers[distance:]
        return np.where((one > 0) & (other > 0), one * self.base + other, 0)

    def use(self, counts: np.ndarray) -> None:
        """Take all pairs as seeds but the commonest of every item, as far as the others must still
        have half of the points; counts go with ``every``."""
        self.left = self.need.copy()
        rows: list[tuple[int, int, int]] = []  # pair, item, points
        for k, own in enumerate(self.words):
            places: dict[int, set[int]] = defaultdict(set)
            near, far = (np.searchsorted(self.every, self.keys(own, d)).tolist() for d in (1, 2))
            for pairs in (near, far):
                for at, pair in enumerate(pairs):
                    places[pair].add(at)
            points = dict.fromkeys(far, MATCH - 1) | dict.fromkeys(near, MATCH)
            dropped: set[int] = set()
            for pair in sorted(places, key=lambda p: -counts[p]):
                more = dropped | places[pair]
                if 2 * MATCH * len(more) > self.need[k]:
                    break
                dropped = more
                del points[pair]
            self.left[k] -= MATCH * len(dropped)
            rows += [(pair, k, n) for pair, n in points.items()]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.item, self.points = table[:, 1], table[:, 2]
        self.starts = np.searchsorted(table[:, 0], np.arange(len(self.every) + 1))

    def hits(self, numbers: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a text's pairs that are an item's, and the pairs' places in ``every``."""
        keys = self.keys(numbers, distance)
        at = np.flatnonzero(keys)
        if not len(at) or not len(self.every):
            return at[:0], at[:0]
        keys = keys[at]
        place = np.minimum(np.searchsorted(self.every, keys), len(self.every) - 1)
        good = self.every[place] == keys
        return at[good], place[good]

    def spots(self, numbers: np.ndarray) -> dict[int, list[int]]:
        """By item, where the words within its reach have the points that an alignment at the bar has."""
        found = [self.hits(numbers, d) for d in (1, 2)]
        pair = np.concatenate([p for _, p in found])
        first, count = self.starts[pair], self.starts[pair + 1] - self.starts[pair]
        row = np.repeat(np.arange(len(pair)), count)
        if not len(row):
            return {}
        at = np.arange(len(row)) + (first - np.cumsum(count) + count)[row]
        item, place = self.item[at], np.concatenate([p for p, _ in found])[row]
        points = np.where(row < len(found[0][0]), self.points[at], MATCH - 1)
        enough = (np.bincount(item, points, len(self.words)) >= self.left - 1e-9)[item]
        if not enough.any():
            return {}
        item, place, points = item[enough], place[enough], points[enough]
        # one entry for every item and word, by both in order; words of two items are out of reach
        width = len(numbers) + int(self.reach.max())
        key = item * width + place
        order = np.argsort(key, kind="stable")
        key, points = key[order], points[order]
        fresh = np.flatnonzero(np.diff(key, prepend=-1))
        key, points = key[fresh], np.maximum.reduceat(points, fresh)
        item = key // width
        before = np.concatenate([[0], np.cumsum(points)])
        good = before[np.searchsorted(key, key + self.reach[item])] - before[:-1] >= self.left[item] - 1e-9
        out: dict[int, list[int]] = defaultdict(list)
        for k, place in zip(item[good].tolist(), (key - item * width)[good].tolist()):
            out[k].append(place)
        return out

    def leaks(self, text: str | None, share: float, known: dict) -> list[tuple[int, float, int, int]]:
        """The items that a text holds: number, share of the full score, first and last word."""
        numbers = self.numbers(words(text))
        spots = self.spots(numbers)
        # of these one word reaches the bar
        spots |= {k: list(range(len(numbers))) for k in np.flatnonzero(self.need <= 0).tolist()}
        out = []
        for item, starts in spots.items():
            own, best = self.words[item], (0, 0, 0)
            reach = int(self.reach[item])
            low = high = None
            for start in [*starts, None]:
                if low is not None and (start is None or start > high + 2 * reach):
                    first, last = max(0, low - reach), min(len(numbers), high + reach)
                    score, a, b = self._best(item, numbers[first:last], share, known)
                    best = max(best, (score, -first - a, first + b))
                    low = None
                if start is not None:
                    low, high = (start if low is None else low), start
            if best[0] >= share * MATCH * len(own):
                out.append((self.ids[item], best[0] / (MATCH * len(own)), -best[1], best[2] - 1))
        return out

    def _best(self, item: int, window: np.ndarray, share: float, known: dict) -> tuple[int, int, int]:
        own = self.words[item]
        # an alignment that reaches the bar matches at least this many of the item's words
        if np.isin(own, window).sum() < share * len(own):
            return 0, 0, 0
        key = (item, window.tobytes())
        if key not in known:
            if len(known) >= 20_000:
                known.clear()
            known[key] = align(window, own)
        return known[key]


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int, share: float, block_bytes: int) -> Iterator[Items]:
    own = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        yield Items(sorted(((r["id"], words(r["text"])) for r in rows), key=lambda r: (r[0] is None, r)), size, share)


def _seeded(docs: DataFrame, block: Items) -> Items:
    """The block with its seeds chosen by how many documents hold each pair."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(block.every), np.int64)
        for batch in batches:
            for text in batch.column(0):
                numbers = block.numbers(words(text.as_py()))
                seen[np.unique(np.concatenate([block.hits(numbers, d)[1] for d in (1, 2)]))] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "docs"])

    counts = np.zeros(len(block.every), np.int64)
    if len(counts):
        for row in docs.mapInArrow(count, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")).collect():
            counts[row["pair"]] = row["docs"]
    block.use(counts)
    return block


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", *, seed_words: int = SEED_WORDS,
          share: float = LEAK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of document and test item: (doc_id, item_id, score, first_word, last_word).

    The score is that of the best local alignment, as a share of the item's full score; pairs
    below ``share`` are left out. Words count from 0. Null or empty texts hold nothing; items of
    fewer than ``seed_words`` words are not searched; repeated rows give rows each, as do rows
    without id. Further columns are ignored. A block's items and pairs travel to the tasks, at
    most about ``block_bytes`` of text at a time, whatever the size of the test set.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for block in _blocks(items, item_id, item_text, seed_words, share, block_bytes):
        part = own.mapInArrow(
            _find(_seeded(own.select("text"), block), share),
            "doc_id long, item_id long, score double, first_word long, last_word long")
        found = part if found is None else found.unionAll(part)
    return found


def _find(block: Items, share: float):
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = [(key.as_py(), *leak) for key, text in zip(batch.column(0), batch.column(1))
                    for leak in block.leaks(text.as_py(), share, known)]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "item_id", "score", "first_word", "last_word"])
    return run


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", *, seed_words: int = SEED_WORDS,
                  share: float = LEAK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all their columns, that hold no test item; rows are judged one by one."""
    at = docs.columns.index(text_col)
    out = docs
    for block in _blocks(items, item_id, item_text, seed_words, share, block_bytes):
        block = _seeded(docs.select(text_col), block)

        def keep(batches: Iterable[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                clean = [not block.leaks(text.as_py(), share, known) for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))
        out = out.mapInArrow(keep, docs.schema)
    return out
