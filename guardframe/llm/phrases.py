"""Phrase collocations, counted by double-array tries over all text positions at once.

Three passes over the texts. The first counts hashes of all word sequences and keeps those that
are frequent enough as bits of a filter of fixed size. The second writes down the sequences that the
filter lets through and whose parts it lets through too: by the Apriori rule these hold every
frequent phrase. They are dealt to tries of bounded size, two levels per word, which are broadcast.
The third pass moves the states of all positions of a text through a trie, level by level, and
counts the accepting states; the counts of all tasks are summed.

A text meets every trie of its language, and tries grow in number with the texts. Where they would be
more than can travel at once, the second pass is the last: it writes down with every sequence how
often a task has met it, and the sums by sequence are the counts. Every text is then read twice, at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardframe.operators.joins import lookup
from guardframe.sources.scratch import materialize

#: Bits of the filter as a power of two: 64 MiB at most; past some hundred million frequent phrases it lets more through.
BITS = 29
#: Least number of parts of the filter; sessions with many shuffle partitions have four times as many parts.
GROUPS = 4096
#: Phrases of a trie, tries whose phrases are broadcast at a time, and neighbouring phrases whose counts are summed together.
TRIE, AT_ONCE, RANGE = 1 << 17, 4, 1 << 13
#: Bytes of text and hashes that a task works on at a time, and words and hashes of phrases that it remembers.
CHUNK, GATHER, REMEMBER, TOLD = 1 << 20, 2_500_000, 150_000, 2_000_000
#: Phrases, and bytes of them, that a task sums up before it hands them on.
HELD, HELD_BYTES = 500_000, 1 << 25
#: Least share of a phrase's occurrences, in percent, that a longer one must have to take its place.
COVERED = 50

#: A-Z to lower case, and every sign that ends a piece to a full stop.
_CLEAN = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def chunks(rows: Iterable[tuple[str, bytes | None]], size: int = CHUNK) -> Iterator[tuple[str, list[bytes]]]:
    """Words of the texts of one language after the other, with a full stop after every piece."""
    waiting: dict[str, list[bytes]] = {}
    length: dict[str, int] = {}

    def split(lang: str) -> tuple[str, list[bytes]]:
        length[lang] = 0
        return lang, b".".join([*waiting.pop(lang), b""]).replace(b".", b" . ").split()

    for lang, text in rows:
        text = (text or b"").translate(_CLEAN)
        while text:
            # a long text is cut behind a piece
            cut = len(text) if len(text) <= size else text.rfind(b".", 0, size) + 1 or text.find(b".") + 1 or len(text)
            waiting.setdefault(lang, []).append(text[:cut])
            length[lang] = length.get(lang, 0) + cut
            text = text[cut:]
            if length[lang] >= size:
                yield split(lang)
    for lang in list(waiting):
        yield split(lang)


class Words(dict):
    """Numbers of the words met so far, 0 for the end of a piece, and a 128-bit digest of each."""

    def __init__(self):
        self.age = 0
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.age += 1
        self.digests, self.table = [bytes(16)], np.zeros((1, 2), np.uint64)
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.digests)
        self.digests.append(xxhash.xxh3_128_digest(word))
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def halves(self) -> np.ndarray:
        """All digests so far as two numbers each."""
        new = self.digests[len(self.table):]
        if new:
            self.table = np.concatenate([self.table, np.frombuffer(b"".join(new), "<u8").reshape(-1, 2)])
        return self.table


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no bit unmixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Hashes of all word sequences of a chunk by length, where a piece holds them; equal words, equal hash."""

    def __init__(self):
        self.words = Words()

    def __call__(self, lang: str, words: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every length from 1 on: (first places, hashes)."""
        if len(self.words) > REMEMBER:
            self.words.forget()
        numbers = self.words.numbers(words)
        own = self.words.halves()[:, 0][numbers]
        places = np.flatnonzero(numbers)
        state = np.full(len(places), xxhash.xxh3_64_intdigest(lang), np.uint64)
        for length in range(1, most + 1):
            state = _mix(state * np.uint64(0x9E3779B97F4A7C15) + own[places + length - 1])
            yield places, state
            # the last word of a chunk is followed by the end of a piece
            on = numbers[places + length] > 0
            places, state = places[on], state[on]


def _keys(hashes: np.ndarray, groups: int) -> np.ndarray:
    """What is counted of a hash: the part of the filter it belongs to, above 32 further bits."""
    return (hashes & np.uint64(groups - 1)) << np.uint64(32) | hashes >> np.uint64(32)


def _places(rest: np.ndarray, size: int) -> np.ndarray:
    """The two bits of a key in its part of the filter, which has ``size``."""
    rest = rest.astype(np.uint32, copy=False)
    mask = np.uint32(size - 1)
    return np.stack([rest & mask, (rest >> np.uint32(15)) & mask]).astype(np.int64)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            some = batch.slice(at, 256)
            yield from zip(some.column("lang").to_pylist(), some.column("text").to_pylist())


def _count_hashes(most: int, least: int, groups: int):
    """Keys of a task with the times they were met, by part; more than ``least`` times is enough to know."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])
    enough = np.uint32(min(least, 2**32 - 1))

    def send(gathered: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(gathered)
        gathered.clear()
        keys.sort()
        firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.minimum(np.diff(firsts, append=len(keys)), enough).astype("<u1" if enough < 256 else "<u4")
        keys = keys[firsts]
        names, starts = np.unique((keys >> np.uint64(32)).astype(np.int32), return_index=True)
        ends = [*starts[1:].tolist(), len(keys)]
        rest = keys.astype("<u4")
        cut = lambda column: pa.array([column[a:b].tobytes() for a, b in zip(starts.tolist(), ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), cut(rest), cut(times)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, gathered, held = Hashed(), [], 0
        for lang, words in chunks(_rows(batches)):
            for _, hashes in hashed(lang, words, most):
                gathered.append(_keys(hashes, groups))
                held += len(hashes)
            if held >= GATHER:
                yield send(gathered)
                held = 0
        if held:
            yield send(gathered)
    return run


def _frequent(least: int, groups: int, bits: int):
    """Parts of the filter: bits of the keys that were counted often enough, and the number of these keys."""
    schema = pa.schema([("part", pa.int32()), ("held", pa.binary()), ("n", pa.int64())])
    size = (1 << bits) // groups
    kind = "<u1" if least < 256 else "<u4"

    def close(part: int, lists: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys, which = np.unique(np.frombuffer(b"".join(h for h, _ in lists), "<u4"), return_inverse=True)
        kept = keys[np.bincount(which, np.frombuffer(b"".join(t for _, t in lists), kind)) >= least]
        table = np.zeros(size, bool)
        table[_places(kept, size).ravel()] = True
        packed = [zlib.compress(np.packbits(table).tobytes(), 1)] if len(kept) else []
        return pa.RecordBatch.from_arrays([pa.array([part] * len(packed), pa.int32()), pa.array(packed, pa.binary()),
                                           pa.array([len(kept)] * len(packed), pa.int64())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, []
        for batch in batches:
            for part, *pair in zip(*(batch.column(n).to_pylist() for n in ("part", "keys", "times"))):
                if part != now and now is not None:
                    yield close(now, lists)
                    lists = []
                now = part
                lists.append(pair)
        if now is not None:
            yield close(now, lists)
    return run


class Filter:
    """The broadcast filter; unpacked once in a task."""

    def __init__(self, parts: dict[int, bytes], groups: int, bits: int):
        self.groups, self.size = groups, (1 << bits) // groups
        self.table = np.zeros((groups, self.size // 8), np.uint8)
        for part, packed in parts.items():
            self.table[part] = np.frombuffer(zlib.decompress(packed), np.uint8)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        keys = _keys(hashes, self.groups)
        at = _places(keys, self.size)
        return ((self.table[(keys >> np.uint64(32)).astype(np.int64), at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def _passing(held: Filter, hashed: Hashed, lang: str, words: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every length from 1 on: (first places, hashes) of the sequences that may be frequent, and whose parts may be."""
    before = None
    for places, hashes in hashed(lang, words, most):
        if before is not None:  # both parts that are a word shorter
            on = before[places] & before[places + 1]
            places, hashes = places[on], hashes[on]
        passed = held.among(hashes)
        places, hashes = places[passed], hashes[passed]
        before = np.zeros(len(words) + 1, bool)
        before[places] = True
        yield places, hashes


def _candidates(filter, groups: int, bits: int, most: int):
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashed, told = Filter(filter.value, groups, bits), Hashed(), np.zeros(0, np.uint64)
        for lang, words in chunks(_rows(batches)):
            found, told_now = [], []
            for length, (places, hashes) in enumerate(_passing(held, hashed, lang, words, most), 1):
                once, at = np.unique(hashes, return_index=True)
                if len(told):
                    new = told[np.minimum(np.searchsorted(told, once), len(told) - 1)] != once
                    once, at = once[new], at[new]
                told_now.append(once)
                found += [b" ".join(words[i:i + length]).decode() for i in places[at].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], schema=schema)
            # what is forgotten is told again, which does no harm
            told = np.sort(np.concatenate([told if len(told) < TOLD else told[:0], *told_now]))
    return run


class Tally:
    """Times of the phrases that a task has met, told apart by the hashes of language and words."""

    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("times", pa.binary())])

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        # hashes in order with the numbers of their phrases, which count in the order of arrival
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.times, self.texts, self.size = np.zeros(0, np.int64), [], 0
        self.langs: list[tuple[str, int]] = []

    def add(self, lang: str, words: list[bytes], found: Iterable[tuple[np.ndarray, np.ndarray]]) -> None:
        """Count the sequences of a chunk, which come as first places and hashes for every length."""
        places, hashes = zip(*found)
        lengths = np.repeat(np.arange(1, len(places) + 1), list(map(len, places)))
        places, hashes = np.concatenate(places), np.concatenate(hashes)
        if not len(hashes):
            return
        order = np.argsort(hashes)
        hashes = hashes[order]
        firsts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        times = np.diff(firsts, append=len(hashes))
        once, at = hashes[firsts], order[firsts]
        slots = np.searchsorted(self.hashes, once)
        known = np.zeros(len(once), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(slots, len(self.hashes) - 1)] == once
        self.times[self.numbers[slots[known]]] += times[known]
        new = ~known
        texts = [b" ".join(words[i:i + n]) for i, n in zip(places[at[new]].tolist(), lengths[at[new]].tolist())]
        self.hashes = np.insert(self.hashes, slots[new], once[new])
        self.numbers = np.insert(self.numbers, slots[new], len(self.texts) + np.arange(len(texts)))
        self.times = np.concatenate([self.times, times[new]])
        self.texts += texts
        self.size += sum(map(len, texts))
        self.langs.append((lang, len(texts)))

    def close(self, groups: int) -> pa.RecordBatch:
        """Phrases and times by part and language; forgets them."""
        hashes = np.zeros(len(self.texts), np.uint64)
        hashes[self.numbers] = self.hashes
        parts = (hashes & np.uint64(groups - 1)).astype(np.int64)
        codes = {lang: i for i, lang in enumerate(dict(self.langs))}
        langs = np.repeat([codes[lang] for lang, _ in self.langs], [n for _, n in self.langs])
        keys = parts * len(codes) + langs
        order = np.argsort(keys)
        keys, times = keys[order], self.times[order].astype("<i8")
        texts = [self.texts[i] for i in order.tolist()]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        names, spans = list(codes), list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]))
        self.forget()
        return pa.RecordBatch.from_arrays([
            pa.array(keys[starts] // len(names), pa.int32()), pa.array([names[i] for i in (keys[starts] % len(names)).tolist()], pa.string()),
            # no word holds a line break
            pa.array([b"\n".join(texts[a:b]) for a, b in spans], pa.binary()),
            pa.array([times[a:b].tobytes() for a, b in spans], pa.binary())], schema=self.schema)


def _tell(filter, groups: int, bits: int, most: int):
    """Candidates of a task with the times they were met; under the empty phrase, a language's words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashed, tally, totals = Filter(filter.value, groups, bits), Hashed(), Tally(), {}
        for lang, words in chunks(_rows(batches)):
            totals[lang] = totals.get(lang, 0) + len(words) - words.count(b".")
            tally.add(lang, words, _passing(held, hashed, lang, words, most))
            if len(tally.texts) >= HELD or tally.size >= HELD_BYTES:
                yield tally.close(groups)
        if tally.texts:
            yield tally.close(groups)
        yield pa.RecordBatch.from_arrays([
            pa.array([zlib.crc32(lang.encode()) & (groups - 1) for lang in totals], pa.int32()), pa.array(list(totals), pa.string()),
            pa.array([b""] * len(totals), pa.binary()),
            pa.array([np.array([n], "<i8").tobytes() for n in totals.values()], pa.binary())], schema=Tally.schema)
    return run


def _add(least: int):
    """Phrases told often enough, and a language's words, from tallies whose parts and languages follow each other."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def kept(name: list, sums: dict[bytes, int]) -> list[tuple[str, str, int]]:
        return [(name[1], p.decode(), f) for p, f in sums.items() if f >= least or not p]

    def send(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, found = None, {}, []
        for batch in batches:
            for *name, phrases, times in zip(*(batch.column(n).to_pylist() for n in ("part", "lang", "phrases", "times"))):
                if name != now:
                    found += kept(now, sums)
                    now, sums = name, {}
                    if len(found) >= 10_000:
                        yield send(found)
                        found = []
                for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(times, "<i8").tolist()):
                    sums[phrase] = sums.get(phrase, 0) + n
        yield send(found + kept(now, sums))
    return run


class Trie:
    """A double array: from state s, digit d leads to ``base[s] + d`` if ``check`` there is s.

    A word's code makes two digits. ``value`` is the number of the phrase that ends in a state, or -1.
    """

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray, alphabet: bytes, radix: int, phrases: int):
        self.base, self.check, self.value, self.radix, self.phrases = base, check, value, radix, phrases
        # digests in order; a word's code is its place
        self.first, self.second = np.frombuffer(alphabet, "<u8").reshape(-1, 2).T.copy()
        self.known, self.age = np.full(1, -1, np.int32), 0

    def of(self, words: Words, numbers: np.ndarray) -> np.ndarray:
        """Codes of a chunk's words, -1 where the trie has none."""
        if self.age != words.age:
            self.known, self.age = self.known[:1], words.age
        new = words.halves()[len(self.known):]
        if len(new):
            at = np.searchsorted(self.first, new[:, 0])
            codes = np.full(len(new), -1, np.int32)
            for place in (at, at + 1):  # two digests may share a half
                held = np.minimum(place, len(self.first) - 1)
                same = (self.first[held] == new[:, 0]) & (self.second[held] == new[:, 1])
                codes[same] = held[same]
            self.known = np.concatenate([self.known, codes])
        return self.known[numbers]

    def count(self, codes: np.ndarray, most: int, counts: np.ndarray) -> None:
        """Add the places of every phrase in the words with these codes, of which the last is none."""
        high, low = np.divmod(codes, np.int32(self.radix))
        places = np.flatnonzero(codes >= 0)
        states = np.zeros(len(places), np.int32)
        for step in range(most):
            for digits in (high, low):
                to = self.base[states] + digits[places + step]
                there = self.check[to] == states
                places, states = places[there], to[there]
            ends = self.value[states]
            counts += np.bincount(ends[ends >= 0], minlength=self.phrases)
            on = codes[places + step + 1] >= 0
            places, states = places[on], states[on]


def build(phrases: list[list[int]], radix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie of different lists of codes below ``radix ** 2``."""
    most = 2 * max(map(len, phrases), default=0)
    digits = np.full((len(phrases), most), -1, np.int64)
    for i, codes in enumerate(phrases):
        digits[i, :2 * len(codes)] = [d for c in codes for d in divmod(c, radix)]
    lengths = (digits >= 0).sum(axis=1)
    node = np.zeros(len(phrases), np.int64)
    parents, steps, nodes = [], [], 1
    for level in range(most):
        on = lengths > level
        keys, which = np.unique(node[on] * radix + digits[on, level], return_inverse=True)
        parents.append(keys // radix)
        steps.append(keys % radix)
        node[on] = nodes + which
        nodes += len(keys)
    # edges come in the order of their children's numbers, those of a parent next to each other
    parent = np.concatenate([*parents, np.zeros(0, np.int64)])
    step = np.concatenate([*steps, np.zeros(0, np.int64)])
    owners, starts, sizes = np.unique(parent, return_index=True, return_counts=True)
    free = np.ones(2 * len(parent) + 2 * radix + 64, bool)
    free[0] = False
    base = np.full(nodes, -1, np.int64)
    at = 1
    for k in np.argsort(-sizes, kind="stable")[:int((sizes > 1).sum())].tolist():
        own = step[starts[k]:starts[k] + sizes[k]]
        # parents with many steps come first; where one finds no room the rest is left to single steps
        while base[owners[k]] < 0:
            if at + 512 + 2 * radix > len(free):
                free = np.concatenate([free, np.ones(len(free) + 2048, bool)])
            tries = np.flatnonzero(free[at:at + 128]) + at - own[0]
            tries = tries[tries >= 0]
            fits = free[tries[:, None] + own].all(axis=1)
            if fits.any():
                base[owners[k]] = tries[np.argmax(fits)]
                free[base[owners[k]] + own] = False
            else:
                at += 64
    single = sizes == 1
    lone, their = owners[single], step[starts[single]]
    if len(lone):
        free = np.concatenate([free, np.ones(len(lone) + radix, bool)])
        slots = radix + np.flatnonzero(free[radix:])[:len(lone)]
        base[lone] = slots - their
        free[slots] = False
    taken = np.flatnonzero(~free)
    size = int(taken[-1]) + 1
    slot = np.zeros(nodes, np.int64)
    slot[1:] = base[parent] + step
    # a state without steps leads behind the end, where no state checks
    out = np.full(size, size, np.int32)
    out[slot] = np.where(base >= 0, base, size)
    check = np.full(size + radix, -1, np.int32)
    check[slot[1:]] = slot[parent]
    value = np.full(size, -1, np.int32)
    value[slot[node]] = np.arange(len(phrases))
    return out, check, value


_TRIE = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("radix", pa.int32()), ("n", pa.int32()), ("alphabet", pa.binary()),
                   ("base", pa.binary()), ("check", pa.binary()), ("value", pa.binary()), ("phrases", pa.list_(pa.string()))])


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A trie for every language and shard, whose phrases follow each other."""
    def close(lang: str, shard: int, phrases: list[str]) -> pa.RecordBatch:
        cut = [p.encode().split(b" ") for p in phrases]
        digests = {w: xxhash.xxh3_128_digest(w) for words in cut for w in words}
        in_order = sorted(digests, key=lambda w: np.frombuffer(digests[w], "<u8").tolist())
        codes = {w: i for i, w in enumerate(in_order)}
        radix = int(np.ceil(np.sqrt(len(codes))))
        alphabet = b"".join(digests[w] for w in in_order)
        arrays = [x.astype("<i4").tobytes() for x in build([[codes[w] for w in words] for words in cut], radix)]
        row = [lang, shard, radix, len(phrases), alphabet, *arrays, phrases]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _TRIE)], schema=_TRIE)

    now, phrases = None, []
    for batch in batches:
        for lang, shard, phrase in zip(*(batch.column(n).to_pylist() for n in ("lang", "shard", "phrase"))):
            if (lang, shard) != now and now is not None:
                yield close(*now, phrases)
                phrases = []
            now = lang, shard
            phrases.append(phrase)
    if now is not None:
        yield close(*now, phrases)


def _count(tries, most: int, first: bool):
    """Counts of a task by trie and range of phrases; the first round also counts all words."""
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("range", pa.int32()),
                        ("numbers", pa.binary()), ("times", pa.binary()), ("words", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[tuple[int, Trie, np.ndarray]]] = {}
        for lang, shard, radix, n, alphabet, *arrays in tries.value:
            trie = Trie(*(np.frombuffer(a, "<i4") for a in arrays), alphabet, radix, n)
            own.setdefault(lang, []).append((shard, trie, np.zeros(n, np.int64)))
        words, totals = Words(), {}
        for lang, chunk in chunks(_rows(batches)):
            if len(words) > REMEMBER:
                words.forget()
            numbers = words.numbers(chunk)
            totals[lang] = totals.get(lang, 0) + int((numbers > 0).sum())
            for _, trie, counts in own.get(lang, ()):
                trie.count(trie.of(words, numbers), most, counts)
        rows = [(lang, -1, 0, b"", b"", n) for lang, n in totals.items() if first]
        for lang, lists in own.items():
            for shard, _, counts in lists:
                met = np.flatnonzero(counts)
                for part in np.unique(met // RANGE).tolist():
                    some = met[met // RANGE == part]
                    rows.append((lang, shard, part, some.astype("<u4").tobytes(), counts[some].astype("<i8").tobytes(), 0))
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a range's counts, whose parts follow each other."""
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("at", pa.int32()), ("f", pa.int64())])

    def close(lang: str, shard: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
        met = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(met), pa.string()), pa.array(np.full(len(met), shard), pa.int32()),
            pa.array(part * RANGE + met, pa.int32()), pa.array(sums[met], pa.int64())], schema=schema)

    now, sums = None, None
    for batch in batches:
        for *name, numbers, times in zip(*(batch.column(n).to_pylist() for n in ("lang", "shard", "range", "numbers", "times"))):
            if name != now:
                if now is not None:
                    yield close(*now, sums)
                now, sums = name, np.zeros(RANGE, np.int64)
            sums[np.frombuffer(numbers, "<u4") - name[2] * RANGE] += np.frombuffer(times, "<i8")
    if now is not None:
        yield close(*now, sums)


def phrase_counts(texts: DataFrame, most: int, least: int, *, bits: int = BITS, trie: int = TRIE,
                  at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 1 to ``most`` words, (lang, phrase, f), and all words by language, (lang, n).

    ``texts`` has lang and binary text. Tries hold about ``trie`` phrases each; more phrases than ``at_once`` of
    them hold are summed up without tries.
    """
    spark = texts.sparkSession
    groups = max(GROUPS, 1 << (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    groups = min(groups, (1 << bits) // 64)
    hashes = texts.mapInArrow(_count_hashes(most, least, groups), "part int, keys binary, times binary")
    kept = hashes.repartition("part").sortWithinPartitions("part").mapInArrow(
        _frequent(least, groups, bits), "part int, held binary, n long").collect()
    passed = spark.sparkContext.broadcast({r["part"]: r["held"] for r in kept})  # 2 ** bits / 8 bytes at most
    if sum(r["n"] for r in kept) > trie * at_once:
        told = texts.mapInArrow(_tell(passed, groups, bits, most), "part int, lang string, phrases binary, times binary")
        sums = materialize(told.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(
            _add(least), "lang string, phrase string, f long"), "phrases")
        return sums.where("phrase <> ''"), sums.where("phrase = ''").select("lang", F.col("f").alias("n"))
    candidates = materialize(texts.mapInArrow(
        _candidates(passed, groups, bits, most), "lang string, phrase string").distinct(), "candidates")
    shards = candidates.groupBy("lang").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / trie).cast("int"))
    dealt = lookup(candidates, materialize(shards, "shards"), "lang", "n").select(
        "lang", F.pmod(F.xxhash64("phrase"), F.col("shards")).cast("int").alias("shard"), "phrase")
    tries = materialize(dealt.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "phrase").mapInArrow(
        _build, "lang string, shard int, radix int, n int, alphabet binary, base binary, check binary, value binary, phrases array<string>"),
        "tries")
    names = tries.select("lang", "shard", "n").orderBy("lang", "shard").collect()  # one for every ``trie`` phrases and language
    together: dict[int, list[tuple[str, int]]] = {}  # one round, unless the filter was too full
    for r, upto in zip(names, accumulate(r["n"] for r in names)):
        together.setdefault((upto - 1) // (trie * at_once), []).append((r["lang"], r["shard"]))
    rounds = []
    for some in together.values():
        own = F.broadcast(spark.createDataFrame(some, "lang string, shard int"))
        held = spark.sparkContext.broadcast([tuple(r) for r in tries.drop("phrases").join(
            own, ["lang", "shard"], "left_semi").collect()])
        rounds.append(materialize(texts.mapInArrow(
            _count(held, most, not rounds), "lang string, shard int, range int, numbers binary, times binary, words long"), "counts"))
        held.unpersist()
    if not rounds:
        return spark.createDataFrame([], "lang string, phrase string, f long"), spark.createDataFrame([], "lang string, n long")
    counts = rounds[0]
    for other in rounds[1:]:
        counts = counts.unionAll(other)
    sums = counts.where("shard >= 0").drop("words").repartition("lang", "shard", "range").sortWithinPartitions(
        "lang", "shard", "range").mapInArrow(_sum, "lang string, shard int, at int, f long").where(F.col("f") >= least)
    phrases = tries.select("lang", "shard", F.posexplode("phrases").alias("at", "phrase"))
    found = phrases.join(sums, ["lang", "shard", "at"]).select("lang", "phrase", "f")
    return materialize(found, "phrases"), counts.where("shard < 0").groupBy("lang").agg(F.sum("words").alias("n"))


def _key(phrase):
    """A digest of language and phrase, which holds no line break."""
    return F.unhex(F.sha2(F.concat_ws("\n", "lang", phrase), 256))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = 3, least: int = 10,
                 top: int = 2000, covered: int = COVERED, bits: int = BITS, trie: int = TRIE, at_once: int = AT_ONCE) -> DataFrame:
    """The best phrases of every language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z) and cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and those into words
    ``[^\\x20\\x09]+``. Phrases are 2 to ``longest`` words in a row within a piece that occur at least ``least``
    times in the language, overlaps included: ``a``. A cut into two parts that occur l and r times scores
    ``floor(1000000 a a / (l r))``; the lowest counts, the first of equal ones. A phrase goes if a longer one
    that holds it has at least ``covered`` percent of its occurrences. ``n`` is the number of words.
    The ``top`` phrases come by score, then a, both falling, then by their UTF-8 bytes. Exact for a below 10 ** 16.

    A null language is ``und``; a null or empty text has no words; every row counts, also repeated ones.
    Empty tables give no rows, further columns are ignored. Texts and words of any length are read whole.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).cast("binary").alias("text")).where("text is not null")
    counts, totals = phrase_counts(texts, longest, least, bits=bits, trie=trie, at_once=at_once)
    words = F.split("phrase", " ", -1)
    phrases = counts.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).where("size(w) > 1")
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = materialize(phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select(
        "lang", "phrase", "a", "k", _key(part(F.lit(1), F.col("k"))).alias("left"),
        _key(part(F.col("k") + 1, F.size("w") - F.col("k"))).alias("right")), "cuts")
    known = counts.select(_key(F.col("phrase")).alias("key"), "f")

    def with_count(rows: DataFrame, side: str, name: str) -> DataFrame:
        used = materialize(rows.groupBy(F.col(side).alias("key")).agg(F.count("*").alias("times"))
                           .join(known, "key").select(F.col("key").alias(side), F.col("f").alias(name), "times"), f"parts-{name}")
        return lookup(rows, used, side, "times").drop(side)

    number = lambda c: F.col(c).cast("decimal(16,0)")
    both = materialize(with_count(materialize(with_count(cuts, "left", "l"), "left"), "right", "r"), "scored") \
        .withColumn("top", F.lit(1000000).cast("decimal(7,0)") * (number("a") * number("a"))) \
        .withColumn("score", F.expr("top div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"))
    best = both.groupBy(F.struct("lang", "phrase").alias("p")).agg(
        F.min(F.struct("score", "k", "l", "r", "a")).alias("b")).select("p.*", "b.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    holders = phrases.where("size(w) > 2").select("lang", "a", F.explode(inner).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(holders, ["lang", "phrase"], "left").where(
        f"longer is null or cast(100 as decimal(3,0)) * longer < cast({covered} as decimal(9,0)) * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
