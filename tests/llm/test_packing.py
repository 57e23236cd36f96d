import random
import zlib
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from guardframe.llm.packing import best_fit, cut, knapsack, least, pack, plan
from guardframe.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, docs, tokenizer, capacity):
    """Pieces are the documents' ids, cut as they should be, and fill sequences without gaps."""
    wanted = Counter()
    for key, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for piece, (start, size) in enumerate(cut(len(ids), capacity)):
            wanted[key, piece, start, size, zlib.crc32(ids[start:start + size].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack(docs).collect()
    many = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 1024)
    # no packing needs fewer sequences than the tokens fill; this one needs few more
    assert many <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_edges(spark, tokenizer):
    docs = edge.documents(spark)
    rows = pack(docs, capacity=64, with_ids=True).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 64)
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert pack(edge.none(spark)).collect() == []


def test_pieces():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and cut(8, 4) == [(0, 4), (4, 4)]


def test_pricing_is_the_best_configuration():
    rng = np.random.default_rng(2)
    for _ in range(30):
        capacity = 12
        prices = np.r_[0, rng.random(capacity) * (rng.random(capacity) > 0.3)]
        best = np.zeros(capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max(best[c - 1], *(best[c - n] + prices[n] for n in range(1, c + 1)))
        found = knapsack(prices, capacity)
        assert sum(n * k for n, k in found.items()) <= capacity
        assert abs(sum(prices[n] * k for n, k in found.items()) - best[capacity]) < 1e-12


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_length_exactly(seed):
    rng = random.Random(seed)
    histogram = {n: rng.choice([1, 3, 50, 4000]) for n in rng.sample(range(1, 1024), rng.choice([1, 5, 300]))}
    for patterns in (plan(histogram), best_fit(np.array([histogram.get(n, 0) for n in range(1025)]), 1024)):
        held = Counter()
        for many, found in patterns:
            assert many > 0 and sum(n * k for n, k in found.items()) <= 1024
            for n, k in found.items():
                held[n] += many * k
        assert held == histogram
    assert plan({}) == []


def _demand(histogram, capacity):
    return np.array([histogram.get(n, 0) for n in range(capacity + 1)])


def _many(patterns):
    return sum(m for m, _ in patterns)


def test_configurations_that_fill_no_sequence_are_used():
    histogram = {517: 6000, 267: 6000, 261: 6000, 243: 12000}
    assert _many(plan(histogram)) == 9000 and _many(best_fit(_demand(histogram, 1024), 1024)) == 11000
    assert 8990 <= least(histogram) <= 9000


@pytest.mark.parametrize("seed", range(10))
def test_plans_are_above_the_bound_and_never_behind_best_fit(seed):
    rng = random.Random(seed)
    capacity = 64
    histogram = {n: rng.choice([1, 3, 50, 4000]) for n in rng.sample(range(1, capacity), rng.choice([2, 20, 40]))}
    many, bound = _many(plan(histogram, capacity)), least(histogram, capacity)
    assert bound <= many <= _many(best_fit(_demand(histogram, capacity), capacity))


def _fewest(pieces, capacity):
    """The least number of sequences, by trying every place for every piece."""
    best = len(pieces)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(pieces):
            best = len(room)
            return
        for k in sorted({r: k for k, r in enumerate(room) if r >= pieces[i]}.values()):
            go(i + 1, room[:k] + [room[k] - pieces[i]] + room[k + 1:])
        go(i + 1, [*room, capacity - pieces[i]])
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(20))
def test_small_plans_against_all_packings(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.randrange(1, 13) for _ in range(rng.randrange(1, 11)))
    fewest = _fewest(sorted(histogram.elements(), reverse=True), 12)
    assert least(histogram, 12) <= fewest <= _many(plan(histogram, 12)) <= fewest + 1


def test_ids_are_those_of_the_tokenizer(tokenizer):
    rng = random.Random(4)
    encoder = Encoder()
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "é", "'s", "12", "<|endoftext|>", "☃", " ", "!?"])
                       for _ in range(rng.randrange(30)))
        assert encoder.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids
