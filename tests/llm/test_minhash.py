import random
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from guardframe.llm import minhash
from guardframe.llm.components import components
from guardframe.llm.minhash import Signer, near_duplicates, shingle_set


def plain(rows, words, percent):
    """id -> (set size, smallest id reachable) by comparing all pairs."""
    sets = {}
    for key, text in rows:
        found = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        sets[key] = frozenset(zip(*(found[k:] for k in range(words)))) if len(found) >= words else frozenset([tuple(found)] if found else [])
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k
    holders = defaultdict(list)
    for a in sorted(sets):
        common = Counter(b for gram in sets[a] for b in holders[gram])
        for b, n in common.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                up[y] = x
        for gram in sets[a]:
            holders[gram].append(a)
    return {k: (len(sets[k]), top(k)) for k in sets}


def result(df):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_whole_table_against_all_pairs(spark, sf_dir, words, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, words=words, percent=percent)
    assert result(found) == plain([(r["doc_id"], r["text"]) for r in docs.collect()], words, percent)
    assert found.where("kept <> (id = component_id)").isEmpty()


def test_group_of_near_copies_that_drift_apart(spark):
    rng = random.Random(3)
    text = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for key in range(150):
        own = list(text)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(9)}"
        rows.append((key, " ".join(own)))
        if key % 10 == 0:
            text[rng.randrange(len(text))] = f"drift{key}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, words=3, percent=85)) == plain(rows, 3, 85)


@pytest.mark.parametrize("limits", [(64, 1024, 2_000_000), (2, 1024, 2_000_000), (2, 20, 2_000_000), (2, 1024, 3000)])
def test_tiles_give_the_same_classes(spark, monkeypatch, limits):
    for name, value in zip(("LARGE", "TILE_MEMBERS", "TILE_GRAMS"), limits):
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(minhash, "STARS", 1)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for key in range(120):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(400)}"
        rows.append((key, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs, words=3, percent=85)) == plain(rows, 3, 85)


def test_edges(spark):
    found = near_duplicates(edge.documents(spark))
    rows = found.collect()
    assert len(rows) == 15
    by = {(r["id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert by[1, 14] == (1, True) and by[2, 14] == (1, False)
    assert by[3, 0] == (3, True) and by[4, 0] == (4, True) and by[5, 0] == (5, True)
    assert by[8, 1] == (8, True) and by[9, 1] == (8, False)
    assert by[None, 14] == (None, False) and by[None, 0] == (None, False)
    assert near_duplicates(edge.none(spark)).collect() == []


def test_signature_is_two_permutations():
    signer = Signer(2, 3)
    hashes = shingle_set("a b c d e f g h", 3)
    found = signer.signature(hashes)
    cells = np.unique(minhash._mix(hashes ^ signer.seed) & signer.ring).astype(int)
    numbers = np.random.default_rng(minhash.SEED).permutation(minhash.RING)
    assert found.tolist() == [int(numbers[(cells + k) % minhash.RING].min()) for k in range(len(found))]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    signer = Signer(24, 5)
    for share in (0.5, 0.85):
        agree = []
        for _ in range(20):
            n = 400
            common = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share)), dtype=np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)]) for _ in range(2))
            agree.append((signer.signature(a) == signer.signature(b)).mean())
        assert abs(np.mean(agree) - share) < 0.02


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (1000, 1001), (1001, 1000), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**{k: 0 for k in range(400)}, 1000: 1000, 1001: 1000}
    assert components(links.where(F.lit(False))).collect() == []
