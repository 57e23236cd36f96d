import math
from collections import Counter

import edge
import numpy as np

from guardframe.llm import hard_negatives as hn
from guardframe.llm.hard_negatives import hard_negatives


def plain(anchors, rows, positives=5, negatives=3, low=50, high=95, scale=256):
    def fine(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])

    cut = lambda rs: [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rs if fine((i, lab, v))]
    out, rows = Counter(), cut(rows)
    for anchor, label, v in {r[0]: r for r in cut(anchors)}.values():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, lab) for i, lab, w in rows if i != anchor and len(v) == len(w))
        for s, positive, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out.update((anchor, positive, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit))
    return out


def result(df):
    return Counter(map(tuple, df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


KIND = "vec_id long, label int, embedding array<double>"


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for width, most in ((1, 3), (7, 100), (64, 256), (65, 40_000), (24, 2**29), (8, 1), (0, 1)):
        rows, anchors = (rng.integers(-most, most + 1, (n, width)) for n in (40, 9))
        bits, packed = hn.planes(rows)
        assert (hn.whole(packed, width) == rows).all()
        assert (hn.scores(hn.subset_sums(anchors), packed) == rows @ anchors.T).all()
        assert ((rows >= -(1 << (bits - 1))[:, None]) & (rows < (1 << (bits - 1))[:, None])).all()
    edge_rows = np.array([[-256, 255], [-1, 0], [0, 0], [2**30, -(2**30)]])
    assert hn.planes(edge_rows)[0].tolist() == [9, 1, 1, 32]


def test_many_equal_vectors_ties_and_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [(k, 1, [0.5, 0.25, -0.5]) for k in range(300)] + [
        (300 + k, int(rng.integers(0, 4)), rng.normal(size=3).round(1).tolist()) for k in range(500)]
    df = spark.createDataFrame(rows, KIND)
    wanted = plain([r for r in rows if r[0] % 9 == 0], rows)
    assert len(wanted) > 500
    for size in (8192, 50):
        assert result(hard_negatives(df.where("vec_id % 9 = 0"), df, tile_anchors=size, tile_rows=size)) == wanted


def test_numbers_of_any_size_and_other_parameters(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(0, 3)), (rng.normal(size=int(rng.choice([5, 16]))) * 10.0 ** rng.integers(-3, 6)).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, KIND)
    given = {"positives": 2, "negatives": 4, "low": 10, "high": 100}
    assert result(hard_negatives(df.where("vec_id % 5 = 0"), df, **given)) == plain([r for r in rows if r[0] % 5 == 0], rows, **given)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.5]), (3, 1, [0.9, 0.0]), (4, 1, None), (5, None, [1.0, 1.0]), (6, 1, [nan, 1.0]),
            (7, 1, [inf, 0.0]), (8, 1, [None, 1.0]), (None, 1, [1.0, 0.0]), (9, 1, []), (10, 0, []), (11, 1, [0.0, 0.0]),
            (12, 1, [0.7, 0.7, 0.7]), (13, 1, [0.9, 0.0]), (13, 1, [0.9, 0.0]), (14, 0, [-1.0, -1.0]), (15, 0, []), (16, 0, [1e300, 0.0])]
    df = edge.clashing(spark.createDataFrame(rows, KIND))
    fits = [r for r in rows if r[0] != 16]
    found = result(hard_negatives(df, df))
    assert found == plain(fits, fits)
    assert found[1, 2, 1, 3, 65536, 58880] == 1 and found[1, 2, 2, 13, 65536, 58880] == 1 and found[10, 15, 1, 9, 0, 0] == 1
    assert hard_negatives(df.limit(0), df).collect() == [] and hard_negatives(df, df.limit(0)).collect() == []


def test_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()]
    assert result(hard_negatives(df.where("vec_id % 10 = 0"), df, tile_rows=64)) == plain([r for r in rows if r[0] % 10 == 0], rows)
