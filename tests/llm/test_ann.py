from functools import reduce
from operator import add

import edge
import numpy as np
from pyspark.sql import functions as F

from guardframe.llm.ann import nearest


def plain(queries, rows, k):
    out = {}
    for key, q in queries:
        scored = sorted((-reduce(add, (a * b for a, b in zip(v, q)), 0.0), i) for i, v in rows if i != key)
        out[key] = [(i, -s) for s, i in scored[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        own.append((r["id"], r["score"]))
        assert r["rank"] == len(own)
    return out


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    own = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    wanted = plain([x for x in own if x[0] % 20 == 0], own, 20)
    for size in (10_000, 37):
        assert result(nearest(rows.where("vec_id % 20 = 0"), rows, 20, tile_queries=size, tile_rows=size)) == wanted


def test_many_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(3)
    vectors = [[1.0, 0.0, 0.0]] * 200 + [list(map(float, v)) for v in rng.integers(-2, 3, (200, 3))]
    own = [(k, v) for k, v in enumerate(vectors) if any(v)]
    rows = spark.createDataFrame(own, "vec_id long, embedding array<float>")
    found = result(nearest(rows.where("vec_id % 7 = 0"), rows, 5, tile_rows=64))
    assert found == plain([x for x in own if x[0] % 7 == 0], own, 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (2, [0.5, 0.5]), (10, [1e300, -1e300])]
    rows = edge.clashing(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    found = result(nearest(rows, rows, 3))
    assert sorted(found) == [1, 2, 10]  # 9 is alone with its width
    assert found[1] == [(10, 1e300), (2, 0.5), (2, 0.5)]
    assert found[10] == [(1, 1e300), (2, 0.0), (2, 0.0)]
    assert nearest(rows.limit(0), rows, 3).collect() == []
    assert nearest(rows, rows.limit(0), 3).collect() == []
    assert nearest(rows.where("vec_id = 1"), rows.where("vec_id = 1"), 3).collect() == []


def test_whole_numbers_are_exact_enough(spark):
    rng = np.random.default_rng(8)
    own = [(k, rng.normal(size=16).astype("float32").tolist()) for k in range(500)]
    rows = spark.createDataFrame(own, "vec_id long, embedding array<float>")
    assert result(nearest(rows.where(F.col("vec_id") < 40), rows, 20, tile_rows=128)) == plain(own[:40], own, 20)


def test_queries_of_a_rare_width_are_searched_among_their_own(spark):
    rng = np.random.default_rng(9)
    own = [(k, rng.normal(size=3 if k % 20 == 0 else 2 if k % 3 else 7).tolist()) for k in range(300)]
    rows = spark.createDataFrame(own, "vec_id long, embedding array<double>").repartition(4)
    for size in (8192, 20):
        found = result(nearest(rows.where("vec_id % 20 = 0 or vec_id % 45 = 1"), rows, 5, tile_rows=size, tile_queries=size))
        asked = [x for x in own if x[0] % 20 == 0 or x[0] % 45 == 1]
        assert len(asked) > 15
        for query in asked:
            assert found[query[0]] == plain([query], [x for x in own if len(x[1]) == len(query[1])], 5)[query[0]]
