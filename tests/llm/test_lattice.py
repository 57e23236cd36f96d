import math
import zlib
from collections import Counter

import edge
import pytest
from pyspark.sql import functions as F

from guardframe.llm.lattice import END, Lattice, score, taught


@pytest.fixture(scope="module")
def lattice():
    return Lattice()


def all_ways(logs, text):
    """Summed probability of all segmentations, by trying them all."""
    return 1.0 if not text else sum(
        math.exp(logs[text[:k]]) * all_ways(logs, text[k:]) for k in range(1, len(text) + 1) if text[:k] in logs)


def test_words_against_all_segmentations(lattice):
    for word in ("the", "cat", "éa", "☃", "xq7", "ing."):
        wanted = math.log10(all_ways(lattice.logs, ("▁" + word).encode())) + math.log10(1 - END)
        assert lattice.word(word.encode()) == pytest.approx(wanted, abs=1e-12)
    assert -300_000 < lattice.word(b"ab" * 20_000) < -1000
    assert sum(map(math.exp, lattice.logs.values())) == pytest.approx(1)


def plain(rows, lattice):
    def words(text):
        return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    counts, ends = Counter(), 0
    for key, text in rows:
        if key is not None and zlib.crc32(str(key).encode()) % 7 != 2:
            counts.update(words(text))
            ends += 1
    n, v = counts.total() + ends, len(counts) + bool(ends)
    unseen = (sum(c == 1 for c in counts.values()) + 1) / (n + 2)
    out = []
    for key, text in rows:
        tokens = [(counts[w], lattice.word(w)) for w in words(text)] + [(ends, math.log10(END))]
        out.append((key or -1, len(tokens), sum(c > 0 for c, _ in tokens), n,
                    sum(math.log10((c + 1) / (n + v + 1)) for c, _ in tokens),
                    sum(math.log10((1 - unseen) * c / n + unseen * 10 ** s) if c else math.log10(unseen) + s for c, s in tokens)))
    return sorted(out)


def compare(df, rows, lattice):
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect())
    wanted = plain(rows, lattice)
    assert [f[:4] for f in found] == [w[:4] for w in wanted]
    for f, w in zip(found, wanted):
        assert f[4:] == pytest.approx(w[4:], rel=1e-9)


@pytest.mark.parametrize("head", [1 << 17, 50, 0])
def test_against_plain_counts(spark, sf_dir, lattice, head):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(score(docs, taught(), head_words=head), rows, lattice)


def test_edges(spark, lattice):
    docs = edge.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    compare(score(docs, taught()), rows, lattice)
    assert score(edge.none(spark), taught()).collect() == []
    alone = score(docs, F.lit(False)).where("doc_id = 4").first()
    assert (alone["n_tokens"], alone["n_known"], alone["train_tokens"], alone["base_score"]) == (1, 0, 0, 0.0)
