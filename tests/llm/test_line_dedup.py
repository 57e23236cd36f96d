import random
from collections import Counter

import edge
import numpy as np
from pyspark.sql import functions as F

from guardframe.llm.line_dedup import Suspects, _bits, _merged, dedup_lines, keys_of, positions, repeated_filter

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10):
    """All lines against all lines: Counter of (id, text, lines, dropped)."""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n") if doc is not None else ():
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(doc)
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or doc <= min(holders.get(key(x), {doc}))]
        out[doc, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def result(df):
    return Counter((r["id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect())


def test_random_lines_whatever_the_size_of_the_filter(spark):
    rng = random.Random(5)
    pool = [f"line number {k} É" for k in range(60)] + ["short", "", "ABCDEFGHIJ", "éééééééééé", "ééééééééé", "\x85nbsp\xa0here\x85"]
    dress = [lambda s: s, lambda s: f"  {s}\t", lambda s: s.upper(), lambda s: f"\x0b{s}\r"]
    rows = [(k, "\n".join(rng.choice(dress)(rng.choice(pool)) if rng.random() < 0.4 else f"own line {rng.random()}"
                          for _ in range(rng.randint(0, 9)))) for k in rng.sample(range(5000), 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    wanted = plain(rows)
    assert sum(n for (_, _, _, dropped), n in wanted.items() if dropped) > 100
    for bits, shard_bits in ((29, 20), (12, 6), (6, 3)):  # the last is full: every line is suspected
        assert result(dedup_lines(docs, bits=bits, shard_bits=shard_bits)) == wanted


def test_one_line_in_every_document(spark):
    rows = [(k, f"the very common line\nbut this is number {k}\nThe very common line ") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert result(dedup_lines(docs)) == plain(rows)


def test_edges(spark):
    docs = edge.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = result(dedup_lines(docs))
    assert found == plain(rows)
    prose = rows[0][1]
    assert found[1, prose, 1, 0] == 1 and found[2, "", 1, 1] == 2 and found[None, prose, 1, 0] == 1
    assert found[3, "", 1, 0] == found[4, "", 1, 0] == 1
    assert dedup_lines(edge.none(spark)).collect() == []
    same = spark.createDataFrame([(5, "a line of its own"), (5, "a line of its own")], "doc_id long, text string")
    assert result(dedup_lines(same)) == {(5, "a line of its own", 1, 0): 2}


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(dedup_lines(docs.repartition(5))) == plain(rows)


def test_filter_holds_what_two_documents_share_and_little_else(spark):
    rows = [(k, f"own line number {k}\nshared line number {k // 2}\nown and own {k}\nown and own {k}") for k in range(4000)]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("text", F.col("text").cast("binary")).repartition(9)
    held = Suspects(repeated_filter(texts, bits=22, shard_bits=12), 22, 12)
    assert len(held.among([b"shared line number %d" % k for k in range(2000)])) == 2000
    assert len(held.among([b"own line number %d" % k for k in range(4000)] + [b"own and own %d" % k for k in range(4000)])) < 10


def test_keys():
    assert keys_of("  ABCDEFGHIJ \n\xe9ABCDEFGHÉ\n\x0b\x0cxyz\r\n123456789".encode()) == [b"abcdefghij", "\xe9abcdefghÉ".encode(), None, None]
    at = positions(np.array([0, 2**64 - 1, 5 + (9 << 32)], np.uint64), 29)
    assert at.tolist() == [[0, 2**29 - 1, 5], [0, 2**29 - 1, 9]]
    assert callable(_bits(4, 2, 10)) and callable(_merged(2))
