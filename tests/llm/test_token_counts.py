from collections import Counter

import edge
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from guardframe.llm.queries import op1_token_counts
from guardframe.llm.token_counts import BYTE_BPE, PIECES, Rollup, count_tokens, deletes, inserts, revisions
from guardframe.sources.scratch import scratch_path


def plain(rows):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, tokens = Counter(), Counter()
    for source, lang, text in rows:
        for version, n in ((BYTE_BPE, len(full.encode(text or "", add_special_tokens=False).ids)), (PIECES, len(pieces.encode(text or "")))):
            docs[source, lang, version] += 1
            tokens[source, lang, version] += n
    return {k: (docs[k], tokens[k]) for k in docs}


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def test_inserts_deletes_revisions_and_repeated_commits(spark):
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    assert totals(rollup) == {}
    docs = edge.documents(spark)
    rows = [(r["source"], r["lang"], r["text"]) for r in docs.collect()]
    counts = count_tokens(docs, [BYTE_BPE, PIECES])
    for _ in range(3):
        rollup.commit(1, inserts(counts))
        assert totals(rollup) == plain(rows)
    longer = docs.where("doc_id = 1").selectExpr("doc_id", "text || ' and more' text", "lang", "'v' source")
    after = count_tokens(longer, [BYTE_BPE, PIECES])
    rollup.commit(2, revisions(counts.where("doc_id = 1"), after))
    changed = [("v", r[1], r[2] + " and more") if k == 0 else r for k, r in enumerate(rows)]
    assert totals(rollup) == plain(changed)
    for _ in range(2):
        rollup.commit(7, deletes(after))
    assert totals(rollup) == plain(changed[1:])
    rollup.commit(8, inserts(counts.limit(0)))
    assert totals(rollup) == plain(changed[1:])
    rollup.commit(9, deletes(counts.where("doc_id is null or doc_id <> 1")))
    assert totals(rollup) == {}


def test_a_commit_that_breaks_off_leaves_the_old_batch(spark):
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    row = spark.createDataFrame([(1, "s", "en", "v", 1, 10)], "doc_id long, source string, lang string, version string, sign int, tokens long")
    rollup.commit(1, row)
    with pytest.raises(Exception, match="lost"):
        rollup.commit(1, row.withColumn("tokens", F.raise_error(F.lit("lost")).cast("long")))
    assert totals(rollup) == {("s", "en", "v"): (1, 10)}
    rollup.commit(1, row.withColumn("tokens", F.lit(12).cast("long")))
    assert totals(rollup) == {("s", "en", "v"): (1, 12)}


def test_old_batches_are_folded(spark):
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    rollup.compact(5)
    row = spark.createDataFrame([(1, "s", None, "v", 1, 10)], "doc_id long, source string, lang string, version string, sign int, tokens long")
    for batch in (1, 2, 3, 4):
        rollup.commit(batch, row)
    before = rollup.totals().collect()
    for until in (2, 2, 3):
        rollup.compact(until)
        assert rollup.totals().collect() == before and before[0]["batches"] == 4
    assert len(rollup.stored.current()["data"]) == 2
    rollup.commit(4, row.limit(0))
    assert totals(rollup) == {("s", None, "v"): (3, 30)}
    with pytest.raises(ValueError):
        rollup.commit(3, row)


def test_copies_and_awkward_rows(spark, tmp_path):
    """A third of the rows are one text; ids are missing, or name several texts."""
    rows = [(k, "the same text  of many", "s", "en") for k in range(5, 105)] + [(k, f"text {k} ", f"s{k % 3}", "en") for k in range(200, 400)]
    rows += [(200, "another text of a number", "s", None), (200, "another text of a number", "s", None), (None, "the same text  of many", None, "en"),
             (None, "alone  here", "s", "en"), (3, None, "s", "en"), (4, "", "s", "en"), (None, "", "s", "en"), (6, "long " * 100_000, "s", "en")]
    edge.clashing(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for key, text, _, _ in rows:
        first[text or ""] = min(first.get(text or "", 1 << 62), 1 << 62 if key is None else key)
    left = [(s, g, " ".join(w for w in (t or "").replace("\t", " ").split(" ") if w)) for k, t, s, g in rows
            if (1 << 62 if k is None else k) == first[t or ""]]
    found = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in op1_token_counts(spark, str(tmp_path)).collect()}
    assert found == plain(left)


def test_registered_query(spark, sf_dir):
    rows, seen = [], set()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    import re
    for r in docs:
        if r["text"] not in seen:
            rows.append((r["source"], r["lang"], re.sub(r"[ \t]+", " ", r["text"]).strip(" ")))
        seen.add(r["text"])
    found = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in op1_token_counts(spark, sf_dir).collect()}
    assert found == plain(rows)
