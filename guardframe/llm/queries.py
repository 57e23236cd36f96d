"""The registered query of every operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.llm import warc
from guardframe.llm.ann import nearest
from guardframe.llm.common import fold, read
from guardframe.llm.decontaminate import leaks
from guardframe.llm.extraction import extract
from guardframe.llm.hard_negatives import hard_negatives
from guardframe.llm.langid import identify, train
from guardframe.llm.lattice import score, taught
from guardframe.llm.licenses import scan
from guardframe.llm.line_dedup import dedup_lines
from guardframe.llm.minhash import near_duplicates
from guardframe.llm.packing import pack
from guardframe.llm.phrases import collocations
from guardframe.llm.token_counts import BYTE_BPE, PIECES, Rollup, count_tokens, deletes, inserts, revisions
from guardframe.operators.joins import lookup
from guardframe.sources.scratch import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents, revised counts of those that have blanks to
    spare, deletion of all but the first of equal texts. The last batch is committed twice.

    The first of equal texts has the smallest id; rows without id are larger than all ids.
    """
    versions = [BYTE_BPE, PIECES]
    blanks = F.trim(F.regexp_replace("text", r"[ \t]+", " "))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"),
        F.coalesce(blanks != F.col("text"), F.lit(False)).alias("spare"))
    before = materialize(count_tokens(docs, versions, keep=["key", "spare"]), "counts")
    after = materialize(count_tokens(docs.where("spare").withColumn("text", blanks), versions, keep=["key"]), "recounts")
    live = before.where("not spare").drop("spare").unionByName(after)
    first = materialize(before.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")), "first")
    copies = lookup(live, first, "key", "times").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    rollup = Rollup(spark, scratch_path(spark, "token-counts"))
    rollup.commit(1, inserts(before))
    rollup.commit(2, revisions(before.where("spare"), after))
    for _ in range(2):
        rollup.commit(3, deletes(copies))
    return rollup.totals()


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 20 = 0"), rows, 20).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("fold", fold("doc_id", 5))
    field = train(docs.where("fold > 0"))
    return identify(docs, field).select(
        F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), taught()).select(
        "doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform("places", lambda p: p["label"])
    spans = F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        joined(said).alias("base_labels"), joined(F.concat(said, spans)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(
            F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))).alias("score"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(read(spark, sf_dir, "pages"))
    return warc.read(spark, archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(rows.where("vec_id % 50 = 0"), rows)


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_neighbours": op3_neighbours,
    "op4_langid": op4_langid,
    "op5_extraction": op5_extraction,
    "op6_lattice": op6_lattice,
    "op7_decontamination": op7_decontamination,
    "op8_minhash": op8_minhash,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
    "op11_phrases": op11_phrases,
    "op12_lines": op12_lines,
    "op13_negatives": op13_negatives,
}

_USABLE = (
    "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    " AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
)
#: SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_neighbours": f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_USABLE}),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1),
  lambda i: q.e[i] * c.e[i]), lambda x, y: x + y) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20""",
    "op8_minhash": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM words UNION
  SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op10_warc": """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
firsts AS (SELECT x, min(page_id) AS first FROM payloads GROUP BY x),
fives AS (SELECT page_id, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, 5 * i + 1, 5) AS INT)) AS v FROM payloads),
digests AS (SELECT page_id, array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31) + 1, 1)), '')), '') AS d FROM fives)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM payloads JOIN firsts USING (x) JOIN digests USING (page_id)""",
    "op11_phrases": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2),
  lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM words),
counts AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, phrase HAVING count(*) >= 10),
cuts AS (SELECT lang, phrase, f AS a, w, unnest(range(1, len(w))) AS k FROM counts WHERE len(w) > 1),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, c.w,
  CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM counts WHERE len(w) = 3),
holders AS (SELECT lang, phrase, max(f) AS longer FROM inner_ GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN holders USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000""",
    "op12_lines": r"""
WITH lines AS (SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, coalesce(doc_id > first, false) AS gone FROM keyed LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
    "op13_negatives": """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id,
  CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score
  AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3""",
}
