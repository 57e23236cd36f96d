"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A change is a signed row: +1 document and its tokens for an insert, -1 and minus its tokens for a
delete, one of each for a revised count. A batch's changes are summed by group and stored under
the batch's number; storing a number again puts the same sums in its place, so a repeated commit
changes nothing. Totals are sums over batches; old batches can be folded into one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardframe.llm.tokens import Encoder
from guardframe.sources.snapshots import Snapshots

GROUP = ["source", "lang", "version"]
_STORED = "source string, lang string, version string, docs long, tokens long, batches long"
#: Name of a batch that stands for all up to its number.
FOLDED = "until "
BYTE_BPE, PIECES = "byte_bpe_50k", "piece_bpe_32k"


def _counters(versions: list[str]):
    def piece_counter():
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        return lambda text: len(model.encode(text))

    def byte_counter():
        encoder = Encoder()
        return lambda text: len(encoder.ids(text))
    return [{BYTE_BPE: byte_counter, PIECES: piece_counter}[v]() for v in versions]


def count_tokens(docs: DataFrame, versions: list[str], id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", lang_col: str = "lang", keep: Iterable[str] = ()) -> DataFrame:
    """Token counts of every row and version: (doc_id, source, lang, version, tokens), then the columns ``keep``.

    Null and empty text has none; rows without id and repeated rows are counted each, a very long text
    as a whole; an empty table has no rows. Columns other than ``keep`` are left out.
    """
    keep = list(keep)
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), *keep)
    names = ["doc_id", "source", "lang", "version", "tokens", *keep]
    kept = "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = _counters(versions)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for version, count in zip(versions, counters):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("source"), batch.column("lang"),
                     pa.array([version] * len(texts), pa.string()),
                     pa.array([0 if t is None else count(t) for t in texts], pa.int64()),
                     *[batch.column(c) for c in keep]], names=names)
    return own.mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long" + kept)


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select("doc_id", *GROUP, F.lit(1).alias("sign"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """The rows as they were counted, taken back."""
    return counts.select("doc_id", *GROUP, F.lit(-1).alias("sign"), "tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Take back the old rows and put in the new ones; equal ones cancel out in the sums."""
    return deletes(before).unionAll(inserts(after))


class Rollup:
    """Totals under a folder that all executors share; every change to it is one rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.stored = spark, Snapshots(spark, path)

    def _closed(self) -> int | None:
        """The last batch that was folded into others, if any was."""
        return max((int(b.removeprefix(FOLDED)) for b in self.stored.current().get("put", {}) if b.startswith(FOLDED)), default=None)

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Store a batch of signed changes (sign 1 or -1). Another commit of the number replaces it.

        A commit that breaks off leaves what was there before. Groups with null source or language are
        groups of their own. Partial sums are made where the changes lie, so a group that holds most
        rows is a row per task. Groups that come to nothing are left out; an empty batch is stored as
        such. Batches up to one that ``compact`` has closed are refused.
        """
        closed = self._closed()
        if closed is not None and int(batch) <= closed:
            raise ValueError(f"batch {batch} is closed; the last one that is, is {closed}")
        sums = changes.groupBy(*GROUP).agg(
            F.sum(F.col("sign").cast("long")).alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        self.stored.put(sums.where("docs <> 0 or tokens <> 0").withColumn("batches", F.lit(1).cast("long")), str(int(batch)))

    def compact(self, until: int) -> None:
        """Fold all batches up to ``until`` into one that is closed; totals stay as they are."""
        now = self.stored.current()
        names = [b for b in now.get("put", {}) if int(b.removeprefix(FOLDED)) <= until]
        if names:
            rows = self.spark.read.schema(_STORED).parquet(*[f"{self.stored.path}/{now['put'][b]}" for b in names])
            self.stored.put(rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "batches")]),
                            f"{FOLDED}{until}", names)

    def totals(self) -> DataFrame:
        """Live totals (source, lang, version, docs, tokens, batches); groups without documents are left out."""
        deltas = self.stored.read() if self.stored.current()["schema"] else self.spark.createDataFrame([], _STORED)
        return deltas.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "batches")]) \
            .where("docs <> 0 or tokens <> 0")
