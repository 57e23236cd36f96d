"""Document probabilities from a subword lattice.

Every way to write a word with the pieces of a public vocabulary is a path through its lattice,
weighted by the pieces' scores; a forward recursion in log space sums all paths. Pieces do not
reach over white space, so a text's probability is the product over its words, and a word's is
worked out once. Words counted in training are arcs of their own over the whole word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardframe.llm.common import fold, space_words
from guardframe.sources.scratch import materialize

#: Most words, and most bytes of a word, that travel to the tasks; all others are joined.
HEAD_WORDS, HEAD_BYTES = 1 << 17, 64
PIECES = "piece_bpe_32k.model"
#: Probability of the end among the pieces.
END = 1 / 32_000


class Lattice:
    """Log10 probabilities of words over all segmentations.

    The vocabulary's scores are ranks, 0 for the best piece; a piece of rank r weighs
    1 / (r + 10). Byte pieces make every text a path.
    """

    def __init__(self, path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
        weights: dict[bytes, float] = {}
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k):
                continue
            piece = model.id_to_piece(k)
            data = bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.encode()
            weights[data] = weights.get(data, 0.0) + 1 / (10 - min(0.0, model.get_score(k)))
        total = sum(weights.values())
        self.logs = {piece: math.log(weight / total) for piece, weight in weights.items()}
        self.longest = max(map(len, self.logs))
        # prefixes that lead to a piece, to stop early
        self.prefixes = {piece[:n] for piece in self.logs for n in range(1, len(piece) + 1)}

    def word(self, word: bytes) -> float:
        """log10 of the summed probability of all ways to write the word."""
        text = "▁".encode() + word
        size, logs, prefixes, longest = len(text), self.logs, self.prefixes, self.longest
        arrivals: list[list[float]] = [[] for _ in range(size + 1)]
        arrivals[0].append(0.0)
        total = 0.0
        for at in range(size + 1):
            terms = arrivals[at]
            if len(terms) == 1:
                total = terms[0]
            else:
                top = max(terms)
                total = top + math.log(sum([math.exp(t - top) for t in terms]))
            arrivals[at] = None
            for to in range(at + 1, min(size, at + longest) + 1):
                piece = text[at:to]
                if piece in logs:
                    arrivals[to].append(total + logs[piece])
                elif piece not in prefixes:
                    break
        return total / math.log(10) + math.log10(1 - END)


def _counted(train: str, most: int = 200_000):
    """Words of a split with their counts in training rows; 0 for words of other rows only."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for text, teaches in zip(batch.column("text"), batch.column(train)):
                words = space_words(text.as_py())
                if teaches.as_py():
                    seen.update(words)
                else:
                    seen.update(dict.fromkeys(words, 0))
                if len(seen) >= most:
                    yield batch_of(seen)
                    seen = Counter()
        if seen:
            yield batch_of(seen)
    return run


def _spelled(path: str | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path)
        for batch in batches:
            spelled = [lattice.word(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(spelled, pa.float64())], names=["word", "c", "spelled"])
    return run


def _head(words: DataFrame, most: int, most_bytes: int):
    """Condition for at most ``most`` of the most frequent words of bounded length."""
    step = F.floor(F.log2("c") * 16)
    short = words.where(f"c > 0 and octet_length(word) <= {most_bytes}")
    sizes = short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    left, least = most, None
    for row in sorted(sizes, key=lambda r: -r["step"]):
        left -= row["n"]
        if left < 0:
            break
        least = row["step"]
    if least is None:
        return F.lit(False)
    return (F.col("c") > 0) & (F.octet_length("word") <= most_bytes) & (step >= least)


def _first_sums(head: dict[bytes, tuple[float, float]], end: tuple[float, float, bool]):
    """Sums over a text's frequent words and its end; the other words are listed with their counts."""
    rest = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base", pa.float64()), ("score", pa.float64()), ("rest", rest)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                counts = Counter(space_words(text.as_py()))
                bases, scores, known, others, total = [end[0]], [end[1]], int(end[2]), [], 1
                for word, n in counts.items():
                    total += n
                    found = head.get(word)
                    if found is None:
                        others.append({"word": word, "n": n})
                    else:
                        known += n
                        bases.append(n * found[0])
                        scores.append(n * found[1])
                values = (row, key.as_py(), total, known, math.fsum(bases), math.fsum(scores), others)
                row += 1
                for column, value in zip(columns, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", *, pieces: str | None = None,
          head_words: int = HEAD_WORDS, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """Log10 probability of every document: (doc_id, n_tokens, n_known, train_tokens, base_score, score).

    ``train`` is a condition on the rows that teach word counts. A-Z are lower-cased; tokens are
    words between white space, then one end. ``base_score`` is add-one smoothing over the counted
    tokens. ``score`` gives a counted token its relative frequency, and every word its lattice
    probability, in the shares that the number of words counted once suggests. Null text is empty:
    one end. Rows without id or with repeated ids are scored each; further columns are ignored.

    The counts are a table. Its most frequent words, a bounded number of bounded length, go to the
    tasks, so the frequent keys are settled where the texts lie; all other words are joined.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.coalesce(train, F.lit(False)).alias("teaches"))
    counts = own.mapInArrow(_counted("teaches"), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    words = materialize(counts.mapInArrow(_spelled(pieces), "word binary, c long, spelled double"), "words")
    ends = own.where("teaches").count()
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    n = (sums["n"] or 0) + ends
    v = (sums["v"] or 0) + bool(ends)
    unseen = ((sums["once"] or 0) + 1) / (n + 2)

    def logs(c, spelled, log10, power):
        base = log10((c + 1) / float(n + v + 1))
        return base, log10((1 - unseen) * c / float(max(n, 1)) + unseen * power(10.0, spelled))

    in_head = _head(words, head_words, head_bytes)
    table = words.where(in_head).toArrow()
    head = {w: logs(c, s, math.log10, math.pow) for w, c, s in
            zip(*(table.column(x).to_pylist() for x in ("word", "c", "spelled")))}
    end = (*logs(ends, math.log10(END), math.log10, math.pow), ends > 0)
    first = materialize(own.select("doc_id", "text").mapInArrow(
        _first_sums(head, end), "row long, doc_id long, n_tokens long, n_known long, base double, score double,"
                                " rest array<struct<word:binary,n:long>>"), "sums")
    base, seen = logs(F.col("c"), F.col("spelled"), F.log10, lambda x, y: F.pow(F.lit(x), y))
    value = F.when(F.col("c") > 0, seen).otherwise(math.log10(unseen) + F.col("spelled"))
    rest = (
        first.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
        .join(words.where(~in_head), "word").groupBy("row").agg(
            F.sum(F.col("n") * base).alias("b"), F.sum(F.col("n") * value).alias("s"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k")))
    add = lambda own, more: F.col(own) + F.coalesce(more, F.lit(0))
    return first.drop("rest").join(rest, "row", "left").select(
        "doc_id", "n_tokens", add("n_known", "k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        add("base", "b").alias("base_score"), add("score", "s").alias("score"))


def taught(id_col: str = "doc_id"):
    """Rows whose crc32 of the id, modulo 7, is not 2; rows without id teach nothing."""
    return ~fold(id_col, 7).isin(-1, 2)
