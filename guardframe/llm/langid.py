"""Language of code-switched text by a linear-chain conditional random field.

Every word gets a label. A word's potentials add up weights of its hashed affixes and character
n-grams and its row of a lexicon, the counts of all training words by language; transition
weights tie neighbours. Forward-backward gives each word's label probabilities over the whole
text, and their mean is the document's answer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows per language that the field's weights are fitted on (on average), words taken of
#: each, rows of the weight table, and rows of the lexicon.
FIT_ROWS, FIT_WORDS, WEIGHTS, LEXICON = 300, 80, 1 << 16, 1 << 16
UNKNOWN = "und"
CHUNK = 64

#: Longest word; a longer run of letters is several words, one behind the other, so every letter counts.
LONGEST = 40
_LETTERS = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def letters(text: str | None) -> list[str]:
    """Runs of letters, lower-cased, in words of ``LONGEST`` letters at most."""
    return [] if text is None else _LETTERS.findall(text.lower())


def lexicon_row(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) & (size - 1)


def features(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table, word after word, and how many each word has.

    A word's features are its affixes of up to four letters and its n-grams of up to three with
    its ends marked, hashed for all words at once.
    """
    marked = [f"^{w}$" for w in words]
    sizes = np.array([len(w) for w in marked])
    signs = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = sizes.cumsum()
    word = np.repeat(np.arange(len(words)), sizes)
    # hashes of the n signs from every place; those that reach into the next word are left out
    hashes = {0: np.zeros(len(signs), np.uint64)}
    owners, rows = [], []

    def put(own: np.ndarray, found: np.ndarray, kind: int) -> None:
        mixed = (found + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        owners.append(own)
        rows.append((mixed >> np.uint64(40)).astype(np.int64) & (size - 1))
    for n in range(1, 5):
        many = len(signs) - n + 1
        hashes[n] = (hashes[n - 1][:max(many, 0)] + signs[n - 1:] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        hashes[n] ^= hashes[n] >> np.uint64(29)
        if n < 4:
            inside = np.flatnonzero(word[:max(many, 0)] == word[n - 1:])
            put(word[inside], hashes[n][inside], 1)
        own = np.flatnonzero(sizes - 2 >= n)
        put(own, hashes[n][ends[own] - sizes[own] + 1], 2)
        put(own, hashes[n][ends[own] - 1 - n], 3)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order], np.bincount(owner, minlength=len(words))


def forward_backward(potentials: np.ndarray, sizes: np.ndarray, start: np.ndarray, step: np.ndarray,
                     chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at every word of chains that lie one behind the other.

    Their product, scaled to a sum of one, gives a word's label probabilities (``probabilities``).

    ``potentials`` has a row of positive label weights per word, ``sizes`` the chains' lengths, at
    least one each. Chains are cut into chunks; products of the transition matrices over a chunk
    carry the messages from chunk to chunk, so the result is that of the whole chain.
    """
    many = -(-sizes // chunk)
    chain = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
    at = ((sizes.cumsum() - sizes)[chain] + nth * chunk)[:, None] + np.arange(chunk)
    real = nth[:, None] * chunk + np.arange(chunk) < sizes[chain][:, None]
    x = np.where(real[:, :, None], potentials[np.minimum(at, len(potentials) - 1)], 1.0)
    labels, first = len(start), nth == 0
    entry = np.broadcast_to(start, (len(nth), labels)).copy()
    leave = np.ones((len(nth), labels))
    if many.max() > 1:
        product = np.broadcast_to(np.eye(labels), (len(nth), labels, labels)).copy()
        for k in range(chunk):
            moved = product if k == 0 else product @ step
            if k == 0:
                moved = np.where(first[:, None, None], product, product @ step)
            moved = moved * x[:, k, None, :]
            moved /= moved.max(axis=(1, 2), keepdims=True)
            product = np.where(real[:, k, None, None], moved, product)
        heads = many.cumsum() - many
        for j in range(1, many.max()):
            to = heads[many > j] + j
            own = (entry[to - 1][:, None, :] @ product[to - 1])[:, 0]
            entry[to] = own / own.sum(axis=1, keepdims=True)
        for j in range(many.max() - 2, -1, -1):
            to = heads[many > j + 1] + j
            own = (product[to + 1] @ leave[to + 1][:, :, None])[:, :, 0]
            leave[to] = own / own.sum(axis=1, keepdims=True)
    ahead = np.empty_like(x)
    state = entry
    for k in range(chunk):
        moved = state @ step if k else np.where(first[:, None], state, state @ step)
        moved = moved * x[:, k]
        moved /= moved.sum(axis=1, keepdims=True)
        state = ahead[:, k] = np.where(real[:, k, None], moved, state)
    behind, state = np.empty_like(x), leave
    for k in range(chunk - 1, -1, -1):
        behind[:, k] = state
        moved = (x[:, k] * state) @ step.T
        moved /= moved.sum(axis=1, keepdims=True)
        state = np.where(real[:, k, None], moved, state)
    return ahead[real], behind[real]


def probabilities(ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    out = ahead * behind
    return out / out.sum(axis=1, keepdims=True)


def unspoken(samples: list[list[str]], every: int, rng: np.random.Generator) -> list[list[str]]:
    """Words of no language for every so many of the samples, as long as the sample's own.

    By turns the sample's letters in another order, and letters drawn evenly from all that occur.
    """
    alphabet = np.array(sorted({sign for own in samples for w in own for sign in w}))
    out = []
    for turn, own in enumerate(samples[::every]):
        signs = np.array(list("".join(own)))
        signs = rng.permutation(signs) if turn % 2 else rng.choice(alphabet, len(signs))
        ends = np.cumsum([len(w) for w in own])
        out.append(["".join(part) for part in np.split(signs, ends[:-1])] if own else [])
    return out


class Field:
    """The field's weights, and potentials of words through a bounded table.

    With ``noise`` the last label stands for words of no language. The lexicon says nothing for or
    against it, so a rare word is judged by its affixes and n-grams.
    """

    def __init__(self, labels: list[str], lexicon: np.ndarray, size: int = WEIGHTS, keep: int = 300_000, noise: bool = False):
        self.labels, self.size, self.keep, self.noise = [*labels, UNKNOWN] if noise else labels, size, keep, noise
        n = len(self.labels)
        rates = np.log((lexicon + 1.0) / (lexicon.sum(axis=0) + len(lexicon)))
        self.lexicon = np.clip(rates - rates.mean(axis=1, keepdims=True), -6, 6).astype(np.float32)
        if noise:
            self.lexicon = np.concatenate([self.lexicon, np.zeros((len(lexicon), 1), np.float32)], axis=1)
        self.weights = np.zeros((size, n), np.float32)
        self.trust = np.full(n, 0.3)
        self.start, self.step = np.zeros(n), np.zeros((n, n))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "table", "known")}

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log potentials of words, their features and how many each has, and their lexicon rows."""
        flat, width = features(words, self.size)
        table = self.lexicon[[lexicon_row(w, len(self.lexicon)) for w in words]]
        summed = np.add.reduceat(self.weights[flat], np.r_[0, width.cumsum()[:-1]], axis=0)
        return summed + table * self.trust, flat, width, table

    def _potentials(self, words: list[str]) -> np.ndarray:
        if not hasattr(self, "number") or len(self.number) > self.keep:
            self.number: dict[str, int] = {}
            self.table, self.known = np.empty((1024, len(self.labels)), np.float32), 0
        new = list(dict.fromkeys(w for w in words if w not in self.number))
        if new:
            while len(self.table) < self.known + len(new):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            found = self.scores(new)[0]
            self.table[self.known:self.known + len(new)] = np.exp(
                np.clip(found - found.max(axis=1, keepdims=True), -30, 0))
            self.number.update(zip(new, range(self.known, self.known + len(new))))
            self.known += len(new)
        return self.table[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))]

    def label(self, words: list[str], sizes: list[int]) -> np.ndarray:
        """Label probabilities of the words of chains, none empty."""
        return probabilities(*forward_backward(
            self._potentials(words).astype(float), np.array(sizes),
            np.exp(self.start - self.start.max()), np.exp(self.step - self.step.max())))

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and mean probability of each text; whole texts, a bounded number of numbers at a time.

        A text of whose letters more than half are noise has no language.
        """
        most = 3_200_000 // max(16, len(self.labels) ** 2)
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        words: list[str] = []
        sizes: list[int] = []
        where: list[int] = []

        def flush() -> None:
            if sizes:
                found = self.label(words, sizes)
                ends = np.cumsum(sizes)
                starts = np.r_[0, ends[:-1]]
                means = np.add.reduceat(found, starts, axis=0) / np.array(sizes)[:, None]
                noisy = np.zeros(len(sizes), bool)
                if self.noise:
                    long = np.fromiter(map(len, words), np.int64, len(words))
                    noisy = 2 * np.add.reduceat(found[:, -1] * long, starts) > np.add.reduceat(long, starts)
                    means = means[:, :-1]
                for k, mean, without in zip(where, means, noisy):
                    best = int(mean.argmax())
                    if not without:
                        out[k] = self.labels[best], float(min(1.0, mean[best]))
            words.clear(), sizes.clear(), where.clear()

        for k, text in enumerate(texts):
            own = letters(text)
            if own and self.labels:
                words.extend(own)
                sizes.append(len(own))
                where.append(k)
                if len(words) >= most:
                    flush()
        flush()
        return out

    def fit(self, samples: list[tuple[str, list[str]]], rounds: int = 6, rate: float = 0.3, seed: int = 7) -> None:
        """Maximum likelihood by adaptive gradient steps on chains that switch language.

        A chain joins stretches of samples, of one language or of several, so that transitions
        and single words are both learned. ``samples`` are (language, words).
        """
        rng = np.random.default_rng(seed)
        number = {name: k for k, name in enumerate(self.labels[:-1] if self.noise else self.labels)}
        if self.noise and samples:
            number[None] = len(number)
            samples = [*samples, *((None, own) for own in unspoken([own for _, own in samples], len(number) - 1, rng))]
        vocabulary = list(dict.fromkeys(w for _, own in samples for w in own))
        index = {w: k for k, w in enumerate(vocabulary)}
        data = [(number[name], np.array([index[w] for w in own])) for name, own in samples if own]
        if not data:
            return
        _, flat, width, table = self.scores(vocabulary)
        ends = width.cumsum()
        past = [np.full_like(x, 1e-6, dtype=float) for x in (self.weights, self.trust, self.start, self.step)]
        weights = self.weights.astype(float)
        for _ in range(rounds):
            chains, truth = [], []
            for k in rng.permutation(len(data)):
                parts = [data[k]] + [data[j] for j in rng.integers(0, len(data), rng.integers(0, 3))]
                cuts = [(y, own if len(parts) == 1 else own[(a := int(rng.integers(0, max(1, len(own) - 4)))):a + int(rng.integers(4, 30))])
                        for y, own in parts]
                chains.append(np.concatenate([own for _, own in cuts]))
                truth.append(np.concatenate([np.full(len(own), y) for y, own in cuts]))
            for at in range(0, len(chains), 64):
                own = chains[at:at + 64]
                words, y = np.concatenate(own), np.concatenate(truth[at:at + 64])
                sizes = np.array([len(c) for c in own])
                used, back = np.unique(words, return_inverse=True)
                picks = np.concatenate([flat[ends[u] - width[u]:ends[u]] for u in used])
                bounds = np.r_[0, width[used].cumsum()[:-1]]
                score = np.add.reduceat(weights[picks], bounds, axis=0) + table[used] * self.trust
                score = np.exp(np.clip(score - score.max(axis=1, keepdims=True), -30, 0))
                step = np.exp(self.step - self.step.max())
                ahead, behind = forward_backward(score[back], sizes, np.exp(self.start - self.start.max()), step)
                error = probabilities(ahead, behind)
                error[np.arange(len(y)), y] -= 1
                by_word = np.zeros((len(used), len(self.labels)))
                np.add.at(by_word, back, error)
                grown = np.zeros_like(weights)
                np.add.at(grown, picks, np.repeat(by_word, width[used], axis=0))
                firsts = np.r_[0, sizes.cumsum()[:-1]]
                inner = np.ones(len(words), bool)
                inner[firsts] = False
                after = np.flatnonzero(inner)
                pair = ahead[after - 1][:, :, None] * step * (score[back[after]] * behind[after])[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                moves = pair.sum(axis=0)
                np.add.at(moves, (y[after - 1], y[after]), -1.0)
                gradients = (grown, (table[back] * error).sum(axis=0), error[firsts].sum(axis=0), moves)
                for value, total, gradient in zip((weights, self.trust, self.start, self.step), past, gradients):
                    total += gradient ** 2
                    value -= rate * gradient / np.sqrt(total + 1e-12) * (gradient != 0)
                np.maximum(self.trust, 0, out=self.trust)
        self.weights = weights.astype(np.float32)


def train(rows: DataFrame, *, fit_rows: int = FIT_ROWS, fit_words: int = FIT_WORDS, weights: int = WEIGHTS,
          lexicon: int = LEXICON, noise: bool = False) -> Field:
    """Fit a field on labelled rows (text, lang); null labels and texts teach nothing.

    The lexicon counts the words of all rows, in a table of ``lexicon`` rows by language whatever
    the corpus. The weights are fitted on a hash sample of at most ``fit_rows`` different texts of each
    language, of which a stretch of ``fit_words`` words each, drawn by the text's hash. With ``noise``
    the field also learns from scrambled samples what is no language; such texts are ``und``.
    """
    rows = rows.select("text", "lang").where("text is not null and lang is not null")
    labels = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    number = {name: k for k, name in enumerate(labels)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(lexicon * len(labels), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                own = letters(text.as_py())
                at = np.fromiter(map(zlib.crc32, map(str.encode, own)), np.int64, len(own)) & (lexicon - 1)
                np.add.at(seen, at * len(labels) + number[lang.as_py()], 1)
        cells = np.flatnonzero(seen)
        for at in range(0, len(cells), 50_000):
            own = cells[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], names=["cell", "n"])

    counts = np.zeros(lexicon * max(1, len(labels)), np.int64)
    if labels:
        found = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    field = Field(labels, counts.reshape(lexicon, -1), weights, noise=noise and bool(labels))

    def stretch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                own = letters(text.as_py())
                at = zlib.crc32(text.as_py().encode()) % max(1, len(own) - fit_words + 1)
                out.append(own[at:at + fit_words])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.string()))], names=["lang", "hash", "words"])

    if labels:
        # different texts in the order of their hashes: copies of a text are drawn once, and no more than fit_rows per language
        hashed = rows.withColumn("hash", F.xxhash64("text"))
        first = Window.partitionBy("lang").orderBy("hash")
        drawn = hashed.select("lang", "hash").distinct().withColumn("nth", F.row_number().over(first)).where(
            F.col("nth") <= fit_rows).drop("nth")
        sample = hashed.join(F.broadcast(drawn), ["lang", "hash"], "left_semi").select("text", "lang", "hash").mapInArrow(
            stretch, "lang string, hash long, words array<string>").dropDuplicates(["lang", "hash"])
        field.fit(sorted((r["lang"], r["words"]) for r in sample.collect()))
    return field


def _labelled(field: Field, text_col: int, func):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield func(batch, field.documents(batch.column(text_col).to_pylist()))
    return run


def identify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, lang_pred, score) per document, from its text alone.

    The language is that with the highest mean probability over all words, the score that mean.
    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
    was learned. Further columns are ignored; rows without id or with repeated ids are kept.
    """
    def give(batch: pa.RecordBatch, found: list[tuple[str, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=["id", "lang_pred", "score"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _labelled(field, 1, give), "id long, lang_pred string, score double")


def in_language(docs: DataFrame, field: Field, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The documents, all their columns, with a recognised language at a mean probability of ``least``."""
    def keep(batch: pa.RecordBatch, found: list[tuple[str, float]]) -> pa.RecordBatch:
        return batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))
    return docs.mapInArrow(_labelled(field, docs.columns.index(text_col), keep), docs.schema)
