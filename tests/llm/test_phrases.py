import random
import re
import types
from collections import Counter

import edge
import numpy as np
import pyarrow as pa

from guardframe.llm import phrases as ph
from guardframe.llm.phrases import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=3, least=10, top=2000, covered=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= least}
    out, holder = [], {}
    for (lang, *w), a in found.items():
        for sub in {(lang, *w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w)}:
            holder[sub] = max(a, holder.get(sub, 0))
    for (lang, *w), a in found.items():
        if len(w) > 1:
            cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if 100 * holder.get((lang, *w), -1) < covered * a:
                out.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    rank, rows = Counter(), set()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.add((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return rows


def result(df):
    rows = df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


def texts(rng, n, words):
    sign = [" ", " ", " ", " ", "  ", "\t", ", ", ".\n", "! ", " ; ", "\r", "\x0b"]
    return ["".join(rng.choice(words) + rng.choice(sign) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_random_texts_whatever_the_sizes(spark):
    rng = random.Random(2)
    words = ["the", "The", "of", "New", "york", "new", "York", "été", "ÉTÉ", "a\xa0b", "x-y", "'", "\x85", "ß"] + [f"w{k}" for k in range(12)]
    rows = [(rng.choice(["en", "en", "de", None]), t) for t in texts(rng, 500, words)] + [("en", "salt and pepper\n" * 30)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    wanted = plain(rows)
    assert len(wanted) > 100
    for given in ({}, {"bits": 20}, {"trie": 40, "at_once": 3}, {"bits": 10, "trie": 400}):
        assert result(collocations(docs, **given)) == wanted
    own = {"longest": 5, "least": 4, "top": 50, "covered": 80}
    assert result(collocations(docs, **own)) == plain(rows, **own)


def test_one_phrase_everywhere_and_long_words(spark):
    long_word = "x" * 50_000
    rows = [("en", f"the very common phrase of {k % 3} {long_word} end")for k in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(16)
    assert result(collocations(docs)) == plain(rows)


def test_edges(spark):
    docs = edge.documents(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert result(collocations(docs, least=2, top=100)) == plain(rows, least=2, top=100)
    assert collocations(edge.none(spark)).collect() == []
    assert collocations(docs.where("text is null")).collect() == []
    assert collocations(docs.where("doc_id = 8")).collect() == []  # nothing frequent


def test_chunks_cut_behind_pieces():
    rng = random.Random(3)
    rows = [(rng.choice("ab"), t.encode()) for t in texts(rng, 60, ["one", "Two", "é"])] + [("a", b"y" * 300), ("b", None)]
    for size in (16, 100, 10**6):
        got = {}
        for lang, words in ph.chunks(rows, size):
            assert words[-1] == b"."
            got.setdefault(lang, Counter()).update(b" ".join(words).split(b"."))
        wanted = {}
        for lang, text in rows:
            for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or b"").lower()):
                wanted.setdefault(lang, Counter())[b" ".join(piece.split())] += 1
        for lang in wanted:
            strip = lambda c: Counter({k.strip(): n for k, n in c.items() if k.strip()})
            merged = Counter()
            for k, n in got[lang].items():
                merged[k.strip()] += n
            del merged[b""]
            assert merged == strip(wanted[lang])


def test_trie_counts_and_forgets():
    rng = random.Random(4)
    vocabulary = [f"v{k}".encode() for k in range(300)]
    sequences = {tuple(rng.choice(vocabulary) for _ in range(rng.randint(1, 3))) for _ in range(3000)}
    phrases = sorted(b" ".join(s).decode() for s in sequences)
    [batch] = ph._build([__import__("pyarrow").RecordBatch.from_pydict(
        {"lang": ["en"] * len(phrases), "shard": [0] * len(phrases), "phrase": phrases})])
    row = batch.to_pylist()[0]
    trie = ph.Trie(*(np.frombuffer(row[n], "<i4") for n in ("base", "check", "value")), row["alphabet"], row["radix"], row["n"])
    assert len(trie.base) < 2.5 * sum(len(p.split(" ")) for p in phrases)
    words, counts, wanted = ph.Words(), np.zeros(len(phrases), np.int64), Counter()
    for size in (2000, 10, 4000):
        stream = [rng.choice(vocabulary + [b".", b"unknown"]) for _ in range(size)] + [b"."]
        wanted.update(p for k in (1, 2, 3) for p in zip(*(stream[i:] for i in range(k))) if p in sequences)
        trie.count(trie.of(words, words.numbers(stream)), 3, counts)
        words.forget()
    assert {tuple(p.encode().split(b" ")): n for p, n in zip(phrases, counts.tolist()) if n} == dict(wanted)


def counted(rows, most, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, " ".join(w[i:i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    return {(lang, p): a for (lang, p), a in f.items() if a >= least}, {lang: a for lang, a in n.items() if a}


def test_texts_are_read_twice_however_many_tries_there_would_be(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", "a\nb"]), t) for t in texts(rng, 300, [f"w{k}" for k in range(25)] + ["É", "the"])]
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(lang, t.encode()) for lang, t in rows], "lang string, text binary").repartition(4)
    counts, totals = ph.phrase_counts(docs.mapInArrow(seen, docs.schema), 3, 4, trie=15, at_once=2)
    phrases, words = counted(rows, 3, 4)
    assert len(phrases) > 10 * 15 * 2  # more than ten rounds of tries
    assert sorted(map(tuple, counts.collect())) == sorted((*p, a) for p, a in phrases.items())
    assert sorted(map(tuple, totals.collect())) == sorted(words.items())
    assert reads.value == 2 * len(rows)


def test_few_phrases_of_many_languages_travel_together(spark):
    rows = [(f"l{k:02d}", "one two three. " * 5) for k in range(12)]
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(lang, t.encode()) for lang, t in rows], "lang string, text binary").repartition(2)
    counts, totals = ph.phrase_counts(docs.mapInArrow(seen, docs.schema), 3, 4, trie=100, at_once=2)
    phrases, words = counted(rows, 3, 4)
    assert sorted(map(tuple, counts.collect())) == sorted((*p, a) for p, a in phrases.items())
    assert sorted(map(tuple, totals.collect())) == sorted(words.items())
    assert reads.value == 3 * len(rows)


def test_tallies_are_handed_on(monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), t) for t in texts(rng, 80, [f"v{k}" for k in range(20)] + ["É", "x" * 300])]
    batches = [pa.RecordBatch.from_pydict({"lang": [r[0]], "text": [r[1].encode()]}) for r in rows]
    in_order = lambda told, *names: pa.Table.from_batches(told).sort_by([(n, "ascending") for n in names]).combine_chunks().to_batches()
    monkeypatch.setattr(ph, "chunks", lambda given, cut=ph.chunks: cut(given, 500))
    kept = ph._frequent(3, 16, 12)(in_order(ph._count_hashes(3, 3, 16)(batches), "part"))
    passed = types.SimpleNamespace(value={r["part"]: r["held"] for b in kept for r in b.to_pylist()})
    for held, size in ((1 << 20, 1 << 20), (50, 1 << 20), (1 << 20, 1000)):
        monkeypatch.setattr(ph, "HELD", held)
        monkeypatch.setattr(ph, "HELD_BYTES", size)
        told = list(ph._tell(passed, 16, 12, 3)(batches))
        assert (len(told) > 2) == (min(held, size) < 1 << 20)
        got = [tuple(r.values()) for b in ph._add(3)(in_order(told, "part", "lang")) for r in b.to_pylist()]
        phrases, words = counted(rows, 3, 3)
        assert len(got) == len(phrases) + len(words)
        assert {(lang, p): f for lang, p, f in got} == {**phrases, **{(lang, ""): n for lang, n in words.items()}}


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert result(collocations(docs)) == plain(rows)
