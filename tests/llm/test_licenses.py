import random
import re

import edge
import pytest
from pyspark.sql import functions as F

from guardframe.llm.licenses import PHRASES, TEMPLATES, Automaton, Scanner, scan, words


def longest_at(sequences, text, end):
    """Longest run of the text that ends there and stands in a sequence, by trying all."""
    for size in range(end, 0, -1):
        own = text[end - size:end]
        if any(s[k:k + size] == own for s in sequences for k in range(len(s) - size + 1)):
            return size
    return 0


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    sequences = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 15))] for _ in range(6)]
    sequences.append(list(sequences[0]))
    automaton = Automaton(sequences)
    text = [rng.randrange(1, 5) for _ in range(80)]
    for end, (size, state) in enumerate(automaton.statistics(text), 1):
        assert size == longest_at(sequences, text, end)
        if size:
            own = text[end - size:end]
            assert automaton.ends[state] == {(k, at) for k, s in enumerate(sequences) for at in range(size, len(s) + 1) if s[at - size:at] == own}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_places(text):
    found = plain_words(text)
    return len(found), sorted(
        (k, label) for label, phrase in PHRASES for k in range(len(found)) if found[k:k + len(phrase.split())] == phrase.split())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["id"]: r for r in scan(docs).collect()}
    labels = set()
    for r in docs.collect():
        n, places = plain_places(r["text"])
        own = found[r["doc_id"]]
        assert own["n_words"] == n and [(p["word"], p["label"]) for p in own["places"]] == places
        joined = " ".join(plain_words(r["text"]))
        for label, template in TEMPLATES:
            if re.search(rf"(?<!\S){' '.join(plain_words(template))}(?!\S)", joined):
                assert label in {s["label"] for s in own["spans"]}
                labels.add(label)
        if "licens" not in joined:
            assert own["spans"] == []
    assert len(found) == docs.count()


def test_every_template_is_found_whole_edited_and_not_in_pieces():
    scanner = Scanner(TEMPLATES, PHRASES)
    for label, template in TEMPLATES:
        said = words(template)
        _, _, spans = scanner.scan("some text " + template.upper() + " more text")
        assert (label, 2, 1 + len(said), 1.0) in spans
        if len(said) > 20:
            own = template.split()
            own[len(own) // 2] = "zzz"
            assert any(s[0] == label and s[3] >= 0.75 for s in scanner.scan(" ".join(own))[2])
            assert not any(s[0] == label for s in scanner.scan(" ".join(own[len(own) // 3:][:len(own) // 4]))[2])


def test_edges(spark):
    docs = edge.documents(spark)
    rows = scan(docs).collect()
    assert len(rows) == 15
    by = {r["id"]: r for r in rows}
    assert by[3]["n_words"] == 0 and by[4]["places"] == [] and by[7]["n_words"] == 1 and by[6]["n_words"] == 120_000
    assert scan(edge.none(spark)).collect() == []
    many = docs.limit(1).withColumn("text", F.repeat(F.lit("CC-BY all rights reserved. "), 3000)).select("doc_id", "text")
    own = scan(many).first()
    assert len(own["places"]) == 6000 and own["n_words"] == 15_000
