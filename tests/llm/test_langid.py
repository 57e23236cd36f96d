import edge
import numpy as np
from pyspark.sql import functions as F

from guardframe.llm.common import fold
from guardframe.llm.langid import Field, forward_backward, identify, in_language, letters, probabilities, train


def test_messages_are_those_of_whole_chains():
    rng = np.random.default_rng(1)
    labels, sizes = 3, np.array([1, 5, 64, 65, 200, 130])
    x = rng.random((sizes.sum(), labels)) + 0.01
    start, step = rng.random(labels) + 0.1, rng.random((labels, labels)) + 0.05
    found, at = probabilities(*forward_backward(x, sizes, start, step)), 0
    for n in sizes:
        own = x[at:at + n]
        ahead, behind = [start * own[0]], [np.ones(labels)]
        for k in range(1, n):
            value = (ahead[-1] @ step) * own[k]
            ahead.append(value / value.sum())
        for k in range(n - 1, 0, -1):
            value = step @ (own[k] * behind[-1])
            behind.append(value / value.sum())
        wanted = np.array(ahead) * np.array(behind[::-1])
        assert np.allclose(found[at:at + n], wanted / wanted.sum(axis=1, keepdims=True))
        at += n


def test_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = train(docs.where(fold("doc_id", 5) > 0))
    found = identify(docs, field).join(docs, F.col("id") == F.col("doc_id")).where((fold("doc_id", 5) == 0) & F.col("lang").isNotNull())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    assert found.where("score < 0 or score > 1").isEmpty()


def test_words_of_switched_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = train(docs)
    english = "this is the and of the thing that are there for the".split()
    french = "dans la et que les pour une le des qui un est".split()
    found = field.label(english + french, [len(english) + len(french)]).argmax(axis=1)
    names = [field.labels[k] for k in found]
    assert names[:10].count("en") >= 9 and names[-10:].count("fr") >= 9


def test_edges(spark):
    docs = edge.documents(spark)
    field = train(docs)
    assert field.labels == ["de", "en", "fr"]
    rows = identify(docs, field).collect()
    assert len(rows) == 15
    found = {r["id"]: (r["lang_pred"], r["score"]) for r in rows if r["id"] is not None}
    assert all(found[k] == ("und", 0.0) for k in (3, 4, 5, 10))
    assert found[7][0] in field.labels and found[6][0] == "de"
    kept = in_language(docs, field)
    assert kept.schema == docs.schema and kept.count() == 10
    assert identify(edge.none(spark), field).collect() == []
    unlearned = train(edge.none(spark))
    assert {r["lang_pred"] for r in identify(docs, unlearned).collect()} == {"und"}


def test_every_letter_of_a_long_run_counts(spark):
    run = "ab" * 60
    assert "".join(letters(f"1{run} x")) == run + "x" and max(map(len, letters(run))) == 40
    rows = [(k, "th" * 30 if k % 2 else "zq" * 30, "en" if k % 2 else "xx") for k in range(60)]
    field = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = ["th" * 10 + "zq" * 200 + "th" * 10, "zq" * 10 + "th" * 200 + "zq" * 10]
    found = identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), field).orderBy("id").collect()
    assert [r["lang_pred"] for r in found] == ["xx", "en"]


def test_the_fit_sample_is_bounded_and_takes_a_copied_text_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Field, "fit", lambda self, sample: seen.append(sample))
    many = spark.range(60_000).select(F.lit("one text copied very often").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(4000).select(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
                                     F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    train(many.unionAll(other), fit_rows=50)
    assert [sum(lang == name for lang, _ in seen[0]) for name in ("de", "en")] == [50, 50]
    train(many, fit_rows=50)
    assert seen[1] == [("en", ["one", "text", "copied", "very", "often"])]


def test_noise_goes_and_switched_or_marked_text_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = train(docs.where(fold("doc_id", 5) > 0), noise=True)
    held = [r["text"] for r in docs.where((fold("doc_id", 5) == 0) & F.col("lang").isNotNull() & (F.length("text") > 100)).collect()]
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxzaeiou  "), 400)) for _ in range(60)]
    noise += ["".join(rng.permutation(list(text[:600]))) for text in held[:60]]
    switched = [a[:300] + " " + b[:300] for a, b in zip(held, held[1:])]
    marked = ["### " + text.upper().replace(" ", "!! ") + " 24be64439e3e49cf 12.3.4.5" for text in held]
    kept = {name: in_language(spark.createDataFrame([(t,) for t in texts], "text string"), field).count() / len(texts)
            for name, texts in (("noise", noise), ("held", held), ("switched", switched), ("marked", marked))}
    print(kept)
    assert kept["noise"] <= 0.02 and min(kept["held"], kept["switched"], kept["marked"]) >= 0.995
    assert {r["lang_pred"] for r in identify(spark.createDataFrame([(n,) for n in noise], "text string").withColumn(
        "doc_id", F.lit(1)), field).collect()} <= {"und", *field.labels}
