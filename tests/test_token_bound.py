import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from guardframe.operators import screening
from guardframe.operators.token_bound import Cutter, first_tokens
from guardframe.rules import CATEGORIES, MODEL_TOKENS

PIECES = ["ab", "abc", "b", "c", "caba", "ç", "  "]


def _plain(text, pieces, limit):
    """Tokens one by one, every piece tried at every place."""
    out = ""
    for _ in range(limit):
        rest = text[len(out):]
        if not rest:
            break
        out += max([p for p in pieces if p and rest.startswith(p)], key=len, default=rest[0])
    return out


@given(st.text("abcç x", max_size=30), st.lists(st.text("abcç ", max_size=4), max_size=8), st.integers(1, 12))
def test_cutter_equals_trying_every_piece(text, pieces, limit):
    assert Cutter(pieces).cut(text, limit) == _plain(text, pieces, limit)


@pytest.mark.parametrize("longest", [None, 4, 9])
def test_column(spark, longest):
    texts = ["", None, "abc", "abcab", "cabaabcxx", "x" * 40, "  " * 9, "ab" * 5000, "ç😀" * 7]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {r.i: r.cut for r in df.select("i", first_tokens(F.col("t"), lambda: PIECES, 3, longest).alias("cut")).collect()}
    assert got == {i: None if t is None else _plain(t, PIECES, 3) for i, t in enumerate(texts)}


def test_wrong_bounds_are_refused(spark):
    df = spark.createDataFrame([("abcabc",)], "t string")
    with pytest.raises(ValueError):
        first_tokens(F.col("t"), lambda: PIECES, 0)
    with pytest.raises(Exception, match="piece of 4 code points"):
        df.select(first_tokens(F.col("t"), lambda: PIECES, 2, longest=2)).collect()


def test_cost_is_that_of_the_bound():
    cutter, text = Cutter(["word ", "other"]), "word " * 2_000_000
    begun = time.perf_counter()
    assert len(cutter.cut(text, MODEL_TOKENS)) == 5 * MODEL_TOKENS
    assert time.perf_counter() - begun < 0.5


def _seen():
    """A model whose logits tell how many words came in; local, as workers do not know this module."""
    n = len(CATEGORIES)

    def make():
        return lambda texts: np.stack([[len(t.split()) / 1000.0] * n for t in texts])
    return make


def test_long_text_reaches_the_model_bounded(spark):
    rows = [(1, "word " * 20_000 + "sarin"), (2, "word word"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, t string")

    def bound(text):
        return first_tokens(text, lambda: ["word "], longest=5)
    plain = screening.score_with_model(df, "t", _seen(), bound=bound)
    got = {r.id: r.screen for r in plain.collect()}
    # 512 words were seen, and the override still read the last word
    other = next(c for c in CATEGORIES if c not in ("Indiscriminate weapons", "Jailbreak prompts"))
    assert got[1].probabilities[other] == pytest.approx(1 / (1 + np.exp(-0.512)))
    assert got[1].probabilities["Indiscriminate weapons"] == 0.99
    assert got[2].probabilities[other] == pytest.approx(1 / (1 + np.exp(-0.002)))
    assert got[3].engine == got[4].engine == "empty_input"
    sorted_ = screening.score_with_model(df, "t", _seen(), bound=bound, by_length=True)
    assert {r.id: r.screen for r in sorted_.collect()} == got and sorted_.columns == plain.columns


def test_batches_hold_texts_of_like_length(spark):
    n = len(CATEGORIES)

    def spread():
        def predict(texts):
            lengths = [len(t) for t in texts]
            return np.full((len(texts), n), (max(lengths) - min(lengths)) / 100.0)
        return predict
    df = spark.range(64, numPartitions=1).select("id", F.repeat(F.lit("x"), (F.col("id") * 37 % 64 + 1).cast("int")).alias("t"))
    other = next(c for c in CATEGORIES if c not in ("Indiscriminate weapons", "Jailbreak prompts"))

    def widest(by_length):
        scored = screening.score_with_model(df, "t", spread, batch_size=8, by_length=by_length)
        return scored.agg(F.max(F.col("screen.probabilities")[other])).first()[0]
    assert widest(True) == pytest.approx(1 / (1 + np.exp(-0.07))) and widest(False) > 0.55
