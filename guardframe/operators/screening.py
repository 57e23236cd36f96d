"""Text safety screening over a text column.

A trigger is counted once however often it occurs. Matching works on word sets: the text is split
into words once, reduced to the trigger words, and every single-word trigger is then a lookup in
that small set. Phrases are searched only in texts that hold their longest word.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardframe.functions.text import (
    contains_any,
    sql_text,
    strip_text,
    text_array,
    whole_word_pattern,
    words,
)
from guardframe.rules import (
    CATEGORIES,
    DEFAULT_THRESHOLD,
    ENGINE_EMPTY,
    ENGINE_KEYWORDS,
    ENGINE_MODEL,
    OVERRIDE_SCORES,
    OVERRIDE_TERMS,
    SCORE_LADDER,
    TRIGGERS,
)

SCREEN_TYPE = (
    "struct<safe:boolean,flagged_categories:array<string>,max_probability:double,"
    "probabilities:map<string,double>,engine:string>"
)


def _bounded(pattern: str) -> bool:
    return pattern.startswith(r"\b")


def _literal(pattern: str) -> str:
    """Text that every match of the pattern contains."""
    return pattern.replace(r"\b", "").split(")?")[-1]


def _key_word(pattern: str) -> str | None:
    """A whole word of every match, by which texts without the phrase are passed over.

    A phrase without word boundaries may start or end inside a longer word, so only its inner
    words are whole; short ones are too common to be worth the lookup.
    """
    parts = re.findall(r"[a-z]+", _literal(pattern))
    if not _bounded(pattern):
        parts = [word for word in parts[1:-1] if len(word) > 4]
        if _literal(pattern) != pattern:
            parts.append(re.findall(r"[a-z]+", _literal(pattern))[0])
    return max(parts, key=len) if parts else None


VOCABULARY = sorted({word for group in TRIGGERS.values() for p in group if (word := _key_word(p))})


def trigger_words(lowered: Column) -> Column:
    """The trigger words in a lowercased text; usually an empty array."""
    return F.filter(words(lowered), lambda word: word.isin(VOCABULARY))


def _match_sql(pattern: str) -> str:
    """Whether a trigger is in ``_lowered``, given its trigger words in ``_found``."""
    literal, word = _literal(pattern), _key_word(pattern)
    tests = [f"array_contains(_found, {sql_text(word)})"] if word else []
    if literal != word:
        tests.append(f"contains(_lowered, {sql_text(literal)})")
        if _bounded(pattern):
            tests.append(f"rlike(_lowered, {sql_text(whole_word_pattern(literal))})")
        elif literal != pattern:
            tests.append(f"rlike(_lowered, {sql_text(pattern)})")
    return f"int({' AND '.join(tests)})"


# a text without trigger words can only match the triggers that have no whole word
_ANY_SQL = " OR ".join(["size(_found) > 0"] + [
    _match_sql(pattern) + " = 1"
    for name in CATEGORIES for pattern in TRIGGERS[name] if not _key_word(pattern)
])
_COUNTS_SQL = ", ".join(
    " + ".join(_match_sql(pattern) for pattern in TRIGGERS[name]) for name in CATEGORIES
)
_ZEROS_SQL = ", ".join("0" for _ in CATEGORIES)
MATCHES_SQL = f"if({_ANY_SQL}, array({_COUNTS_SQL}), array({_ZEROS_SQL}))"


def match_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``matches``: per category, in order, the number of triggers found in the text.

    The found words pass through a one-row ``explode``. A filter on the verdict would otherwise be
    pushed below the projections, with the text split again for every trigger; filters on other
    columns still reach the scan.
    """
    keep = [c for c in df.columns if c != "matches"]
    lowered = df.select(*keep, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_lowered"))
    found = F.explode_outer(F.array(trigger_words(F.col("_lowered")))).alias("_found")
    return lowered.select("*", found).select(*keep, F.expr(MATCHES_SQL).alias("matches"))


def score(matches: Column) -> Column:
    """Score of one category from its number of matches."""
    ladder = F.when(matches == 0, SCORE_LADDER[0])
    for n, value in enumerate(SCORE_LADDER[1:-1], start=1):
        ladder = ladder.when(matches == n, value)
    return ladder.otherwise(SCORE_LADDER[-1])


def keyword_scores(matches: Column, empty: Column) -> Column:
    """Scores in category order; an empty text scores zero everywhere."""
    zeros = F.array_repeat(F.lit(0.0), len(CATEGORIES))
    return F.when(empty, zeros).otherwise(F.transform(matches, score))


def category_array() -> Column:
    return text_array(CATEGORIES)


def flags(scores: Column, threshold: Column) -> Column:
    """Names of the categories that reach the threshold, in category order.

    The scores are zipped, not looked up from inside a lambda, where the optimizer would work them
    out again for every category.
    """
    pairs = F.arrays_zip(category_array().alias("category"), scores.alias("score"))
    return F.filter(pairs, lambda pair: pair["score"] >= threshold)["category"]


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def is_empty_text(col: Column) -> Column:
    return strip_text(F.coalesce(col, F.lit(""))) == ""


def screen(
    df: DataFrame,
    text_col: str,
    threshold: Column | float = DEFAULT_THRESHOLD,
    output: str = "screen",
) -> DataFrame:
    """Add a struct column with the verdict of the keyword engine on ``text_col``.

    ``threshold`` may be a column of ``df``, so that each row has its own. A null text is
    screened as an empty one.
    """
    engine = F.when(is_empty_text(F.col(text_col)), ENGINE_EMPTY).otherwise(ENGINE_KEYWORDS)
    prepared = df.select("*", _as_column(threshold).alias("_threshold"), engine.alias("_engine"))
    scored = match_counts(prepared, text_col).withColumn(
        "_scores", keyword_scores(F.col("matches"), F.col("_engine") == ENGINE_EMPTY)
    )
    return _verdict(scored, df.columns, output)


def _verdict(scored: DataFrame, keep: list[str], output: str) -> DataFrame:
    """Turn ``_scores``, ``_engine`` and ``_threshold`` into the result struct."""
    reached = flags(F.col("_scores"), F.col("_threshold"))
    flagged = scored.withColumn(
        "_flags",
        F.when(F.col("_engine") == ENGINE_EMPTY, F.array().cast("array<string>")).otherwise(reached),
    )
    return flagged.select(
        *[c for c in keep if c != output],
        F.struct(
            (F.size("_flags") == 0).alias("safe"),
            F.col("_flags").alias("flagged_categories"),
            F.array_max("_scores").alias("max_probability"),
            F.map_from_arrays(category_array(), F.col("_scores")).alias("probabilities"),
            F.col("_engine").alias("engine"),
        ).alias(output),
    )


def override_scores(df: DataFrame, text_col: str, scores_col: str) -> DataFrame:
    """Set the fixed scores of the override in a ``map<string,double>`` column of scores.

    Applies where the lowercased text contains any of the weapons terms, inside words too.
    """
    def replaced(name, value):
        for category, fixed in OVERRIDE_SCORES.items():
            value = F.when(name == category, fixed).otherwise(value)
        return value

    lowered = df.select("*", F.lower(F.col(text_col)).alias("_lowered"))
    hit = contains_any(F.col("_lowered"), OVERRIDE_TERMS)
    fixed = F.when(hit, F.transform_values(scores_col, replaced)).otherwise(F.col(scores_col))
    return lowered.withColumn(scores_col, fixed).select(*df.columns)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _predict_or_nan(make_predict: Callable):
    """Wrap a prediction function so that a text it fails on yields NaN logits.

    A batch that fails is halved until the texts at fault are alone, so one bad text of n costs
    about 2 log n calls. Missing texts are not sent.
    """
    def make():
        predict = make_predict()

        def logits(texts: np.ndarray) -> np.ndarray:
            return np.asarray(predict(texts), dtype=np.float64).reshape(len(texts), len(CATEGORIES))

        def halved(texts: np.ndarray) -> np.ndarray:
            try:
                return logits(texts)
            except Exception:
                if len(texts) == 1:
                    return np.full((1, len(CATEGORIES)), np.nan)
                middle = len(texts) // 2
                return np.concatenate([halved(texts[:middle]), halved(texts[middle:])])

        def batch(texts: np.ndarray) -> np.ndarray:
            out = np.full((len(texts), len(CATEGORIES)), np.nan)
            sent = np.array([text is not None for text in texts], dtype=bool)
            if sent.any():
                out[sent] = halved(texts[sent])
            return out

        return batch

    return make


def score_with_model(
    df: DataFrame,
    text_col: str,
    make_predict: Callable,
    threshold: Column | float = DEFAULT_THRESHOLD,
    output: str = "screen",
    engine: str = ENGINE_MODEL,
    batch_size: int = 64,
    bound: Callable[[Column], Column] | None = None,
    by_length: bool = False,
) -> DataFrame:
    """Screen with an injected model; texts the model fails on get the keyword verdict.

    ``make_predict`` runs once per Python worker and returns a function from an array of texts to
    an array of logits with one column per category. ``bound`` gives the part of a text that is sent, as
    ``token_bound.first_tokens`` does; without it the model does its own truncation. The override and the
    triggers see the whole text. With ``by_length`` texts of like length are sent together, which saves
    padding, after a sort within each partition. Overrides apply to model scores only. Empty texts are not sent, and triggers are sought in texts that the model
    failed on only.
    """
    model = predict_batch_udf(
        _predict_or_nan(make_predict), return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    stripped = df.select(
        "*",
        _as_column(threshold).alias("_threshold"),
        strip_text(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
    )
    empty = F.col("_text") == ""
    if bound is not None:
        stripped = stripped.withColumn("_sent", bound(F.col("_text")))
    sent = F.col("_text" if bound is None else "_sent")
    if by_length:
        stripped = stripped.sortWithinPartitions(F.length(sent))
    predicted = stripped.select("*", model(F.when(~empty, sent)).alias("_logits"))
    failed = F.col("_logits").isNull() | F.exists("_logits", lambda x: x.isNull() | F.isnan(x))
    counted = match_counts(predicted.withColumn("_sought", F.when(failed, F.col("_text"))), "_sought")
    probabilities = F.transform("_logits", sigmoid)
    fixed = F.array(*[
        F.lit(OVERRIDE_SCORES[name]) if name in OVERRIDE_SCORES
        else F.get(F.col("_probabilities"), F.lit(i))
        for i, name in enumerate(CATEGORIES)
    ])
    weapons = contains_any(F.col("_lower_text"), OVERRIDE_TERMS)
    chosen = (
        counted
        .select(
            "*",
            F.lower("_text").alias("_lower_text"),
            F.when(empty, ENGINE_EMPTY).when(failed, ENGINE_KEYWORDS).otherwise(engine).alias("_engine"),
            probabilities.alias("_probabilities"),
        )
        .withColumn(
            "_scores",
            F.when(F.col("_engine") != engine, keyword_scores(F.col("matches"), empty))
            .when(weapons, fixed)
            .otherwise(F.col("_probabilities")),
        )
    )
    return _verdict(chosen, df.columns, output)


def scores_long(df: DataFrame, keys: list[str], screen_col: str = "screen") -> DataFrame:
    """One row per key, category and score."""
    # never empty; a plain explode would add a filter that works the map out a second time
    return df.select(
        *keys, F.explode_outer(F.col(screen_col)["probabilities"]).alias("category", "score")
    )


def screen_counters(df: DataFrame, screen_col: str = "screen", model: str = ENGINE_MODEL) -> DataFrame:
    """Totals by engine; empty input counts in the total only."""
    verdict = F.col(screen_col)
    return df.agg(
        F.count_if(verdict.isNotNull()).alias("total_requests"),
        F.count_if(~verdict["safe"]).alias("blocked_requests"),
        F.count_if(verdict["engine"] == model).alias("local_inferences"),
        F.count_if(verdict["engine"] == ENGINE_KEYWORDS).alias("fallback_inferences"),
        F.count_if(verdict["engine"] == ENGINE_EMPTY).alias("empty_inputs"),
    )
