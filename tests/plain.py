"""The rules once more, for one text at a time, to check the columns against."""

import re

from guardframe import rules


def counts(text):
    lowered = text.lower()
    return [len([p for p in rules.TRIGGERS[name] if re.search(p, lowered)]) for name in rules.CATEGORIES]


def scores(text):
    if not text.strip():
        return [0.0] * len(rules.CATEGORIES)
    return [rules.SCORE_LADDER[min(n, 3)] for n in counts(text)]


def flagged(text, threshold):
    if not text.strip():
        return []
    return [name for name, s in zip(rules.CATEGORIES, scores(text)) if s >= threshold]
