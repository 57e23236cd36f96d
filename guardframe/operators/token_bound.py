"""The part of a text that a model with a bounded input sees: its first tokens, over any vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from guardframe.rules import MODEL_TOKENS


class Cutter:
    """Tokens by longest match: at each place the longest piece that stands there, else one code point."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces = frozenset(p for p in pieces if p)
        lengths: dict[str, set[int]] = {}
        for piece in self.pieces:
            lengths.setdefault(piece[0], set()).add(len(piece))
        # only lengths that some piece with this first sign has are tried
        self._lengths = {sign: sorted(found, reverse=True) for sign, found in lengths.items()}

    def ends(self, text: str, limit: int) -> Iterator[int]:
        """Where the first ``limit`` tokens end; what lies behind them is not looked at."""
        at = 0
        while at < len(text) and limit > 0:
            here = (n for n in self._lengths.get(text[at], ()) if text[at:at + n] in self.pieces)
            at += next(here, 1)
            limit -= 1
            yield at

    def cut(self, text: str, limit: int) -> str:
        at = 0
        for at in self.ends(text, limit):
            pass
        return text[:at]


def first_tokens(
    text: Column, make_vocabulary: Callable[[], Iterable[str]], limit: int = MODEL_TOKENS, longest: int | None = None
) -> Column:
    """The longest prefix of a text that has at most ``limit`` tokens; null stays null.

    ``make_vocabulary`` gives the pieces and runs once per task, so a large vocabulary is read where it
    is used. A token is one code point at least, so texts of up to ``limit`` code points are never sent to
    Python. With ``longest``, the most code points of a piece, only the ``limit * longest`` code points
    are sent that the tokens can cover; a vocabulary with a longer piece is refused.
    """
    if limit < 1 or (longest is not None and longest < 1):
        raise ValueError("a model sees one token at least")

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cutter = Cutter(make_vocabulary())
        most = max(map(len, cutter.pieces), default=1)
        if longest is not None and most > longest:
            raise ValueError(f"the vocabulary has a piece of {most} code points, {longest} were given")
        for texts in batches:
            yield texts.map(lambda t: None if t is None else cutter.cut(t, limit))

    sent = F.substring(text, 1, limit * longest) if longest else text
    long = F.length(text) > limit
    return F.when(long, cut(F.when(long, sent))).otherwise(text)
