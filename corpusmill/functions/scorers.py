"""Pluggable scorers of texts: one protocol, adapters, and columns made of them."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class Scorer(Protocol):
    """What a language model must offer: ``prefill`` takes a context, ``decode`` scores a continuation after it."""

    def prefill(self, context: str) -> object: ...

    def decode(self, state: object, text: str) -> float: ...


class BigramScorer:
    """Logarithms of counted bigrams ``{ctx: {ch: share}}`` with a floor."""

    def __init__(self, shares: dict[str, dict[str, float]], floor: float = 1e-6):
        self.shares, self.floor = shares, floor

    def prefill(self, context: str) -> str:
        return context[-1:] or "^"

    def decode(self, state: str, text: str) -> float:
        return sum(math.log(max(self.floor, self.shares.get(a, {}).get(b, 0.0))) for a, b in zip(state + text, text, strict=False))


class LengthScorer:
    """Shorter texts score higher; the trivial adapter."""

    def prefill(self, context: str) -> None:
        return None

    def decode(self, state: None, text: str) -> float:
        return -float(len(text))


class SearchScorer:
    """A model of ``functions.search`` behind this protocol."""

    def __init__(self, model):
        self.model = model

    def prefill(self, context: str) -> str:
        return context

    def decode(self, state: str, text: str) -> float:
        return self.model.log_share(state, text)


class Normalized:
    """Another scorer's score by the length of the text."""

    def __init__(self, inner: Scorer):
        self.inner = inner

    def prefill(self, context: str) -> object:
        return self.inner.prefill(context)

    def decode(self, state: object, text: str) -> float:
        return self.inner.decode(state, text) / max(1, len(text))


class Ensemble:
    """The weighted sum of several scorers."""

    def __init__(self, members: list[tuple[float, Scorer]]):
        self.members = members

    def prefill(self, context: str) -> list:
        return [m.prefill(context) for _, m in self.members]

    def decode(self, state: list, text: str) -> float:
        return sum(w * m.decode(s, text) for (w, m), s in zip(self.members, state, strict=True))


def score_column(scorer: Callable[[], Scorer]):
    """A column function ``(context, text) -> score``; the scorer is made once in each batch."""

    @F.pandas_udf(DoubleType())
    def over(context: pd.Series, text: pd.Series) -> pd.Series:
        model = scorer()
        return pd.Series([None if t is None else model.decode(model.prefill(c or ""), t) for c, t in zip(context, text, strict=True)])

    return over
