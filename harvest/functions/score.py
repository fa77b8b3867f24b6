"""Relevance scores from keyword sets; array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, tokens

# Fixed values: (weight of precision, weight of recall, factor, greatest penalty) by mode.
MODES = {"title": (0.75, 0.25, 1.15, 0.45), "href": (0.60, 0.40, 1.05, 0.60), "description": (0.65, 0.35, 1.25, 0.60)}


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once: an expression in several places is computed in each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hits(t: Column, words: Column) -> Column:
    return F.size(F.filter(t, lambda x: F.array_contains(words, x)))


def _share(t: Column, good: Column) -> Column:
    return F.size(F.array_intersect(t, good)) / F.greatest(F.lit(1), F.size(good))


def keyword_score(text: Column, good: Column, bad: Column) -> Column:
    """0.65 * good tokens / tokens + 0.35 * share of the good set - at most 0.6 at 0.15 a bad token, within [0, 1]."""

    def scored(t: Column) -> Column:
        s = F.lit(0.65) * _hits(t, good) / F.size(t) + F.lit(0.35) * _share(t, good) - F.least(F.lit(0.60), F.lit(0.15) * _hits(t, bad))
        return F.when(F.size(t) > 0, clamp(s)).otherwise(F.lit(0.0))

    return F.coalesce(_let(tokens(text), scored), F.lit(0.0))


def mode_score(text: Column, mode: str, good: Column, bad: Column) -> Column:
    """The same with precision over distinct tokens, shaped by mode (any other name is a description)."""
    return F.coalesce(_let(tokens(text), lambda t: _mode_score(t, mode, good, bad)), F.lit(0.0))


def mode_scores(text: Column, good: Column, bad: Column) -> Column:
    """struct of the scores of all modes, from tokens made once."""
    return _let(tokens(text), lambda t: F.struct(*(F.coalesce(_mode_score(t, m, good, bad), F.lit(0.0)).alias(m) for m in MODES)))


def _mode_score(t: Column, mode: str, good: Column, bad: Column) -> Column:
    p, r, factor, most = MODES.get(mode, MODES["description"])
    recall = F.when(F.size(good) > 0, _share(t, good)).otherwise(F.lit(0.0))
    base = F.lit(p) * _hits(t, good) / F.size(F.array_distinct(t)) + F.lit(r) * recall
    return F.when(F.size(t) > 0, clamp(base * F.lit(factor) - F.least(F.lit(most), F.lit(0.15) * _hits(t, bad)))).otherwise(F.lit(0.0))


def accept_band(strong: float | None = None) -> float:
    return 0.80 if strong is None else max(0.80, strong)


def reject_band(threshold: float | None = None) -> float:
    return 0.20 if threshold is None else min(0.20, threshold / 2)


def classify(text: Column, score: Column, accept: float, reject: float) -> Column:
    """struct(label, confidence, source): yes, no, or '' where neither band decides (a gate may be plugged in)."""
    blank = strip(text) == ""
    label = F.when(blank, "").when(score >= accept, "yes").when(score <= reject, "no").otherwise("")
    confidence = F.when(label == "yes", score).when(label == "no", 1 - score).otherwise(F.lit(0.0))
    return F.struct(label.alias("label"), confidence.alias("confidence"), F.when(label == "", "").otherwise("heuristic").alias("source"))


def should_consider(text: Column, good: list[str], bad: list[str], threshold: float) -> Column:
    """No with any bad word anywhere (within words too), else yes with any good one, else by score."""
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    sets = [F.array(*map(F.lit, x)) for x in (good, bad)]
    return F.when(has(bad), False).when(has(good), True).otherwise(keyword_score(text, *sets) >= threshold)
