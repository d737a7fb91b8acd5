"""Ordered pattern cascades.

Much of the rule logic is "first rule (in a given order) whose pattern
occurs in the text wins".  Two physical forms:

* :func:`first_match` – a small, fixed rule list becomes one generated
  ``CASE WHEN`` expression; it stays inside whole-stage codegen and needs
  no join at all.
* rule *tables* (DataFrames that are edited as data) are matched by
  ``functions.automaton`` – one pass of a multi-pattern automaton.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _test(text: Column, pattern: str, how: str) -> Column:
    if how == "contains":
        return text.contains(pattern)
    if how == "startswith":
        return text.startswith(pattern)
    if how == "endswith":
        return text.endswith(pattern)
    if how == "equals":
        return text == F.lit(pattern)
    if how == "rlike":
        return text.rlike(pattern)
    raise ValueError(how)


def any_contains(text, patterns: Iterable[str], how: str = "contains") -> Column:
    """True when any pattern matches (``how`` = contains/startswith/...)."""
    t = _c(text)
    cond = F.lit(False)
    for p in patterns:
        cond = cond | _test(t, p, how)
    return cond


def first_match(text, rules: Sequence[tuple[object, Iterable[str]]],
                default=None, how: str = "contains") -> Column:
    """Generated ``CASE WHEN``: value of the first rule with a matching pattern.

    ``rules`` is an ordered list of ``(value, patterns)``.
    """
    t = _c(text)
    expr = None
    for value, pats in rules:
        cond = any_contains(t, pats, how)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))
