"""First rule whose pattern occurs in a text, by a multi-pattern automaton.

The patterns of a rule table are put into tries with failure links, in shards
of bounded size in the order of the rules.  A shard goes to the tasks as a
column function: a text is read once per shard, beside the other columns of its
row, and only the best rule is kept.  Nothing is joined, exploded or shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

#: most patterns, and characters of patterns, in one automaton
SHARD_PATTERNS, SHARD_CHARS = 100_000, 2_000_000


class Automaton:
    """Patterns with the ranks of their rules (0 is best)."""

    def __init__(self, patterns: Sequence[str]):
        import ahocorasick
        ranks: dict[str, list[int]] = {}
        for rank, pattern in enumerate(patterns):
            ranks.setdefault(pattern, []).append(rank)
        self.everywhere = ranks.pop("", [])
        self.ranks = list(ranks.values())
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, pattern in enumerate(ranks):
            self.trie.add_word(pattern, number)
        if ranks:
            self.trie.make_automaton()

    def _found(self, text: str) -> Iterator[int]:
        """Numbers of the patterns in a text, once per place."""
        return (number for _, number in self.trie.iter(text)) if self.ranks else iter(())

    def first(self, text: str) -> int | None:
        """The least rank of a pattern in ``text``; None without one."""
        best = self.everywhere[0] if self.everywhere else None
        for number in self._found(text):
            if best is None or self.ranks[number][0] < best:
                best = self.ranks[number][0]
                if best == 0:
                    break
        return best

    def all(self, text: str) -> list[int]:
        """The ranks of all patterns in ``text``."""
        return sorted([*self.everywhere, *(r for number in set(self._found(text)) for r in self.ranks[number])])


#: automata of this worker process, by shard
_BUILT: dict[str, Automaton] = {}


def _shards(rows, width: int) -> Iterator[tuple[list, list]]:
    """(patterns, payloads) of bounded size, in the order of the rows."""
    patterns, payloads, chars = [], [], 0
    for row in rows:
        patterns.append(row[0])
        payloads.append(tuple(row)[1:1 + width])
        chars += len(row[0])
        if len(patterns) >= SHARD_PATTERNS or chars >= SHARD_CHARS:
            yield patterns, payloads
            patterns, payloads, chars = [], [], 0
    if patterns:
        yield patterns, payloads


def _built(key: str, patterns: list[str]) -> Automaton:
    if key not in _BUILT:
        if len(_BUILT) >= 16:
            _BUILT.clear()
        _BUILT[key] = Automaton(patterns)
    return _BUILT[key]


def _lookup(patterns: list, payloads: list, schema: StructType):
    """The column function of one shard: ``hit`` and the payload of a text."""
    key = uuid.uuid4().hex
    names = [f.name for f in schema.fields]
    nothing = (False, *[None] * (len(names) - 1))

    @F.pandas_udf(schema)
    def find(texts: pd.Series) -> pd.DataFrame:
        first = _built(key, patterns).first
        ranks = [first(t) if isinstance(t, str) else None for t in texts]
        return pd.DataFrame([nothing if r is None else (True, *payloads[r]) for r in ranks], columns=names)

    return find


def _lookup_all(patterns: list, payloads: list, schema: StructType):
    """The column function of one shard: the payloads of all its rules in a text."""
    key = uuid.uuid4().hex
    names = [f.name for f in schema.fields]

    @F.pandas_udf(ArrayType(schema))
    def find(texts: pd.Series) -> pd.Series:
        every = _built(key, patterns).all
        return pd.Series([[dict(zip(names, payloads[r])) for r in every(t)] if isinstance(t, str) else None for t in texts], dtype=object)

    return find


def _ordered(rules: DataFrame, pattern: str, order: Sequence[str], payload: Sequence[str]):
    """The shards of a rule table, in the order of its rules."""
    kept = rules.where(F.col(pattern).isNotNull())
    rows = (kept.orderBy(*order, *payload, pattern)
            .select(F.col(pattern).alias("__pattern"), *payload).toLocalIterator())
    return _shards(rows, len(payload))


def first_match(rules: DataFrame, pattern: str, order: Sequence[str], payload: Sequence[str]) -> Callable[[Column], Column]:
    """A function from a text column to a struct of ``hit`` and the ``payload``
    columns of the first rule, by ``order``, whose ``pattern`` occurs in it.

    Rules of one order stand by payload, then pattern.  An empty pattern occurs
    in every text that is not null, a null pattern in none.  Rules pass through
    the driver one shard at a time; texts never do."""
    fields = [rules.schema[c] for c in payload]
    schema = StructType([StructField("hit", BooleanType()), *(StructField(f.name, f.dataType) for f in fields)])
    shards = [_lookup(p, q, schema) for p, q in _ordered(rules, pattern, order, payload)]

    def match(text: Column) -> Column:
        found = F.struct(F.lit(False).alias("hit"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        for shard in reversed(shards):  # rules of an earlier shard come first
            own = shard(text)
            found = own if shard is shards[-1] else F.when(own["hit"], own).otherwise(found)
        return found

    return match


def all_matches(rules: DataFrame, pattern: str) -> Callable[[Column], Column]:
    """A function from a text column to the array of all rules (whole rows of
    ``rules``) whose ``pattern`` occurs in it; null for a null text.  It grows
    with the rules that a text has, so it is meant for small rule tables."""
    schema = StructType([StructField(f.name, f.dataType) for f in rules.schema.fields])
    shards = [_lookup_all(p, q, schema) for p, q in _ordered(rules, pattern, [], rules.columns)]

    def match(text: Column) -> Column:
        none = F.when(text.isNotNull(), F.array().cast(ArrayType(schema)))
        return F.concat(*[shard(text) for shard in shards]) if shards else none

    return match
