"""Secret scans: fixed patterns and a guess-cost dynamic program (operator 8).

Base spans come from three patterns (``assign``, ``access``, ``hex``), each
searched from the left without overlaps; a match that is too short is dropped.

The method adds ``guess`` spans.  Wherever a credential word stands before a
value, the value is segmented at minimum cost into dictionary words, dates,
repeats of one character or group, keyboard walks and brute-force characters;
the cost of a segment is log10 of the guesses it takes.  The program runs over
the positions of the value: best[j] is the least over the segments that end at
j.  A value that costs at least ``min_log10_guesses`` is a secret; one built of
words, dates and walks is not.  Words are priced by their rank in a fixed list
and in the corpus itself.  After a bare blank or "is", as in prose, plain words
and addresses are no values, and others must cost ``PROSE_MARGIN`` more.  Values
that a base span already holds add none.

Offsets are code points, ends exclusive; a span is the whole match (``assign``:
from the credential word to the end of the value; ``guess``: the value).

Defined results: a null text counts as empty and has no spans; the value's
length is not bounded (brute force is one cost per character, the other kinds
are found in linear time); repeated rows each get their result.
"""

from __future__ import annotations

import collections
import math
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import staged

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10_GUESSES = 8.0
#: what a value costs more before it counts as a secret after a bare blank or "is"
PROSE_MARGIN = 2.0
#: words of the corpus that are priced by their rank, and their lengths
CORPUS_WORDS, WORD_LENGTHS = 50_000, (3, 24)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORD = r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization|auth|login|bearer)"
_VALUE = r"""(?:bearer\x20+|basic\x20+)?["']?([!-&(-~]{6,})"""
#: what may follow the credential word in a name: SECRET_KEY, token2, secretKey, but not author
_TAIL = r"s?(?-i:(?:[_-]|[0-9]|(?<=[a-z])[A-Z])[A-Za-z0-9_-]*)?(?![A-Za-z0-9_])"
#: a match ends with the name, so that a credential word taken for a value is searched, too
_CONTEXT = re.compile(rf"""{_WORD}(?:{_TAIL}(?=["']?\x20*[:=]\x20*{_VALUE})|{_TAIL}(?=["']?\x20+is\x20+{_VALUE})|\b(?=["']?\x20+{_VALUE}))""", re.ASCII | re.IGNORECASE)
#: after a bare blank or "is", as in prose: plain words, a web or mail address
_PROSE = re.compile(r"""["'(]?(?:[A-Za-z]?[a-z]+|[A-Z]+)(?:['/.,:;()&-]+(?:[A-Za-z]?[a-z]+|[A-Z]+))*|[A-Za-z]+://.*|[\w.+-]+@[\w-]+\..*""", re.ASCII)

# Dictionary of frequent words, most frequent first; the rank is the guess count.
WORDS = """password admin user login welcome secret token example changeme letmein master dragon monkey test guest root
default public private server service account access system database access key value name none null true false your
the and for that this with from have not you are was but all can had her one our out day get has him his how new now
old see two way who boy did its let put say she too use love hello sunshine princess football baseball summer winter
spring autumn monday friday january march april june july august october december qwerty abc iloveyou shadow michael
super batman trust hunter ranger harley pass word""".split()
_RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
_KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEXT_KEY = {(r[i], r[i + d]): d for r in _KEY_ROWS for d in (1, -1) for i in range(len(r)) if 0 <= i + d < len(r)}
_NEXT_KEY.update({(chr(c), chr(c + d)): 2 * d for c in range(48, 123) for d in (1, -1)
                  if chr(c).isalnum() and chr(c + d).isalnum() and (chr(c), chr(c + d)) not in _NEXT_KEY})
_DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_LEET = str.maketrans("430@$15!7", "aeoasisit")
_DIGIT = math.log10(10)
_LOWER = math.log10(26)
_MIXED = math.log10(62)
_OTHER = math.log10(95)


def _char_cost(value: str) -> float:
    """log10 of the alphabet a brute-force search of this value would use."""
    kinds = (any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value),
             any(not c.isalnum() for c in value))
    if kinds[3]:
        return _OTHER
    if sum(kinds) > 1:
        return _MIXED if kinds[2] and kinds[1] else math.log10(36)
    return _DIGIT if kinds[0] else _LOWER


def ranks_of(words: Iterable[str] = ()) -> dict[str, int]:
    """Ranks of the fixed words and of ``words`` (most frequent first), the better of both."""
    ranks = {w: i + 1 for i, w in reversed(list(enumerate(words)))}
    return ranks | {w: min(r, ranks.get(w, r)) for w, r in _RANK.items()}


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``."""
    ranks = _RANK if ranks is None else ranks
    n = len(value)
    if not n:
        return 0.0
    char = _char_cost(value)
    low = value.lower()
    plain = low.translate(_LEET)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # per end: (start, cost)
    for i in range(n):
        for j in range(i + WORD_LENGTHS[0], min(n, i + WORD_LENGTHS[1]) + 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                varied = (low[i:j] not in ranks) + (value[i:j] != low[i:j])
                ends[j].append((i, math.log10(rank + 1) + 0.6 * varied))
    for m in _DATE.finditer(value):
        ends[m.end()].append((m.start(), math.log10(120 * (365 if m.end() - m.start() > 4 else 1))))
    for unit in (1, 2, 3, 4):  # repeats of one character or a short group
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            if j - i >= max(3, 2 * unit):
                for k in {j, i + (j - i) // unit * unit}:
                    ends[k].append((i, unit * char + math.log10((k - i) / unit)))
                i = j - unit + 1
            else:
                i += 1
    i = 0
    while i < n - 1:  # keyboard walks and alphabet runs
        d, j = _NEXT_KEY.get((low[i], low[i + 1])), i + 1
        if d is not None:
            while j + 1 < n and _NEXT_KEY.get((low[j], low[j + 1])) == d:
                j += 1
            if j - i >= 2:
                for k in range(i + 3, j + 2) if j - i < 64 else (j + 1,):
                    ends[k].append((i, math.log10(47 * 2 * (k - i))))
        i = max(j, i + 1)
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        cost = best[j - 1] + char
        for i, c in ends[j]:
            cost = min(cost, best[i] + c + (math.log10(2) if i else 0.0))
        best[j] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, base: list[tuple[int, int, int]], least: float, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    found = []
    done = 0  # end of the last secret
    for m in _CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        if a < done:
            continue
        b = a + len(text[a:b].rstrip("\"'`,.;:!?)]}>"))
        prose = m.lastindex > 1
        if b - a < 6 or any(s <= a and b <= e for s, _, e in base) or prose and _PROSE.fullmatch(text, a, b):
            continue
        if guess_cost(text[a:b], ranks) >= least + PROSE_MARGIN * prose:
            found.append((a, 3, b))
            done = b
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_OUTSIDE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))


def frequent_words(docs: DataFrame, text_col: str = "text", size: int = CORPUS_WORDS) -> list[str]:
    """The most frequent words (runs of ASCII letters, in lower case) of the
    corpus, at most ``size``, ties by word; words of a level of frequency come
    together or not at all.  Counted over all texts; tasks hand on what they
    have counted, and only the words returned reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]):
        held: collections.Counter = collections.Counter()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(w for w in text.as_py().translate(_OUTSIDE).split() if WORD_LENGTHS[0] <= len(w) <= WORD_LENGTHS[1])
                if len(held) > 400_000:
                    yield batch_of()
                    held.clear()
        yield batch_of()

    src = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    counts = src.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * 64)  # 64 levels to a doubling, so few whatever the corpus
    counts = staged(counts.withColumn("level", level), "secret-words")
    least, held = None, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        held += r["count"]
        if held > size:
            break
        least = r.level
    best = counts.where(F.col("level") >= least).select("word", "n").collect() if least is not None else []
    return [r.word for r in sorted(best, key=lambda r: (-r.n, r.word))]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10_guesses: float = MIN_LOG10_GUESSES,
                 words: Sequence[str] = ()) -> DataFrame:
    """Per row: counts of the base kinds, ``base_spans`` and ``spans`` (all)
    as ``kind:start:end`` joined by commas, and ``n_guess``.  ``words`` are priced
    by their rank beside the fixed ones (at most a few 10,000, see
    ``frequent_words``)."""
    words = list(words)

    def run(batches: Iterator[pa.RecordBatch]):
        ranks = ranks_of(words)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                added = guess_spans(text, base, min_log10_guesses, ranks)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), _joined(base), _joined(sorted(base + added)), len(added)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()),
                 pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64())],
                ["id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_guess"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, n_guess bigint")
    return out.withColumnRenamed("id", id_col)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``scan_secrets`` with the base spans as a digest."""
    return scan_secrets(docs, id_col, text_col, **options).select(
        id_col, "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_guess")
