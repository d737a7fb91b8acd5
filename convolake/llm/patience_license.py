"""License scans by patience alignment (operator 4).

Words of a text are aligned with the words of a license template: words that
occur once in either are anchors; the longest increasing subsequence of the
anchors' places is kept; the gaps between kept anchors are aligned in the same
way, after equal words at their ends are taken off.  Coverage is the share of
the template's words that are aligned.

A text is not aligned as a whole (a word of a license may stand anywhere in a
long text and then anchors nothing).  Words that tell of licenses mark places;
each cluster of places, widened by the longest template, is a region.  A region
in which no template reaches the limit is cut at its widest gap between places
and its halves are tried, so that repeated notices, whose words are not unique
in the whole region, are found one by one.  A cluster longer than four
templates is first cut into overlapping blocks in which any notice fits.

Defined results: null or wordless texts have no license; of several found, the
row's ``license`` is the one with the highest coverage, then with most words
aligned, then the first by name; ``licenses`` lists all that were found.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.license_templates import TEMPLATES

MIN_COVERAGE = 0.8
GAP = 48
_WORD = re.compile(r"[a-z0-9]+")
#: words that mark a possible notice (every template holds at least one)
TELLING = frozenset("license licensed licence licences licenses copyright permission redistribution redistributions "
                    "warranty warranties gnu mozilla apache mit".split())


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places ``(i, j)`` with ``a[i] == b[j]``, both increasing."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {w: j for j, w in enumerate(b[j0:j1], j0) if in_b[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[i0:i1], i0) if in_a[w] == 1 and w in place]
        if not pairs:
            continue
        tops: list[int] = []  # smallest end of an increasing run of each length
        top_at: list[int] = []
        before = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tops, j)
            before[k] = top_at[at - 1] if at else -1
            tops[at:at + 1], top_at[at:at + 1] = [j], [k]
        chain, k = [], top_at[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = before[k]
        i, j = i0, j0
        for p, q in [*reversed(chain), (i1, j1)]:
            todo.append((i, p, j, q))
            i, j = p + 1, q + 1
        found += chain
    return sorted(found)


class LicenseScanner:
    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.templates = {name: words_of(t) for name, t in sorted(templates.items())}
        self.sets = {name: set(t) for name, t in self.templates.items()}
        self.longest = max([1, *map(len, self.templates.values())])
        self.min_coverage = min_coverage

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(name, coverage, aligned words, first word, last word) per find."""
        low = text.lower()
        if not any(w in low for w in ("licen", "copyright", "permission", "redistribution", "warrant", "gnu", "mozilla", "apache", "mit")):
            return []
        words = _WORD.findall(low)
        marks = [i for i, w in enumerate(words) if w in TELLING]
        found, begin = [], 0
        for k in range(1, len(marks) + 1):
            if k == len(marks) or marks[k] - marks[k - 1] > GAP:
                found += self._cluster(words, marks[begin:k])
                begin = k
        best: dict[tuple[str, int], tuple] = {}
        for f in found:
            best[f[0], f[3]] = max(f, best.get((f[0], f[3]), f), key=lambda x: x[1:3])
        return list(best.values())

    def _cluster(self, words: list[str], marks: list[int]) -> list[tuple]:
        size = 2 * self.longest
        if marks[-1] - marks[0] <= 2 * size:
            return self._region(words, marks)
        found, a = [], marks[0]
        while a <= marks[-1]:  # overlapping blocks; a notice lies wholly in one
            part = marks[bisect_left(marks, a):bisect_left(marks, a + size)]
            if part:
                found += self._region(words, part)
            a += self.longest
        return found

    def _region(self, words: list[str], marks: list[int]) -> list[tuple]:
        found, todo = [], [(marks, self.longest, 0, len(words))]
        while todo:
            marks, margin, low, high = todo.pop()
            a, b = max(low, marks[0] - margin), min(high, marks[-1] + 1 + margin)
            part = words[a:b]
            inside, hits = set(part), []
            for name, t in self.templates.items():
                if len(inside & self.sets[name]) < self.min_coverage * len(self.sets[name]) * 0.75:
                    continue
                pairs = self._dense(patience(part, t))
                if pairs and len(pairs) >= self.min_coverage * len(t):
                    hits.append((name, len(pairs) / len(t), len(pairs), a + pairs[0][0], a + pairs[-1][0]))
            if hits:
                top = max(hits, key=lambda x: (x[1], x[2], [-ord(c) for c in x[0]]))
                found.append(top)
                rest = (([m for m in marks if m < top[3]], margin, low, top[3]), ([m for m in marks if m > top[4]], margin, top[4] + 1, high))
                todo += [r for r in rest if r[0]]  # what was found is not looked at again
            elif len(marks) > 1:
                gap, k = max((marks[k] - marks[k - 1], k) for k in range(1, len(marks)))
                todo += [(marks[:k], min(margin, gap), low, high), (marks[k:], min(margin, gap), low, high)]
        return found

    @staticmethod
    def _dense(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The longest run of pairs without a large jump in the text."""
        best, begin = [], 0
        for k in range(1, len(pairs) + 1):
            if k == len(pairs) or pairs[k][0] - pairs[k - 1][0] > 8 + 2 * (pairs[k][1] - pairs[k - 1][1]):
                if k - begin > len(best):
                    best = pairs[begin:k]
                begin = k
        return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``license`` (null: none), ``coverage``, ``n_aligned``,
    ``first_word``, ``last_word`` (places of words in the text) and
    ``licenses`` (all names found, sorted)."""
    scanner = LicenseScanner(templates or TEMPLATES, min_coverage)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                hits = scanner.scan(text)
                top = min(hits, key=lambda x: (-x[1], -x[2], x[0], x[3])) if hits else (None, 0.0, 0, None, None)
                rows.append((*top, sorted({h[0] for h in hits})))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["id", "license", "coverage", "n_aligned", "first_word", "last_word", "licenses"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, license string, coverage double, n_aligned bigint, "
                              "first_word bigint, last_word bigint, licenses array<string>")
    return out.withColumnRenamed("id", id_col)
