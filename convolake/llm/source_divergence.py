"""Source divergence audit: how far the sources of one language lie apart in
their use of words, and which words set a source apart.

Terms are runs of letters (ASCII letters and everything beyond ASCII), with
only A-Z lower-cased.  A language keeps the V terms that occur in at least
``min_docs`` of its documents.  With N the occurrences of kept terms in a group
(language, source), or in the whole language, a term that occurs ``count`` times
there has the share ``p = 1 + floor(10**9 * (count + 2) / (N + 2 V))``, and two
shares lie ``floor((p - q)**2 / (p + q))`` apart.  All arithmetic is exact.

Steps, all on Spark:

1. Each task counts its texts per (language, term): documents, and occurrences
   by source.  These partial counts are the only thing that is shuffled; they
   meet by (language, term), where rare terms go.
2. The nonzero cells of the group-term count matrix are dealt to blocks of
   about ``BLOCK`` terms and to pairs of tiles of ``TILE`` groups, so that one
   task never holds more than ``2 * TILE * BLOCK`` cells.
3. A task builds the K-squared tree (K = 2) of its part of the matrix and walks
   it jointly for all pairs of groups.  A quadrant that is zero for both rows
   of groups is uniform: all its terms cost the same for a pair, so they are
   counted and priced by one multiplication.  Only leaves with a count in
   either group are visited.  Terms that occur in neither tile are not even in
   the task; they are priced when the parts of a pair are summed.

Null text, language and source count as ''.  Texts without a term, and groups
without one, take part: such a group has N = 0.  A language without a kept term
gives its pairs of sources the value 0.  Repeated rows are documents of their
own.  Ties in value are ranked by item.  An empty table gives an empty result.
Other columns, whatever their names, are not read.  A text is read whole, as
one row; all else is held in bounded parts.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import staged

TILE, BLOCK = 32, 4096
#: distinct (language, source, term) entries a task holds before it hands them on
HELD = 400_000
#: entries of the joint walk that are expanded at once
FRONT = 1 << 17
#: A-Z in lower case, other ASCII letters and all bytes beyond ASCII as they are, all else a blank
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


# ---------------------------------------------------------------- counting

_COUNTS = "lang string, term string, docs bigint, total bigint, sources array<string>, counts array<bigint>"


def _flat(seen: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    """The held counts, one row per (language, term) with its sources."""
    for lang, by_source in seen.items():
        names = list(by_source)
        keys = pa.array([t for s in names for t in by_source[s]], pa.binary()).dictionary_encode()
        counts = np.array([n for s in names for n in by_source[s].values()], dtype=np.int64)
        source = np.repeat(np.arange(len(names)), [len(by_source[s]) for s in names])
        code = keys.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(keys.dictionary)))
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        found = keys.dictionary
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(found), pa.string()), found.cast(pa.string()),
            pa.array([docs[lang][t] for t in found.to_pylist()], pa.int64()),
            pa.array(np.add.reduceat(counts[order], first), pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(source[order]))),
            pa.ListArray.from_arrays(offsets, pa.array(counts[order]))], ["lang", "term", "docs", "total", "sources", "counts"])


def _count(batches):
    seen, docs, held = collections.defaultdict(dict), collections.defaultdict(collections.Counter), 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2)):
            group = seen[lang].get(source)
            if group is None:  # the empty term stands for the group itself
                group = seen[lang][source] = collections.Counter({b"": 0})
                docs[lang][b""] = 0
            words = terms(text.as_py())
            before = len(group)
            group.update(words)
            docs[lang].update(set(words))
            held += len(group) - before
            if held > HELD:
                yield from _flat(seen, docs)
                seen.clear(), docs.clear()
                held = 0
    yield from _flat(seen, docs)


def count_cells(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``lang, source, term, n, lang_n, first``: the nonzero counts of the kept
    terms, ``n`` in the group and ``lang_n`` in the language; ``first`` marks one
    row per (language, term).  Each group has one more row, with term ''."""
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    src = docs.select(*blank, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    key = Window.partitionBy("lang", "term")
    parts = (src.mapInArrow(_count, _COUNTS)
             .withColumn("docs", F.sum("docs").over(key)).withColumn("lang_n", F.sum("total").over(key))
             .where((F.col("docs") >= min_docs) | (F.col("term") == "")))
    cells = (parts.select("lang", "term", "lang_n", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
             .groupBy("lang", "term", F.col("c.sources").alias("source"))
             .agg(F.sum("c.counts").alias("n"), F.first("lang_n").alias("lang_n")))
    return cells.withColumn("first", (F.row_number().over(key.orderBy("source")) == 1) & (F.col("term") != ""))


def share(n: Column, total: Column, kept: Column) -> Column:
    return F.expr("1L") + F.call_function("div", F.lit(10**9).cast("decimal(38,0)") * (n + 2), total + 2 * kept)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


# ---------------------------------------------------------------- the tree

class QuadTree:
    """K-squared tree (K = 2) of the nonzero cells of a matrix of ``n_rows`` by
    ``n_cols``: per level one bit per quadrant, in the order of the parents that
    have one; the child of a set bit is found by its rank."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int):
        self.n_rows, self.n_cols = n_rows, n_cols
        self.height = max(int(max(n_rows, n_cols, 2) - 1).bit_length(), 1)
        code = np.zeros(len(rows), dtype=np.int64)  # quadrant digits from the root down
        for bit in range(self.height - 1, -1, -1):
            code = code * 4 + ((rows >> bit) & 1) * 2 + ((cols >> bit) & 1)
        #: where the value of a leaf stands in the input
        self.leaf = np.argsort(code, kind="stable")
        code = code[self.leaf]
        self.bits, self.rank = [], []
        parents = np.zeros(min(len(code), 1), dtype=np.int64)
        for level in range(self.height):
            nodes = np.unique(code >> 2 * (self.height - 1 - level))
            bits = np.zeros(4 * len(parents), dtype=bool)
            bits[4 * np.searchsorted(parents, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - 1)
            parents = nodes

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The node of a quadrant; -1 where it, or the node itself, is all zero."""
        if not len(self.bits[level]):
            return np.full(len(node), -1)
        at = np.where(node >= 0, 4 * node + quadrant, 0)
        return np.where((node >= 0) & self.bits[level][at], self.rank[level][at], -1)


def pair_values(tree: QuadTree, p: np.ndarray, p0: np.ndarray, split: int) -> np.ndarray:
    """``value[a, b]`` for rows a < b of the tree's matrix: the distances of all
    its columns summed; ``p`` holds the shares of the cells, ``p0`` a row's share
    of a term it lacks.  With ``split`` only pairs across that row are wanted."""
    n, leaf_p = tree.n_rows, p[tree.leaf]
    value = np.zeros((n, n), dtype=np.int64)
    zero = [np.zeros((-(-n >> s) if s else n,) * 2, dtype=np.int64) for s in range(tree.height, -1, -1)]
    root = 0 if len(p) else -1
    start = [np.zeros(1, dtype=np.int64) for _ in range(3)] + [np.full(1, root), np.full(1, root)]
    stack = [(0, start)] if root == 0 else []
    if root < 0:
        zero[0] += tree.n_cols
    while stack:
        level, front = stack.pop()
        if len(front[0]) > FRONT:
            half = len(front[0]) // 2
            stack += [(level, [x[:half] for x in front]), (level, [x[half:] for x in front])]
            continue
        ra, rb, c, na, nb = front
        shift = tree.height - 1 - level
        found = []
        for i, j, k in np.ndindex(2, 2, 2):
            a, b, col = 2 * ra + i, 2 * rb + j, 2 * c + k
            keep = (a <= b) & (b << shift < n) & (col << shift < tree.n_cols)
            if shift == 0:
                keep &= a < b
            if split:
                keep &= (a << shift < split) & ((b + 1) << shift > split)
            a, b, col = a[keep], b[keep], col[keep]
            x = tree.child(level, na[keep], np.int64(2 * i + k))
            y = tree.child(level, nb[keep], np.int64(2 * j + k))
            none = (x < 0) & (y < 0)  # uniform for every pair of the two row ranges: priced below
            width = np.minimum((col[none] + 1) << shift, tree.n_cols) - (col[none] << shift)
            np.add.at(zero[level + 1], (a[none], b[none]), width)
            found.append([v[~none] for v in (a, b, col, x, y)])
        front = [np.concatenate(v) for v in zip(*found)]
        if shift:
            if len(front[0]):
                stack.append((level + 1, front))
        else:
            a, b, _, x, y = front
            p_a, p_b = np.where(x >= 0, leaf_p[x], p0[a]), np.where(y >= 0, leaf_p[y], p0[b])
            np.add.at(value, (a, b), (p_a - p_b) ** 2 // (p_a + p_b))
    n_zero = zero[0]
    for layer in zero[1:]:
        n_zero = np.repeat(np.repeat(n_zero, 2, 0), 2, 1)[:len(layer), :len(layer)] + layer
    return value + n_zero * ((p0[:, None] - p0[None, :]) ** 2 // (p0[:, None] + p0[None, :]))


def _tile_pair(key, table):
    """One block of terms for one pair of tiles; rows without a term carry each
    group's share of the terms it lacks."""
    lang, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
    gid, p = table["gid"].to_numpy().astype(np.int64), table["p"].to_numpy().astype(np.int64)
    term = table["term"].combine_chunks().dictionary_encode()
    term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
    cell = table["is_cell"].to_numpy().astype(bool)
    groups = np.unique(gid)
    first, second = groups[groups // TILE == low], groups[groups // TILE == high]
    split = TILE if high > low else 0
    position = np.where(gid // TILE == low, gid - low * TILE, TILE + gid - high * TILE)
    n_rows = int(position.max()) + 1
    p0 = np.ones(n_rows, dtype=np.int64)
    p0[position[~cell]] = p[~cell]
    names, cols = np.unique(term.indices.to_numpy()[cell], return_inverse=True)
    value = pair_values(QuadTree(position[cell], cols.astype(np.int64), n_rows, len(names)), p[cell], p0, split)
    a, b = np.meshgrid(first, second if split else first, indexing="ij")
    a, b = a[a < b], b[a < b]
    at_b = b - high * TILE + split
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                     "value": pa.array(value[a - low * TILE, at_b], pa.int64()),
                     "covered": pa.array(np.full(len(a), len(names)), pa.int64())})


# ---------------------------------------------------------------- the audit

def audit_sources(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks the other
    sources of the language by distance, part ``term`` the ``top_terms`` kept
    terms that the source uses more than its language does."""
    cells = staged(count_cells(docs, min_docs), "divergence-cells")
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = cells.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("first").alias("kept"),
                                      F.count_if(F.col("term") == "").alias("n_groups"))
    numbered = groups.withColumn("gid", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint"))
    groups = staged(numbered.join(langs, "lang").withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0), F.col("n_group"), F.col("kept")))),
                    "divergence-groups")
    full = (cells.where("term <> ''").join(groups, ["lang", "source"])
            .withColumn("p", share(F.col("n"), F.col("n_group"), F.col("kept"))))

    q = share(F.col("lang_n"), F.col("n_lang"), F.col("kept"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = (full.withColumn("q", q).where("n > 0 and p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms))

    blocks = F.expr(f"greatest(1L, cast(ceil(kept / {BLOCK}) as bigint))")
    cols = ["lang", "gid", "n_groups", "block", "term", "p", "is_cell"]
    leaves = full.withColumn("block", F.pmod(F.xxhash64("term"), blocks)).withColumn("is_cell", F.lit(True)).select(cols)
    bare = (groups.where("kept > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
            .select("lang", "gid", "n_groups", "block", F.lit("").alias("term"), F.col("p0").alias("p"), F.lit(False).alias("is_cell")))
    tile = F.expr(f"gid div {TILE}")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_groups - 1) div {TILE}")))
    dealt = (leaves.unionByName(bare).withColumn("other", other)
             .select("lang", F.least(tile, "other").alias("low"), F.greatest(tile, "other").alias("high"), "block", "gid", "term", "p", "is_cell"))
    parts = (dealt.groupBy("lang", "low", "high", "block")
             .applyInArrow(_tile_pair, "lang string, a bigint, b bigint, value bigint, covered bigint")
             .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered")))
    both = parts.unionByName(parts.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "covered"))

    left = groups.select("lang", "source", F.col("gid").alias("a"), "kept", F.col("p0").alias("pa"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("p0").alias("pb"))
    pairs = (left.join(right, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.when(F.col("kept") > 0, F.coalesce("value", F.lit(0)) + (F.col("kept") - F.coalesce("covered", F.lit(0)))
                            * apart(F.col("pa"), F.col("pb"))).otherwise(F.lit(0)).cast("bigint").alias("value"))
             .withColumn("rank", F.row_number().over(by_value)))
    return pairs.unionByName(over)


#: the same by counting every kept term for every pair of sources
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
n_kept AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS ng,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS ln,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS nl, v
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN n_kept v ON v.lang = g.lang
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (ng + 2 * v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (ln + 2)) // (nl + 2 * v) AS BIGINT) AS q FROM cell),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
over_used AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over_used))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
