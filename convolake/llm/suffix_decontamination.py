"""Benchmark decontamination with training suffix arrays (operator 7).

The training texts of a task are read as shards of a bounded number of words.
For each shard a suffix array over its word stream is built (prefix doubling),
then every suffix of every benchmark item is binary-searched in it, one word
deeper at a time.  What is left at depth d is the range of all training
positions where the suffix's first d words occur; the deepest non-empty range
is its longest verbatim match.  Suffix arrays of different shards are
independent, so nothing is shuffled and a lost task is simply run again.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
case.  A window is ``window`` consecutive words of an item; an item with fewer
words, but not none, is one window.  A training word inside any occurrence of
a window is hit.

Training words that no item has cannot be part of a match; only runs of item
words that are long enough for the shortest window enter the suffix array.
This drops nothing: an occurrence lies wholly inside one such run.

The benchmark is read in chunks of at most ``chunk_words`` words (a bound on
what a task holds); each chunk is one pass over the training texts, and the
hits of all passes are united.

Defined results: null or wordless texts have no words and are clean; null or
wordless items are not searched; items that repeat (same or other id) are all
reported; an empty benchmark leaves every document clean; a null item_id is
searched and marks words, but has no name in the list of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import staged, text_bytes

WINDOW = 10
SHARD_WORDS = 1_000_000
CHUNK_WORDS = 4_000_000
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def suffix_array(stream: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` words (at least)."""
    order = np.argsort(stream, kind="stable")
    rank = np.empty(len(stream), dtype=np.int64)
    sorted_words = stream[order]
    rank[order] = np.cumsum(np.concatenate([[0], sorted_words[1:] != sorted_words[:-1]]))
    have = 1
    while have < depth and len(stream) and rank[order[-1]] < len(stream) - 1:
        then = np.full(len(stream), 0, dtype=np.int64)
        then[:-have] = rank[have:] + 1
        key = rank * (len(stream) + 1) + then
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        rank = np.empty(len(stream), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_keys[1:] != sorted_keys[:-1]]))
        have *= 2
    return order


class Benchmark:
    """The words of one chunk of items as numbers; what tasks search for."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        self.names: list[str | None] = []
        self.vocab: dict[bytes, int] = {}
        stream: list[int] = []
        starts, sizes = [], []
        for name, text in items:
            found = words_of(text)
            if found:
                self.names.append(name)
                starts.append(len(stream))
                sizes.append(len(found))
                stream.extend(self.vocab.setdefault(w, len(self.vocab) + 1) for w in found)
        self.stream = np.array(stream, dtype=np.int64)
        size = np.array(sizes, dtype=np.int64)
        self.suffix_item = np.repeat(np.arange(len(sizes)), size)
        self.suffix_left = np.repeat(np.array(starts, dtype=np.int64) + size, size) - np.arange(len(stream))
        need = np.minimum(size, window)  # words of a window of this item
        self.need = np.repeat(need, size)
        self.shortest = int(need.min()) if len(sizes) else 0
        self.longest = int(size.max()) if len(sizes) else 0


class Shard:
    """Documents whose word streams make up one suffix array."""

    def __init__(self, bench: Benchmark):
        self.bench = bench
        self.n_words: list[int] = []
        self.parts: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.held = 0

    def add(self, text: bytes) -> None:
        found = words_of(text)
        self.n_words.append(len(found))
        if len(found) < max(1, self.bench.shortest):
            return
        ids = np.fromiter((self.bench.vocab.get(w, 0) for w in found), dtype=np.int64, count=len(found))
        known = np.concatenate([[0], ids > 0, [0]])
        edges = np.flatnonzero(np.diff(known))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= self.bench.shortest
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            self.parts += [ids[a:b], np.zeros(1, dtype=np.int64)]  # 0 ends a run
            self.owners.append(np.full(b - a + 1, len(self.n_words) - 1))
            self.places.append(np.arange(a, b + 1))
            self.held += b - a + 1

    def search(self) -> tuple[list[np.ndarray], list[set[int]], np.ndarray]:
        """Per document: positions of the words hit, numbers of the items
        found, words of the longest match."""
        n = len(self.n_words)
        none = np.empty(0, dtype=np.int64)
        hits, items, longest = [none] * n, [set() for _ in range(n)], np.zeros(n, dtype=np.int64)
        if not self.parts:
            return hits, items, longest
        bench = self.bench
        stream, owner = np.concatenate(self.parts), np.concatenate(self.owners)
        place = np.concatenate(self.places)
        order = suffix_array(stream, bench.longest)
        padded = np.concatenate([stream, np.zeros(bench.longest + 1, dtype=np.int64)])
        mark = np.zeros(len(stream) + 1, dtype=np.int64)
        live = np.arange(len(bench.stream))
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(stream), dtype=np.int64)
        depth = 0
        while len(live):
            live_left = bench.suffix_left[live] > depth
            live, low, high = live[live_left], low[live_left], high[live_left]
            if not len(live):
                break
            wanted = bench.stream[live + depth]
            low, high = (self._bound(padded, order, depth, low, high, wanted + k) for k in (0, 1))
            found = high > low
            live, low, high = live[found], low[found], high[found]
            depth += 1
            whole = bench.need[live] == depth  # a window ends here
            for suffix, a, b in zip(live[whole].tolist(), low[whole].tolist(), high[whole].tolist()):
                at = order[a:b]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + depth, -1)
                for d in np.unique(owner[at]).tolist():
                    items[d].add(int(bench.suffix_item[suffix]))
            deep = bench.need[live] <= depth
            for a, b in zip(low[deep].tolist(), high[deep].tolist()):
                longest[owner[order[a:b]]] = depth
        covered = np.cumsum(mark[:-1]) > 0
        where, who = place[covered], owner[covered]
        edges = np.searchsorted(who, np.arange(n + 1))  # owners ascend
        for d in np.unique(who).tolist():
            hits[d] = where[edges[d]:edges[d + 1]]
        return hits, items, longest

    @staticmethod
    def _bound(padded, order, depth, low, high, wanted):
        """First rank in [low, high) whose word at ``depth`` is >= wanted."""
        a, b = low.copy(), high.copy()
        open_ = a < b
        while open_.any():
            mid = (a + b) >> 1
            less = padded[order[np.minimum(mid, len(order) - 1)] + depth] < wanted
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
            open_ = a < b
        return a


def _chunks(items: DataFrame, item_id: str, item_text: str, words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in lists of at most ``words`` words (one longer item: alone)."""
    rows = items.select(F.col(item_id).cast("string"), text_bytes(item_text))
    chunk, held = [], 0
    for name, text in rows.toLocalIterator():
        size = len(words_of(bytes(text)))
        if not size:
            continue
        if chunk and held + size > words:
            yield chunk
            chunk, held = [], 0
        chunk.append((name, bytes(text)))
        held += size
    if chunk:
        yield chunk


_SCHEMA = "n_words bigint, hit binary, items array<string>, longest_match bigint"


def _pass(src: DataFrame, chunk: list[tuple[str | None, bytes]], window: int, shard_words: int, id_type: str, text_type: str) -> DataFrame:
    """One pass of a chunk of items over ``id, text, n_words, hit, items,
    longest_match``; adds what this chunk hits to what earlier ones did."""

    def run(batches):
        bench = Benchmark(chunk, window)

        def flush(rows, shard):
            hits, items, longest = shard.search()
            hit, found, most = [], [], []
            for i, (_, _, old_hit, old_items, old_longest) in enumerate(rows):
                at = np.union1d(np.frombuffer(old_hit, dtype="<i8"), hits[i]) if old_hit else hits[i]
                hit.append(at.astype("<i8").tobytes())
                found.append(sorted({*old_items, *(x for x in (bench.names[k] for k in items[i]) if x is not None)}))
                most.append(max(old_longest, int(longest[i])))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], ids_type), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array(shard.n_words, pa.int64()), pa.array(hit, pa.binary()),
                 pa.array(found, pa.list_(pa.string())), pa.array(most, pa.int64())],
                ["id", "t", "n_words", "hit", "items", "longest_match"])

        rows, shard, ids_type = [], Shard(bench), None
        held = 0
        for batch in batches:
            ids_type = batch.schema.field(0).type
            cols = [batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)]
            for row in zip(*cols):
                rows.append(row)
                shard.add(row[1])
                held += len(row[1])
                if shard.held >= shard_words or held >= 48_000_000:
                    yield flush(rows, shard)
                    rows, shard, held = [], Shard(bench), 0
        if rows:
            yield flush(rows, shard)

    return src.mapInArrow(run, f"id {id_type}, t {text_type}, {_SCHEMA}")


def find_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``items`` (sorted ids of the items
    that have an occurring window), ``longest_match`` (words) and ``hit``
    (positions of the words hit, little-endian 64-bit)."""
    src = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"), F.lit(0).cast("bigint").alias("n_words"),
                      F.lit(b"").alias("hit"), F.array().cast("array<string>").alias("items"),
                      F.lit(0).cast("bigint").alias("longest_match"))
    id_type = src.schema["id"].dataType.simpleString()
    done, first = None, True
    for chunk in _chunks(items, item_id, item_text, chunk_words):
        if done is not None:
            src = staged(done, "suffix-pass")
        done, first = _pass(src, chunk, window, shard_words, id_type, "binary"), False
    if first:
        done = _pass(src, [], window, shard_words, id_type, "binary")
    return done.select(F.col("id").alias(id_col), "n_words", (F.octet_length("hit") / 8).cast("bigint").alias("n_hit"),
                       "items", "longest_match", "hit")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``find_matches`` with counts and a digest in place of the lists."""
    found = find_matches(docs, items, **options)
    id_col = options.get("id_col", "doc_id")
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "longest_match")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without a hit word, with all their columns.  A row whose
    id is null is judged by its text like any other."""
    rows = docs.withColumn("__llm_key", F.struct(F.col(id_col), F.xxhash64(text_bytes(text_col))))
    found = find_matches(rows.select(F.col("__llm_key").alias("k"), F.col(text_col).alias("t")), items,
                         id_col="k", text_col="t", **options)
    bad = staged(found.where("n_hit > 0").select(F.col("k").alias("__llm_bad")).distinct(), "contaminated")
    return rows.join(bad, F.col("__llm_key").eqNullSafe(F.col("__llm_bad")), "left_anti").drop("__llm_key")
