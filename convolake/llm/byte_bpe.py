"""Byte-level BPE encoding and decoding with a segment tree (operator 5).

A piece (one match of the split pattern) is a row of byte positions.  A
segment tree over the positions keeps, in every node, the smallest pair rank
below it and the leftmost position that has it; the root therefore names the
next merge.  A merge changes three leaves (the merged position, its live left
neighbour and the position that goes), each a point update of log2(n) nodes.

Pieces that a worker has not met are encoded many at a time: the trees of all
pieces of one size class are the rows of one numpy array, and each step makes
the next merge of every piece that still has one.

Ranks come from a file of ``base64 rank`` lines.  Two adjacent tokens may be
merged if their bytes together are a token; its id is the rank of the pair.

Defined results: a null text counts as empty; an empty text has no ids;
repeated rows each get their result; an unknown byte cannot occur (each byte
is a token of its own, which is checked when the file is read).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import text_bytes

NO_RANK = np.int64(1) << 40
#: pieces that a worker remembers before it forgets the rare ones
CACHE_PIECES = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTreeBpe:
    """Encoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(merged, dtype=np.int64)[order]
        self._forget()

    # -- pairs -------------------------------------------------------------
    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NO_RANK where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((right >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], NO_RANK)

    # -- many pieces of one size class ---------------------------------------
    def _encode_rows(self, data: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces whose bytes stand one after the other in
        ``data``, and the ids of each; ``width`` is a power of two, at least
        their length."""
        n, levels = len(lengths), width.bit_length() - 1
        pos = np.arange(width)
        token = np.full((n, width), -1, dtype=np.int64)
        token[pos < lengths[:, None]] = self.byte_ids[data]
        following = np.where(pos + 1 < lengths[:, None], pos + 1, width)
        before = np.broadcast_to(pos - 1, (n, width)).copy()
        # leaves hold rank * width + position, so the minimum is leftmost too
        tree = np.full((n, 2 * width), NO_RANK * width, dtype=np.int64)
        rank = np.full((n, width), NO_RANK, dtype=np.int64)
        rank[:, :-1] = self._rank(np.maximum(token[:, :-1], 0), token[:, 1:])
        tree[:, width:] = rank * width + pos
        for level in range(levels - 1, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, 2 * a:2 * b:2], tree[:, 2 * a + 1:2 * b:2])

        def update(rows, at, value):
            node = at + width
            tree[rows, node] = value
            for _ in range(levels):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < NO_RANK * width)
        while len(live):
            root = tree[live, 1]
            at, new = root % width, root // width
            gone = following[live, at]
            after = following[live, gone]
            token[live, at] = new
            token[live, gone] = -1
            following[live, at] = after
            inner = after < width
            before[live[inner], after[inner]] = at[inner]
            right = np.where(inner, token[live, np.minimum(after, width - 1)], -1)
            update(live, gone, NO_RANK * width + gone)
            update(live, at, self._rank(new, right) * width + at)
            prev = before[live, at]
            has = prev >= 0
            rows, p = live[has], prev[has]
            update(rows, p, self._rank(token[rows, p], new[has]) * width + p)
            live = live[tree[live, 1] < NO_RANK * width]
        kept = token >= 0
        return token[kept].astype(np.uint32), kept.sum(axis=1)

    def _encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the pieces in the order in which they are encoded, the
        number of ids of each, and all ids."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        width = np.array([max(2, 1 << (k - 1).bit_length()) if k else 2 for k in range(int(lengths.max(initial=0)) + 1)])[lengths]
        order = np.argsort(width, kind="stable")
        sizes, ids = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint32)]
        edges = np.flatnonzero(np.diff(width[order], prepend=-1, append=-1)) if len(pieces) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            w = int(width[order[a]])
            step = max(1, 1 << 17 >> w.bit_length() - 2)  # bounds the array of trees
            for k in range(a, b, step):
                part = order[k:min(k + step, b)]
                data = np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), dtype=np.uint8)
                found, n = self._encode_rows(data, lengths[part], w)
                ids.append(found)
                sizes.append(n)
        return order, np.concatenate(sizes), np.concatenate(ids)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        order, sizes, ids = self._encode_many(pieces)
        out: list[np.ndarray] = [None] * len(pieces)
        ends = np.cumsum(sizes)
        for i, a, b in zip(order.tolist(), (ends - sizes).tolist(), ends.tolist()):
            out[i] = ids[a:b]
        return out

    # -- texts ----------------------------------------------------------------
    def _forget(self, least_uses: int = 1 << 40) -> None:
        """Keeps only the pieces that were used at least so often since then."""
        old = np.flatnonzero(self.uses >= least_uses) if hasattr(self, "uses") else np.empty(0, dtype=np.int64)
        if not len(old) or len(old) > CACHE_PIECES // 2:
            self.known: dict[str, int] = {}
            self.flat = np.empty(0, dtype=np.uint32)
            self.start, self.size, self.uses = (np.empty(0, dtype=np.int64) for _ in range(3))
            return
        pieces, size = list(self.known), self.size[old]
        self.flat = self.flat[_places(self.start[old], size)]
        self.start, self.size, self.uses = np.cumsum(size) - size, size, np.zeros(len(old), dtype=np.int64)
        self.known = {pieces[i]: k for k, i in enumerate(old.tolist())}

    def _learn(self, unseen: list[str]) -> None:
        order, sizes, ids = self._encode_many([p.encode() for p in unseen])
        self.known.update(zip([unseen[i] for i in order.tolist()], range(len(self.size), len(self.size) + len(unseen))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, ids])
        self.size = np.concatenate([self.size, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(unseen), dtype=np.int64)])

    def encode_texts(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, in order."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self._forget(least_uses=2)
        unseen = list(set(chain.from_iterable(split)).difference(self.known))
        if unseen:
            self._learn(unseen)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(map(len, split)))
        self.uses += np.bincount(at, minlength=len(self.uses))
        size = self.size[at]
        ids, upto = self.flat[_places(self.start[at], size)], np.concatenate([[0], np.cumsum(size)])
        end = np.cumsum([0, *map(len, split)])
        for a, b in zip(upto[end[:-1]].tolist(), upto[end[1:]].tolist()):
            yield ids[a:b]


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Every place of the runs of ``size`` places from ``start``."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))


_ENCODERS: dict[tuple[str, str], SegmentTreeBpe] = {}


def encoder(path: str, pattern: str) -> SegmentTreeBpe:
    """One encoder per worker process and file."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = SegmentTreeBpe(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


_TOKENS: dict[str, dict[int, bytes]] = {}


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id, all that decoding needs; one table per worker process and file."""
    if path not in _TOKENS:
        _TOKENS[path] = {i: t for t, i in read_ranks(path).items()}
    return _TOKENS[path]


def in_slices(columns: list[list], weight: list[int], limit: int = 1_000_000) -> Iterator[slice]:
    """Slices of about ``limit`` bytes each, so that a batch of long texts is
    handled in bounded memory."""
    begin, held = 0, 0
    for i, w in enumerate(weight):
        held += w
        if held >= limit:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(weight):
        yield slice(begin, len(weight))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens`` and ``ids`` (the ids as
    little-endian unsigned 32-bit integers)."""

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in in_slices([], [len(t) for t in texts]):
                found = list(bpe.encode_texts([t.decode() for t in texts[part]]))
                yield pa.RecordBatch.from_arrays(
                    [ids[part], pa.array([len(x) for x in found], pa.int64()),
                     pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())], ["id", "n_tokens", "ids"])

    src = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The bytes of each row of ``encode_documents``, beside its columns."""

    def run(batches):
        known = token_bytes(path)
        for batch in batches:
            ids = batch.column(2).to_pylist()
            for part in in_slices([], [len(x) for x in ids]):
                texts = [b"".join(map(known.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in ids[part]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], batch.column(2)[part],
                                                  pa.array(texts, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    src = encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids")
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes the ids and returns digests of both."""
    both = decode_documents(encode_documents(docs, path, pattern, id_col, text_col), path, id_col)
    return both.select(id_col, "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
