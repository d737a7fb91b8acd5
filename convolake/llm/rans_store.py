"""Token-id files coded with a static range asymmetric numeral system (op 6).

Writing: texts are range-partitioned and sorted by id, tokenized, and cut into
blocks of whole documents (about ``block_ids`` ids).  One table of symbol
counts over all ids, normalised to ``2**SCALE_BITS``, is shared by all blocks.
Each block is coded independently by ``lanes`` interleaved coder states, so
that one numpy operation advances all lanes at once.  A block row holds:

* ``part``, ``first``: its partition and the ids before it there; ``doc_ids``, ``doc_sizes``: its documents;
* ``n_ids``, ``lanes``: how many ids, over how many lanes;
* ``payload``: 32-bit words in the order in which a decoder reads them;
* ``states``: the checkpoint, i.e. the lanes' states where decoding starts;
* ``crc``: crc32 of the ids as little-endian unsigned 32-bit integers.

Blocks decode in any order and on any machine: a block needs the shared table
and its own row only.  The files are two Parquet folders, ``blocks`` and
``symbols``, so any store that Spark reaches will do.

Defined results: a null text counts as empty and holds the end id only; rows
that repeat an id are all kept, in the order of their texts; null ids come
first; an empty table gives empty folders; one document longer than a block is
a block of its own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm.common import scratch_path, shuffle_partitions, staged
from convolake.session import small_batches

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
BLOCK_IDS = 1 << 17
LANES = 2048
CACHE_WORDS = 400_000
SLICE_CHARS = 1_000_000  # tokenized at once
LIBRARY_CALL = 4096  # words handed to the library at once
JOINED = 256  # of them, as one text
MARK = "\x01"  # stands between them; its id comes from no text without it
#: a pre-tokenizer that parts letters from punctuation, so that a mark behind a letter or digit and before a blank is a word by itself
PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: such a mark (RE2, which has no lookaround; the blank behind it can't belong to a second match)
LAST_MARK = r"([A-Za-z0-9À-ÖØ-öø-ÿ])([.,;:!?])( |\z)"

#: a normalizer that only lowers texts of printable ASCII and the letters of Latin-1 (no combining marks, no other blanks)
LOWERING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
BEYOND_LATIN_1 = r"[^ -~À-ÖØ-öø-ÿ]"
SMALL_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch


class WordCachedTokenizer:
    """ids of whole texts from the tokenizers library, which sees each
    distinct run of non-blank characters once, many of them in one text.  Only
    for vocabularies whose tokens never span a blank (the pre-tokenizer drops
    them).  Where it also parts letters from punctuation, a mark at a word's
    end is a word of its own, so that fewer words are new."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker on every core; threads of their own only cost each worker memory
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        settings = json.loads(self.library.to_str())
        steps = settings["pre_tokenizer"] or {}
        first = (steps.get("pretokenizers") or [steps])[0]
        self.parting = first.get("type") == "Split" and first["pattern"] == {"Regex": PARTING} and first["behavior"] == "Removed" and first["invert"]
        self.parting = self.parting and not any(set(x["content"]) & {*".,;:!?", MARK} for x in settings["added_tokens"])
        self.letters = None
        if self.parting and settings["normalizer"] == LOWERING and settings["model"].get("end_of_word_suffix"):
            # a word of small letters is one piece that the normalizer leaves as it is: the same model without these steps
            own = settings["pre_tokenizer"] | {"pretokenizers": [{"type": "WhitespaceSplit"}, *steps["pretokenizers"][1:]]}
            self.letters = Tokenizer.from_str(json.dumps(settings | {"normalizer": None, "pre_tokenizer": own}))
            # texts that may not be lowered first: an added token is found in the text as it came, in its own case only
            self.as_it_is = "|".join([BEYOND_LATIN_1, *(f"(?i:{re.escape(x['content'])})" for x in settings["added_tokens"])])
            suffix, vocabulary = settings["model"]["end_of_word_suffix"], self.library.get_vocab()
            self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
            self.closing[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if self.parting and len(mark) == 1 else None
        self._forget()

    def _forget(self, least_uses: int = 1 << 40) -> None:
        """Keeps only the words that were used at least so often since then."""
        old = np.flatnonzero(self.uses >= least_uses) if hasattr(self, "uses") else np.empty(0, dtype=np.int64)
        if len(old) > CACHE_WORDS // 2:
            old = old[:0]
        if not len(old):
            self.known, self.flat = {}, np.empty(0, dtype=np.uint32)
            self.start, self.size, self.uses = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
            return
        words, size = list(self.known), self.size[old]
        self.flat = self.flat[np.repeat(self.start[old] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self.start, self.size, self.uses = np.cumsum(size) - size, size, np.zeros(len(old), dtype=np.int32)
        self.known = {words[i]: k for k, i in enumerate(old.tolist())}

    def _library(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in some order, the number of ids of each, and all ids."""
        small = [w for w in words if SMALL_LETTERS(w)] if self.letters else []
        others = [w for w in words if not SMALL_LETTERS(w)] if self.letters else words
        alone = [w for w in others if self.mark is None or MARK in w]
        joined = [w for w in others if MARK not in w] if alone else others
        joined = [] if self.mark is None else joined
        plain = self._ids([" ".join(small[k:k + JOINED]) for k in range(0, len(small), JOINED)], self.letters)
        last = np.flatnonzero(self.closing[plain]) if small else np.empty(0, dtype=np.int64)
        ids = self._ids([f" {MARK} ".join([*joined[k:k + JOINED], ""]) for k in range(0, len(joined), JOINED)], self.library)  # a mark behind every word
        ends = np.flatnonzero(ids == self.mark) if joined else np.empty(0, dtype=np.int64)
        if len(ends) != len(joined) or len(last) != len(small):
            raise ValueError("the tokenizer merges words over blanks")
        own = [e.ids for e in self.library.encode_batch_fast(alone, add_special_tokens=False)]
        sizes = np.concatenate([np.diff(last, prepend=-1), np.diff(ends, prepend=-1) - 1, np.array([len(x) for x in own], dtype=np.int64)])
        return [*small, *joined, *alone], sizes, np.concatenate([plain, np.delete(ids, ends), np.array([i for x in own for i in x], dtype=np.uint32)])

    @staticmethod
    def _ids(texts: list[str], library) -> np.ndarray:
        found = library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return np.fromiter(chain.from_iterable(e.ids for e in found), dtype=np.uint32)

    def _add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, ids])
        self.size = np.concatenate([self.size, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), dtype=np.int32)])

    def encode(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text closed by ``end_id``, and the sizes."""
        if len(self.known) > CACHE_WORDS:
            self._forget(least_uses=2)
        if "\n" not in self.known:  # stands for the end of a text
            self._add(["\n"], np.ones(1, dtype=np.int64), np.array([end_id], dtype=np.uint32))
        lines = pc.replace_substring(pa.array(texts, pa.string()), "\n", " ")
        if self.parting:
            lines = pc.replace_substring_regex(lines, LAST_MARK, r"\1 \2\3")
        if self.letters:  # lower case may come before the rest where it and the other steps of the normalizer don't meet
            lines = pc.if_else(pc.match_substring_regex(lines, self.as_it_is), lines, pc.utf8_lower(lines))
        split = pc.split_pattern(lines, " ")
        words = split.flatten().dictionary_encode()  # a word is looked up once a call
        found = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        unseen = [w for w in found if w not in self.known]
        for k in range(0, len(unseen), LIBRARY_CALL):
            self._add(*self._library(unseen[k:k + LIBRARY_CALL]))
        place = np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts + 1)
        at = np.full(int(ends[-1]) if len(ends) else 0, self.known["\n"], dtype=np.int64)
        inner = np.ones(len(at), dtype=bool)
        inner[ends - 1] = False
        at[inner] = place[words.indices.to_numpy(zero_copy_only=False)]
        self.uses += np.bincount(at, minlength=len(self.uses)).astype(np.int32)
        size = self.size[at]
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (upto - size), size) + np.arange(int(size.sum()))]
        return ids, np.diff(upto[ends - 1], prepend=0)


_TOKENIZERS: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCachedTokenizer(path)
    return _TOKENIZERS[path]


def normalised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, at least 1 where a count is."""
    total, scale = counts.sum(), 1 << bits
    if not total:
        return np.zeros(len(counts), dtype=np.uint64)
    freq = np.where(counts > 0, np.maximum(1, counts * (scale / total)).astype(np.int64), 0)
    order = np.argsort(-freq, kind="stable")
    spare = scale - int(freq.sum())
    if spare >= 0:
        freq[order[0]] += spare
    for i in order:
        if spare >= 0:
            break
        cut = min(int(freq[i]) - 1, -spare)
        freq[i] -= cut
        spare += cut
    return freq.astype(np.uint64)


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int, bits: int = SCALE_BITS) -> tuple[bytes, bytes]:
    """(payload, states).  Id k belongs to lane k mod ``lanes``; ids are coded
    from the last to the first, the words are stored in reading order."""
    lanes = max(1, min(lanes, len(ids)))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    f_all, s_all = freq[ids], start[ids]
    shift, low_word = np.uint64(63 - bits), np.uint64(0xFFFFFFFF)
    for k in range(steps - 1, -1, -1):
        a, b = k * lanes, min((k + 1) * lanes, len(ids))
        f, s, x = f_all[a:b], s_all[a:b], state[:b - a]
        over = x >= f << shift
        words.append((x[over] & low_word).astype("<u4"))
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[:b - a] = (q << np.uint64(bits)) + (x - q * f) + s
    payload = np.concatenate(words[::-1]) if words else np.empty(0, dtype="<u4")
    return payload.tobytes(), state.astype("<u8").tobytes()


def decode_block(payload: bytes, states: bytes, n_ids: int, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    state, words = np.frombuffer(states, dtype="<u8").astype(np.uint64), np.frombuffer(payload, dtype="<u4")
    lanes, read = len(state), 0
    out = np.empty(n_ids, dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for a in range(0, n_ids, max(1, lanes)):
        b = min(a + lanes, n_ids)
        x = state[:b - a]
        slot = x & mask
        ids = slots[slot]
        out[a:b] = ids
        x = freq[ids] * (x >> np.uint64(bits)) + slot - start[ids]
        short = np.flatnonzero(x < LOW)
        x[short] = x[short] << np.uint64(32) | words[read:read + len(short)]
        read += len(short)
        state[:b - a] = x
    return out


_RAW = "part int, first bigint, doc_ids binary, doc_nulls binary, doc_sizes binary, n_ids bigint, ids binary"
_BLOCKS = "part int, first bigint, doc_ids binary, doc_nulls binary, doc_sizes binary, n_ids bigint, lanes int, payload binary, states binary, crc bigint"


def _tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, block_ids: int, width: str) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        coder, part, first = tokenizer(path), TaskContext.get().partitionId(), 0
        doc_ids, sizes, ids = [], [], []

        def row():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()),
                 "doc_ids": [np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes()],
                 "doc_nulls": [np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes()],
                 "doc_sizes": [np.concatenate(sizes).astype("<i8").tobytes()],
                 "n_ids": pa.array([len(flat)], pa.int64()), "ids": [flat.astype(width).tobytes()]})

        held = 0
        for batch in batches:
            names, chars = batch.column(0).to_pylist(), np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < len(names):
                end = int(np.searchsorted(chars, (chars[begin - 1] if begin else 0) + SLICE_CHARS)) + 1
                found, n = coder.encode(batch.column(1)[begin:end], end_id)
                upto, a = np.cumsum(n), 0
                while a < len(n):  # whole documents, until the block is full
                    before = int(upto[a - 1]) if a else 0
                    b = min(int(np.searchsorted(upto, before + block_ids - held)) + 1, len(n))
                    doc_ids += names[begin + a:begin + b]
                    sizes.append(n[a:b])
                    ids.append(found[before:int(upto[b - 1])])
                    held += int(upto[b - 1]) - before
                    a = b
                    if held >= block_ids:
                        yield row()
                        doc_ids, sizes, ids, held, first = [], [], [], 0, first + held
                begin = end
        if doc_ids:
            yield row()

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = shuffle_partitions(docs.sparkSession)
    ordered = src.repartitionByRange(n, F.col("id"), F.xxhash64("t")).sortWithinPartitions("id", "t")
    return ordered.mapInArrow(run, _RAW)


def _counts(raw: DataFrame, width: str) -> DataFrame:
    def run(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                found = np.bincount(np.frombuffer(ids, dtype=width))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), dtype=np.int64)])
                total[:len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["symbol", "n"])

    return raw.select("ids").mapInArrow(run, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                      block_ids: int = BLOCK_IDS, lanes: int = LANES, vocab_size: int = 1 << 16) -> None:
    """Writes ``folder/blocks`` and ``folder/symbols``."""
    spark = docs.sparkSession
    width = "<u2" if vocab_size <= 1 << 16 else "<u4"
    with small_batches(spark):
        raw = staged(_tokenized(docs, tokenizer_path, end_id, id_col, text_col, block_ids, width), "token-ids")
    found = _counts(raw, width).collect()  # bounded by the vocabulary
    counts = np.zeros(max([vocab_size, *(r.symbol + 1 for r in found)]), dtype=np.int64)
    for r in found:
        counts[r.symbol] = r.n
    freq = normalised(counts)
    at = np.flatnonzero(freq)
    symbols = [(int(len(freq)), at.astype("<u4").tobytes(), freq[at].astype("<u4").tobytes())]
    spark.createDataFrame(symbols, "vocab_size bigint, symbols binary, freqs binary").coalesce(1).write.parquet(f"{folder}/symbols")
    shared = spark.sparkContext.broadcast((freq, (np.cumsum(freq) - freq).astype(np.uint64)))  # 16 bytes a symbol

    def run(batches):
        f, s = shared.value
        for batch in batches:
            rows = batch.to_pydict()
            ids = [np.frombuffer(x, dtype=width) for x in rows.pop("ids")]
            coded = [encode_block(x, f, s, lanes) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(6)), pa.array([len(x[1]) // 8 for x in coded], pa.int32()),
                 pa.array([x[0] for x in coded], pa.binary()), pa.array([x[1] for x in coded], pa.binary()),
                 pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                ["part", "first", "doc_ids", "doc_nulls", "doc_sizes", "n_ids", "lanes", "payload", "states", "crc"])

    raw.mapInArrow(run, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document: id, ``start``, ``n_tokens``, ``ids_crc32`` and,
    unless ``with_ids`` is off, ``ids`` (little-endian unsigned 32-bit).
    A block whose checksum doesn't hold raises an error."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    head = spark.read.parquet(f"{folder}/symbols").collect()[0]
    freq = np.zeros(head.vocab_size, dtype=np.uint64)
    freq[np.frombuffer(head.symbols, dtype="<u4")] = np.frombuffer(head.freqs, dtype="<u4")
    # ids before each partition: a row per partition of the writer
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in parts:
        before[r.part], total = total, total + r.n
    shared = spark.sparkContext.broadcast((freq, before))

    def run(batches):
        f, before = shared.value
        s = (np.cumsum(f) - f).astype(np.uint64)
        slots = np.repeat(np.arange(len(f), dtype=np.uint32), f.astype(np.int64))
        for batch in batches:
            for part, first, doc_ids, nulls, sizes, n_ids, payload, states, crc in zip(*(batch.column(k).to_pylist() for k in range(9))):
                start = before[part] + first
                ids = decode_block(payload, states, n_ids, f, s, slots)
                data = memoryview(ids.astype("<u4").tobytes())
                if zlib.crc32(data) != crc:
                    raise ValueError(f"checksum of the block at id {start} does not hold")
                size = np.frombuffer(sizes, dtype="<i8")
                end = np.cumsum(size)
                cut = [data[4 * (b - n):4 * b] for b, n in zip(end.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(doc_ids, dtype="<i8"), pa.int64(), mask=np.frombuffer(nulls, dtype=np.uint8) > 0),
                     pa.array(start + end - size, pa.int64()), pa.array(size, pa.int64()),
                     pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                     pa.array([bytes(x) for x in cut] if with_ids else [None] * len(cut), pa.binary())],
                    ["id", "start", "n_tokens", "ids_crc32", "ids"])

    out = blocks.select("part", "first", "doc_ids", "doc_nulls", "doc_sizes", "n_ids", "payload", "states", "crc") \
        .mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    out = out.withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes the files into the shared folder and returns what they hold."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder, tokenizer_path, end_id, id_col, text_col, **options)
    return read_token_files(spark, folder, id_col, with_ids=False)
