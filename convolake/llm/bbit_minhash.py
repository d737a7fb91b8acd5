"""MinHash near-duplicates with b-bit signatures (operator 2).

A document's set holds its distinct shingles of ``SHINGLE`` words; with fewer
words the whole sequence is one shingle; without words it is empty and linked
with nothing.  Two documents are linked if 100 |A & B| >= 75 |A | B|.

1.  Per document: shingle hashes, ``PERMUTATIONS`` minima, the low ``BITS``
    bits of each minimum packed into eight 64-bit integers, and one key per
    band of ``ROWS`` minima.
2.  Documents with equal word sequences form a class, named by its smallest
    doc_id.  Everything below works on classes, so groups of exact copies of
    any size cost one class.
3.  Each band bucket links its members to its smallest member only (a star,
    never all pairs).  A candidate goes on if its similarity as estimated from
    bit counts, corrected for chance collisions of ``BITS``-bit values, is not
    hopelessly low (``MARGIN`` below the limit, five standard
    deviations) and its parities allow it: a set has ``PARITIES`` bits, each
    the parity of the shingles that hash there.  Every shingle that only one
    of two sets has flips one bit, so more unequal bits than the limit allows
    unequal shingles rule a pair out for certain.  What is left is confirmed
    on the full sets.
4.  Links give components.  A bucket whose members then lie in more than one
    component is not settled.  If at most ``SMALL`` members are outside its
    largest component, each of those is compared with all members of other
    components.  Otherwise the bucket is cut into finer ones by a second band
    key, up to ``CUTS`` times; what is still mixed then makes its outside
    members centres in turns, until each has been one.  Hence no link between
    different texts is lost to a group's size.

Defined results: null text counts as empty; ``kept`` is doc_id = component_id;
rows that share a doc_id count as one document (each row gets its result); a
null doc_id has a null component and is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from convolake.llm.common import staged, text_bytes
from convolake.llm.components import components

SHINGLE = 5
PERMUTATIONS, ROWS, BITS = 128, 4, 4
BANDS = PERMUTATIONS // ROWS
WORDS = PERMUTATIONS * BITS // 64
PARITIES = 1024
PARITY_WORDS = PARITIES // 64
#: percent of the union, as integers so that the test is exact
LIMIT = 75
MARGIN = 0.2
#: members outside the largest component up to which they are compared at once
SMALL = 512
#: times that a bucket with more of them is cut into finer ones
CUTS = 2

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, in order."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = _mix(np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    s = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        s = _mix(s * _STEP + h[i:i + n])
    return np.unique(s)


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(PERMUTATIONS, ~np.uint64(0))
    for a in range(0, len(shingles), 4096):
        best = np.minimum(best, (shingles[a:a + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return best


def packed(minimum: np.ndarray) -> np.ndarray:
    """The low bits of the minima, ``64 // BITS`` to an integer."""
    low = (_mix(minimum) & np.uint64((1 << BITS) - 1)).reshape(WORDS, -1)
    return (low << (np.arange(low.shape[1], dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(minimum: np.ndarray) -> np.ndarray:
    rows = minimum.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * _STEP + rows[:, i])
    return key.view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of ``PARITIES`` hashed places."""
    odd = np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: columns of a document's signature: minima and parities
_SIGN = [*(f"s{k}" for k in range(WORDS)), *(f"p{k}" for k in range(PARITY_WORDS))]


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            kept, sizes, classes, signs, bands = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.lower().split()
                s = shingle_hashes(words)
                kept.append(i)
                sizes.append(len(s))
                classes.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                m = minima(s)
                signs.append(packed(m).tobytes() + parities(s).tobytes())
                bands.append(band_keys(m))
            keys = np.frombuffer(b"".join(classes), dtype="<i8").reshape(-1, 2)
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, dtype=np.int64), pa.int64())
            sign = np.frombuffer(b"".join(signs), dtype="<i8").reshape(-1, len(_SIGN))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys[:, 0], pa.int64()), pa.array(keys[:, 1], pa.int64()),
                 *(pa.array(sign[:, k], pa.int64()) for k in range(len(_SIGN))),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), flat)],
                ["id", "n_shingles", "k1", "k2", *_SIGN, "bands"])

    signs = ", ".join(f"{k} bigint" for k in _SIGN)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("t"))
    return src.mapInArrow(run, f"id bigint, n_shingles bigint, k1 bigint, k2 bigint, {signs}, bands array<bigint>")


def estimated_similarity(left: str, right: str) -> Column:
    """Share of equal ``BITS``-bit values from bit counts, with the share
    that unequal minima reach by chance taken out."""
    ones = int("1" * (64 // BITS), 2 ** BITS) if BITS > 1 else -1
    unequal = F.lit(0)
    for k in range(WORDS):
        x = F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))
        shift = 1
        while shift < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 2.0 ** -BITS
    return (1 - unequal / float(PERMUTATIONS) - chance) / (1 - chance)


def _sign() -> Column:
    return F.struct(F.col("n_shingles").alias("n"), *_SIGN)


def _possible(left: str, right: str) -> Column:
    """Holds for every similar pair whose estimate is not far off."""
    unequal = F.lit(0)
    for k in range(PARITY_WORDS):
        unequal = unequal + F.bit_count(F.col(f"{left}.p{k}").bitwiseXOR(F.col(f"{right}.p{k}")))
    allowed = (F.col(f"{left}.n") + F.col(f"{right}.n")) * (100 - LIMIT)
    return (estimated_similarity(left, right) >= LIMIT / 100 - MARGIN) & (unequal * (100 + LIMIT) <= allowed)


def _similar(pairs: DataFrame, signs: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs ``(a, b)`` that the full sets confirm."""
    one = signs.select(F.col("id").alias("a"), _sign().alias("l"))
    two = signs.select(F.col("id").alias("b"), _sign().alias("r"))
    near = pairs.join(one, "a").join(two, "b").where(_possible("l", "r")).select("a", "b")
    near = staged(near, "near-pairs")

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sets: dict[bytes, np.ndarray] = {}
            keep = []
            for x, y in zip(left, right):
                if len(sets) > 256:
                    sets.clear()
                for t in (x, y):
                    if t not in sets:
                        sets[t] = shingle_hashes(t.lower().split())
                p, q = sets[x], sets[y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(both) and 100 * both >= LIMIT * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    full = near.join(texts.select(F.col("id").alias("a"), F.col("t").alias("x")), "a") \
        .join(texts.select(F.col("id").alias("b"), F.col("t").alias("y")), "b")
    return staged(full.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "links")


def _buckets(members: DataFrame) -> DataFrame:
    """Members ``(key, id)`` of buckets with at least two, with ``centre``
    (the smallest id) and ``n``."""
    size = members.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1")
    return staged(members.join(staged(size, "bucket-sizes"), "key"), "buckets")


def _unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with the
    component ``c`` and ``others``: members outside the bucket's largest."""
    own = buckets.select("key", "id").join(labels.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    own = staged(own, "bucket-labels")
    sizes = own.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key") \
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top")).where("n > top.n")
    sizes = staged(sizes.select("key", F.col("top.c").alias("top"), (F.col("n") - F.col("top.n")).alias("others")), "mixed-buckets")
    return staged(own.join(sizes, "key"), "unsettled")


def _across(members: DataFrame, signs: DataFrame, centres: Column) -> DataFrame:
    """Pairs of a member outside its bucket's largest component for which
    ``centres`` holds with every member of another component; pairs that are
    hopelessly unlike don't leave the join."""
    members = staged(members.join(signs.select("id", _sign().alias("sign")), "id"), "signed-members")
    one = members.where((F.col("c") != F.col("top")) & centres).select("key", F.col("id").alias("x"), F.col("c").alias("cx"), F.col("sign").alias("l"))
    two = members.select("key", F.col("id").alias("y"), F.col("c").alias("cy"), F.col("sign").alias("r"))
    return one.join(two, "key").where((F.col("cx") != F.col("cy")) & _possible("l", "r")) \
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id``, ``kept``."""
    signed = staged(_signatures(docs, id_col, text_col), "signatures")
    classes = staged(signed.where("id is not null and n_shingles > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")
    reps = signed.join(classes.select("k1", "k2", F.col("rep").alias("id")), ["k1", "k2", "id"], "left_semi").dropDuplicates(["k1", "k2"])
    reps = staged(reps.drop("k1", "k2"), "class-signatures")
    buckets = _buckets(reps.select(F.explode("bands").alias("key"), "id"))
    candidates = buckets.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("t"))
    texts = staged(texts.join(candidates, "id", "left_semi").dropDuplicates(["id"]), "candidate-texts")

    def star(members):
        pairs = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        return _similar(pairs, reps, texts)

    links = star(buckets)
    labels = staged(components(links), "labels")
    for cut in range(CUTS + 1):
        open_ = _unsettled(buckets, labels)
        more = _similar(_across(open_.where(F.col("others") <= SMALL), reps, F.lit(True)), reps, texts)
        many = open_.where(F.col("others") > SMALL)
        last = many.isEmpty()
        if not last and cut < CUTS:  # finer buckets: this key with every other band key
            finer = many.select("key", "id").join(reps.select("id", F.explode("bands").alias("band")), "id").where("key <> band") \
                .select(F.xxhash64(F.least("key", "band"), F.greatest("key", "band")).alias("key"), "id").distinct()
            buckets = _buckets(finer)
            more = more.unionByName(star(buckets))
        links = staged(links.unionByName(more).distinct(), "links")
        labels = staged(components(links), "labels")
        if last:
            break
    else:  # large buckets to the end: every member outside the largest component is a centre once
        rounds = many.agg(F.max(F.ceil(F.col("others") / SMALL))).collect()[0][0]
        for k in range(rounds):
            turn = F.pmod(F.xxhash64("id"), F.ceil(F.col("others") / SMALL)) == k
            now = many.drop("c").join(labels.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
            links = staged(links.unionByName(_similar(_across(now, reps, turn), reps, texts)).distinct(), "links")
            labels = staged(components(links), "labels")
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    named = staged(named, "class-components")
    out = signed.select("id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns; rows that repeat an
    id are one document, of which one row stays (rows without id all stay)."""
    gone = duplicate_components(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__llm_gone")).distinct()
    left = docs.join(staged(gone, "duplicates"), F.col(id_col) == F.col("__llm_gone"), "left_anti")
    return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(left.where(F.col(id_col).isNull()))
