"""Order MinHash fingerprints (operator 1), in DataFrame functions only.

The k-mers are runs of ``K`` words (split at ASCII blanks); a text with fewer
words, but not none, is one k-mer.  Each k-mer is numbered by its occurrence in
the text, so repeats count.  Every (k-mer, occurrence) pair is hashed once; the
hash deals it to one of ``SAMPLES`` samples and ranks it there (one permutation
serves all samples).  A sample keeps its ``TUPLE`` minimal pairs, puts them
back into text order and hashes the k-mers in that order.  Two texts agree in a
sample if they have the same minimal k-mers in the same order, which moving a
passage breaks as well as editing one: likeness follows edit similarity.

A fingerprint is a string of ``SAMPLES`` groups of four hex digits; ``----``
stands for a sample that no pair fell into (short texts).  The likeness of two
fingerprints is the share of equal samples among those that either text has;
two fingerprints without any are alike (1.0).

Within a row everything is linear but two sorts of 64-bit integers: k-mer
hashes are packed with their places and sorted, which puts occurrences side by
side in text order.

Neighbours in id order: ids are cut into ranges at quantiles of the ids; the
first row of a range is also sent to the range above it, so that ``lead`` over
a range sees its successor and the text is shuffled once.

Defined results: a null text counts as empty; empty texts have the fingerprint
without samples; an empty text edited stays empty and alike (1.0); rows with
equal ids follow each other by text; null ids come last; with one row the next
document is the row itself; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import shuffle_partitions

K = 2
SAMPLES = 64
TUPLE = 2
_BLANKS = " \t\n\x0b\x0c\r"


def _right(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, bits)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def with_samples(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array of ``SAMPLES`` values from 0 to 65535, or -1.

    Packed integers hold a hash in their upper 32 bits and the place of the
    k-mer in the lower ones; the six top bits below the sign (after the second
    hash) are the sample.  An array that a lambda reads is named there at least
    twice: the optimizer then keeps it as a column and doesn't put the
    expression that makes it into the lambda.
    """
    w, s, r, e, m, t = (f"__{out}_{x}" for x in "wsremt")
    col = F.col
    keep = [c for c in df.columns if c != out]
    upper, place, no_longs = F.lit(-1 << 32), F.lit((1 << 32) - 1), F.array().cast("array<bigint>")

    def kmer(i):  # a k-mer beyond the end has nulls, which the hash leaves out
        return F.xxhash64(F.get(col(w), i), *(F.get(col(w), i + k) for k in range(1, K)))

    # (hash of the k-mer | place), sorted: occurrences stand together, in text order
    d = df.select(*keep, _words(col(text)).alias(w))
    d = d.select(*keep, w, F.when(F.size(w) == 0, no_longs).otherwise(F.sort_array(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0))), lambda i: kmer(i).bitwiseAND(upper).bitwiseOR(i)))).alias(s))
    # where the occurrences of each k-mer begin, and the end
    n = F.size(s)
    begins = F.filter(F.sequence(F.lit(1), n - 1), lambda i: _right(F.get(col(s), i).bitwiseXOR(F.get(col(s), i - 1)), 32) != 0)
    d = d.select(*keep, w, s, F.when(n == 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(0), F.lit(1)))
                 .otherwise(F.concat(F.array(F.lit(0)), begins, F.array(n))).alias(r))

    # hash of (k-mer, occurrence) | place, sorted by sample and rank
    def packed(v, occurrence):
        return F.xxhash64(_right(v, 32), occurrence).bitwiseAND(F.lit(0x7FFFFFFF << 32)).bitwiseOR(v.bitwiseAND(place))

    def run(begin, k):
        size = F.get(col(r), k + 1) - begin
        return F.when(size == 1, F.array(packed(F.get(col(s), begin), F.lit(0)))) \
            .otherwise(F.transform(F.slice(col(s), begin + 1, size), packed))

    heads = F.slice(col(r), 1, F.greatest(F.size(r) - 1, F.lit(0)))
    d = d.select(*keep, w, F.sort_array(F.flatten(F.transform(heads, run))).alias(e))
    # the minimal pairs of each sample: those whose sample is not that of the pair TUPLE places before
    other = lambda x, y: F.coalesce(_right(x.bitwiseXOR(y), 57) != 0, F.lit(True))
    d = d.select(*keep, w, F.filter(col(e), lambda x, i: other(x, F.get(col(e), i - TUPLE)) | F.get(col(e), i - TUPLE).isNull()).alias(m))

    def tuple_hash(i):
        here, after = F.get(col(m), i), F.get(col(m), i + 1)
        one, two = here.bitwiseAND(place).cast("int"), F.when(~other(here, after), after.bitwiseAND(place).cast("int"))
        return F.when(two < one, F.xxhash64(kmer(two), kmer(one))).when(two.isNull(), F.xxhash64(kmer(one))).otherwise(F.xxhash64(kmer(one), kmer(two)))

    firsts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: other(F.get(col(m), i), F.get(col(m), i - 1)))
    d = d.select(*keep, w, m, F.when(F.size(m) == 0, F.array().cast("array<int>")).otherwise(firsts).alias(t))
    values = F.map_from_arrays(F.transform(col(t), lambda i: _right(F.get(col(m), i), 57)),
                               F.transform(col(t), lambda i: tuple_hash(i).bitwiseAND(F.lit(0xFFFF)).cast("int")))
    d = d.select(*keep, values.alias(f"{out}_map"))
    # named twice, so that the optimizer keeps the map as a column of its own
    found = col(f"{out}_map")
    return d.select(*keep, F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.when(
        F.map_contains_key(found, i.cast("bigint")), F.element_at(found, i.cast("bigint"))).otherwise(-1)).alias(out))


def fingerprint(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.when(x < 0, "----").otherwise(F.lpad(F.lower(F.hex(x)), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x >= 0) | (y >= 0)), lambda x: x))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x >= 0) & (x == y)), lambda x: x))
    return F.when(either == 0, 1.0).otherwise(equal / either)


def _ranges(keys: DataFrame, n: int) -> list[int]:
    """At most ``n`` ids (ascending, the largest among them) that cut the ids
    into ranges of about equal size."""
    found = keys.agg(F.percentile_approx("k", [(i + 1) / n for i in range(n)], 20 * max(n, 500)).alias("q")).collect()[0].q
    return sorted(set(found or []))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``t``, ``next_t`` (the next row's text in descending id order,
    after the last the first's), beside ``r`` and ``place``, which order the
    rows: a window over ``r`` by ``place`` needs no further shuffle.  Rows
    whose ``own`` is false are copies for that purpose."""
    null_key = -(1 << 63)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(null_key)).alias("k"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    cuts = _ranges(rows.select("k"), 4 * shuffle_partitions(docs.sparkSession))
    if not cuts:
        return rows.select("id", "t", F.lit("").alias("next_t"), F.lit(0).alias("r"), F.lit(True).alias("own"),
                           F.struct(F.lit(0).alias("wrap"), F.col("k"), F.lit(0).cast("bigint").alias("x")).alias("place"))
    # range of k: how many cuts are below it; a coarse list first, then a part of the fine one
    step = max(1, int(len(cuts) ** 0.5))
    fine = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    coarse = F.from_json(F.lit(json.dumps(cuts[::step])), "array<bigint>")
    blocks = F.size(F.filter(coarse, lambda c: c < F.col("k")))
    first = F.greatest(blocks - 1, F.lit(0)) * step
    rows = rows.withColumn("r", first + F.size(F.filter(F.slice(fine, first + 1, step), lambda c: c < F.col("k"))))
    # a cut is the largest id of its range, i.e. the first one in descending order
    is_cut = F.array_contains(F.slice(fine, F.col("r") + 1, 1), F.col("k"))
    top = len(cuts) - 1
    copies = F.when(is_cut, F.array(F.struct(F.col("r"), F.lit(0).alias("wrap"), F.lit(True).alias("own")),
                                    F.struct(F.when(F.col("r") == top, 0).otherwise(F.col("r") + 1).alias("r"),
                                             F.when(F.col("r") == top, 1).otherwise(0).alias("wrap"), F.lit(False).alias("own")))) \
        .otherwise(F.array(F.struct(F.col("r"), F.lit(0).alias("wrap"), F.lit(True).alias("own"))))
    rows = rows.withColumn("c", F.explode(copies)).select(
        "id", "t", F.col("c.r").alias("r"), F.col("c.own").alias("own"),
        F.struct(F.col("c.wrap").alias("wrap"), (-F.col("k").cast("decimal(20,0)")).alias("k"), F.xxhash64("t").alias("x")).alias("place"))
    return rows.withColumn("next_t", F.lead("t").over(Window.partitionBy("r").orderBy("place", "own")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    d = with_next_text(docs, id_col, text_col)
    d = d.withColumn("n_chars", F.char_length("t").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.left(F.col("t"), F.col("n_chars").cast("int") - half), F.left(F.coalesce("next_t", F.lit("")), half)))
    d = with_samples(d.drop("next_t"), "t", "own_s").drop("t")
    d = with_samples(d, "edited", "edited_s")
    d = d.withColumn("next_s", F.lead("own_s").over(Window.partitionBy("r").orderBy("place", "own"))).where("own")
    return d.select(F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    fingerprint(F.col("own_s")).alias("fingerprint"), fingerprint(F.col("edited_s")).alias("edited_fingerprint"),
                    likeness(F.col("own_s"), F.col("edited_s")).alias("near_edited"),
                    likeness(F.col("own_s"), F.col("next_s")).alias("near_next"))
