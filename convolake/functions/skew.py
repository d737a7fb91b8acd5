"""Salted joins for hot keys.

AQE's skew-join handling splits oversized shuffle partitions at run time
and is the first line of defence.  When it is off, or when one key alone is
larger than what a task should hold, ``salted_join`` spreads the big side
of a key over ``buckets`` sub-keys (a deterministic hash of row columns, so
a retried task reproduces the same assignment) and replicates the matching
small-side rows once per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
                buckets: int = 16, salt_cols: Sequence[str] | None = None) -> DataFrame:
    """``big.join(small, keys, how)`` with the key space multiplied by
    ``buckets``.  ``how`` must keep big-side rows only once ("inner" or
    "left"); ``salt_cols`` (default: all big-side columns) feed the hash."""
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    cols = list(salt_cols or big.columns)
    b = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(buckets)).cast("int"))
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, [*keys, "__salt"], how).drop("__salt")
