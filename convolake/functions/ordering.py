"""Row numbering inside groups of any size.

``row_number() over (partition by key order by …)`` sends a whole group to
one task; with a key holding a third of the data that task sorts a third of
the data.  :func:`row_number_within` gives the same numbers from a range
partitioned sort instead: the range partitioner splits a hot key over many
tasks, each task numbers its sorted slice, and a tiny table of per-(key,
slice) counts turns the local positions into global ones.

The sorted, id-stamped frame is written to the shared checkpoint folder before
it is used twice, so the range bounds (found by sampling) and the positions
cannot change if an executor is lost and a stage is recomputed.

An input that is known to fit in one task as a whole (``ONE_TASK_BYTES``) is
numbered by the plain window: the same numbers without the extra passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.sizing import estimated_bytes, source_bytes
from convolake.session import staged

#: by Catalyst's estimate, which for a table in files is their compressed size and
#: doesn't grow by ``inline``: a check of ``health_state_changes`` has a quarter
#: of a byte by it, and over 30 bytes in a window
ONE_TASK_BYTES = 1 << 20


def fits_one_task(df: DataFrame) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= ONE_TASK_BYTES


def sort_tasks(df: DataFrame) -> int:
    """Tasks for a sort of ``df``: they grow with its input in files, so that
    none of them does."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, 1 + (source_bytes(df) or 0) // ONE_TASK_BYTES)


def row_number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """``row_number()`` per ``keys`` in ``order`` (which must end with a unique
    column), computed without a per-key window over the data."""
    if num_partitions is None and fits_one_task(df):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    n = num_partitions or sort_tasks(df)
    sort = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    s = (df.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
         .withColumn("__pid", F.spark_partition_id())
         .withColumn("__mid", F.monotonically_increasing_id()))
    s = staged(s, "numbered")
    seg = s.groupBy(*keys, "__pid").agg(F.count("*").alias("__c"), F.min("__mid").alias("__m0"))
    w = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("__off", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    cond = F.col("__pid") == F.col("__p2")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    seg = seg.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__pid").alias("__p2"), "__off", "__m0")
    j = s.join(seg, cond, "inner")
    return (j.withColumn(out, F.col("__off") + (F.col("__mid") - F.col("__m0")) + 1)
            .drop("__pid", "__mid", "__p2", "__off", "__m0", *[f"__k_{k}" for k in keys]))
