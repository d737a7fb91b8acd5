"""Running values along sorted groups of any size.

A window over a key sorts the whole key in one task.  Here the rows of a key are
numbered by a range-partitioned sort (:func:`row_number_within`) and cut into
blocks of at most ``size`` rows; windows run inside blocks, and what a block
needs from those before it comes from a summary with one row per block, joined
to the rows by (key, block), where they stand already.  A key with a third of
all rows is thus many blocks in many tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.ordering import fits_one_task, row_number_within, sort_tasks

NUMBER, BLOCK = "__n", "__block"


class Blocks:
    """``rows``: the input with its number in its key (from 1) and its block."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int = 1 << 16):
        self.keys, self.whole = list(keys), Window.partitionBy(*keys)
        #: the whole input fits in a task, so a key needs no carry between blocks
        self.small = fits_one_task(df)
        self.order = list(order)
        numbered = row_number_within(df, keys, order, NUMBER)
        self.rows = numbered.withColumn(BLOCK, F.floor((F.col(NUMBER) - 1) / size))
        if not self.small:  # as many tasks for the windows as for the numbers
            self.rows = self.rows.repartition(sort_tasks(df), *keys, BLOCK)
        self.first = F.col(NUMBER) == F.col(BLOCK) * size + 1
        #: rows of a block in order
        self.inside = Window.partitionBy(*self.keys, BLOCK).orderBy(NUMBER)
        #: blocks of a key in order
        self.along = Window.partitionBy(*self.keys).orderBy(BLOCK)

    def summary(self, *aggregates: Column) -> DataFrame:
        """One row per block."""
        return self.rows.groupBy(*self.keys, BLOCK).agg(*aggregates)

    def attach(self, rows: DataFrame, summary: DataFrame, *columns: str) -> DataFrame:
        """``columns`` of a row's block beside ``rows`` (null keys are one key)."""
        right = summary.select(*[F.col(k).alias(f"__k_{k}") for k in self.keys], F.col(BLOCK).alias("__b"), *columns)
        same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in self.keys]
        joined = rows.join(right, functools.reduce(lambda a, b: a & b, same, F.col(BLOCK) == F.col("__b")), "left")
        return joined.drop("__b", *[f"__k_{k}" for k in self.keys])

    def previous(self, rows: DataFrame, value: Column, out: str, summary: dict[str, Column] | None = None,
                 carried: dict[str, Column] | None = None) -> DataFrame:
        """The value of the row before (null for the first of a key) as ``out``;
        ``summary`` aggregates of blocks, and ``carried`` columns made of them
        over ``whole`` or ``along``, go with the same join."""
        summary, carried = summary or {}, carried or {}
        if self.small:
            rows = rows.withColumn(out, F.lag(value).over(self.whole.orderBy(*self.order)))
            return rows.select("*", *[c.over(self.whole).alias(a) for a, c in summary.items()]).select("*", *[c.alias(a) for a, c in carried.items()])
        ends = self.summary(F.max_by(value, NUMBER).alias("__end"), *[c.alias(a) for a, c in summary.items()])
        ends = ends.select("*", F.lag("__end").over(self.along).alias("__before"), *[c.alias(a) for a, c in carried.items()])
        joined = self.attach(rows.withColumn("__within", F.lag(value).over(self.inside)), ends, "__before", *summary, *carried)
        return joined.withColumn(out, F.when(self.first, F.col("__before")).otherwise(F.col("__within"))).drop("__before", "__within")

    def drop(self, rows: DataFrame) -> DataFrame:
        return rows.drop(NUMBER, BLOCK)


#: exponents of e that a double holds with room to spare
_REACH = 600.0


def decayed_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, decay: float, out: str,
                size: int = 1 << 16) -> DataFrame:
    """``s = decay · s + value`` along each key, from 0, for every row.

    A prefix scan over (decay, value) pairs in closed form: inside a block, s at
    the p-th value is ``decay^p · Σ value_j · decay^-j``, a running sum.  Blocks
    are short enough that no power leaves the range of a double, whatever
    ``decay`` in [0, 1] is.  Block ends are composed in the same way inside
    stretches of ``_REACH`` powers of e; what lies more than one stretch back weighs
    less than 1e-260 and is left out.  A null value leaves s as it is, without
    decay."""
    if decay == 0:  # nothing is carried but over nulls
        blocks = Blocks(df, keys, order, size)
        x = blocks.rows.withColumn("__v", value.cast("double"))
        ends = blocks.summary(F.max_by(value.cast("double"), F.when(value.isNotNull(), F.col(NUMBER))).alias("__end"))
        ends = ends.withColumn("__carry", F.last("__end", True).over(blocks.along.rowsBetween(Window.unboundedPreceding, -1)))
        x = blocks.attach(x.withColumn("__last", F.last("__v", True).over(blocks.inside)), ends, "__carry")
        return blocks.drop(x.withColumn(out, F.coalesce("__last", "__carry", F.lit(0.0))).drop("__v", "__last", "__carry"))
    rate = -math.log(decay)
    blocks = Blocks(df, keys, order, max(1, min(size, int(_REACH / rate) if rate else size)))
    power = lambda n: F.exp(n * F.lit(-rate))
    run = blocks.inside.rowsBetween(Window.unboundedPreceding, 0)
    x = blocks.rows.withColumn("__v", value.cast("double")).withColumn("__p", F.count("__v").over(run))
    x = x.withColumn("__s", F.coalesce(F.sum(F.col("__v") * power(-F.col("__p"))).over(run), F.lit(0.0)) * power(F.col("__p")))
    # per block: its own end, and how many values it and all before it have
    ends = (x.groupBy(*blocks.keys, BLOCK).agg(F.max_by("__s", NUMBER).alias("__end"), F.max("__p").alias("__len"))
            .withColumn("__upto", F.sum("__len").over(blocks.along.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("__stretch", F.floor(F.col("__upto") * F.lit(rate / _REACH))))
    in_stretch = Window.partitionBy(*blocks.keys, "__stretch").orderBy(BLOCK)
    ends = ends.withColumn("__base", F.min("__upto").over(in_stretch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.withColumn("__own", F.sum(F.col("__end") * power(F.col("__base") - F.col("__upto"))).over(in_stretch) * power(F.col("__upto") - F.col("__base")))
    stretches = (ends.groupBy(*blocks.keys, "__stretch").agg(F.max_by("__own", BLOCK).alias("__s_end"), F.max("__upto").alias("__s_upto"))
                 .withColumn("__next", F.lead("__stretch").over(Window.partitionBy(*blocks.keys).orderBy("__stretch"))))
    before = stretches.select(*[F.col(k).alias(f"__q_{k}") for k in blocks.keys], F.col("__next").alias("__to"), "__s_end", "__s_upto").where("__next is not null")
    same = [F.col(k).eqNullSafe(F.col(f"__q_{k}")) for k in blocks.keys]
    ends = ends.join(before, functools.reduce(lambda a, b: a & b, same, F.col("__stretch") == F.col("__to")), "left")
    total = F.col("__own") + F.coalesce(F.col("__s_end") * power(F.col("__upto") - F.col("__s_upto")), F.lit(0.0))
    ends = ends.withColumn("__carry", F.coalesce(F.lag(total).over(blocks.along), F.lit(0.0)))
    y = blocks.attach(x, ends, "__carry")
    return blocks.drop(y.withColumn(out, F.col("__s") + F.col("__carry") * power(F.col("__p"))).drop("__v", "__p", "__s", "__carry"))
