"""Broadcast only what is proven small.

``broadcast_if_small`` is applied to *parameter tables* (prices, units,
patterns, taxonomies, lexicons): it reads Catalyst's size estimate of the
optimized plan and only adds the broadcast hint when the estimate is
below the bound.  Above the bound the join is left to the planner
(sort-merge / shuffled hash with AQE), so a parameter table that grows
with the data can never blow up executor memory.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Hard bound for hinted broadcasts (bytes, Catalyst estimate).
BROADCAST_LIMIT = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for the optimized plan (no job is run)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - Connect sessions have no _jdf
        return None


def source_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the tables that ``df`` reads, without what it
    makes of joins; null if one is not known."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    except Exception:  # pragma: no cover - Connect sessions have no _jdf
        return None
    return sum(sizes) if all(size < 1 << 60 for size in sizes) else None


def broadcast_if_small(df: DataFrame, what: str = "side",
                       limit: int = BROADCAST_LIMIT) -> DataFrame:
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    log.info("not broadcasting %s: estimate %s > %s", what, size, limit)
    return df


def param_table(spark, rows, schema: str) -> DataFrame:
    """A small parameter table built from literals.

    ``inline(array(struct(lit…)))`` over a one-row range gives Catalyst a
    plan with a tiny known size (a plain Python list would become an RDD
    scan of unknown size, which no size check could let through to a
    broadcast) and does not depend on Arrow settings of the session."""
    from pyspark.sql.types import StructType
    st = StructType.fromDDL(schema)
    rows = list(rows)
    if not rows:
        return spark.createDataFrame([], st)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
