"""Small column helpers shared by the operators.

Rounding is half away from zero everywhere (quirk Q10): doubles are cast
to a wide decimal before ``round`` so the result does not depend on the
binary representation of the input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without blanks at both ends (what ``\\s`` matches), in linear time."""
    return F.btrim(_c(c), F.lit(" \t\n\x0b\f\r"))


def round_half_up(c, scale: int) -> Column:
    """Round to ``scale`` decimals, half away from zero, as double."""
    return F.round(_c(c).cast("decimal(38,10)"), scale).cast("double")


def round_int(c) -> Column:
    """Round to the nearest integer, half away from zero, as int."""
    return F.round(_c(c).cast("decimal(38,10)"), 0).cast("int")


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null."""
    d = _c(den)
    return F.when(d != 0, _c(num) / d)


def pct(num, den, scale: int) -> Column:
    """Percentage num/den·100 rounded half up; null when den is 0."""
    return round_half_up(safe_div(_c(num) * F.lit(100.0), den), scale)


def word_count(c) -> Column:
    """Whitespace word count, equal to Python's ``len(s.split())``."""
    return F.regexp_count(_c(c), F.lit(r"(?U)\S+"))


def trunc_ts(unit: str, c) -> Column:
    """``date_trunc`` that keeps a wall-clock (NTZ) timestamp.

    ``date_trunc`` returns a session-zone timestamp; casting back to NTZ
    undoes the zone shift so results do not depend on the session zone.
    """
    return F.date_trunc(unit, _c(c)).cast("timestamp_ntz")


def with_distinct_counts(base, df, by, counts: dict):
    """Join exact ``count(DISTINCT expr)`` columns onto ``base`` (one row per
    ``by`` group) without Spark's Expand rewrite.

    Several distinct aggregates in one ``agg`` make Spark replicate every
    input row once per distinct expression before the shuffle.  Here each
    distinct count is its own two-step aggregate – (group, value) pairs
    first, map-side combined, then a count per group – so only distinct
    pairs are shuffled.  Nulls are not counted, as in ``count(DISTINCT)``.
    """
    by = list(by)
    for alias, expr in counts.items():
        pairs = df.select(*by, expr.alias("__v")).where(F.col("__v").isNotNull()).distinct()
        if not by:
            base = base.withColumn(alias, pairs.select(F.count("*")).scalar())
            continue
        d = pairs.groupBy(*by).agg(F.count("*").alias(alias))
        d = d.select(*[F.col(b).alias(f"__b_{b}") for b in by], alias)
        cond = None
        for b in by:
            c = F.col(b).eqNullSafe(F.col(f"__b_{b}"))
            cond = c if cond is None else cond & c
        base = (base.join(d, cond, "left").drop(*[f"__b_{b}" for b in by])
                .withColumn(alias, F.coalesce(F.col(alias), F.lit(0)).cast("bigint")))
    return base
