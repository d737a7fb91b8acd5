"""Interaction analytics: derivation, validation, cost, rollups (SURVEY §2
ops 10-12, 22, 25-28, 45, 47-52).

All inputs follow the ``interactions`` schema (FIXTURES §1).  Nothing here
collects; every aggregate is a map-side-combined ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.columns import pct, round_half_up, round_int, safe_div, trunc_ts
from convolake.functions.ordering import row_number_within
from convolake.functions.sizing import broadcast_if_small
from convolake.functions.skew import salted_join

SYSTEMS = ("fast", "deep")


def derive_interaction(df: DataFrame) -> DataFrame:
    """Op 10: total latency default and training-candidate flag (Q4)."""
    return (df
            .withColumn("total_latency_ms",
                        F.coalesce(F.col("total_latency_ms"),
                                   F.col("fast_latency_ms") + F.coalesce(F.col("deep_latency_ms"), F.lit(0))))
            .withColumn("is_training_candidate",
                        (F.col("system_used") == "deep") & ~F.coalesce(F.col("error_occurred"), F.lit(False))))


def interaction_cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Op 11: tokens × per-token price of the system used, DECIMAL(10,6).

    ``prices`` (system_used, in_price, out_price) is a parameter table,
    broadcast after its size is checked; unknown systems get a null cost.
    """
    p = broadcast_if_small(prices.select("system_used", "in_price", "out_price"), "prices")
    cost = (F.col("input_tokens").cast("decimal(12,0)") * F.col("in_price")
            + F.col("output_tokens").cast("decimal(12,0)") * F.col("out_price"))
    return (df.join(p, "system_used", "left")
            .withColumn("estimated_cost_usd", cost.cast("decimal(10,6)"))
            .drop("in_price", "out_price"))


def reject_reason() -> Column:
    """First violated constraint of the interactions table (null = valid)."""
    return (F.when(F.col("session_id").isNull(), "session_id is null")
            .when(F.col("skill_id").isNull(), "skill_id is null")
            .when(F.col("user_input").isNull(), "user_input is null")
            .when(F.col("agent_response").isNull(), "agent_response is null")
            .when(~F.col("system_used").isin(*SYSTEMS), "system_used not in (fast, deep)")
            .when(~F.col("user_feedback").between(1, 5), "user_feedback not in 1..5"))


def validate_interactions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Op 12: apply the table's CHECK / NOT NULL constraints.

    Returns ``(ok, rejected)``; ``rejected`` carries ``reject_reason``.  A
    CHECK on a null value passes, as in SQL.
    """
    tagged = df.withColumn("reject_reason", reject_reason())
    ok = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.where(F.col("reject_reason").isNotNull())
    return ok, bad


def throughput_metrics(df: DataFrame, tokens: str = "output_tokens",
                       ms: str = "total_latency_ms") -> DataFrame:
    """Op 22: tokens per second (1 dp); null unless tokens > 0 and ms > 0."""
    ok = (F.col(tokens) > 0) & (F.col(ms) > 0)
    return df.withColumn("tokens_per_sec",
                         F.when(ok, round_half_up(F.col(tokens) / F.col(ms) * 1000.0, 1)))


def monthly_cost_projection(df: DataFrame, unit_cost: DataFrame) -> DataFrame:
    """Op 25: per-skill monthly projection from the *observed* system split.

    ``unit_cost`` (system_used, per_call decimal).  calls/day is measured
    as calls over distinct active days of the skill; the saving is against
    sending every call to the deep system.
    """
    fast_c = unit_cost.where(F.col("system_used") == "fast").select("per_call").scalar()
    deep_c = unit_cost.where(F.col("system_used") == "deep").select("per_call").scalar()
    x = (df.groupBy("skill_id")
         .agg(F.count_if(F.col("system_used") == "fast").alias("n_fast"),
              F.count_if(F.col("system_used") == "deep").alias("n_deep"),
              F.count("*").alias("n_calls"),
              F.countDistinct(F.to_date("created_at")).alias("days_observed"))
         .withColumn("fast_per_call", fast_c).withColumn("deep_per_call", deep_c))
    s1 = (F.col("n_fast") * 30).cast("decimal(20,0)") / F.col("days_observed")
    s2 = (F.col("n_deep") * 30).cast("decimal(20,0)") / F.col("days_observed")
    cpm = (F.col("n_calls") * 30).cast("decimal(20,0)") / F.col("days_observed")
    x = x.select(
        "skill_id", "days_observed",
        F.floor(cpm).cast("bigint").alias("calls_per_month"),
        F.floor(s1).cast("bigint").alias("system1_calls"),
        F.floor(s2).cast("bigint").alias("system2_calls"),
        (s1 * F.col("fast_per_call")).alias("_c1"),
        (s2 * F.col("deep_per_call")).alias("_c2"),
        (cpm * F.col("deep_per_call")).alias("_all"),
    )
    total = F.col("_c1") + F.col("_c2")
    return x.select(
        "skill_id", "days_observed", "calls_per_month", "system1_calls", "system2_calls",
        F.round(F.col("_c1"), 2).cast("decimal(20,2)").alias("system1_cost"),
        F.round(F.col("_c2"), 2).cast("decimal(20,2)").alias("system2_cost"),
        F.round(total, 2).cast("decimal(20,2)").alias("total_cost"),
        F.round(F.col("_all"), 2).cast("decimal(20,2)").alias("all_deep_cost"),
        F.round(F.col("_all") - total, 2).cast("decimal(20,2)").alias("savings"),
        F.when(F.col("_all") > 0,
               F.round((F.col("_all") - total) * 100 / F.col("_all"), 1).cast("double"))
         .alias("savings_percentage"),
    )


def training_candidates(df: DataFrame, min_rating: int = 4) -> DataFrame:
    """Op 26: the ``training_candidates`` view – deep, well rated, no error,
    not yet exported; best first."""
    return _candidates(df, min_rating).orderBy(F.desc("user_feedback"), F.desc("created_at"), "id")


def _candidates(df: DataFrame, min_rating: int) -> DataFrame:
    return (df.where((F.col("system_used") == "deep") & (F.col("user_feedback") >= min_rating)
                     & (F.col("error_occurred") == F.lit(False))
                     & (F.col("exported_for_training") == F.lit(False)))
            .select("id", "skill_id", "user_input", "agent_response", "user_feedback", "created_at"))


def export_candidates(df: DataFrame, min_rating: int = 4, limit_per_skill: int | None = None,
                      skill: str | None = None) -> DataFrame:
    """Op 27: export pairs per skill, keeping ids (Q20).

    All pairs, unless a caller takes batches of ``limit_per_skill``; the order
    inside a skill is explicit (best rating, newest, id) so a batch is stable.
    A batch is cut task by task before the skills meet; the whole export is
    numbered over ranges, so that a hot skill is spread over many tasks.
    """
    c = _candidates(df, min_rating)
    if skill is not None:
        c = c.where(F.col("skill_id") == skill)
    order = [F.desc("user_feedback"), F.desc("created_at"), F.asc("id")]
    if limit_per_skill is not None:
        w = Window.partitionBy("skill_id").orderBy(*order)
        ranked = c.withColumn("rank_in_skill", F.row_number().over(w)).where(F.col("rank_in_skill") <= limit_per_skill)
    else:
        ranked = row_number_within(c, ["skill_id"], order, "rank_in_skill").withColumn("rank_in_skill", F.col("rank_in_skill").cast("int"))
    return (ranked
            .select("id", "skill_id", F.col("user_input").alias("prompt"),
                    F.col("agent_response").alias("completion"), "user_feedback", "rank_in_skill"))


def mark_exported(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Op 28: set ``exported_for_training`` for an id set in one join.

    The id set can be as large as the table, so no broadcast is forced –
    AQE turns the join into a broadcast only when the set is small at run
    time.
    """
    hit = ids.select(F.col(id_col).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    out = df.join(hit, df[id_col] == hit["__id"], "left")
    return (out.withColumn("exported_for_training",
                           F.coalesce(F.col("__hit"), F.lit(False)) | F.col("exported_for_training"))
            .drop("__id", "__hit"))


def session_feedback(interactions: DataFrame, feedback: DataFrame, salt_buckets: int | None = None) -> DataFrame:
    """Op 45: a session rating applies to all interactions of the session.

    ``feedback`` (session_id, rating, ts): ratings outside 1..5 are rejected;
    the latest valid rating per session wins.  Feedback is reduced to one
    row per session before the join (map-side partial aggregation), so a hot
    session cannot multiply rows; AQE splits a skewed left side, and
    ``salt_buckets`` spreads a hot session explicitly (salted join).
    """
    latest = (feedback.where(F.col("rating").between(1, 5))
              .groupBy("session_id")
              .agg(F.max_by(F.col("rating"), F.struct("ts", "rating")).alias("__rating")))
    if salt_buckets:
        out = salted_join(interactions, latest, ["session_id"], "left", salt_buckets)
    else:
        out = interactions.join(latest, "session_id", "left")
    rated = F.col("__rating").isNotNull()
    return (out.withColumn("user_feedback", F.when(rated, F.col("__rating").cast("int"))
                           .otherwise(F.col("user_feedback")))
            .withColumn("call_completed", F.when(rated, F.lit(True)).otherwise(F.col("call_completed")))
            .drop("__rating"))


def hourly_metrics(df: DataFrame, since=None) -> DataFrame:
    """Op 47 (flagship): per-hour calls, split by system, rounded average
    latency, errors and cost.

    ``since`` (timestamp or Column) restricts the recompute window; it is
    aligned down to the hour (Q1) so no bucket is recomputed from a part of
    its rows.
    """
    if since is not None:
        s = since if isinstance(since, Column) else F.lit(since).cast("timestamp_ntz")
        df = df.where(F.col("created_at") >= trunc_ts("hour", s))
    return (df.groupBy(trunc_ts("hour", "created_at").alias("hour_bucket"))
            .agg(F.count("*").alias("total_calls"),
                 F.count_if(F.col("system_used") == "fast").alias("system1_calls"),
                 F.count_if(F.col("system_used") == "deep").alias("system2_calls"),
                 round_int(F.avg("total_latency_ms")).alias("avg_latency_ms"),
                 F.count_if(F.col("error_occurred")).alias("error_count"),
                 F.sum("estimated_cost_usd").cast("decimal(18,4)").alias("total_cost_usd")))


def dashboard_metrics(df: DataFrame, as_of=None, windows_hours: Sequence[int] = (24,)) -> DataFrame:
    """Op 48: one row per trailing window ending at ``as_of`` (Q2, Q11).

    ``as_of`` defaults to the newest ``created_at`` of the input (a one-row
    aggregate).  All windows are computed in a single scan with conditional
    aggregates, then unpivoted.  Shares divide by all rows of the window;
    the latency average counts missing latencies as 0 (reference rule).
    """
    anchor = (df.agg(F.max("created_at")).scalar() if as_of is None
              else F.lit(as_of).cast("timestamp_ntz"))
    x = df.withColumn("__as_of", anchor)  # scalar subquery, evaluated once
    aggs = [F.max("__as_of").alias("__as_of")]
    for h in windows_hours:
        inw = F.col("created_at") >= F.col("__as_of") - F.expr(f"INTERVAL {int(h)} HOURS")
        aggs += [
            F.count_if(inw).alias(f"n_{h}"),
            F.count_if(inw & (F.col("system_used") == "fast")).alias(f"f_{h}"),
            F.count_if(inw & F.col("error_occurred")).alias(f"e_{h}"),
            F.sum(F.when(inw, F.coalesce(F.col("total_latency_ms"), F.lit(0)))).alias(f"l_{h}"),
            F.sum(F.when(inw, F.col("estimated_cost_usd"))).alias(f"c_{h}"),
        ]
    g = x.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(int(h)).alias("window_hours"),
                              F.col(f"n_{h}").alias("n"), F.col(f"f_{h}").alias("f"),
                              F.col(f"e_{h}").alias("e"), F.col(f"l_{h}").alias("l"),
                              F.col(f"c_{h}").alias("c")) for h in windows_hours])
    r = g.select(F.col("__as_of").alias("as_of"), F.inline(rows))
    return r.select(
        "as_of", "window_hours",
        F.col("n").alias("total_calls"),
        pct("f", "n", 1).alias("system1_percentage"),
        F.col("f").alias("system1_count"),
        (F.col("n") - F.col("f")).alias("system2_count"),
        round_int(safe_div(F.col("l"), F.col("n"))).alias("avg_latency_ms"),
        pct("e", "n", 2).alias("error_rate"),
        F.coalesce(F.col("c"), F.lit(0)).cast("decimal(18,6)").alias("cost_usd"),
    )


def calls_by_skill(df: DataFrame) -> DataFrame:
    """Op 49: calls per skill, missing skill reported as ``unknown``."""
    return (df.groupBy(F.coalesce(F.col("skill_id"), F.lit("unknown")).alias("skill_id"))
            .agg(F.count("*").alias("calls")))


def recent_errors(df: DataFrame, n: int = 5) -> DataFrame:
    """Op 50: the newest ``n`` errors (explicit order, id breaks ties)."""
    return (df.where(F.col("error_occurred"))
            .select("id", "created_at", "skill_id", "system_used", "error_message")
            .orderBy(F.desc("created_at"), F.desc("id")).limit(n))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str,
                      ps: Sequence[float] = (0.5, 0.99), prefix: str = "p") -> DataFrame:
    """Exact linear-interpolated percentiles without buffering a group.

    Values are first counted per (group, value) – a map-side combined
    aggregate whose size is bounded by the value domain, not by the row
    count – then a running count over the distinct values locates the two
    order statistics around ``p·(n−1)``.  A hot group therefore never has to
    hold its raw rows in one task.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    h = (h.withColumn("__cum", F.sum("__c").over(w))
         .withColumn("__n", F.sum("__c").over(Window.partitionBy(*by))))
    aggs = []
    for i, p in enumerate(ps):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.min(F.when(F.col("__cum") > lo, F.col(value))).alias(f"__lo{i}"),
                 F.min(F.when(F.col("__cum") > hi, F.col(value))).alias(f"__hi{i}"),
                 F.first(pos - lo).alias(f"__fr{i}")]
    g = h.groupBy(*by).agg(*aggs, F.first("__n").alias("n"))
    out = [F.col(b) for b in by] + [F.col("n")]
    for i, p in enumerate(ps):
        name = f"{prefix}{int(round(p * 100))}"
        lo, hi, fr = F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__fr{i}")
        out.append(round_half_up(lo + (hi - lo) * fr, 3).alias(name))
    return g.select(*out)


def band_percentiles(df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float] = (0.5, 0.99),
                     accuracy: int = 10000, prefix: str = "p") -> DataFrame:
    """Exact percentiles for continuous values in two passes, no group held
    whole.

    Pass 1: ``percentile_approx`` gives, per group, values bracketing each
    wanted rank with a margin of three times the sketch's rank error
    (1/accuracy of the group size).  Pass 2: per group, count the values
    below the lower bracket and collect only the values inside the bracket
    (about 6/accuracy of the group), then pick the exact order statistics
    from that sorted band.  A group whose band misses its ranks (the sketch
    bound failed) gets null.
    """
    eps = 3.0 / accuracy
    bands = [(max(0.0, p - eps), min(1.0, p + eps)) for p in ps]
    qs = sorted({q for b in bands for q in b})
    g = (df.where(F.col(value).isNotNull()).groupBy(*by)
         .agg(F.count(value).alias("__n"), F.percentile_approx(value, qs, accuracy).alias("__q")))
    g = g.select(*[F.col(b).alias(f"__g_{b}") for b in by], "__n", "__q")
    g = broadcast_if_small(g, "percentile brackets")
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__g_{b}"))
    x = df.where(F.col(value).isNotNull()).join(g, cond, "inner")
    aggs = [F.first("__n").alias("n")]
    for i, (lo_q, hi_q) in enumerate(bands):
        lo, hi = F.col("__q")[qs.index(lo_q)], F.col("__q")[qs.index(hi_q)]
        aggs += [F.count_if(F.col(value) < lo).alias(f"__below{i}"),
                 F.array_sort(F.collect_list(F.when(F.col(value).between(lo, hi), F.col(value)))).alias(f"__band{i}"),
                 # the nearest value on each side extends the band by one rank
                 F.max(F.when(F.col(value) < lo, F.col(value))).alias(f"__prev{i}"),
                 F.min(F.when(F.col(value) > hi, F.col(value))).alias(f"__next{i}")]
    r = x.groupBy(*[F.col(f"__g_{b}").alias(b) for b in by]).agg(*aggs)
    out = [F.col(b) for b in by] + [F.col("n")]
    for i, p in enumerate(ps):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        k_lo, k_hi = F.floor(pos), F.ceil(pos)
        prev, nxt = F.col(f"__prev{i}"), F.col(f"__next{i}")
        band = F.concat(F.array_compact(F.array(prev)), F.col(f"__band{i}"), F.array_compact(F.array(nxt)))
        below = F.col(f"__below{i}") - F.when(prev.isNotNull(), 1).otherwise(0)
        v_lo = F.try_element_at(band, (k_lo - below + 1).cast("int"))
        v_hi = F.try_element_at(band, (k_hi - below + 1).cast("int"))
        ok = (k_lo >= below) & (k_hi - below < F.size(band))
        out.append(F.when(ok, round_half_up(v_lo + (v_hi - v_lo) * (pos - k_lo), 3))
                   .alias(f"{prefix}{int(round(p * 100))}"))
    return r.select(*out)


def latency_percentiles(df: DataFrame, by: Sequence[str] = ("skill_id", "system_used"),
                        value: str = "total_latency_ms", exact: bool = True,
                        method: str = "histogram") -> DataFrame:
    """Op 51: P50 / P99 latency per group – exact (``histogram`` for a
    bounded value domain such as integer milliseconds, ``band`` for
    continuous values) or ``percentile_approx``."""
    if exact and method == "band":
        return band_percentiles(df, list(by), value, (0.5, 0.99))
    if exact:
        return exact_percentiles(df, list(by), value, (0.5, 0.99))
    return (df.groupBy(*by)
            .agg(F.count(value).alias("n"),
                 F.percentile_approx(value, 0.5, 10000).cast("double").alias("p50"),
                 F.percentile_approx(value, 0.99, 10000).cast("double").alias("p99")))


def routing_rollup(df: DataFrame) -> DataFrame:
    """Op 52: calls, errors and cost by (skill, system) with subtotals."""
    return (df.rollup("skill_id", "system_used")
            .agg(F.grouping_id().alias("grouping_level"),
                 F.count("*").alias("calls"),
                 F.count_if(F.col("error_occurred")).alias("errors"),
                 F.sum("estimated_cost_usd").cast("decimal(18,6)").alias("cost_usd")))
