"""Cross-table summaries and ordered per-key computations (SURVEY §2 ops
59, 61, 63, 70, 71)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.columns import pct, round_half_up, word_count
from convolake.functions.scan import decayed_sum
from convolake.functions.sizing import broadcast_if_small

# Data-quality tier thresholds (metric, tier, minimum, rank).
QUALITY_TIERS = [("examples", "Minimum", 10, 1), ("examples", "Recommended", 50, 2), ("examples", "Excellent", 500, 3),
                 ("avg_tokens", "Minimum", 50, 1), ("avg_tokens", "Recommended", 200, 2),
                 ("avg_tokens", "Excellent", 1000, 3),
                 ("topics", "Minimum", 3, 1), ("topics", "Recommended", 10, 2), ("topics", "Excellent", 50, 3)]
HEALTH_SERVICES = ["groq", "anthropic", "deepgram", "cartesia", "livekit"]
LATENCY_SERVICES = ["groq", "anthropic"]


def _overview(rows: DataFrame, key: str) -> DataFrame:
    """Adds up rows of partial figures by skill (one union, no joins)."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    x = rows.groupBy(key).agg(*[n(c) for c in ("examples", "tokens", "approved", "adapters", "__done")], F.min("best_loss").alias("best_loss"),
                              F.max("__listed").alias("__listed"))
    status = F.when(F.col("__done") > 0, "trained").when(F.col("examples") > 0, "has_data").otherwise("untrained")
    return x.where("__listed").select(key, "examples", "tokens", "approved", "adapters", "best_loss", status.alias("status"))


def _figures(df: DataFrame, key: str, listed: bool, **aggregates: Column) -> DataFrame:
    """One row per skill of a table, in the columns of ``_overview``; rows
    without a skill make one without figures."""
    kinds = {"examples": "bigint", "tokens": "bigint", "approved": "bigint", "adapters": "bigint", "__done": "bigint", "best_loss": "double"}
    found = df.groupBy(key).agg(F.lit(listed).alias("__listed"), *[c.alias(a) for a, c in aggregates.items()])
    own = {c: F.when(F.col(key).isNotNull(), F.col(c)) if c in aggregates else F.lit(None) for c in kinds}
    return found.select(key, "__listed", *[own[c].cast(k).alias(c) for c, k in kinds.items()])


def _adapter_figures(adapters: DataFrame, key: str, listed: bool) -> DataFrame:
    return _figures(adapters, key, listed, adapters=F.count("*"), best_loss=F.min("final_loss"), __done=F.count_if(F.col("status") == "completed"))


def skill_overview(skills: DataFrame, examples: DataFrame, items: DataFrame, adapters: DataFrame,
                   key: str = "skill_id") -> DataFrame:
    """Op 59: per skill – examples, item tokens, approved items, adapters,
    best loss and a status (trained / has_data / untrained).  Each input is
    aggregated to one row per skill; the rows are added up in one union."""
    parts = [_figures(skills.select(F.col("id").alias(key)), key, True),
             _figures(examples, key, False, examples=F.count("*")),
             _figures(items, key, False, tokens=F.sum("tokens"), approved=F.count_if(F.col("is_approved"))),
             _adapter_figures(adapters, key, False)]
    return _overview(functools.reduce(DataFrame.unionByName, parts), key)


def skill_overview_of(interactions: DataFrame, training: DataFrame, items: DataFrame, adapters: DataFrame,
                      key: str = "skill_id") -> DataFrame:
    """Op 59 for every skill that interactions, items or adapters name, where
    the examples are the training rows and the items that are not archived:
    each table is read once."""
    parts = [_figures(interactions, key, True), _figures(training, key, False, examples=F.count("*")),
             _figures(items, key, True, examples=F.count_if(~F.col("is_archived")), tokens=F.sum("tokens"), approved=F.count_if(F.col("is_approved"))),
             _adapter_figures(adapters, key, True)]
    return _overview(functools.reduce(DataFrame.unionByName, parts), key)


def dataset_quality(df: DataFrame, tiers: DataFrame, key: str = "skill_id", user: str = "user_message",
                    response: str = "assistant_response", topic: str = "category") -> DataFrame:
    """Op 61: per skill – examples, average tokens, distinct topics, the tier
    reached on each (range join to the tier table), the overall tier (the
    lowest), response-length spread, question-word variety and the examples
    still missing to the next example tier.

    The input is read once and words are counted once a text; the figures of a
    skill go through the join with the tiers as three rows and come back as one."""
    first = F.lower(F.regexp_extract(F.col(user), r"^\s*([A-Za-z']+)", 1))
    x = df.select(key, word_count(user).alias("__u"), word_count(response).alias("__r"), F.col(topic).alias("__topic"),
                  F.nullif(first, F.lit("")).alias("__opener"))
    own = ["examples", "avg_tokens", "topics", "min_response_words", "max_response_words", "response_words_stddev", "question_openers"]
    g = x.groupBy(key).agg(
        F.count("*").alias("examples"),
        round_half_up(F.avg(F.col("__u") + F.col("__r")), 1).alias("avg_tokens"),
        F.count_distinct("__topic").alias("topics"),
        F.min("__r").alias("min_response_words"),
        F.max("__r").alias("max_response_words"),
        round_half_up(F.stddev_samp("__r"), 2).alias("response_words_stddev"),
        F.count_distinct("__opener").alias("question_openers"))
    metrics = ("examples", "avg_tokens", "topics")
    long = g.select(key, F.struct(*own).alias("__g"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("__metric"), F.col(m).cast("double").alias("__value")) for m in metrics])))
    tb = broadcast_if_small(tiers, "tiers")
    joined = long.join(tb, F.col("__metric") == tb["metric"], "left")
    rank = {m: F.coalesce(F.max(F.when((F.col("__metric") == m) & (F.col("__value") >= F.col("min_value")), F.col("rank"))), F.lit(0)) for m in metrics}
    steps = F.collect_list(F.when(F.col("__metric") == "examples", F.struct("rank", "min_value")))
    per = joined.groupBy(key).agg(F.first("__g").alias("__g"), *[r.alias(f"__{m}") for m, r in rank.items()], steps.alias("__steps"))
    names = F.array(F.lit("Below Minimum"), *[F.lit(n) for n in ("Minimum", "Recommended", "Excellent")])
    tier = lambda c: F.try_element_at(names, c + 1)
    above = F.filter("__steps", lambda s: s["rank"] == F.col("__examples") + 1)
    return per.select(
        key, *[F.col(f"__g.{c}").alias(c) for c in own],
        tier(F.col("__examples")).alias("examples_tier"), tier(F.col("__avg_tokens")).alias("tokens_tier"),
        tier(F.col("__topics")).alias("topics_tier"),
        tier(F.least("__examples", "__avg_tokens", "__topics")).alias("overall_tier"),
        (F.try_element_at(above, F.lit(1))["min_value"] - F.col("__g.examples")).alias("missing_to_next_tier"))


def health_rollup(df: DataFrame, services: Sequence[str] = tuple(HEALTH_SERVICES),
                  latency_services: Sequence[str] = tuple(LATENCY_SERVICES)) -> DataFrame:
    """Op 63: unpivot the wide health table (one boolean per service) and
    report checks, uptime %, average / max latency and last status per
    service."""
    rows = F.array(*[F.struct(F.lit(s).alias("service"), F.col(f"{s}_healthy").alias("healthy"),
                              (F.col(f"{s}_latency_ms") if s in latency_services else F.lit(None).cast("int"))
                              .alias("latency_ms")) for s in services])
    long = df.select("checked_at", F.inline(rows))
    return long.groupBy("service").agg(
        F.count("*").alias("checks"),
        pct(F.count_if(F.col("healthy")), F.count("healthy"), 2).alias("uptime_pct"),
        round_half_up(F.avg("latency_ms"), 1).alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.max_by("healthy", F.struct("checked_at", "healthy")).alias("last_healthy"))


def ewma(df: DataFrame, key: str | None, order: Sequence[str], value: str, alpha: float = 0.1,
         block: int = 1 << 16, out: str = "ewma") -> DataFrame:
    """Op 70: ``s = (1−α)·s + α·x`` in time order per key, starting at 0, for
    every row, by the prefix scan of ``functions.scan.decayed_sum``: no array
    per row, and a hot key (or hour) is spread over blocks of at most ``block``
    rows.  A null value leaves the average as it is."""
    return decayed_sum(df, [key] if key else [], [F.col(c).asc_nulls_first() for c in order],
                       F.col(value).cast("double") * alpha, 1.0 - alpha, out, block)


def last_turns(df: DataFrame, n: int = 10, conv: str = "conv_id", order: str = "turn",
               text: Column | str = "text") -> DataFrame:
    """Op 71: the last ``n`` turns of each conversation as an ordered array
    (Q19: the cap applies to every role).  Only ``n`` rows per conversation
    survive the rank filter before anything is collected."""
    t = F.col(text) if isinstance(text, str) else text
    w = Window.partitionBy(conv).orderBy(F.desc(order))
    x = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    g = x.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                 F.concat_ws(": ", "role", t).alias("t"))))
                            .alias("__h"))
    return g.select(conv, F.transform("__h", lambda s: s["t"]).alias("last_turns"))


def ewma_latency(df: DataFrame, key: str | None = "skill_id", order: Sequence[str] = ("created_at", "id"),
                 alpha: float = 0.1, value: str = "total_latency_ms") -> DataFrame:
    """Op 70 under its inventory name: running latency average per key."""
    return ewma(df, key, list(order), value, alpha, out="ewma_latency_ms")
