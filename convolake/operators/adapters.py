"""Adapter registry and training jobs (SURVEY §2 ops 23-24, 57, 65-67, 73,
125-126).

Top-1-per-skill uses ``row_number`` over a per-skill window only where the
reference's tie rules need a full ordering; the counts beside it come from
the same window pass (no per-skill query loop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.columns import pct, round_half_up, safe_div
from convolake.functions.scan import NUMBER, Blocks
from convolake.functions.sizing import broadcast_if_small

# Loss rating bands and the fallback loss used for ordering.
LOSS_BANDS = [(0.3, "Excellent"), (0.5, "Great"), (1.0, "Good")]
LOSS_ELSE = "Needs More Data"
NULL_LOSS = 999.0


def loss_rating(df: DataFrame, loss: str = "final_loss") -> DataFrame:
    """Op 23: <0.3 Excellent, <0.5 Great, <1.0 Good, else Needs More Data."""
    e = None
    for bound, label in LOSS_BANDS:
        cond = F.col(loss) < bound
        e = F.when(cond, label) if e is None else e.when(cond, label)
    return df.withColumn("loss_rating", e.otherwise(LOSS_ELSE))


def training_budget(counts: DataFrame, times: DataFrame, rates: DataFrame,
                    n_col: str = "n_examples", gpu: str = "a10g") -> DataFrame:
    """Op 24: minutes by exact lookup else 0.2·n; cost = minutes/60 · hourly
    rate of the GPU; confidence high when n ≤ 100 (measured range)."""
    t = broadcast_if_small(times.select(F.col("n_examples").alias("__n"), F.col("minutes").alias("__m")), "times")
    rate = rates.where(F.col("gpu") == gpu).select("hourly_rate").scalar()
    x = counts.join(t, F.col(n_col) == F.col("__n"), "left")
    minutes = F.coalesce(F.col("__m").cast("double"), F.col(n_col) * 0.2)
    return (x.withColumn("est_minutes", round_half_up(minutes, 1))
            .withColumn("est_cost_usd", round_half_up(minutes / 60 * rate, 2))
            .withColumn("confidence", F.when(F.col(n_col) <= 100, "high").otherwise("medium"))
            .drop("__n", "__m"))


def duplicate_groups(df: DataFrame, key: str = "skill_id") -> DataFrame:
    """Op 57: skills with more than one adapter (HAVING count > 1)."""
    return df.groupBy(key).agg(F.count("*").alias("count")).where(F.col("count") > 1)


def _best_window(key: str = "skill_id"):
    return Window.partitionBy(key).orderBy(F.coalesce(F.col("final_loss"), F.lit(NULL_LOSS)).asc(),
                                           F.col("created_at").desc(), F.col("id").asc())


def best_adapter(df: DataFrame, key: str = "skill_id") -> DataFrame:
    """Op 65: per skill the lowest loss (null counts as 999), newest on
    ties, then id."""
    return (df.withColumn("__rn", F.row_number().over(_best_window(key)))
            .where(F.col("__rn") == 1).drop("__rn"))


def keep_best_or_newest(df: DataFrame, key: str = "skill_id") -> DataFrame:
    """Op 66: per skill the lowest non-null loss; when every loss is null,
    the newest (Q21: differs from op 65 in null handling)."""
    w = Window.partitionBy(key).orderBy(F.col("final_loss").asc_nulls_last(),
                                        F.col("created_at").desc(), F.col("id").asc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def adapter_cleanup_report(df: DataFrame, key: str = "skill_id") -> DataFrame:
    """Op 67: for every skill with duplicates – kept id, kept loss, deleted
    count.  One hash aggregate (map-side partial ``min_by`` and count)
    instead of a query per skill or a window over a whole skill."""
    newest_first = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.lit("1970-01-01").cast("timestamp_ntz"))
    rank = F.struct(F.coalesce(F.col("final_loss"), F.lit(NULL_LOSS)), newest_first, F.col("id"))
    g = df.groupBy(key).agg(F.count("*").alias("__n"),
                            F.min_by(F.struct(F.col("id").alias("i"), F.col("final_loss").alias("l")), rank)
                            .alias("__k"))
    return g.where(F.col("__n") > 1).select(key, F.col("__k.i").alias("kept_id"), F.col("__k.l").alias("kept_loss"),
                                            (F.col("__n") - 1).alias("deleted"))


def adapter_cleanup_total(df: DataFrame, key: str = "skill_id") -> DataFrame:
    """Op 67, closing figures: rows deleted and skills cleaned, one row."""
    return adapter_cleanup_report(df, key).agg(F.coalesce(F.sum("deleted"), F.lit(0)).alias("total_deleted"),
                                               F.count("*").alias("skills_cleaned"))


def loss_curve(steps: DataFrame, job: str = "job_id") -> DataFrame:
    """Op 73: per job start loss, current loss, improvement %, progress %
    and ETA seconds from the step events."""
    first = F.min_by(F.col("loss"), F.struct("step", "timestamp"))
    last = F.max_by(F.col("loss"), F.struct("step", "timestamp"))
    g = steps.groupBy(job).agg(
        first.alias("start_loss"), last.alias("current_loss"),
        F.max("step").alias("step"), F.max("total_steps").alias("total_steps"),
        F.avg("step_time_seconds").alias("__avg_step"))
    return g.select(
        job, "start_loss", "current_loss", "step", "total_steps",
        round_half_up(safe_div((F.col("start_loss") - F.col("current_loss")) * 100, F.col("start_loss")), 1)
        .alias("improvement_pct"),
        pct("step", "total_steps", 1).alias("progress_pct"),
        F.round((F.col("total_steps") - F.col("step")) * F.col("__avg_step")).cast("bigint").alias("eta_seconds"),
    )


def adapter_versions(df: DataFrame, key: str = "skill_id", block: int = 1 << 16) -> DataFrame:
    """Op 125: version number per skill in time order, active flag on the
    newest completed adapter, loss change against the previous version.

    A scan over blocks of a skill: the loss before a block and the newest
    completed adapter of the skill come with the block's summary row."""
    blocks = Blocks(df, [key], [F.col("created_at").asc_nulls_first(), F.col("id").asc_nulls_first()], block)
    done, at = F.col("status") == "completed", F.struct("created_at", "id")
    x = blocks.previous(blocks.rows, F.col("final_loss"), "__loss", {"__done": F.max(F.when(done, at))}, {"__newest": F.max("__done").over(blocks.whole)})
    x = (x.withColumn("version", F.col(NUMBER).cast("int"))
         .withColumn("is_active", F.coalesce(done & (at == F.col("__newest")), F.lit(False)))
         .withColumn("loss_change", round_half_up(F.col("final_loss") - F.col("__loss"), 6)))
    return blocks.drop(x).drop("__loss", "__done", "__newest")


def training_job_summary(jobs: DataFrame, key: str = "skill_id") -> DataFrame:
    """Op 126: jobs started / completed / failed, success rate, average time
    and cost – per skill and overall (rollup)."""
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    return (jobs.rollup(key).agg(
        F.grouping_id().alias("__g"),
        F.count("*").alias("started"),
        F.count_if(done).alias("completed"),
        F.count_if(failed).alias("failed"),
        pct(F.count_if(done), F.count_if(done | failed), 1).alias("success_rate"),
        round_half_up(F.avg(F.when(done, F.col("training_time_seconds"))), 1).alias("avg_time_seconds"),
        F.sum(F.when(done, F.col("cost_usd"))).cast("decimal(18,2)").alias("total_cost_usd"))
        .withColumn("level", F.when(F.col("__g") == 1, "overall").otherwise("skill")).drop("__g"))
