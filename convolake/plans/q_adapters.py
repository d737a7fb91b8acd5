"""Queries for the adapter registry and jobs (23-24, 57, 65-67, 73, 125-126)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.sizing import param_table

from convolake.operators import adapters as AD
from convolake.operators import curation as C
from convolake.plans import views as V
from convolake.plans.catalog import query


@query("loss_rating", """
SELECT id, CASE WHEN final_loss < 0.3 THEN 'Excellent' WHEN final_loss < 0.5 THEN 'Great'
  WHEN final_loss < 1.0 THEN 'Good' ELSE 'Needs More Data' END AS loss_rating FROM v_adapters""")
def q_loss_rating(t):
    return AD.loss_rating(V.adapters(t)).select("id", "loss_rating")


def budget_tables(spark):
    # Typical training minutes by example count; GPU hourly rates (USD).
    times = param_table(spark, [(10, 5), (50, 12), (100, 20), (500, 60)], "n_examples int, minutes int")
    rates = param_table(spark, [("a10g", 1.10), ("t4", 0.40)], "gpu string, hourly_rate double")
    return times, rates


@query("training_budget", """
WITH c AS (SELECT skill_id, count(*) AS n_examples FROM (
    SELECT skill_id FROM v_training_data UNION ALL SELECT skill_id FROM v_extracted WHERE NOT is_archived) GROUP BY 1),
tm AS (SELECT * FROM (VALUES (10, 5), (50, 12), (100, 20), (500, 60)) AS t(n, m))
SELECT c.skill_id, c.n_examples,
  CAST(round(CAST(coalesce(CAST(tm.m AS DOUBLE), c.n_examples * 0.2) AS DECIMAL(38,10)), 1) AS DOUBLE) AS est_minutes,
  CAST(round(CAST(coalesce(CAST(tm.m AS DOUBLE), c.n_examples * 0.2) / 60 * 1.10 AS DECIMAL(38,10)), 2) AS DOUBLE)
    AS est_cost_usd,
  CASE WHEN c.n_examples <= 100 THEN 'high' ELSE 'medium' END AS confidence
FROM c LEFT JOIN tm ON c.n_examples = tm.n""")
def q_budget(t):
    counts = C.all_training_examples(V.training_data(t), V.extracted(t)).groupBy("skill_id") \
        .agg(F.count("*").alias("n_examples"))
    times, rates = budget_tables(t.spark)
    return AD.training_budget(counts, times, rates)


@query("duplicate_groups", """
SELECT skill_id, count(*) AS count FROM v_adapters GROUP BY 1 HAVING count(*) > 1""")
def q_dups(t):
    return AD.duplicate_groups(V.adapters(t))


@query("best_adapter", """
SELECT skill_id, id, final_loss FROM (SELECT *, row_number() OVER (PARTITION BY skill_id
  ORDER BY coalesce(final_loss, 999) ASC, created_at DESC, id ASC) AS rn FROM v_adapters) WHERE rn = 1""")
def q_best(t):
    return AD.best_adapter(V.adapters(t)).select("skill_id", "id", "final_loss")


@query("keep_best_or_newest", """
SELECT skill_id, id, final_loss FROM (SELECT *, row_number() OVER (PARTITION BY skill_id
  ORDER BY final_loss ASC NULLS LAST, created_at DESC, id ASC) AS rn FROM v_adapters) WHERE rn = 1""")
def q_keep(t):
    return AD.keep_best_or_newest(V.adapters(t)).select("skill_id", "id", "final_loss")


@query("adapter_cleanup_report", """
SELECT skill_id, id AS kept_id, final_loss AS kept_loss, n - 1 AS deleted FROM (
  SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY coalesce(final_loss, 999) ASC, created_at DESC, id ASC) AS rn,
    count(*) OVER (PARTITION BY skill_id) AS n FROM v_adapters) WHERE rn = 1 AND n > 1""")
def q_cleanup(t):
    return AD.adapter_cleanup_report(V.adapters(t))


@query("adapter_cleanup_total", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS total_deleted, count(*) AS skills_cleaned
FROM (SELECT skill_id, count(*) AS n FROM v_adapters GROUP BY 1) WHERE n > 1""")
def q_cleanup_total(t):
    return AD.adapter_cleanup_total(V.adapters(t))


@query("loss_curve", """
WITH g AS (SELECT job_id, arg_min(loss, (step, "timestamp")) AS start_loss, arg_max(loss, (step, "timestamp")) AS current_loss,
  max(step) AS step, max(total_steps) AS total_steps, avg(step_time_seconds) AS a FROM v_steps GROUP BY 1)
SELECT job_id, start_loss, current_loss, step, total_steps,
  CAST(round(CAST(CASE WHEN start_loss <> 0 THEN (start_loss - current_loss) * 100 / start_loss END AS DECIMAL(38,10)), 1)
    AS DOUBLE) AS improvement_pct,
  CAST(round(CAST(CASE WHEN total_steps <> 0 THEN step * 100.0 / total_steps END AS DECIMAL(38,10)), 1) AS DOUBLE)
    AS progress_pct,
  CAST(round((total_steps - step) * a) AS BIGINT) AS eta_seconds
FROM g""")
def q_loss_curve(t):
    return AD.loss_curve(V.steps(t))


@query("adapter_versions", """
SELECT id, skill_id, CAST(row_number() OVER w AS INTEGER) AS version,
  coalesce(status = 'completed' AND (created_at, id) = max(CASE WHEN status = 'completed' THEN (created_at, id) END)
    OVER (PARTITION BY skill_id), false) AS is_active,
  CAST(round(CAST(final_loss - lag(final_loss) OVER w AS DECIMAL(38,10)), 6) AS DOUBLE) AS loss_change
FROM v_adapters WINDOW w AS (PARTITION BY skill_id ORDER BY created_at, id)""")
def q_versions(t):
    return AD.adapter_versions(V.adapters(t)).select("id", "skill_id", "version", "is_active", "loss_change")


@query("training_job_summary", """
SELECT skill_id, count(*) AS started, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'failed') AS failed,
  CAST(round(CAST(CASE WHEN count(*) FILTER (WHERE status IN ('completed','failed')) <> 0 THEN
    count(*) FILTER (WHERE status = 'completed') * 100.0 / count(*) FILTER (WHERE status IN ('completed','failed')) END
    AS DECIMAL(38,10)), 1) AS DOUBLE) AS success_rate,
  CAST(round(CAST(avg(training_time_seconds) FILTER (WHERE status = 'completed') AS DECIMAL(38,10)), 1) AS DOUBLE)
    AS avg_time_seconds,
  CAST(sum(cost_usd) FILTER (WHERE status = 'completed') AS DECIMAL(18,2)) AS total_cost_usd,
  CASE WHEN GROUPING(skill_id) = 1 THEN 'overall' ELSE 'skill' END AS level
FROM v_jobs GROUP BY ROLLUP (skill_id)""")
def q_job_summary(t):
    return AD.training_job_summary(V.jobs(t))
