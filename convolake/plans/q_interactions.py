"""Queries for interaction analytics (ops 10-12, 22, 25-28, 45, 47-52)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.sizing import param_table

from convolake.operators import interactions as I
from convolake.plans import views as V
from convolake.plans.catalog import query


def costed(t):
    """interactions → derived (10) → costed (11)."""
    return I.interaction_cost(I.derive_interaction(V.interactions(t)), V.prices(t.spark))


COSTED_SQL = """
v_costed AS (
  SELECT i.* REPLACE (coalesce(i.total_latency_ms, i.fast_latency_ms + coalesce(i.deep_latency_ms, 0)) AS total_latency_ms),
    i.system_used = 'deep' AND NOT coalesce(i.error_occurred, false) AS is_training_candidate,
    CAST(CAST(i.input_tokens AS DECIMAL(12,0)) * p.in_price + CAST(i.output_tokens AS DECIMAL(12,0)) * p.out_price
         AS DECIMAL(10,6)) AS estimated_cost_usd
  FROM v_interactions i LEFT JOIN v_prices p ON i.system_used = p.system_used)"""


def _w(sql: str) -> str:
    return "WITH " + COSTED_SQL.strip() + "\n" + sql


@query("derive_interaction", _w("""
SELECT id, total_latency_ms, is_training_candidate FROM v_costed"""))
def q_derive(t):
    return I.derive_interaction(V.interactions(t)).select("id", "total_latency_ms", "is_training_candidate")


@query("interaction_cost", _w("""
SELECT id, system_used, input_tokens, output_tokens, estimated_cost_usd FROM v_costed"""))
def q_cost(t):
    return costed(t).select("id", "system_used", "input_tokens", "output_tokens", "estimated_cost_usd")


@query("validate_interactions", """
SELECT id, CASE WHEN session_id IS NULL THEN 'session_id is null'
  WHEN skill_id IS NULL THEN 'skill_id is null'
  WHEN user_input IS NULL THEN 'user_input is null'
  WHEN agent_response IS NULL THEN 'agent_response is null'
  WHEN NOT system_used IN ('fast','deep') THEN 'system_used not in (fast, deep)'
  WHEN NOT user_feedback BETWEEN 1 AND 5 THEN 'user_feedback not in 1..5' END AS reject_reason
FROM v_interactions
WHERE session_id IS NULL OR skill_id IS NULL OR user_input IS NULL OR agent_response IS NULL
   OR NOT system_used IN ('fast','deep') OR NOT user_feedback BETWEEN 1 AND 5""")
def q_validate(t):
    _, bad = I.validate_interactions(V.interactions(t))
    return bad.select("id", "reject_reason")


@query("throughput_metrics", _w("""
SELECT id, CASE WHEN output_tokens > 0 AND total_latency_ms > 0
  THEN CAST(round(CAST(output_tokens / total_latency_ms * 1000.0 AS DECIMAL(38,10)), 1) AS DOUBLE) END AS tokens_per_sec
FROM v_costed"""))
def q_throughput(t):
    return I.throughput_metrics(I.derive_interaction(V.interactions(t))).select("id", "tokens_per_sec")


def unit_cost(spark):
    # Per-call cost of each system (USD).
    return param_table(spark, [("fast", "0.0005"), ("deep", "0.01")], "system_used string, per_call string") \
        .select("system_used", F.col("per_call").cast("decimal(10,4)").alias("per_call"))


@query("monthly_cost_projection", """
WITH g AS (
  SELECT skill_id, count(*) FILTER (WHERE system_used = 'fast') AS n_fast,
    count(*) FILTER (WHERE system_used = 'deep') AS n_deep, count(*) AS n_calls,
    count(DISTINCT CAST(created_at AS DATE)) AS days_observed
  FROM v_interactions GROUP BY skill_id),
x AS (
  SELECT skill_id, days_observed,
    CAST(n_calls * 30 AS DECIMAL(20,0)) / days_observed AS cpm,
    CAST(n_fast * 30 AS DECIMAL(20,0)) / days_observed AS s1,
    CAST(n_deep * 30 AS DECIMAL(20,0)) / days_observed AS s2
  FROM g),
y AS (
  SELECT skill_id, days_observed, cpm, s1, s2,
    s1 * CAST('0.0005' AS DECIMAL(10,4)) AS c1, s2 * CAST('0.01' AS DECIMAL(10,4)) AS c2,
    cpm * CAST('0.01' AS DECIMAL(10,4)) AS call_all FROM x)
SELECT skill_id, days_observed, CAST(floor(cpm) AS BIGINT) AS calls_per_month,
  CAST(floor(s1) AS BIGINT) AS system1_calls, CAST(floor(s2) AS BIGINT) AS system2_calls,
  CAST(round(c1, 2) AS DECIMAL(20,2)) AS system1_cost, CAST(round(c2, 2) AS DECIMAL(20,2)) AS system2_cost,
  CAST(round(c1 + c2, 2) AS DECIMAL(20,2)) AS total_cost, CAST(round(call_all, 2) AS DECIMAL(20,2)) AS all_deep_cost,
  CAST(round(call_all - (c1 + c2), 2) AS DECIMAL(20,2)) AS savings,
  CASE WHEN call_all > 0 THEN CAST(round((call_all - (c1 + c2)) * 100 / call_all, 1) AS DOUBLE) END AS savings_percentage
FROM y""")
def q_monthly(t):
    return I.monthly_cost_projection(V.interactions(t), unit_cost(t.spark))


@query("training_candidates", """
SELECT id, skill_id, user_input, agent_response, user_feedback, created_at FROM v_interactions
WHERE system_used = 'deep' AND user_feedback >= 4 AND error_occurred = false AND exported_for_training = false""")
def q_candidates(t):
    return I.training_candidates(V.interactions(t))


@query("export_candidates", """
SELECT * FROM (
  SELECT id, skill_id, user_input AS prompt, agent_response AS completion, user_feedback,
    CAST(row_number() OVER (PARTITION BY skill_id ORDER BY user_feedback DESC, created_at DESC, id) AS INTEGER)
      AS rank_in_skill
  FROM v_interactions
  WHERE system_used = 'deep' AND user_feedback >= 4 AND error_occurred = false AND exported_for_training = false)
WHERE rank_in_skill <= 100""")
def q_export(t):
    return I.export_candidates(V.interactions(t), 4, 100)


@query("export_candidates_whole", """
SELECT id, skill_id, user_input AS prompt, agent_response AS completion, user_feedback,
  CAST(row_number() OVER (PARTITION BY skill_id ORDER BY user_feedback DESC, created_at DESC, id) AS INTEGER) AS rank_in_skill
FROM v_interactions
WHERE system_used = 'deep' AND user_feedback >= 4 AND error_occurred = false AND exported_for_training = false""")
def q_export_whole(t):
    return I.export_candidates(V.interactions(t))


@query("mark_exported_whole", """
SELECT id, (system_used = 'deep' AND user_feedback >= 4 AND error_occurred = false AND exported_for_training = false) IS TRUE
  OR exported_for_training AS exported_for_training
FROM v_interactions""")
def q_mark_whole(t):
    inter = V.interactions(t)
    return I.mark_exported(inter, I.export_candidates(inter).select("id")).select("id", "exported_for_training")


@query("mark_exported", """
WITH ids AS (
  SELECT id FROM (
    SELECT id, row_number() OVER (PARTITION BY skill_id ORDER BY user_feedback DESC, created_at DESC, id) AS r
    FROM v_interactions
    WHERE system_used = 'deep' AND user_feedback >= 4 AND error_occurred = false AND exported_for_training = false)
  WHERE r <= 100)
SELECT i.id, (ids.id IS NOT NULL) OR i.exported_for_training AS exported_for_training
FROM v_interactions i LEFT JOIN ids ON i.id = ids.id""")
def q_mark(t):
    inter = V.interactions(t)
    ids = I.export_candidates(inter, 4, 100).select("id")
    return I.mark_exported(inter, ids).select("id", "exported_for_training")


def session_ratings(t):
    """feedback submissions ← events: every event rates its session with
    value % 7 (0 and 6 are invalid ratings)."""
    e = t.events
    return e.select(e.user_id.alias("session_id"), (F.floor(e.value) % 7).cast("int").alias("rating"),
                    e.ts.alias("ts"))


@query("session_feedback", """
WITH fb AS (
  SELECT user_id AS session_id, CAST(floor(value) % 7 AS INTEGER) AS rating, ts FROM events),
latest AS (
  SELECT session_id, arg_max(rating, (ts, rating)) AS r FROM fb WHERE rating BETWEEN 1 AND 5 GROUP BY session_id)
SELECT i.id, i.session_id, CASE WHEN l.r IS NOT NULL THEN l.r ELSE i.user_feedback END AS user_feedback,
  CASE WHEN l.r IS NOT NULL THEN true ELSE i.call_completed END AS call_completed
FROM v_interactions i LEFT JOIN latest l ON i.session_id = l.session_id""")
def q_session_feedback(t):
    out = I.session_feedback(V.interactions(t), session_ratings(t))
    return out.select("id", "session_id", "user_feedback", "call_completed")


HOURLY_SQL = _w("""
SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_bucket,
  count(*) AS total_calls,
  count(*) FILTER (WHERE system_used = 'fast') AS system1_calls,
  count(*) FILTER (WHERE system_used = 'deep') AS system2_calls,
  CAST(round(CAST(avg(total_latency_ms) AS DECIMAL(38,10)), 0) AS INTEGER) AS avg_latency_ms,
  count(*) FILTER (WHERE error_occurred) AS error_count,
  CAST(sum(estimated_cost_usd) AS DECIMAL(18,4)) AS total_cost_usd
FROM v_costed GROUP BY 1""")


@query("hourly_metrics", HOURLY_SQL)
def q_hourly(t):
    return I.hourly_metrics(costed(t))


@query("dashboard_metrics", _w("""
, a AS (SELECT max(created_at) AS as_of FROM v_costed),
w AS (SELECT * FROM (VALUES (1), (24), (168), (720)) AS w(window_hours)),
g AS (
  SELECT a.as_of, w.window_hours, count(c.id) AS n,
    count(c.id) FILTER (WHERE c.system_used = 'fast') AS f,
    count(c.id) FILTER (WHERE c.error_occurred) AS e,
    sum(coalesce(c.total_latency_ms, 0)) AS l, sum(c.estimated_cost_usd) AS c
  FROM a CROSS JOIN w LEFT JOIN v_costed c ON c.created_at >= a.as_of - to_hours(w.window_hours)
  GROUP BY a.as_of, w.window_hours)
SELECT as_of, window_hours, n AS total_calls,
  CAST(round(CAST(CASE WHEN n <> 0 THEN f * 100.0 / n END AS DECIMAL(38,10)), 1) AS DOUBLE) AS system1_percentage,
  f AS system1_count, n - f AS system2_count,
  CAST(round(CAST(CASE WHEN n <> 0 THEN l / n END AS DECIMAL(38,10)), 0) AS INTEGER) AS avg_latency_ms,
  CAST(round(CAST(CASE WHEN n <> 0 THEN e * 100.0 / n END AS DECIMAL(38,10)), 2) AS DOUBLE) AS error_rate,
  CAST(coalesce(c, 0) AS DECIMAL(18,6)) AS cost_usd
FROM g""").replace("\n, a AS", ",\na AS"))
def q_dashboard(t):
    return I.dashboard_metrics(costed(t), None, (1, 24, 168, 720))


@query("calls_by_skill", """
SELECT coalesce(skill_id, 'unknown') AS skill_id, count(*) AS calls FROM v_interactions GROUP BY 1""")
def q_calls_by_skill(t):
    return I.calls_by_skill(V.interactions(t))


@query("recent_errors", """
SELECT id, created_at, skill_id, system_used, error_message FROM v_interactions
WHERE error_occurred ORDER BY created_at DESC, id DESC LIMIT 5""")
def q_recent_errors(t):
    return I.recent_errors(V.interactions(t), 5)


@query("latency_percentiles", _w("""
SELECT skill_id, system_used, count(total_latency_ms) AS n,
  CAST(round(CAST(quantile_cont(total_latency_ms, 0.5) AS DECIMAL(38,10)), 3) AS DOUBLE) AS p50,
  CAST(round(CAST(quantile_cont(total_latency_ms, 0.99) AS DECIMAL(38,10)), 3) AS DOUBLE) AS p99
FROM v_costed WHERE total_latency_ms IS NOT NULL GROUP BY skill_id, system_used"""))
def q_percentiles(t):
    return I.latency_percentiles(I.derive_interaction(V.interactions(t)))


@query("routing_rollup", _w("""
SELECT skill_id, system_used, GROUPING(skill_id, system_used) AS grouping_level,
  count(*) AS calls, count(*) FILTER (WHERE error_occurred) AS errors,
  CAST(sum(estimated_cost_usd) AS DECIMAL(18,6)) AS cost_usd
FROM v_costed GROUP BY ROLLUP (skill_id, system_used)"""))
def q_rollup(t):
    return I.routing_rollup(costed(t))
