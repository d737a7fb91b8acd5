"""Queries for cross-table summaries and ordered per-key ops (59, 61, 63, 70, 71)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.sizing import param_table

from convolake.operators import analytics as AN
from convolake.plans import views as V
from convolake.plans.catalog import query
from convolake.plans.q_curation import WORDS_SQL


@query("skill_overview", """
WITH sk AS (SELECT skill_id AS id FROM v_interactions UNION SELECT skill_id FROM v_extracted
            UNION SELECT skill_id FROM v_adapters),
ex AS (SELECT skill_id, count(*) AS examples FROM (SELECT skill_id FROM v_training_data
        UNION ALL SELECT skill_id FROM v_extracted WHERE NOT is_archived) GROUP BY 1),
it AS (SELECT skill_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE is_approved) AS approved
       FROM v_extracted GROUP BY 1),
ad AS (SELECT skill_id, count(*) AS adapters, min(final_loss) AS best_loss,
         count(*) FILTER (WHERE status = 'completed') AS done FROM v_adapters GROUP BY 1)
SELECT sk.id AS skill_id, coalesce(ex.examples, 0) AS examples, CAST(coalesce(it.tokens, 0) AS BIGINT) AS tokens,
  coalesce(it.approved, 0) AS approved, coalesce(ad.adapters, 0) AS adapters, ad.best_loss,
  CASE WHEN coalesce(ad.done, 0) > 0 THEN 'trained' WHEN coalesce(ex.examples, 0) > 0 THEN 'has_data'
       ELSE 'untrained' END AS status
FROM sk LEFT JOIN ex ON sk.id = ex.skill_id LEFT JOIN it ON sk.id = it.skill_id LEFT JOIN ad ON sk.id = ad.skill_id""")
def q_skill_overview(t):
    return AN.skill_overview_of(V.interactions(t), V.training_data(t), V.extracted(t), V.adapters(t))


def tiers(spark):
    return param_table(spark, AN.QUALITY_TIERS, "metric string, tier string, min_value int, rank int")


def _quality_sql() -> str:
    tv = ", ".join(f"('{m}', '{n}', {v}, {r})" for m, n, v, r in AN.QUALITY_TIERS)
    u, a = "user_input", "assistant_response"
    wu, wa = WORDS_SQL.format(c=u), WORDS_SQL.format(c=a)
    return f"""
WITH tb AS (SELECT * FROM (VALUES {tv}) AS t(metric, tier, min_value, rank)),
g AS (SELECT skill_id, count(*) AS examples,
        CAST(round(CAST(avg({wu} + {wa}) AS DECIMAL(38,10)), 1) AS DOUBLE) AS avg_tokens,
        count(DISTINCT category) AS topics, min({wa}) AS min_response_words, max({wa}) AS max_response_words,
        CAST(round(CAST(stddev_samp({wa}) AS DECIMAL(38,10)), 2) AS DOUBLE) AS response_words_stddev,
        count(DISTINCT nullif(lower(regexp_extract({u}, '^\\s*([A-Za-z'']+)', 1)), '')) AS question_openers
      FROM v_extracted GROUP BY 1),
lg AS (SELECT skill_id, 'examples' AS metric, CAST(examples AS DOUBLE) AS value FROM g
       UNION ALL SELECT skill_id, 'avg_tokens', avg_tokens FROM g
       UNION ALL SELECT skill_id, 'topics', CAST(topics AS DOUBLE) FROM g),
r AS (SELECT lg.skill_id, lg.metric, max(tb.rank) AS rank FROM lg LEFT JOIN tb
        ON lg.metric = tb.metric AND lg.value >= tb.min_value GROUP BY 1, 2),
p AS (SELECT skill_id, coalesce(max(rank) FILTER (WHERE metric = 'examples'), 0) AS re,
        coalesce(max(rank) FILTER (WHERE metric = 'avg_tokens'), 0) AS rt,
        coalesce(max(rank) FILTER (WHERE metric = 'topics'), 0) AS rp FROM r GROUP BY 1)
SELECT g.*, ['Below Minimum', 'Minimum', 'Recommended', 'Excellent'][re + 1] AS examples_tier,
  ['Below Minimum', 'Minimum', 'Recommended', 'Excellent'][rt + 1] AS tokens_tier,
  ['Below Minimum', 'Minimum', 'Recommended', 'Excellent'][rp + 1] AS topics_tier,
  ['Below Minimum', 'Minimum', 'Recommended', 'Excellent'][least(re, rt, rp) + 1] AS overall_tier,
  (SELECT min_value FROM tb WHERE metric = 'examples' AND rank = re + 1) - g.examples AS missing_to_next_tier
FROM g JOIN p ON g.skill_id = p.skill_id"""


@query("dataset_quality", _quality_sql())
def q_quality(t):
    x = V.extracted(t).select("skill_id", F.col("user_input").alias("user_message"), "assistant_response",
                              "category")
    return AN.dataset_quality(x, tiers(t.spark))


@query("health_rollup", "WITH lg AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS service, checked_at, {s}_healthy AS healthy, "
    + (f"{s}_latency_ms" if s in AN.LATENCY_SERVICES else "CAST(NULL AS INTEGER)") + " AS latency_ms FROM v_health"
    for s in AN.HEALTH_SERVICES) + """)
SELECT service, count(*) AS checks,
  CAST(round(CAST(count(*) FILTER (WHERE healthy) * 100.0 / count(healthy) AS DECIMAL(38,10)), 2) AS DOUBLE) AS uptime_pct,
  CAST(round(CAST(avg(latency_ms) AS DECIMAL(38,10)), 1) AS DOUBLE) AS avg_latency_ms, max(latency_ms) AS max_latency_ms,
  arg_max(healthy, (checked_at, healthy)) AS last_healthy
FROM lg GROUP BY 1""")
def q_health(t):
    return AN.health_rollup(V.health(t))


@query("ewma_latency", """
WITH c AS (SELECT id, skill_id, created_at,
  CAST(coalesce(total_latency_ms, fast_latency_ms + coalesce(deep_latency_ms, 0)) AS DOUBLE) AS x FROM v_interactions)
SELECT id, CAST(round(CAST(list_reduce(list(x) OVER (PARTITION BY skill_id ORDER BY created_at, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda acc, v: acc * 0.9 + v * 0.1, 0.0) AS DECIMAL(38,10)), 6)
  AS DOUBLE) AS ewma
FROM c""")
def q_ewma(t):
    from convolake.functions.columns import round_half_up
    from convolake.operators.interactions import derive_interaction
    x = derive_interaction(V.interactions(t))
    out = AN.ewma(x, "skill_id", ["created_at", "id"], "total_latency_ms", 0.1)
    return out.select("id", round_half_up("ewma", 6).alias("ewma"))


@query("last_turns", """
SELECT conv_id, list(role || ': ' || text ORDER BY turn) AS last_turns FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 10
GROUP BY conv_id""")
def q_last_turns(t):
    return AN.last_turns(t.conversations, 10)
