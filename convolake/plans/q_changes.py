"""Queries for set operations and table changes (43-44, 68-69, 75-79)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convolake.operators import changes as CH
from convolake.operators import adapters as AD
from convolake.operators import interactions as I
from convolake.plans import views as V
from convolake.plans.catalog import query
from convolake.plans.q_interactions import COSTED_SQL, costed
from convolake.session import ensure_checkpoint_dir
from convolake.sources.versioned import VersionedTable


@query("select_ids", """
SELECT id, skill_id FROM v_extracted WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def q_select_ids(t):
    ids = t.labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    return CH.select_ids(V.extracted(t), ids).select("id", "skill_id")


@query("rows_to_retire", """
WITH best AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY skill_id
    ORDER BY coalesce(final_loss, 999) ASC, created_at DESC, id ASC) AS rn FROM v_adapters) WHERE rn = 1)
SELECT a.id, a.skill_id FROM v_adapters a WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.id = a.id)""")
def q_retire(t):
    a = V.adapters(t)
    return CH.rows_to_retire(a, AD.best_adapter(a).select("id")).select("id", "skill_id")


@query("latest_by_key", """
SELECT skill_used, arg_max(conv_id, ("timestamp", conv_id, turn)) AS conv_id,
  arg_max(turn, ("timestamp", conv_id, turn)) AS turn, arg_max(rating, ("timestamp", conv_id, turn)) AS rating
FROM v_feedback_log GROUP BY skill_used""")
def q_latest(t):
    log = V.feedback_log(t).select("skill_used", "timestamp", "conv_id", "turn", "rating")
    out = CH.latest_by_key(log, ["skill_used"], ["timestamp", "conv_id", "turn"])
    return out.select("skill_used", "conv_id", "turn", "rating")


@query("merge_by_priority", """
WITH u AS (
  SELECT DISTINCT skill_id AS id, 'runtime ' || skill_id AS name, 'runtime' AS source, 0 AS p FROM v_training_data
  UNION ALL SELECT id, name, 'db', 1 FROM v_skills
  UNION ALL SELECT DISTINCT skill_id, 'builtin ' || skill_id, 'builtin', 2 FROM v_interactions WHERE skill_id IS NOT NULL)
SELECT id, arg_min(name, p) AS name, arg_min(source, p) AS source FROM u GROUP BY id""")
def q_merge(t):
    runtime = V.training_data(t).select(F.col("skill_id").alias("id")).distinct() \
        .withColumn("name", F.concat(F.lit("runtime "), "id"))
    db = V.skills(t).select("id", "name")
    builtin = V.interactions(t).where(F.col("skill_id").isNotNull()).select(F.col("skill_id").alias("id")) \
        .distinct().withColumn("name", F.concat(F.lit("builtin "), "id"))
    return CH.merge_by_priority([("runtime", runtime), ("db", db), ("builtin", builtin)], "id")


@query("distinct_ids", """
SELECT skill_id AS id FROM v_interactions UNION SELECT skill_id FROM v_extracted UNION SELECT skill_id FROM v_adapters""")
def q_distinct_ids(t):
    return CH.distinct_ids(V.interactions(t), V.extracted(t), V.adapters(t), key="skill_id").withColumnRenamed(
        "skill_id", "id")


@query("insert_new_only", """
SELECT e.id, e.skill_id FROM v_extracted e WHERE e.id NOT IN (SELECT doc_id FROM labels)""")
def q_insert_new(t):
    x = V.extracted(t).select("id", "skill_id", "category")
    base = x.join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_semi")
    _, inserted = CH.insert_new_only(base, x, "id")
    return inserted.select("id", "skill_id")


@query("upsert_rows", "WITH " + COSTED_SQL.strip() + """,
base AS (
  SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_bucket, count(*) AS total_calls,
    count(*) FILTER (WHERE system_used = 'fast') AS system1_calls, count(*) FILTER (WHERE system_used = 'deep') AS system2_calls,
    CAST(round(CAST(avg(total_latency_ms) AS DECIMAL(38,10)), 0) AS INTEGER) AS avg_latency_ms,
    count(*) FILTER (WHERE error_occurred) AS error_count, CAST(sum(estimated_cost_usd) AS DECIMAL(18,4)) AS total_cost_usd
  FROM v_costed WHERE system_used = 'fast' GROUP BY 1),
new AS (
  SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_bucket, count(*) AS total_calls,
    count(*) FILTER (WHERE system_used = 'fast') AS system1_calls, count(*) FILTER (WHERE system_used = 'deep') AS system2_calls,
    CAST(round(CAST(avg(total_latency_ms) AS DECIMAL(38,10)), 0) AS INTEGER) AS avg_latency_ms,
    count(*) FILTER (WHERE error_occurred) AS error_count, CAST(sum(estimated_cost_usd) AS DECIMAL(18,4)) AS total_cost_usd
  FROM v_costed WHERE created_at >= date_trunc('hour', (SELECT max(created_at) FROM v_costed) - INTERVAL 48 HOUR)
  GROUP BY 1)
SELECT coalesce(n.hour_bucket, b.hour_bucket) AS hour_bucket,
  coalesce(n.total_calls, b.total_calls) AS total_calls, coalesce(n.system1_calls, b.system1_calls) AS system1_calls,
  coalesce(n.system2_calls, b.system2_calls) AS system2_calls,
  CASE WHEN n.hour_bucket IS NOT NULL THEN n.avg_latency_ms ELSE b.avg_latency_ms END AS avg_latency_ms,
  coalesce(n.error_count, b.error_count) AS error_count, coalesce(n.total_cost_usd, b.total_cost_usd) AS total_cost_usd
FROM base b FULL OUTER JOIN new n ON b.hour_bucket = n.hour_bucket""")
def q_upsert(t):
    c = costed(t)
    base = I.hourly_metrics(c.where(F.col("system_used") == "fast"))
    since = c.agg(F.max("created_at")).scalar() - F.expr("INTERVAL 48 HOURS")
    new = I.hourly_metrics(c, since=since)
    return CH.upsert_rows(base, new, "hour_bucket", reset=("avg_latency_ms",))


def adapter_patches(t):
    """per-adapter patch set ← lineitem aggregates (one row per order)."""
    li = t.lineitem
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max("l_linenumber").alias("epochs"),
        F.round(F.avg("l_discount").cast("decimal(38,10)"), 6).cast("double").alias("final_loss"),
        F.lit("not-allowed").alias("adapter_name"))


@query("patch_rows", """
WITH p AS (SELECT l_orderkey AS id, max(l_linenumber) AS epochs,
             CAST(round(CAST(avg(l_discount) AS DECIMAL(38,10)), 6) AS DOUBLE) AS final_loss FROM lineitem GROUP BY 1)
SELECT a.id, CASE WHEN p.id IS NOT NULL THEN coalesce(CAST(p.epochs AS INTEGER), a.epochs) ELSE a.epochs END AS epochs,
  CASE WHEN p.id IS NOT NULL THEN coalesce(p.final_loss, a.final_loss) ELSE a.final_loss END AS final_loss,
  a.adapter_name, CASE WHEN p.id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
FROM v_adapters a LEFT JOIN p ON a.id = p.id""")
def q_patch(t):
    out = CH.patch_rows(V.adapters(t), adapter_patches(t), "id", ["epochs", "final_loss"], "2024-02-01 00:00:00")
    return out.select("id", "epochs", "final_loss", "adapter_name", "updated_at")


@query("patch_table", """
WITH p AS (SELECT l_orderkey AS id, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS epochs,
             bool_or(l_linenumber % 2 = 0) AS gone FROM lineitem
           WHERE l_orderkey <= (SELECT max(l_orderkey) // 8 FROM lineitem) GROUP BY 1)
SELECT a.id, coalesce(CAST(p.epochs AS INTEGER), a.epochs) AS epochs,
  CASE WHEN p.gone THEN NULL ELSE a.final_loss END AS final_loss,
  CASE WHEN p.id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
FROM v_adapters a LEFT JOIN p ON a.id = p.id""")
def q_patch_table(t):
    """Patches of an eighth of the keys, several a key, on a table of files by
    key range: the files of other ranges stay as they are."""
    base = V.adapters(t).select("id", "epochs", "final_loss", F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/convolake-table-{uuid.uuid4().hex[:8]}"
    table = VersionedTable(t.spark, path, base.schema)
    table.append(base.repartitionByRange(8, "id"))
    li = t.lineitem
    few = li.where(F.col("l_orderkey") <= li.agg(F.floor(F.max("l_orderkey") / 8)).scalar())
    patches = few.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("epochs"), "l_shipdate", "l_linenumber",
                         F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("final_loss"))).alias("set_null"))
    table.patch(patches, "id", ["epochs", "final_loss"], "2024-02-01 00:00:00", ["l_shipdate", "l_linenumber"])
    return table.read()


@query("delete_rows", """
SELECT e.id, e.skill_id FROM v_extracted e JOIN v_skills s ON e.skill_id = s.id WHERE s.is_builtin""")
def q_delete_cascade(t):
    sk = V.skills(t)
    _, kids = CH.delete_rows(sk, sk.select("id"), soft=False, guard="is_builtin",
                             children=V.extracted(t), child_fk="skill_id")
    return kids.select("id", "skill_id")


@query("delete_rows_soft", """
SELECT id, CASE WHEN is_builtin THEN true ELSE false END AS is_active FROM v_skills""")
def q_delete_soft(t):
    sk = V.skills(t)
    parents, _ = CH.delete_rows(sk, sk.select("id"), soft=True, guard="is_builtin", flag="is_active")
    return parents.select("id", "is_active")
