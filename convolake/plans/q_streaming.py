"""Queries for the streaming operators (116-123).

Each streaming query runs to completion over the driver table with
``trigger(availableNow=True)`` into a sink in the shared checkpoint folder
and is read back as a batch frame – the same path a scheduled job takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.functions.sizing import estimated_bytes
from convolake.operators import interactions as I
from convolake.plans import views as V
from convolake.plans.catalog import query
from convolake.plans.q_interactions import HOURLY_SQL, _w
from convolake.session import ensure_checkpoint_dir, rocksdb_session
from convolake.sources.versioned import VersionedTable
from convolake.streaming import cycle as CY
from convolake.streaming import metrics as SM
from convolake.streaming import turns as ST


def _dir(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/convolake-stream/{name}-{uuid.uuid4().hex[:8]}"


def _run_to_files(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = df.sparkSession
    d = _dir(spark, name)
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", d + "/_checkpoint")
         .trigger(availableNow=True).start(d + "/out"))
    q.awaitTermination()
    return spark.read.parquet(d + "/out")


def _arrivals(t, batches: int = 4, late: str = "12 HOURS"):
    """The events as they would arrive: in ``batches`` files by time, each event
    up to ``late`` after its time (by a hash of its id), so that micro-batches
    overlap in time and hold their rows in no order.  Returns the folder."""
    d = _dir(t.spark, "arrivals")
    delay = F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000 * F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {late})")
    arrived = t.events.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp")) + delay.cast("bigint"))
    cuts = arrived.select(F.percentile_approx("__at", [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    batch = sum(((F.col("__at") >= c).cast("int") for c in cuts), F.lit(0))
    dealt = arrived.withColumn("__batch", F.coalesce(batch, F.lit(0))).drop("__at")
    for k in range(batches):  # one after the other: the file source reads by time of writing
        part = dealt.where(F.col("__batch") == k).drop("__batch")
        part.repartition(_files(t, batches)).write.mode("append").parquet(d)
    return d


def _files(t, batches: int) -> int:
    """Files of about 1 MB in a batch: a row of a few bytes here becomes several
    of many more in the tasks that read them."""
    return 1 + (estimated_bytes(t.events) or 0) // (batches << 20)


def _arriving(spark, t, folder: str, batches: int = 4):
    """A stream over them with as many micro-batches."""
    return spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", _files(t, batches)).parquet(folder)


def _costed_stream(t):
    s = V.interactions_of(t.stream("events"))
    return I.interaction_cost(I.derive_interaction(s), V.prices(t.spark))


@query("stream_hourly_metrics", HOURLY_SQL)
def q_stream_hourly(t):
    spark = t.spark
    d = _dir(spark, "hourly")
    agg = SM.stream_hourly_metrics(_costed_stream(t), "2 hours")
    q = (agg.writeStream.outputMode("update").foreachBatch(SM.hourly_upsert_sink(d + "/table"))
         .option("checkpointLocation", d + "/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(d + "/table").drop("hour")


@query("stream_alerts", _w("""
, w AS (SELECT c.*, time_bucket(INTERVAL 5 MINUTE, created_at) - to_minutes(5 * k) AS ws
        FROM v_costed c, (SELECT unnest(range(0, 12)) AS k)),
g AS (SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, count(*) AS calls,
        count(*) FILTER (WHERE error_occurred) AS errors, avg(coalesce(total_latency_ms, 0)) AS avg_latency
      FROM w GROUP BY ws),
r AS (SELECT *, CAST(round(CAST(errors * 100.0 / calls AS DECIMAL(38,10)), 2) AS DOUBLE) AS rate FROM g)
SELECT window_start, window_end, calls, 'error' AS severity, 'error_rate' AS metric, rate AS value FROM r WHERE rate > 5.0
UNION ALL
SELECT window_start, window_end, calls, 'warning', 'avg_latency_ms',
  CAST(round(CAST(avg_latency AS DECIMAL(38,10)), 1) AS DOUBLE) FROM r WHERE avg_latency > 500""").replace("\n, w AS", ",\nw AS"))
def q_stream_alerts(t):
    spark = t.spark
    d = _dir(spark, "alerts")
    windows = SM.stream_alert_windows(_costed_stream(t))
    q = (windows.writeStream.outputMode("update").foreachBatch(SM.day_upsert_sink(d + "/table", "window_start"))
         .option("checkpointLocation", d + "/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if not SM.table_exists(spark, d + "/table"):  # no event at all
        return SM.alert_rows(spark.createDataFrame([], windows.schema))
    return SM.alert_rows(spark.read.schema(windows.schema).parquet(d + "/table"))


HEALTH_CHANGES_SQL = """
WITH lg AS (""" + " UNION ALL ".join(
    f"SELECT '{s}' AS service, checked_at, {s}_healthy AS healthy FROM v_health"
    for s in ["groq", "anthropic", "deepgram", "cartesia", "livekit"]) + """),
x AS (SELECT *, lag(healthy) OVER (PARTITION BY service ORDER BY checked_at, healthy) AS previous FROM lg
      WHERE healthy IS NOT NULL AND checked_at IS NOT NULL),
ch AS (SELECT * FROM x WHERE previous IS NULL OR previous <> healthy)
SELECT service, checked_at, previous, healthy, 'state_change' AS event FROM ch
UNION ALL SELECT service, checked_at, previous, healthy, 'down_alert' FROM x WHERE NOT healthy"""


@query("stream_health", HEALTH_CHANGES_SQL)
def q_stream_health(t):
    """The stream, and a closing batch of what still waits behind the watermark."""
    own, d = rocksdb_session(t.spark), _dir(t.spark, "health")
    checks = V.health_of(_arriving(own, t, _arrivals(t)))
    q = (ST.stream_health(checks, "1 day").writeStream.format("parquet")
         .option("checkpointLocation", d + "/_checkpoint").trigger(availableNow=True).start(d + "/out"))
    q.awaitTermination()
    closing = ST.pending_health(own, d + "/_checkpoint")
    closing.write.mode("append").parquet(d + "/closing")
    out = t.spark.read.schema(closing.schema).parquet(d + "/out", d + "/closing")
    return out.withColumn("checked_at", F.col("checked_at").cast("timestamp_ntz"))


@query("health_state_changes", HEALTH_CHANGES_SQL)
def q_health_changes(t):
    return ST.health_batch(V.health(t)).withColumn("checked_at", F.col("checked_at").cast("timestamp_ntz"))


def _closed(spark, folder: str, closing) -> DataFrame:
    """What a stream wrote, and its closing batch."""
    closing(spark.read.parquet(folder + "/out")).write.parquet(folder + "/closing")
    schema = spark.read.parquet(folder + "/out").schema
    return spark.read.schema(schema).parquet(folder + "/out", folder + "/closing")


# Every interaction appears: with each feedback in its hour, or once without.
@query("stream_feedback", """
WITH f AS (SELECT user_id AS session_id, CAST(floor(value) % 7 AS INTEGER) AS rating, ts + INTERVAL 5 MINUTE AS fb_ts
           FROM events WHERE CAST(floor(value) % 7 AS INTEGER) BETWEEN 1 AND 5)
SELECT i.id, i.session_id, i.created_at, f.rating, f.fb_ts FROM v_interactions i LEFT JOIN f
        ON i.session_id = f.session_id AND f.fb_ts >= i.created_at AND f.fb_ts <= i.created_at + INTERVAL 1 HOUR""")
def q_stream_feedback(t):
    """Four micro-batches of late rows in no order, and a closing batch."""
    arrivals = _arrivals(t)
    e = _arriving(t.spark, t, arrivals)
    fb = e.select(e.user_id.alias("session_id"), (F.floor(e.value) % 7).cast("int").alias("rating"),
                  (e.ts + F.expr("INTERVAL 5 MINUTES")).alias("ts"))
    d = _dir(t.spark, "feedback")
    joined = SM.stream_feedback(V.interactions_of(_arriving(t.spark, t, arrivals)), fb.where(F.col("rating").between(1, 5)), lateness="1 day")
    q = (joined.writeStream.format("parquet").option("checkpointLocation", d + "/_checkpoint").trigger(availableNow=True).start(d + "/out"))
    q.awaitTermination()
    out = _closed(t.spark, d, lambda done: SM.pending_feedback(t.spark, d + "/_checkpoint", done))
    return (out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
            .withColumn("fb_ts", F.col("fb_ts").cast("timestamp_ntz")))


SESSIONS_SQL = """
WITH x AS (SELECT session_id, created_at, system_used, call_completed,
  CASE WHEN lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at) IS NULL
    OR created_at - lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at) >= INTERVAL 30 MINUTE
    THEN 1 ELSE 0 END AS brk FROM v_interactions),
y AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS sid FROM x)
SELECT session_id, min(created_at) AS session_start, max(created_at) + INTERVAL 30 MINUTE AS session_end,
  count(*) AS turns, epoch_us(max(created_at)) - epoch_us(min(created_at)) AS duration_us,
  CAST(round(CAST(count(*) FILTER (WHERE system_used = 'deep') * 100.0 / count(*) AS DECIMAL(38,10)), 1) AS DOUBLE)
    AS deep_share_pct,
  max(CAST(call_completed AS INTEGER)) = 1 AS completed
FROM y GROUP BY session_id, sid"""


@query("stream_sessions", SESSIONS_SQL)
def q_stream_sessions(t):
    """Batch twin over the whole table: the same session-window plan."""
    return SM.stream_sessions(V.interactions(t))


@query("stream_sessions_live", SESSIONS_SQL)
def q_stream_sessions_live(t):
    """The stream itself: four micro-batches of late rows, windows merged in
    state and appended behind the watermark, open ones by a closing batch."""
    d = _dir(t.spark, "sessions")
    sessions = SM.stream_sessions(V.interactions_of(_arriving(t.spark, t, _arrivals(t))), lateness="1 day")
    q = (sessions.writeStream.format("parquet").option("checkpointLocation", d + "/_checkpoint").trigger(availableNow=True).start(d + "/out"))
    q.awaitTermination()
    return _closed(t.spark, d, lambda done: SM.pending_sessions(t.spark, d + "/_checkpoint").select(*done.columns))


@query("stream_corrections", """SELECT "timestamp", user_input AS prompt, correction AS chosen, agent_response AS rejected, skill_used AS skill
  FROM v_feedback_log WHERE correction IS NOT NULL AND correction <> ''""")
def q_stream_corrections(t):
    spark = t.spark
    d = _dir(spark, "corrections-log")
    V.feedback_log(t).drop("conv_id", "turn").write.json(d + "/log")
    schema = ("timestamp timestamp_ntz, user_input string, agent_response string, skill_used string, "
              "rating int, correction string")
    s = spark.readStream.schema(schema).json(d + "/log")
    out = _run_to_files(SM.stream_corrections(s), "corrections")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


CYCLE_SQL = """
WITH c AS (SELECT "timestamp", user_input AS prompt, correction AS chosen, agent_response AS rejected, skill_used AS skill
  FROM v_feedback_log WHERE correction IS NOT NULL AND correction <> ''),
rc AS (SELECT DISTINCT skill, prompt, chosen, rejected FROM c
       WHERE "timestamp" > (SELECT max("timestamp") FROM c) - INTERVAL 30 DAY)
SELECT skill, count(*) AS n_pairs, '{version}' AS version FROM rc GROUP BY skill HAVING count(*) >= 3"""


@query("training_cycle", CYCLE_SQL.format(version="v1"))
def q_training_cycle(t):
    d = _dir(t.spark, "cycle")
    hist = CY.training_cycle(V.feedback_log(t), None, d + "/out", d + "/history", days=30, min_examples=3)
    return hist.select("skill", "n_pairs", "version")


@query("stream_training_cycle", CYCLE_SQL.format(version="v2"))
def q_stream_cycle(t):
    """The scheduled form: the feedback log comes in two micro-batches, each of
    which makes a version; the newest stands for the whole log."""
    spark, d = t.spark, _dir(t.spark, "live-cycle")
    log = V.feedback_log(t).select(*CY.LOG_COLUMNS)
    half = log.agg(F.percentile_approx(F.unix_micros(F.col("timestamp").cast("timestamp")), 0.5)).first()[0] or 0
    early = F.unix_micros(F.col("timestamp").cast("timestamp")) <= half
    n = 1 + (estimated_bytes(t.conversations) or 0) // (256 << 20)
    for part in (early, ~early):
        log.where(part).repartition(n).write.mode("append").parquet(d + "/in")
    table = VersionedTable(spark, d + "/log", log.schema)
    q = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", n).parquet(d + "/in").writeStream
         .foreachBatch(CY.cycle_sink(table, d + "/out", d + "/history", days=30, min_examples=3))
         .option("checkpointLocation", d + "/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return CY.history_table(spark, d + "/history").read().where("version = 'v2'").select("skill", "n_pairs", "version")
