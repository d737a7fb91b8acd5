"""Windowed streaming aggregates and joins (ops 116, 117, 119, 120, 122).

Streams carry event time as ``TIMESTAMP`` (``withWatermark`` rejects the
NTZ type of the driver tables, so the time column is cast on entry).  Every
function also accepts a batch DataFrame, which is how the batch twins and
the tests run the very same plan.
"""

from __future__ import annotations

import functools
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convolake.functions.columns import round_half_up, round_int


def _ts(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def stream_hourly_metrics(stream: DataFrame, lateness: str = "2 hours", ts: str = "created_at") -> DataFrame:
    """Op 116: op 47 per event-time hour; rows up to ``lateness`` late still
    update their hour (watermark), later ones are dropped by the engine."""
    s = _ts(stream, ts).withWatermark(ts, lateness)
    g = s.groupBy(F.window(ts, "1 hour").alias("w")).agg(
        F.count("*").alias("total_calls"),
        F.count_if(F.col("system_used") == "fast").alias("system1_calls"),
        F.count_if(F.col("system_used") == "deep").alias("system2_calls"),
        F.avg("total_latency_ms").alias("__avg"),
        F.count_if(F.col("error_occurred")).alias("error_count"),
        F.sum("estimated_cost_usd").alias("__cost"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("hour_bucket"), "total_calls", "system1_calls",
                    "system2_calls", round_int("__avg").alias("avg_latency_ms"), "error_count",
                    F.col("__cost").cast("decimal(18,4)").alias("total_cost_usd"))


def hourly_upsert_sink(path: str, partition: str = "hour"):
    """``foreachBatch`` sink for op 116; idempotent on batch replay.

    ``partition="hour"``: the table is partitioned by hour and each batch
    overwrites exactly the hours it touched (dynamic partition overwrite –
    the hour is the key, so this is the upsert).  ``partition="day"``: fewer,
    larger files – the touched days are read back, the batch is merged into
    them with op 77 (``upsert_rows`` on ``hour_bucket``), the merge is cut
    with a reliable checkpoint (the job reads and rewrites the same
    partitions) and the touched days are overwritten.
    """
    def sink(batch: DataFrame, epoch_id: int) -> None:
        if partition == "hour":
            (batch.withColumn("hour", F.date_format("hour_bucket", "yyyyMMddHH"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("hour").parquet(path))
            return
        day_upsert_sink(path, "hour_bucket")(batch, epoch_id)
    return sink


def table_exists(spark, path: str) -> bool:
    """Whether a written table stands at ``path``; any other trouble with the
    storage raises."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def day_upsert_sink(path: str, key: str):
    """``foreachBatch`` sink for rows named by the time ``key``: the days that
    a batch touches are read back, its rows replace those of the same key, and
    the days are overwritten.  A replayed batch changes nothing."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        from convolake.operators.changes import upsert_rows
        from convolake.session import cut_lineage
        spark = batch.sparkSession
        merged = batch
        if table_exists(spark, path):
            batch = cut_lineage(batch)
            days = batch.select(F.date_format(key, "yyyyMMdd").alias("day")).distinct()
            old = spark.read.schema(_with_day(batch)).parquet(path).join(days, "day", "left_semi").drop("day")
            merged = upsert_rows(old, batch.select(*old.columns), key)
        merged = cut_lineage(merged.withColumn("day", F.date_format(key, "yyyyMMdd")))
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(path))
    return sink


def _with_day(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("day", StringType())])


def epoch_sink(path: str):
    """``foreachBatch`` sink that writes each micro-batch to its own
    ``epoch=<id>`` partition with overwrite: a batch replayed after a
    failure replaces its own output instead of appending a duplicate."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("epoch", F.lit(int(epoch_id))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path))
    return sink


# Default alert thresholds.
ALERT_THRESHOLDS = {"error_rate_pct": 5.0, "avg_latency_ms": 500}


def stream_alerts(stream: DataFrame, thresholds: dict | None = None, ts: str = "created_at",
                  lateness: str = "2 hours") -> DataFrame:
    """Op 117: sliding one-hour windows every five minutes; a window whose
    error rate exceeds the threshold raises an ``error`` alert, one whose
    average latency exceeds it a ``warning``.  Alerts are rows (the sink is
    a table, not a webhook)."""
    return alert_rows(stream_alert_windows(stream, thresholds, ts, lateness))


def alert_rows(windows: DataFrame) -> DataFrame:
    return windows.select("window_start", "window_end", "calls", F.inline("alerts"))


def stream_alert_windows(stream: DataFrame, thresholds: dict | None = None, ts: str = "created_at",
                         lateness: str = "2 hours") -> DataFrame:
    """The windows of op 117 with ``alerts`` as an array, empty where none
    holds.  In update mode a window comes again whenever it changes; a sink
    keyed by ``window_start`` (``day_upsert_sink``) keeps its newest state, so
    an alert that no longer holds goes."""
    th = {**ALERT_THRESHOLDS, **(thresholds or {})}
    s = _ts(stream, ts).withWatermark(ts, lateness)
    g = s.groupBy(F.window(ts, "1 hour", "5 minutes").alias("w")).agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("error_occurred")).alias("errors"),
        F.avg(F.coalesce(F.col("total_latency_ms"), F.lit(0))).alias("avg_latency"))
    rate = round_half_up(F.col("errors") * 100.0 / F.col("calls"), 2)
    alerts = F.array_compact(F.array(
        F.when(rate > th["error_rate_pct"], F.struct(F.lit("error").alias("severity"), F.lit("error_rate").alias("metric"),
                                                      rate.alias("value"))),
        F.when(F.col("avg_latency") > th["avg_latency_ms"],
               F.struct(F.lit("warning").alias("severity"), F.lit("avg_latency_ms").alias("metric"),
                        round_half_up("avg_latency", 1).alias("value")))))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "calls", alerts.alias("alerts"))


def stream_feedback(interactions: DataFrame, feedback: DataFrame, within: str = "1 hour",
                    lateness: str = "2 hours") -> DataFrame:
    """Op 119: each interaction with the session's feedback given within
    ``within`` after it – a stream-stream left outer join, both sides
    watermarked, so state is bounded by the time-range condition."""
    i = _ts(interactions, "created_at").withWatermark("created_at", lateness).alias("i")
    f = (_ts(feedback.select(F.col("session_id").alias("fb_session"), "rating", F.col("ts").alias("fb_ts")), "fb_ts")
         .withWatermark("fb_ts", lateness).alias("f"))
    cond = ((F.col("i.session_id") == F.col("f.fb_session"))
            & (F.col("f.fb_ts") >= F.col("i.created_at"))
            & (F.col("f.fb_ts") <= F.col("i.created_at") + F.expr(f"INTERVAL {within}")))
    return i.join(f, cond, "leftOuter").select("i.id", "i.session_id", "i.created_at", "f.rating", "f.fb_ts")


def pending_feedback(spark, checkpoint: str, emitted: DataFrame) -> DataFrame:
    """Interactions that wait without feedback in the state of a stopped
    ``stream_feedback``, in the columns of its result; a closing batch appends
    them.  The state also keeps interactions that have matched: these are in
    ``emitted``, what the stream has written so far."""
    names = ["id", "session_id", "created_at"]
    state = spark.read.format("statestore").option("path", checkpoint).option("joinSide", "left").load()
    waiting = state.select(*[F.col(f"value.{c}").alias(c) for c in names])
    done = emitted.select(*[F.col(c).alias(f"__{c}") for c in names]).distinct()
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
    return waiting.join(done, same, "left_anti").select(
        *names, *[F.lit(None).cast(emitted.schema[c].dataType).alias(c) for c in ("rating", "fb_ts")])


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", key: str = "session_id",
                    ts: str = "created_at", lateness: str = "2 hours") -> DataFrame:
    """Op 120: session windows per caller – turns, duration, deep share and
    completion.  The same function runs on a batch frame (batch twin)."""
    s = _ts(stream, ts)
    if stream.isStreaming:
        s = s.withWatermark(ts, lateness)
    g = s.groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("turns"),
        F.min(ts).alias("__first"), F.max(ts).alias("__last"),
        F.count_if(F.col("system_used") == "deep").alias("__deep"),
        F.max(F.col("call_completed").cast("int")).alias("__done"))
    return _session_rows(g, key)


def _session_rows(g: DataFrame, key: str) -> DataFrame:
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("session_end"), "turns",
                    (F.unix_micros("__last") - F.unix_micros("__first")).alias("duration_us"),
                    round_half_up(F.col("__deep") * 100.0 / F.col("turns"), 1).alias("deep_share_pct"),
                    (F.col("__done") == 1).alias("completed"))


def pending_sessions(spark, checkpoint: str, key: str = "session_id") -> DataFrame:
    """Sessions still open in the state of a stopped ``stream_sessions``, as it
    would write them if nothing more came; a closing batch appends them."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    kind = state.schema["value"].dataType
    # the state holds the key, the window and the aggregates in their order
    names = [key, "w", "turns", "__first", "__last", "__deep", "__done"]
    value = StructType([StructField(n, f.dataType) for n, f in zip(names, kind.fields)])
    return _session_rows(state.select(F.col("value").cast(value).alias("v")).select("v.*"), key)


def stream_corrections(stream: DataFrame, lateness: str = "1 day", ts: str = "timestamp") -> DataFrame:
    """Op 122: logged feedback → preference pairs, appended as they arrive;
    the same pair logged twice within the watermark is emitted once."""
    s = _ts(stream, ts).withWatermark(ts, lateness)
    c = F.col("correction")
    pairs = s.where(c.isNotNull() & (c != "")).select(
        ts, F.col("user_input").alias("prompt"), c.alias("chosen"), F.col("agent_response").alias("rejected"),
        F.col("skill_used").alias("skill"))
    if stream.isStreaming:
        return pairs.dropDuplicatesWithinWatermark(["skill", "prompt", "chosen", "rejected"])
    return pairs.dropDuplicates(["skill", "prompt", "chosen", "rejected"])
