"""Turn machine fixtures, batch/stream equality and streaming smoke tests."""

import datetime as dt
import os
import tempfile

import pandas as pd

from convolake.operators import interactions as I
from convolake.plans import views as V
from convolake.session import rocksdb_session
from convolake.streaming import metrics as SM
from convolake.streaming import turns as ST


def test_stream_hourly_equals_batch(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    t = V.Tables(spark, "/root/testdata/sf0.001")
    costed = lambda e: I.interaction_cost(I.derive_interaction(V.interactions_of(e)), V.prices(spark))
    batch = I.hourly_metrics(costed(t.events))
    q = (SM.stream_hourly_metrics(costed(t.stream("events"))).writeStream.outputMode("update")
         .foreachBatch(SM.hourly_upsert_sink(d + "/t")).option("checkpointLocation", d + "/c")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(d + "/t").drop("hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))


def test_stream_health_equals_batch(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    t = V.Tables(spark, "/root/testdata/sf0.001")
    own = rocksdb_session(spark)
    q = (ST.stream_health(V.health_of(V.Tables(own, t.sf_dir).stream("events"))).writeStream.format("parquet")
         .option("checkpointLocation", d + "/c").trigger(availableNow=True).start(d + "/o"))
    q.awaitTermination()
    b = ST.health_batch(V.health(t))
    s = spark.read.schema(b.schema).parquet(d + "/o").collect() + ST.pending_health(own, d + "/c").collect()
    assert sorted(map(str, s)) == sorted(map(str, b.collect()))


def test_sessions_batch_twin(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0, "fast", True), (1, t0 + dt.timedelta(minutes=10), "deep", False),
                                (1, t0 + dt.timedelta(minutes=50), "fast", False)],
                               "session_id bigint, created_at timestamp_ntz, system_used string, call_completed boolean")
    out = sorted((r.turns, r.deep_share_pct, r.completed) for r in SM.stream_sessions(df).collect())
    assert out == [(1, 0.0, False), (2, 50.0, True)]


def test_corrections_dedup_batch(spark):
    ts = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(ts, "q", "a", "s", 1, "b"), (ts, "q", "a", "s", 1, "b"), (ts, "q", "a", "s", 5, None)],
                                "timestamp timestamp_ntz, user_input string, agent_response string, skill_used string, "
                                "rating int, correction string")
    assert SM.stream_corrections(log).count() == 1


def _calls(spark, rows):
    return spark.createDataFrame(rows, "id bigint, session_id bigint, created_at timestamp_ntz, error_occurred boolean, "
                                       "total_latency_ms int")


def test_alert_rows(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 2)
    df = _calls(spark, [(1, 1, t0, True, 100), (2, 1, t0, False, 1000)])
    out = SM.stream_alerts(df).collect()
    kinds = {(r.severity, r.metric) for r in out}
    assert kinds == {("error", "error_rate"), ("warning", "avg_latency_ms")}
    assert {r.value for r in out if r.metric == "error_rate"} == {50.0} and len(out) == 24   # 12 windows × 2


def test_alerts_over_several_batches(spark):
    """Windows that change in later batches are replaced; an alert that no
    longer holds goes.  Files arrive in any order of time."""
    import random
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1, 20)
    rows = [(i, i % 9, t0 + dt.timedelta(minutes=rng.randint(0, 600)), rng.random() < 0.06, rng.randint(100, 900)) for i in range(600)]
    rng.shuffle(rows)
    d = tempfile.mkdtemp(dir="/tmp")
    for k in range(4):
        _calls(spark, rows[k::4]).coalesce(1).write.mode("append").parquet(d + "/in")
    calls = spark.readStream.schema(_calls(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(d + "/in")
    q = (SM.stream_alert_windows(calls, lateness="2 days").writeStream.outputMode("update")
         .foreachBatch(SM.day_upsert_sink(d + "/t", "window_start")).option("checkpointLocation", d + "/c").trigger(availableNow=True).start())
    q.awaitTermination()
    got = SM.alert_rows(spark.read.schema(SM.stream_alert_windows(_calls(spark, [])).schema).parquet(d + "/t"))
    want = SM.stream_alerts(_calls(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_feedback_join_time_range(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    calls = _calls(spark, [(1, 7, t0, False, 1), (2, 8, t0, False, 1)])
    fb = spark.createDataFrame([(7, 5, t0 + dt.timedelta(minutes=30)), (8, 4, t0 + dt.timedelta(hours=2))],
                               "session_id bigint, rating int, ts timestamp_ntz")
    out = {r.id: r.rating for r in SM.stream_feedback(calls, fb).collect()}
    assert out == {1: 5, 2: None}


def test_epoch_sink_is_idempotent(spark):
    d = tempfile.mkdtemp(dir="/tmp") + "/alerts"
    sink = SM.epoch_sink(d)
    batch = spark.createDataFrame([(1,)], "x int")
    sink(batch, 0)
    sink(batch, 0)   # replay of the same epoch
    sink(batch, 1)
    assert spark.read.parquet(d).count() == 2


def test_day_partitioned_upsert_sink(spark):
    d = tempfile.mkdtemp(dir="/tmp") + "/hourly"
    sink = SM.hourly_upsert_sink(d, partition="day")
    schema = ("hour_bucket timestamp_ntz, total_calls bigint, system1_calls bigint, system2_calls bigint, "
              "avg_latency_ms int, error_count bigint, total_cost_usd decimal(18,4)")
    t = dt.datetime
    b1 = spark.createDataFrame([(t(2024, 1, 1, 8), 2, 2, 0, 10, 0, None), (t(2024, 1, 1, 9), 1, 1, 0, 5, 0, None)], schema)
    b2 = spark.createDataFrame([(t(2024, 1, 1, 9), 3, 2, 1, 7, 1, None), (t(2024, 1, 2, 0), 1, 1, 0, 1, 0, None)], schema)
    sink(b1, 0)
    sink(b2, 1)
    sink(b2, 1)   # replay
    got = {r.hour_bucket: r.total_calls for r in spark.read.parquet(d).collect()}
    assert got == {t(2024, 1, 1, 8): 2, t(2024, 1, 1, 9): 3, t(2024, 1, 2, 0): 1}
