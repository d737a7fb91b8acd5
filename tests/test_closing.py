"""Streams over several micro-batches of late, shuffled rows, with their closing
batches, against the batch forms; the training cycle as a stream."""

import datetime as dt
import random
import tempfile

import pytest

from convolake.sources.versioned import VersionedTable
from convolake.streaming import cycle as CY
from convolake.streaming import metrics as SM

CALLS = "id bigint, session_id bigint, created_at timestamp_ntz, system_used string, call_completed boolean"
FEEDBACK = "session_id bigint, rating int, ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def arrivals(spark):
    rng = random.Random(1)
    calls = [(i, rng.choice([None, 0, 0, 0, 1, 2, 3]), T0 + dt.timedelta(minutes=rng.randrange(1500)), rng.choice(["deep", "fast"]), rng.random() < .5) for i in range(200)]
    given = [(rng.randrange(5), rng.randint(1, 5), T0 + dt.timedelta(minutes=rng.randrange(1500))) for _ in range(80)]
    d = tempfile.mkdtemp(dir="/tmp")
    for rows, schema, name in ((calls, CALLS, "calls"), (given, FEEDBACK, "given")):
        late = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(110)))
        for k in range(4):
            part = late[k * len(rows) // 4:(k + 1) * len(rows) // 4]
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{d}/{name}")
    read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}")
    return calls, given, lambda: read(CALLS, "calls"), lambda: read(FEEDBACK, "given")


def _run(df):
    d = tempfile.mkdtemp(dir="/tmp")
    df.writeStream.format("parquet").option("checkpointLocation", d + "/c").trigger(availableNow=True).start(d + "/o").awaitTermination()
    return d


def _sorted(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_feedback_is_whole(spark, arrivals):
    calls, given, read_calls, read_given = arrivals
    d = _run(SM.stream_feedback(read_calls(), read_given()))
    done = spark.read.parquet(d + "/o")
    waiting = SM.pending_feedback(spark, d + "/c", done)
    assert done.where("rating is null").count() > 0 and waiting.count() > 0
    hour = dt.timedelta(hours=1)
    want = []
    for i, s, at, *_ in calls:
        hits = [(r, t) for k, r, t in given if k == s and at <= t <= at + hour]
        want += [(i, s, at, r, t) for r, t in hits or [(None, None)]]
    assert _sorted(done.collect() + waiting.collect()) == _sorted(want)


def test_sessions_are_whole(spark, arrivals):
    calls, _, read_calls, _ = arrivals
    d = _run(SM.stream_sessions(read_calls()))
    done, waiting = spark.read.parquet(d + "/o"), SM.pending_sessions(spark, d + "/c")
    assert done.count() > 0 and waiting.count() > 0
    batch = SM.stream_sessions(spark.createDataFrame(calls, CALLS))
    assert _sorted(done.collect() + waiting.select(*done.columns).collect()) == _sorted(batch.select(*done.columns).collect())


LOG = "timestamp timestamp_ntz, user_input string, agent_response string, skill_used string, rating int, correction string"


def _log(n, first=0):
    return [(T0 + dt.timedelta(hours=i), f"q{i % 30}", "a", f"s{i % 2}", 1 + i % 5, "better" if i % 3 else None) for i in range(first, first + n)]


def test_cycle_stream_makes_versions(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    for k in range(3):
        spark.createDataFrame(_log(40, 40 * k), LOG).coalesce(1).write.mode("append").parquet(d + "/in")
    log = VersionedTable(spark, d + "/log", spark.createDataFrame([], LOG).schema)
    sink = CY.cycle_sink(log, d + "/out", d + "/history", days=2, min_examples=2)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(d + "/in")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", d + "/c").trigger(availableNow=True).start().awaitTermination()
    rows = CY.history_table(spark, d + "/history").read().collect()
    assert {r.version for r in rows} == {"v1", "v2", "v3"}
    d2 = tempfile.mkdtemp(dir="/tmp")
    whole = CY.training_cycle(spark.createDataFrame(_log(120), LOG), None, d2 + "/out", d2 + "/history", 2, 2, "v3")
    assert {(r.skill, r.n_pairs, r.as_of) for r in rows if r.version == "v3"} == {(r.skill, r.n_pairs, r.as_of) for r in whole.collect()}
    sink(spark.createDataFrame(_log(40, 80), LOG), 2)  # replayed: nothing is doubled
    assert log.read().count() == 120 and _sorted(CY.history_table(spark, d + "/history").read().collect()) == _sorted(rows)


def test_a_cycle_that_dies_is_not_seen(spark, monkeypatch):
    d = tempfile.mkdtemp(dir="/tmp")
    log = spark.createDataFrame(_log(60), LOG)
    CY.training_cycle(log, None, d + "/out", d + "/history", 30, 2)
    before = _sorted(CY.history_table(spark, d + "/history").read().collect())
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            CY.training_cycle(log, None, d + "/out", d + "/history", 30, 2)
    assert _sorted(CY.history_table(spark, d + "/history").read().collect()) == before
    assert {r.version for r in CY.training_cycle(log, None, d + "/out", d + "/history", 30, 2).collect()} == {"v2"}
