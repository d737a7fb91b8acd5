"""Scans along keys in small blocks, and health events over micro-batches."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from convolake.functions import ordering
from convolake.functions.scan import Blocks, decayed_sum
from convolake.operators import adapters as AD
from convolake.operators import interactions as I
from convolake.session import rocksdb_session
from convolake.streaming import turns as ST


@pytest.fixture(autouse=True, params=["ranges", "small"])
def bound(request, monkeypatch):
    """Every test by ranges, and by the plan for an input that fits in a task."""
    monkeypatch.setattr(ordering, "ONE_TASK_BYTES", -1 if request.param == "ranges" else 1 << 70)


@pytest.mark.parametrize("alpha", [0.0, 1e-9, 0.1, 0.999999, 1.0])
@pytest.mark.parametrize("size", [7, 1 << 16])
def test_decayed_sum(spark, alpha, size):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice([None, 0.0, rng.uniform(-50, 100)])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, x double").repartition(4)
    got = {r.id: r.s for r in decayed_sum(df, ["k"], [F.asc("id")], F.col("x") * alpha, 1 - alpha, "s", size).collect()}
    state = {}
    for i, k, x in rows:
        s = state.get(k, 0.0)
        state[k] = s if x is None else (1 - alpha) * s + alpha * x
        assert got[i] == pytest.approx(state[k], rel=1e-9, abs=1e-9)


def test_long_decay_reaches_over_stretches(spark):
    n, alpha = 3000, 0.5  # blocks of 865 rows, 2079 powers of e in all
    df = spark.range(n).select("id", F.when(F.col("id") % 700 == 0, 1e6).otherwise(0.0).alias("x"))
    got = {r.id: r.s for r in decayed_sum(df, [], [F.asc("id")], F.col("x") * alpha, 1 - alpha, "s").collect()}
    s = 0.0
    for i in range(n):
        s = s / 2 + (5e5 if i % 700 == 0 else 0.0)
        assert got[i] == pytest.approx(s, rel=1e-9, abs=1e-250)


def test_previous_over_block_edges(spark):
    rows = [(i, "k" if i % 3 else None, None if i % 5 == 0 else i) for i in range(60)]
    blocks = Blocks(spark.createDataFrame(rows, "id int, k string, x int"), ["k"], [F.asc("id")], 4)
    got = {r.id: r.p for r in blocks.previous(blocks.rows, F.col("x"), "p").collect()}
    last = {}
    for i, k, x in rows:
        assert got[i] == last.get(k)
        last[k] = x


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_adapter_versions_of_a_hot_skill(spark, block):
    t0, rng = dt.datetime(2024, 1, 1), random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), t0 + dt.timedelta(days=rng.randrange(20)), rng.choice(["completed", "failed"]),
             rng.choice([None, 0.25, 0.5, 0.75])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, skill_id string, created_at timestamp, status string, final_loss double").repartition(5)
    got = {r.id: (r.version, r.is_active, r.loss_change) for r in AD.adapter_versions(df, block=block).collect()}
    for skill in ("hot", "b", None):
        mine = sorted((r for r in rows if r[1] == skill), key=lambda r: (r[2], r[0]))
        done = [r[0] for r in mine if r[3] == "completed"]
        for n, r in enumerate(mine):
            before = mine[n - 1][4] if n else None
            change = None if before is None or r[4] is None else r[4] - before
            assert got[r[0]] == (n + 1, r[0] == (done[-1] if done else None), change)


def test_whole_export_numbers_as_a_window(spark):
    cols = "id bigint, skill_id string, user_input string, agent_response string, user_feedback int, created_at timestamp, system_used string, error_occurred boolean, exported_for_training boolean"
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice(["hot", "hot", "b", None]), "q", "a", rng.randint(4, 5), dt.datetime(2024, 1, rng.randint(1, 4)), "deep", False, False)
                                for i in range(300)], cols).repartition(4)
    whole = I.export_candidates(df)
    assert sorted(map(str, whole.collect())) == sorted(map(str, I.export_candidates(df, limit_per_skill=10_000).collect()))


def _checks(n, rng):
    t0 = dt.datetime(2024, 1, 1)
    flags = lambda: [rng.choice([True, True, True, False, None]) for _ in ST.SERVICES]
    rows = [(t0 + dt.timedelta(minutes=rng.randrange(0, 14_400, 10)), *flags()) for _ in range(n)]
    return rows, "checked_at timestamp, " + ", ".join(f"{s}_healthy boolean" for s in ST.SERVICES)


def _brute(rows):
    out = []
    for at, name in enumerate(ST.SERVICES, 1):
        previous = None
        for t, ok in sorted((r[0], r[at]) for r in rows if r[0] is not None and r[at] is not None):
            if previous is None or ok != previous:
                out.append((name, t, previous, ok, "state_change"))
            if not ok:
                out.append((name, t, previous, ok, "down_alert"))
            previous = ok
    return sorted(map(str, out))


def test_health_batch_over_blocks(spark):
    rows, schema = _checks(200, random.Random(3))
    rows += [(None, *[True] * 5), rows[0]]
    df = spark.createDataFrame(rows, schema).repartition(4)
    for block in (1, 5, 1 << 16):
        assert sorted(str(tuple(r)) for r in ST.health_batch(df, block).collect()) == _brute(rows)


def test_health_stream_over_micro_batches(spark):
    """Shuffled rows, up to a day late, in five micro-batches; ranges of six
    hours are released behind the watermark, the rest by the closing batch."""
    rng = random.Random(5)
    rows, schema = _checks(150, rng)
    arrival = sorted(rows, key=lambda r: r[0] + dt.timedelta(minutes=rng.randrange(1440)))
    d = tempfile.mkdtemp(dir="/tmp")
    for k in range(5):
        part = arrival[k * 30:(k + 1) * 30]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(d + "/in")
    own = rocksdb_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d + "/in")
    q = (ST.stream_health(stream, "1 day", range_ms=6 * 3_600_000).writeStream.format("parquet").option("checkpointLocation", d + "/c")
         .trigger(availableNow=True).start(d + "/out"))
    q.awaitTermination()
    done = spark.read.parquet(d + "/out")
    waiting = ST.pending_health(own, d + "/c")
    assert done.count() > 100 and waiting.count() > 0
    got = [tuple(r) for r in done.collect()] + [tuple(r) for r in waiting.collect()]
    assert sorted(map(str, got)) == _brute(rows)
