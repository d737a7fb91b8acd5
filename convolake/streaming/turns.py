"""Service health state (op 118) as keyed streaming state with event-time timers.

``transformWithState`` needs the RocksDB state store; ``streaming.session``
gives a session with it that leaves the caller's settings alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from convolake.functions.scan import Blocks

# times are microseconds inside the processors: a Python timestamp depends on the zone of its process
_OUT = "service string, at bigint, previous boolean, healthy boolean, event string"
SERVICES = ("groq", "anthropic", "deepgram", "cartesia", "livekit")
#: checks of a range as they came, a 64-bit word each: the time, then the flag as the lowest bit
_CHECKS = StructType([StructField("words", BinaryType())])
_LAST = StructType([StructField("healthy", BooleanType())])
#: checks turned into events, or read from the state store, at once
_SLICE = 50_000
#: lanes over which finished events of a service are spread on their way out
LANES = 64


def health_long(df: DataFrame, services=SERVICES) -> DataFrame:
    """One row per check and service; checks without a time or a result have
    no place in the order and are left out."""
    rows = F.array(*[F.struct(F.lit(s).alias("service"), F.col(f"{s}_healthy").alias("healthy")) for s in services])
    long = df.select(F.col("checked_at").cast("timestamp").alias("checked_at"), F.inline(rows))
    return long.where("checked_at is not null and healthy is not null")


class _Ranges(StatefulProcessor):
    """Holds the checks of one service and time range until the watermark has
    passed the range, then releases them in order.  What the first check of the
    range follows is not known here: it goes out as an ``edge`` with the last
    value of the range, all others as finished events."""

    def __init__(self, range_ms: int):
        self.range_ms = range_ms

    def init(self, handle):
        self.handle = handle
        self.rows = handle.getListState("rows", _CHECKS)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            self.rows.appendValue((_packed(pdf["at"], pdf["healthy"]),))
        self.handle.registerTimer((key[1] + 1) * self.range_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        words = [np.frombuffer(w, dtype="<i8") for (w,) in self.rows.get()]
        self.rows.clear()
        if words:
            yield from _events(key[0], np.sort(np.concatenate(words)))

    def close(self):
        pass


def _packed(at: pd.Series, healthy: pd.Series) -> bytes:
    """Words sort as (time, flag) does."""
    return (at.to_numpy(dtype="<i8") << 1 | healthy.to_numpy(dtype=bool)).astype("<i8").tobytes()


def _events(service: str, words: np.ndarray):
    """Events of sorted checks; the first row is the edge and carries the last value."""
    yield _frame(service, 0, words[:1] >> 1, None, (words[:1] & 1) > 0, "edge", bool(words[-1] & 1))
    for k in range(1, len(words), _SLICE):
        at, ok = words[k:k + _SLICE] >> 1, (words[k:k + _SLICE] & 1) > 0
        previous = (words[k - 1:k - 1 + len(ok)] & 1) > 0
        # every failed check raises an alert, as the scheduled check does
        for found, event in ((ok != previous, "state_change"), (~ok, "down_alert")):
            if found.any():
                yield _frame(service, 1 + at[found] % LANES, at[found], previous[found], ok[found], event, None)


def _frame(service: str, lane, at, previous, healthy, event: str, last) -> pd.DataFrame:
    return pd.DataFrame({"service": service, "lane": lane, "at": at, "previous": previous, "healthy": healthy, "event": event, "last": last})


class _Edges(StatefulProcessor):
    """Carries the last value of a range over to the next one.  All ranges that
    end behind the watermark come in one micro-batch and later ones only
    afterwards, so sorting the edges of a batch puts them in their order."""

    def init(self, handle):
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows, timerValues):
        columns = [c.split()[0] for c in _OUT.split(", ")]
        if key[1] != 0:
            for pdf in rows:
                yield pdf[columns]
            return
        previous = self.last.get()[0] if self.last.exists() else None
        out = []
        edges = sorted((at, ok, last) for pdf in rows for at, ok, last in zip(pdf["at"], pdf["healthy"], pdf["last"]))
        for at, ok, last in edges:
            if previous is None or bool(ok) != previous:
                out.append((key[0], at, previous, bool(ok), "state_change"))
            if not ok:
                out.append((key[0], at, previous, False, "down_alert"))
            previous = bool(last)
        self.last.update((previous,))
        yield pd.DataFrame(out, columns=columns)

    def close(self):
        pass


def stream_health(stream: DataFrame, lateness: str = "1 hour", range_ms: int = 86_400_000) -> DataFrame:
    """Op 118: per service the changes of the health flag and a down alert for
    every failed check, each with the value before it.

    State is keyed by (service, range of ``range_ms``), so the checks of one
    service are spread over many keys; a check takes eight bytes there, and the
    checks that come together are one value.  A second state per service holds one value.  Checks later than ``lateness``
    are dropped by the watermark.  Checks of one time stand with the failed one
    first.  What the watermark has not passed yet waits in state;
    ``pending_health`` reads it from there."""
    checks = health_long(stream).withWatermark("checked_at", lateness).withColumn("at", F.unix_micros("checked_at"))
    ranges = checks.withColumn("range", F.floor(F.col("at") / (range_ms * 1000)))
    released = ranges.groupBy("service", "range").transformWithStateInPandas(
        _Ranges(range_ms), "service string, lane int, at bigint, previous boolean, healthy boolean, event string, last boolean", "Append", "EventTime")
    events = released.groupBy("service", "lane").transformWithStateInPandas(_Edges(), _OUT, "Append", "None")
    return events.select("service", F.timestamp_micros("at").alias("checked_at"), "previous", "healthy", "event")


def _unpacked(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            words = np.frombuffer(batch.column(1)[k].as_py(), dtype="<i8")
            for part in (words[a:a + _SLICE] for a in range(0, len(words), _SLICE)):
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(part)), pa.array((part & 1) > 0), pa.array(part >> 1)],
                                                 ["service", "healthy", "at"])


def pending_health(spark, checkpoint: str) -> DataFrame:
    """The events of checks that wait behind the watermark of a stopped
    ``stream_health``: rows of open ranges from the state store, after the last
    value that each service was left with.  A closing batch appends them."""
    read = spark.read.format("statestore").option("path", checkpoint)
    # the state of the later operator has the lower id
    last = (read.option("operatorId", 0).option("stateVarName", "last").load()
            .select(F.col("key.service").alias("service"), F.col("value.healthy").alias("healthy"), F.lit(None).cast("timestamp").alias("checked_at")))
    held = (read.option("operatorId", 1).option("stateVarName", "rows").option("flattenCollectionTypes", True).load()
            .select(F.col("key.service").alias("service"), F.col("list_element.words").alias("words")))
    rows = held.mapInArrow(_unpacked, "service string, healthy boolean, at bigint").withColumn("checked_at", F.timestamp_micros("at")).drop("at")
    # an older value stands before all that waits
    return _changes(last.unionByName(rows)).where("checked_at is not null")


def _changes(x: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Changes and alerts of each service, by a scan over blocks of its checks."""
    blocks = Blocks(x, ["service"], [F.asc_nulls_first("checked_at"), F.asc("healthy")], block)
    x = blocks.previous(blocks.rows, F.col("healthy"), "previous")
    changed = F.col("previous").isNull() | (F.col("previous") != F.col("healthy"))
    ev = F.array_compact(F.array(F.when(changed, F.lit("state_change")), F.when(~F.col("healthy"), F.lit("down_alert"))))
    return x.select("service", "checked_at", "previous", "healthy", F.explode(ev).alias("event"))


def health_batch(df: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Batch twin of op 118: the same events from a whole table."""
    return _changes(health_long(df), block)
