"""Turns of conversations in order, however long a conversation is.

Rows are dealt by range of (conversation, turn, role, text) and sorted inside
each range, so that a conversation that holds a third of all rows is spread over
many tasks.  A task sees whole conversations, except that the first and the last
of its range may go on in a neighbour; operators hand those on as segments,
ordered by (``part``, ``seq``), and put them together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.functions.sizing import estimated_bytes
from convolake.llm.common import shuffle_partitions

#: bytes of input a range should hold; estimates beyond UNKNOWN are none
RANGE_BYTES, UNKNOWN = 64 << 20, 1 << 50


def ranges_for(source: DataFrame) -> int:
    """How many ranges the rows read from ``source`` should make."""
    size = estimated_bytes(source) or 0
    return max(shuffle_partitions(source.sparkSession), -(-size // RANGE_BYTES) if size < UNKNOWN else 0)


def in_ranges(rows: DataFrame, n: int, *carry: str) -> DataFrame:
    """``conv_id, turn, role, text`` and the ``carry`` columns, sorted by them
    within ``n`` ranges (nulls first).  Rows of one turn stand by the first 32 code
    points of the role, the first 64 of the text, then role and text."""
    heads = [F.left("role", F.lit(32)).alias("__r"), F.left("text", F.lit(64)).alias("__t")]
    keys = ["conv_id", "turn", "__r", "__t"]
    return (rows.select("conv_id", "turn", "role", "text", *carry, *heads)
            .repartitionByRange(n, *keys).sortWithinPartitions(*keys, "role", "text").drop("__r", "__t"))


def rows_of(batches: Iterable[pa.RecordBatch], step: int = 2000) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, converted a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(c.to_pylist() for c in part.columns))


def part_id() -> int:
    return TaskContext.get().partitionId()


def by_conversation(segments: DataFrame) -> DataFrame:
    """Segments of one conversation in one task, in order, streamed."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
