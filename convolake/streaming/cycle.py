"""Scheduled training cycle (op 123): one job for all skills, in batch or as a
stream of the feedback log.

The history is a versioned table: a training set counts only once its history
rows are published, in one step.  A run that dies between data and history
leaves files that no version names, and the old version visible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from convolake.operators import curation as C
from convolake.session import staged
from convolake.sources.logs import write_training_set
from convolake.sources.versioned import VersionedTable

HISTORY = StructType([StructField("skill", StringType()), StructField("n_pairs", LongType()), StructField("as_of", TimestampNTZType()),
                      StructField("output_path", StringType()), StructField("version", StringType())])
LOG_COLUMNS = ("timestamp", "user_input", "agent_response", "skill_used", "rating", "correction")


def history_table(spark, path: str) -> VersionedTable:
    return VersionedTable(spark, path, HISTORY)


def training_cycle(log: DataFrame, as_of, out_path: str, history_path: str, days: int = 7,
                   min_examples: int = 10, version: str | None = None) -> DataFrame:
    """Op 123: gate (op 60) → preference dataset (op 94) → versioned JSONL output per
    skill (op 7) → one history row per trained skill.

    Every skill is handled in the same job (no per-skill loop or re-read of
    the logs).  The recent part of the log and the dataset are each written once
    and read from there by what follows.  ``version`` defaults to the next free
    one; a version that is run again replaces its own output and history rows.
    Returns the history rows written by this run.
    """
    spark = log.sparkSession
    history = history_table(spark, history_path)
    ver = version or f"v{history.version() + 1}"
    # without a date, corrections count back from the newest of them and ratings from the newest row
    corrected = F.col("correction").isNotNull() & (F.col("correction") != "")
    newest, newest_pair = (as_of, as_of) if as_of is not None else log.agg(F.max("timestamp"), F.max(F.when(corrected, F.col("timestamp")))).first()
    recent = staged(C.recent(log, "timestamp", newest_pair, days).select(*LOG_COLUMNS), "cycle-log")
    data = staged(C.preference_dataset(C.correction_pairs(recent), recent, as_of, days), "cycle-pairs")
    gate = staged(C.enough_to_train(data.select("skill", "prompt", "chosen", "rejected"), min_examples), "cycle-gate")
    chosen = data.join(gate.select("skill"), "skill", "left_semi")
    write_training_set(chosen, out_path, "dpo", skill="skill", as_of=ver)
    rows = gate.select("skill", "n_pairs", F.lit(newest).cast("timestamp_ntz").alias("as_of"),
                       F.concat(F.lit(out_path.rstrip("/") + "/skill="), F.col("skill")).alias("output_path"), F.lit(ver).alias("version"))
    history.replace(rows, "version", ver)
    return history.read().where(F.col("version") == ver)


def cycle_sink(log: VersionedTable, out_path: str, history_path: str, days: int = 7, min_examples: int = 10) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink of the streaming form: each micro-batch of feedback
    becomes a version of the log, and version ``v<n>`` of the training sets is
    made from the log as it then stands.  Run it with ``availableNow`` by a
    schedule.  A batch that is replayed after a failure finds its log rows in
    place and replaces its own version."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        number = int(epoch_id) + 1
        if log.version() < number:
            log.append(batch.select(*LOG_COLUMNS))
        training_cycle(log.read(number), None, out_path, history_path, days, min_examples, f"v{number}")
    return sink
