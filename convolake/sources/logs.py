"""JSON-lines logs and partitioned training-set datasets (ops 1, 2, 7, 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: StructType) -> StructType:
    if CORRUPT in schema.fieldNames():
        return schema
    return StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])


def read_event_log(spark: SparkSession, path: str, schema: StructType | str,
                   streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """Op 1: read JSONL logs with an explicit schema; malformed lines go to a
    quarantine frame instead of failing the read.

    Returns ``(good, bad)``; ``bad`` has the raw line and its file.  With
    ``streaming=True`` both are streaming frames over the same folder.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    full = _with_corrupt(schema)
    # Lines are read as text and parsed with from_json: the corrupt-record
    # column is then an ordinary column (the JSON source refuses queries that
    # touch only that column, e.g. a count of the good rows).
    lines = (spark.readStream if streaming else spark.read).text(path)
    lines = lines.where(F.trim(F.col("value")) != "").withColumn("_source_file", F.col("_metadata.file_path"))
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE",
                                                      "columnNameOfCorruptRecord": CORRUPT}).alias("r"),
                          "value", "_source_file")
    df = parsed.select("r.*", "value", "_source_file")
    good = df.where(F.col(CORRUPT).isNull()).select(*schema.fieldNames())
    bad = df.where(F.col(CORRUPT).isNotNull()).select(F.col("value").alias("raw_line"), "_source_file")
    return good, bad


def write_training_set(df: DataFrame, path: str, layout: str = "instruction", skill: str = "skill",
                       as_of: str | None = None, mode: str = "overwrite") -> None:
    """Op 7: write a shaped training set as JSON lines, partitioned by skill
    (and an ``as_of`` batch date when given).  Only the partitions present in
    ``df`` are replaced (dynamic partition overwrite), so re-running one
    batch never touches other skills or dates."""
    cols = {"instruction": ["instruction", "input", "output"],
            "messages": ["messages"], "dpo": ["prompt", "chosen", "rejected"],
            "text": ["text"]}[layout]
    out = df.select(*cols, skill)
    parts = [skill]
    if as_of is not None:
        out = out.withColumn("as_of", F.lit(as_of))
        parts.append("as_of")
    _write_partitioned(out, parts, cols, mode, path)


def _write_partitioned(out: DataFrame, parts: list[str], cols: list[str], mode: str, path: str,
                       max_records: int = 1_000_000) -> None:
    """Range-partition on (partition columns, row hash) before writing: each
    task holds a contiguous slice, so it writes into few partitions, and a
    very large partition value is spread over several tasks instead of one;
    ``maxRecordsPerFile`` bounds the file size."""
    out = out.repartitionByRange(*[F.col(p) for p in parts], F.xxhash64(*[F.col(c) for c in cols]))
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records)
     .partitionBy(*parts).json(path))


def read_part_files(spark: SparkSession, root: str, skill: str | None = None,
                    schema: StructType | str | None = None) -> DataFrame:
    """Op 2: every dated part of a training dataset, excluding merged output
    (kept under ``as_of=merged``) – partition pruning on ``skill``."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.json(root)
    if "as_of" in df.columns:
        df = df.where(F.col("as_of").cast("string") != "merged")
    if skill is not None:
        df = df.where(F.col("skill") == skill)
    return df


def write_step_outputs(df: DataFrame, path: str, step: str = "step", data: str = "data",
                       mode: str = "overwrite") -> None:
    """Op 8: one JSON dataset per workflow step, only where data exists."""
    _write_partitioned(df.where(F.col(data).isNotNull()), [step], [data], mode, path)
