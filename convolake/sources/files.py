"""File sources: document scan and adapter registry folders (ops 3, 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.functions import lexicons as L
from convolake.functions.sizing import broadcast_if_small, param_table


def file_types(spark: SparkSession) -> DataFrame:
    """The supported-type table (ext, category, name)."""
    return param_table(spark, L.FILE_TYPES, "ext string, category string, name string")


def scan_documents(spark: SparkSession, path: str, types: DataFrame | None = None,
                   glob: str | None = None) -> DataFrame:
    """Op 3: recursive scan of a folder with the ``binaryFile`` source; keeps
    files with a supported extension and adds ``ext`` and ``category``.

    The content column is only read for rows that survive (column pruning
    keeps a listing-only query cheap)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(path)
    t = broadcast_if_small((types if types is not None else file_types(spark))
                           .select(F.col("ext").alias("__e"), "category"), "file types")
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([^./\\]+)$", 1))
    x = files.withColumn("ext", ext)
    return x.join(t, x["ext"] == t["__e"], "inner").drop("__e")


def read_adapter_metadata(spark: SparkSession, root: str,
                          meta_glob: str = "*/training_metadata.json") -> DataFrame:
    """Op 5: one row per adapter folder with its ``training_metadata.json``
    fields; a folder without metadata gets status ``unknown``."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
               .select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).distinct())
    meta = (spark.read.option("mode", "PERMISSIVE").json(root.rstrip("/") + "/" + meta_glob)
            .withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1)))
    x = listing.join(meta, "folder", "left")
    status = F.coalesce(F.col("status"), F.lit("unknown")) if "status" in meta.columns else F.lit("unknown")
    return (x.withColumn("status", status)
            .withColumn("adapter_name", F.regexp_extract("folder", r"([^/]+)$", 1)))
