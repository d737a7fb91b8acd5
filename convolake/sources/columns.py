"""JSON text columns and table profiles (ops 6, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, _parse_datatype_string


def decode_json_columns(df: DataFrame, specs: dict[str, DataType | str]) -> DataFrame:
    """Op 6: decode JSON text columns in place; null / empty / invalid text
    becomes an empty array or map (structs stay null).  The spec
    ``"variant"`` keeps free-form JSON as a VARIANT (``try_parse_json``)."""
    for col, t in specs.items():
        if t == "variant":
            df = df.withColumn(col, F.try_parse_json(F.nullif(F.trim(F.col(col)), F.lit(""))))
            continue
        dt = _parse_datatype_string(t) if isinstance(t, str) else t
        parsed = F.from_json(F.nullif(F.trim(F.col(col)), F.lit("")), dt, {"mode": "PERMISSIVE"})
        if isinstance(dt, ArrayType):
            parsed = F.coalesce(parsed, F.array().cast(dt))
        elif isinstance(dt, MapType):
            parsed = F.coalesce(parsed, F.create_map().cast(dt))
        df = df.withColumn(col, parsed)
    return df


def table_profile(tables: dict[str, DataFrame], key: str = "skill_id", approx: bool = False) -> DataFrame:
    """Op 9: row count and distinct ``key`` values per table (one global
    aggregate per table, unioned); ``approx=True`` counts with HyperLogLog."""
    out = None
    for name, d in tables.items():
        if key not in d.columns:
            distinct = F.lit(None).cast("bigint")
        else:
            distinct = F.approx_count_distinct(key, 0.01) if approx else F.countDistinct(key)
        row = d.agg(F.count("*").alias("row_count"), distinct.alias("distinct_skills")) \
            .select(F.lit(name).alias("table_name"), "row_count", "distinct_skills")
        out = row if out is None else out.unionByName(row)
    return out
