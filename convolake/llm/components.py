"""Connected components by contraction over an edge table.

Every round each vertex takes the smallest hashed id of its neighbourhood,
edges are renamed accordingly and loops and repeats dropped.  Hashed ids stand
in random order, so a round removes a constant share of the vertices whatever
the shape of the graph; a star, however large, needs two or three rounds.
Groupings are pre-aggregated per task and joins read written tables on both
sides, so Spark may split a hot vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id in an edge; ``component`` is the
    smallest id that can be reached.  Loops and repeated edges do no harm."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # xxhash64 of one 64-bit integer is a bijection: hashed ids never clash
    labels = staged(ids.select("id", F.xxhash64(F.col("id").cast("bigint")).alias("root")), "cc-ids")
    current = staged(pairs.where("a <> b").select(F.xxhash64(F.col("a").cast("bigint")).alias("a"),
                                                   F.xxhash64(F.col("b").cast("bigint")).alias("b")).distinct(), "cc-edges")
    while not current.isEmpty():
        both = current.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        best = staged(both.groupBy(F.col("e.a").alias("v")).agg(F.min("e.b").alias("n"))
                      .select("v", F.least("v", "n").alias("to")), "cc-best")
        left = current.join(best.withColumnRenamed("v", "a"), "a").select(F.col("to").alias("x"), "b")
        renamed = left.join(best.withColumnRenamed("v", "b"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
        current = staged(renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        labels = staged(labels.join(best.withColumnRenamed("v", "root"), "root", "left")
                        .select("id", F.coalesce("to", "root").alias("root")), "cc-ids")
    least = staged(labels.groupBy("root").agg(F.min("id").alias("component")), "cc-least")
    return labels.join(least, "root").select("id", "component")
