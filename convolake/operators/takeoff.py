"""Drawing takeoff from an entity table.

One row per drawing entity (``cad_entities`` schema, FIXTURES §1).
Geometry folds (polyline length, bounds, area) are higher-order functions
over the entity's own point array – JVM only, no UDF.  Several lenses are
usually computed from one scan: callers may ``persist()`` the entity table
(the scan-once pattern of the reference).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions.columns import round_half_up, strip
from convolake.functions.sizing import broadcast_if_small

# Drawing unit codes → (name, feet per unit); miles corrected to 5280 (Q12).
UNITS = {0: ("Unitless", 1.0), 1: ("Inches", 1 / 12.0), 2: ("Feet", 1.0), 3: ("Miles", 5280.0),
         4: ("Millimeters", 0.00328084), 5: ("Centimeters", 0.0328084), 6: ("Meters", 3.28084)}
GEOMETRY_TYPES = ["LWPOLYLINE", "POLYLINE", "LINE", "CIRCLE", "ARC"]
ENTITY_TYPES = ["LINE", "LWPOLYLINE", "CIRCLE", "ARC", "TEXT", "MTEXT", "INSERT", "DIMENSION", "LEADER"]
# Output recommendations by content.
REC_SPATIAL = "SPATIAL - Good for layer analysis and spatial relationships"
REC_QUANTITY = "QUANTITY - Good for linear footage takeoffs"
REC_SPECS = "SPECS - Good for extracting notes and dimensions"
REC_BLOCKS = "QUANTITY - Will count blocks (drains, scuppers, etc.)"
REC_FULL = "FULL - Recommended for complete data extraction"


def with_feet(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Attach ``to_feet`` by unit code (unknown code → 1.0)."""
    u = broadcast_if_small(units.select(F.col("code").alias("__uc"), F.col("to_feet").alias("__tf")), "units")
    return (entities.join(u, entities["units_code"] == u["__uc"], "left")
            .withColumn("to_feet", F.coalesce(F.col("__tf"), F.lit(1.0))).drop("__uc", "__tf"))


def _dist(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def path_length(points: Column, closed: Column) -> Column:
    """Sum of segment lengths (+ closing segment when closed, ≥ 2 points);
    arc bulges are ignored (chord length, Q13)."""
    n = F.size(points)
    segs = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))),
                      F.slice(points, 2, F.greatest(n - 1, F.lit(0))), _dist)
    open_len = F.aggregate(segs, F.lit(0.0), lambda acc, d: acc + d)
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    closing = F.when(closed & (n > 1), _dist(last, first)).otherwise(0.0)
    return open_len + closing


def entity_length(type_col: str = "type") -> Column:
    """Raw length of a LINE (start–end) or LWPOLYLINE (segments), else null."""
    p = F.col("points")
    return (F.when(F.col(type_col) == "LINE", _dist(F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2))))
            .when(F.col(type_col) == "LWPOLYLINE", path_length(p, F.coalesce(F.col("closed"), F.lit(False)))))


def entity_preview(entities: DataFrame, n_samples: int = 5) -> DataFrame:
    """Op 109: per drawing – counts by type, sorted layers and block names,
    first text samples (≤ 50 chars, entity order) and recommendations.

    Text samples come from a per-drawing ``row_number`` over text entities
    only, so at most ``n_samples`` values are ever collected per drawing.
    """
    t = F.col("type")
    w = Window.partitionBy("drawing").orderBy("entity_id")
    samples = (entities.where(t.isin("TEXT", "MTEXT"))
               .withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n_samples)
               .groupBy("drawing").agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", F.left(
                   F.col("text"), F.lit(50)).alias("s")))), lambda x: x["s"]).alias("text_samples")))
    by_type = entities.groupBy("drawing", "type").agg(F.count("*").alias("__n"))
    counts = by_type.groupBy("drawing").agg(
        F.array_sort(F.collect_list(F.concat(F.col("type"), F.lit(":"), F.col("__n").cast("string"))))
        .alias("entity_counts"),
        F.sum("__n").alias("total_entities"),
        *[F.sum(F.when(F.col("type") == k, F.col("__n"))).alias(f"__{k}")
          for k in ("LINE", "LWPOLYLINE", "TEXT", "MTEXT", "DIMENSION", "INSERT")])
    names = entities.groupBy("drawing").agg(
        F.array_sort(F.collect_set("layer")).alias("layers"),
        F.array_sort(F.collect_set(F.when(t == "INSERT", F.col("block_name")))).alias("block_names"))
    x = counts.join(names, "drawing").join(samples, "drawing", "left")
    z = lambda k: F.coalesce(F.col(f"__{k}"), F.lit(0))
    geo, txt, dim, blk = z("LINE") + z("LWPOLYLINE") > 0, z("TEXT") + z("MTEXT") > 0, z("DIMENSION") > 0, z("INSERT") > 0
    recs = F.array_compact(F.array(
        F.when(geo, F.lit(REC_SPATIAL)), F.when(geo, F.lit(REC_QUANTITY)),
        F.when(txt | dim, F.lit(REC_SPECS)), F.when(blk, F.lit(REC_BLOCKS))))
    recs = F.when(F.size(recs) == 0, F.array(F.lit(REC_FULL))).otherwise(recs)
    return x.select("drawing", "entity_counts", "total_entities", "layers", F.size("layers").alias("layer_count"),
                    "block_names", F.coalesce("text_samples", F.array().cast("array<string>")).alias("text_samples"),
                    recs.alias("recommendations"))


def entity_bounds(entities: DataFrame) -> DataFrame:
    """Op 110: bounding box per geometric entity (4 dp), closed flag;
    circles and arcs use centre ± radius."""
    g = entities.where(F.col("type").isin(*GEOMETRY_TYPES))
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    r = F.coalesce(F.col("radius"), F.lit(0.0))
    round_ = F.col("type").isin("CIRCLE", "ARC")
    c = F.try_element_at("points", F.lit(1))
    minx = F.when(round_, c["x"] - r).otherwise(F.array_min(xs))
    maxx = F.when(round_, c["x"] + r).otherwise(F.array_max(xs))
    miny = F.when(round_, c["y"] - r).otherwise(F.array_min(ys))
    maxy = F.when(round_, c["y"] + r).otherwise(F.array_max(ys))
    return g.where(F.size("points") > 0).select(
        "drawing", "entity_id", "type", "layer",
        round_half_up(minx, 4).alias("min_x"), round_half_up(miny, 4).alias("min_y"),
        round_half_up(maxx, 4).alias("max_x"), round_half_up(maxy, 4).alias("max_y"),
        F.coalesce(F.col("closed"), F.lit(False)).alias("closed"))


def linear_feet(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Op 111: linear feet per (drawing, layer) from lines and polylines,
    plus a drawing total row (``layer`` null); rounded to 2 dp after the
    sum."""
    x = with_feet(entities.where(F.col("type").isin("LINE", "LWPOLYLINE")), units)
    x = x.withColumn("__ft", entity_length() * F.col("to_feet"))
    layers = x.groupBy("drawing", "layer").agg(F.sum("__ft").alias("__sum"))
    totals = layers.groupBy("drawing").agg(F.sum("__sum").alias("__sum")).select("drawing", F.lit(None).cast("string").alias("layer"), "__sum")
    g = layers.withColumn("is_total", F.lit(False)).unionByName(totals.withColumn("is_total", F.lit(True)))
    return g.select("drawing", "layer", "is_total", round_half_up(F.col("__sum"), 2).alias("linear_feet"))


def block_counts(entities: DataFrame) -> DataFrame:
    """Op 112: inserted blocks per drawing and block name."""
    return (entities.where(F.col("type") == "INSERT").groupBy("drawing", "block_name")
            .agg(F.count("*").alias("count")))


def entity_matrix(entities: DataFrame, types: Sequence[str] = tuple(ENTITY_TYPES)) -> DataFrame:
    """Op 113: entity count by layer × type (pivot over a given type list)."""
    p = entities.groupBy("drawing", "layer").pivot("type", list(types)).count()
    return p.select("drawing", "layer", *[F.coalesce(F.col(t), F.lit(0)).alias(t.lower()) for t in types])


def spec_notes(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Op 114: notes (TEXT/MTEXT: stripped text, location and height at
    2 dp), dimensions (raw and feet at 4 dp) and leaders, one row each with
    a ``kind``."""
    x = with_feet(entities.where(F.col("type").isin("TEXT", "MTEXT", "DIMENSION", "LEADER")), units)
    loc = F.try_element_at("points", F.lit(1))
    kind = F.when(F.col("type").isin("TEXT", "MTEXT"), "note").when(F.col("type") == "DIMENSION", "dimension") \
        .otherwise("leader")
    note = F.col("type").isin("TEXT", "MTEXT")
    dim = F.col("type") == "DIMENSION"
    raw = F.coalesce(F.col("measurement"), F.lit(0.0))
    return x.select(
        "drawing", "entity_id", kind.alias("kind"), "layer",
        F.when(note, strip("text")).when(~dim, F.col("text")).alias("text"),
        F.when(note, round_half_up(loc["x"], 2)).alias("x"), F.when(note, round_half_up(loc["y"], 2)).alias("y"),
        F.when(note, round_half_up(F.col("height"), 2)).alias("height"),
        F.when(dim, round_half_up(raw, 4)).alias("value_raw"),
        F.when(dim, round_half_up(raw * F.col("to_feet"), 4)).alias("value_feet"))


def spec_note_counts(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Op 114: how many notes, dimensions and leaders a drawing has."""
    kinds = spec_notes(entities, units)
    return kinds.groupBy("drawing").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("note", "dimension", "leader")])


def entity_full(entities: DataFrame, units: DataFrame) -> DataFrame:
    """Op 115: typed flat dump of every entity with its type-specific
    columns (null where a column does not apply)."""
    x = with_feet(entities, units)
    t = F.col("type")
    p1, p2 = F.try_element_at("points", F.lit(1)), F.try_element_at("points", F.lit(2))
    ln = _dist(p1, p2)
    is_ = lambda *ks: t.isin(*ks)
    return x.select(
        "drawing", "entity_id", "type", "layer", "color",
        F.when(is_("LINE"), round_half_up(p1["x"], 4)).alias("start_x"),
        F.when(is_("LINE"), round_half_up(p1["y"], 4)).alias("start_y"),
        F.when(is_("LINE"), round_half_up(p2["x"], 4)).alias("end_x"),
        F.when(is_("LINE"), round_half_up(p2["y"], 4)).alias("end_y"),
        F.when(is_("LINE"), round_half_up(ln, 4)).alias("length_raw"),
        F.when(is_("LINE"), round_half_up(ln * F.col("to_feet"), 4)).alias("length_feet"),
        F.when(is_("LWPOLYLINE"), F.size("points")).alias("point_count"),
        F.when(is_("LWPOLYLINE"), F.coalesce(F.col("closed"), F.lit(False))).alias("closed"),
        F.when(is_("CIRCLE", "ARC"), round_half_up(p1["x"], 4)).alias("center_x"),
        F.when(is_("CIRCLE", "ARC"), round_half_up(p1["y"], 4)).alias("center_y"),
        F.when(is_("CIRCLE", "ARC"), round_half_up(F.col("radius"), 4)).alias("radius"),
        F.when(is_("CIRCLE"), round_half_up(F.col("radius") * F.col("to_feet"), 4)).alias("radius_feet"),
        F.when(is_("TEXT", "MTEXT"), F.col("text")).alias("content"),
        F.when(is_("TEXT", "MTEXT", "INSERT"), round_half_up(p1["x"], 4)).alias("location_x"),
        F.when(is_("TEXT", "MTEXT", "INSERT"), round_half_up(p1["y"], 4)).alias("location_y"),
        F.when(is_("INSERT"), F.col("block_name")).alias("block_name"),
        F.when(is_("DIMENSION"), round_half_up(F.coalesce(F.col("measurement"), F.lit(0.0)), 4)).alias("value_raw"),
        F.when(is_("DIMENSION"), round_half_up(F.coalesce(F.col("measurement"), F.lit(0.0)) * F.col("to_feet"), 4))
        .alias("value_feet"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of a closed point ring (absolute value)."""
    n = F.size(points)
    nxt = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def takeoff_lenses(entities: DataFrame, units: DataFrame,
                   lenses: Sequence[str] = ("preview", "bounds", "linear_feet", "blocks", "matrix", "specs", "full")
                   ) -> dict[str, DataFrame]:
    """All takeoff lenses (ops 109-115) from one scan of the entity table.

    The entity table is persisted (memory, spilling to disk) so the lenses
    share one read of the source; a lost executor only recomputes its
    blocks from the lineage.  Call ``unpersist()`` on the returned
    ``"_entities"`` frame when done.
    """
    from pyspark import StorageLevel
    e = entities.persist(StorageLevel.MEMORY_AND_DISK)
    build = {"preview": lambda: entity_preview(e), "bounds": lambda: entity_bounds(e),
             "linear_feet": lambda: linear_feet(e, units), "blocks": lambda: block_counts(e),
             "matrix": lambda: entity_matrix(e), "specs": lambda: spec_notes(e, units),
             "full": lambda: entity_full(e, units)}
    out = {name: build[name]() for name in lenses}
    out["_entities"] = e
    return out
