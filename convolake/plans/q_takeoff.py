"""Queries for drawing takeoff (109-115) and project scoring (106-108)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.columns import round_half_up
from convolake.operators import labels as LB
from convolake.operators import projects as P
from convolake.operators import takeoff as TK
from convolake.plans import views as V
from convolake.plans.catalog import query
from convolake.plans.q_labels import STEP_NAMES_SQL, step_sql


def R(expr: str, d: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {d}) AS DOUBLE)"


def DIST(a: str, b: str) -> str:
    return f"sqrt(({b}.x - {a}.x) * ({b}.x - {a}.x) + ({b}.y - {a}.y) * ({b}.y - {a}.y))"


PATH = ("list_reduce(list_transform(range(1, len(points)), lambda i: " + DIST("points[i]", "points[i + 1]")
        + "), lambda acc, d: acc + d, 0.0) + CASE WHEN coalesce(closed, false) AND len(points) > 1 THEN "
        + DIST("points[len(points)]", "points[1]") + " ELSE 0.0 END")
LENGTH = f"CASE WHEN type = 'LINE' THEN {DIST('points[1]', 'points[2]')} WHEN type = 'LWPOLYLINE' THEN {PATH} END"
FEET = "e AS (SELECT v_entities.*, coalesce(u.to_feet, 1.0) AS to_feet FROM v_entities LEFT JOIN v_units u ON units_code = u.code)"


@query("entity_preview", """
WITH bt AS (SELECT drawing, type, count(*) AS n FROM v_entities GROUP BY 1, 2),
c AS (SELECT drawing, list_sort(list(type || ':' || CAST(n AS VARCHAR))) AS entity_counts,
        CAST(sum(n) AS BIGINT) AS total_entities,
        coalesce(sum(n) FILTER (WHERE type IN ('LINE', 'LWPOLYLINE')), 0) AS geo,
        coalesce(sum(n) FILTER (WHERE type IN ('TEXT', 'MTEXT')), 0) AS txt,
        coalesce(sum(n) FILTER (WHERE type = 'DIMENSION'), 0) AS dim,
        coalesce(sum(n) FILTER (WHERE type = 'INSERT'), 0) AS blk FROM bt GROUP BY 1),
nm AS (SELECT drawing, list_sort(list(DISTINCT layer)) AS layers,
         list_sort(coalesce(list(DISTINCT block_name) FILTER (WHERE type = 'INSERT' AND block_name IS NOT NULL), []))
           AS block_names FROM v_entities GROUP BY 1),
s AS (SELECT drawing, list(left(text, 50) ORDER BY entity_id) AS text_samples FROM (
        SELECT *, row_number() OVER (PARTITION BY drawing ORDER BY entity_id) AS rn FROM v_entities
        WHERE type IN ('TEXT', 'MTEXT')) WHERE rn <= 5 GROUP BY 1),
r AS (SELECT c.*, list_filter([CASE WHEN geo > 0 THEN 'SPATIAL - Good for layer analysis and spatial relationships' END,
        CASE WHEN geo > 0 THEN 'QUANTITY - Good for linear footage takeoffs' END,
        CASE WHEN txt > 0 OR dim > 0 THEN 'SPECS - Good for extracting notes and dimensions' END,
        CASE WHEN blk > 0 THEN 'QUANTITY - Will count blocks (drains, scuppers, etc.)' END], lambda x: x IS NOT NULL) AS recs
      FROM c)
SELECT r.drawing, r.entity_counts, r.total_entities, nm.layers, CAST(len(nm.layers) AS INTEGER) AS layer_count,
  nm.block_names,
  coalesce(s.text_samples, []) AS text_samples,
  CASE WHEN len(r.recs) = 0 THEN ['FULL - Recommended for complete data extraction'] ELSE r.recs END AS recommendations
FROM r JOIN nm ON r.drawing = nm.drawing LEFT JOIN s ON r.drawing = s.drawing""")
def q_preview(t):
    return TK.entity_preview(V.entities(t))


@query("entity_bounds", f"""
SELECT drawing, entity_id, type, layer,
  {R("CASE WHEN type IN ('CIRCLE','ARC') THEN points[1].x - coalesce(radius, 0.0) ELSE list_min(list_transform(points, lambda p: p.x)) END", 4)} AS min_x,
  {R("CASE WHEN type IN ('CIRCLE','ARC') THEN points[1].y - coalesce(radius, 0.0) ELSE list_min(list_transform(points, lambda p: p.y)) END", 4)} AS min_y,
  {R("CASE WHEN type IN ('CIRCLE','ARC') THEN points[1].x + coalesce(radius, 0.0) ELSE list_max(list_transform(points, lambda p: p.x)) END", 4)} AS max_x,
  {R("CASE WHEN type IN ('CIRCLE','ARC') THEN points[1].y + coalesce(radius, 0.0) ELSE list_max(list_transform(points, lambda p: p.y)) END", 4)} AS max_y,
  coalesce(closed, false) AS closed
FROM v_entities WHERE type IN ('LWPOLYLINE', 'POLYLINE', 'LINE', 'CIRCLE', 'ARC') AND len(points) > 0""")
def q_bounds(t):
    return TK.entity_bounds(V.entities(t))


@query("linear_feet", f"""
WITH {FEET}
SELECT drawing, layer, GROUPING(drawing, layer) = 1 AS is_total, {R("sum((" + LENGTH + ") * to_feet)", 2)} AS linear_feet
FROM e WHERE type IN ('LINE', 'LWPOLYLINE') GROUP BY ROLLUP (drawing, layer) HAVING GROUPING(drawing, layer) < 3""")
def q_linear_feet(t):
    return TK.linear_feet(V.entities(t), V.units(t.spark))


@query("block_counts", """
SELECT drawing, block_name, count(*) AS count FROM v_entities WHERE type = 'INSERT' GROUP BY 1, 2""")
def q_blocks(t):
    return TK.block_counts(V.entities(t))


@query("entity_matrix", "SELECT drawing, layer, " + ", ".join(
    f"count(*) FILTER (WHERE type = '{k}') AS {k.lower()}" for k in TK.ENTITY_TYPES)
    + " FROM v_entities GROUP BY 1, 2")
def q_matrix(t):
    return TK.entity_matrix(V.entities(t))


@query("spec_notes", f"""
WITH {FEET}
SELECT drawing, entity_id,
  CASE WHEN type IN ('TEXT','MTEXT') THEN 'note' WHEN type = 'DIMENSION' THEN 'dimension' ELSE 'leader' END AS kind, layer,
  CASE WHEN type IN ('TEXT','MTEXT') THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN type <> 'DIMENSION' THEN text END
    AS text,
  CASE WHEN type IN ('TEXT','MTEXT') THEN {R('points[1].x', 2)} END AS x,
  CASE WHEN type IN ('TEXT','MTEXT') THEN {R('points[1].y', 2)} END AS y,
  CASE WHEN type IN ('TEXT','MTEXT') THEN {R('height', 2)} END AS height,
  CASE WHEN type = 'DIMENSION' THEN {R('coalesce(measurement, 0.0)', 4)} END AS value_raw,
  CASE WHEN type = 'DIMENSION' THEN {R('coalesce(measurement, 0.0) * to_feet', 4)} END AS value_feet
FROM e WHERE type IN ('TEXT', 'MTEXT', 'DIMENSION', 'LEADER')""")
def q_spec_notes(t):
    return TK.spec_notes(V.entities(t), V.units(t.spark))


@query("spec_note_counts", """
SELECT drawing, count(*) FILTER (WHERE type IN ('TEXT','MTEXT')) AS note_count, count(*) FILTER (WHERE type = 'DIMENSION') AS dimension_count,
  count(*) FILTER (WHERE type = 'LEADER') AS leader_count
FROM v_entities WHERE type IN ('TEXT', 'MTEXT', 'DIMENSION', 'LEADER') GROUP BY drawing""")
def q_spec_note_counts(t):
    return TK.spec_note_counts(V.entities(t), V.units(t.spark))


@query("entity_full", f"""
WITH {FEET}
SELECT drawing, entity_id, type, layer, color,
  CASE WHEN type = 'LINE' THEN {R('points[1].x', 4)} END AS start_x,
  CASE WHEN type = 'LINE' THEN {R('points[1].y', 4)} END AS start_y,
  CASE WHEN type = 'LINE' THEN {R('points[2].x', 4)} END AS end_x,
  CASE WHEN type = 'LINE' THEN {R('points[2].y', 4)} END AS end_y,
  CASE WHEN type = 'LINE' THEN {R(DIST('points[1]', 'points[2]'), 4)} END AS length_raw,
  CASE WHEN type = 'LINE' THEN {R(DIST('points[1]', 'points[2]') + ' * to_feet', 4)} END AS length_feet,
  CASE WHEN type = 'LWPOLYLINE' THEN CAST(len(points) AS INTEGER) END AS point_count,
  CASE WHEN type = 'LWPOLYLINE' THEN coalesce(closed, false) END AS closed,
  CASE WHEN type IN ('CIRCLE','ARC') THEN {R('points[1].x', 4)} END AS center_x,
  CASE WHEN type IN ('CIRCLE','ARC') THEN {R('points[1].y', 4)} END AS center_y,
  CASE WHEN type IN ('CIRCLE','ARC') THEN {R('radius', 4)} END AS radius,
  CASE WHEN type = 'CIRCLE' THEN {R('radius * to_feet', 4)} END AS radius_feet,
  CASE WHEN type IN ('TEXT','MTEXT') THEN text END AS content,
  CASE WHEN type IN ('TEXT','MTEXT','INSERT') THEN {R('points[1].x', 4)} END AS location_x,
  CASE WHEN type IN ('TEXT','MTEXT','INSERT') THEN {R('points[1].y', 4)} END AS location_y,
  CASE WHEN type = 'INSERT' THEN block_name END AS block_name,
  CASE WHEN type = 'DIMENSION' THEN {R('coalesce(measurement, 0.0)', 4)} END AS value_raw,
  CASE WHEN type = 'DIMENSION' THEN {R('coalesce(measurement, 0.0) * to_feet', 4)} END AS value_feet
FROM e""")
def q_full(t):
    return TK.entity_full(V.entities(t), V.units(t.spark))


STEPS_SQL = f"""cf AS (SELECT project_id, name, {step_sql('name')} AS step FROM v_files),
per AS (SELECT project_id, step, count(*) AS n_files, min(name) AS first_file FROM cf GROUP BY 1, 2),
grid AS (SELECT project_id, CAST(unnest(range(1, 11)) AS INTEGER) AS step FROM (SELECT DISTINCT project_id FROM cf)),
ps AS (SELECT g.project_id, g.step, {STEP_NAMES_SQL}[g.step] AS step_name,
         CASE WHEN p.n_files > 0 THEN 'complete' ELSE 'pending' END AS status,
         coalesce(p.n_files, 0) AS n_files, p.first_file
       FROM grid g LEFT JOIN per p ON g.project_id = p.project_id AND g.step = p.step)"""


def steps_df(t):
    return P.project_steps(LB.classify_files(V.files(t)))


@query("project_steps", "WITH " + STEPS_SQL + " SELECT * FROM ps")
def q_project_steps(t):
    return steps_df(t)


@query("project_step_files", "WITH " + STEPS_SQL + f""" SELECT project_id, step, {STEP_NAMES_SQL}[step] AS step_name, name FROM cf""")
def q_step_files(t):
    return P.project_step_files(LB.classify_files(V.files(t)))


@query("project_score", "WITH " + STEPS_SQL + f""",
g AS (SELECT project_id, count(*) FILTER (WHERE step BETWEEN 1 AND 4 AND status = 'complete') AS critical_complete,
        count(*) FILTER (WHERE status = 'complete') AS completed_steps,
        list_filter([max(CASE WHEN step = 1 AND status <> 'complete' THEN 'Scope of Work' END),
                     max(CASE WHEN step = 2 AND status <> 'complete' THEN 'Spec Sections (Division 07)' END),
                     max(CASE WHEN step = 3 AND status <> 'complete' THEN 'Architectural Drawings' END),
                     max(CASE WHEN step = 4 AND status <> 'complete' THEN 'Manufacturer Specifications' END)],
                    lambda x: x IS NOT NULL) AS missing_docs,
        coalesce(bool_or(step = 6 AND status <> 'complete'), false) AS taper_missing
      FROM ps GROUP BY 1)
SELECT g.project_id, critical_complete, completed_steps,
  CAST(floor((critical_complete * 700 + completed_steps * 120) / 40) AS INTEGER) AS score, missing_docs,
  CAST(floor((critical_complete * 700 + completed_steps * 120) / 40) AS INTEGER) >= 70 AS ready,
  list_filter([CASE WHEN CAST(floor((critical_complete * 700 + completed_steps * 120) / 40) AS INTEGER) < 70
                 THEN 'Upload missing critical documents before proceeding' END,
               CASE WHEN taper_missing THEN 'Consider uploading taper plan for accurate insulation takeoff' END],
              lambda x: x IS NOT NULL) AS recommendations,
  CASE WHEN ex.e IS NULL THEN []::VARCHAR[] ELSE ['Scope excludes: ' || array_to_string(ex.e, ', ')] END
    AS key_findings
FROM g LEFT JOIN (
  SELECT project_id, flatten(list(excl ORDER BY name, excl)) AS e FROM (
    SELECT project_id, name,
      CASE WHEN strpos(lower(text), 'exclud') > 0 THEN list_filter(list_transform(
          string_split(split_part(lower(text), 'exclud', 2), chr(10)),
          lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10)
        ELSE [] END AS excl
    FROM v_files WHERE {step_sql('name')} = 1)
  WHERE len(excl) > 0 GROUP BY project_id) ex ON g.project_id = ex.project_id""")
def q_project_score(t):
    f = LB.classify_files(V.files(t))
    return P.project_score(P.project_steps(f), scope_files=f.where(F.col("step") == 1))


@query("project_effort", f"""
WITH {FEET},
a AS (SELECT drawing AS project_id, sum(abs(list_reduce(list_transform(range(1, len(points) + 1), lambda i:
          points[i].x * points[CASE WHEN i = len(points) THEN 1 ELSE i + 1 END].y
          - points[CASE WHEN i = len(points) THEN 1 ELSE i + 1 END].x * points[i].y), lambda acc, v: acc + v, 0.0)) / 2
          * to_feet * to_feet) AS total_sf
      FROM e WHERE type = 'LWPOLYLINE' AND closed AND len(points) > 2 GROUP BY 1),
d AS (SELECT drawing AS project_id, count(*) AS detail_count FROM v_entities WHERE type = 'INSERT' GROUP BY 1),
x AS (SELECT coalesce(a.project_id, d.project_id) AS project_id, coalesce(a.total_sf, 0.0) AS total_sf,
        coalesce(d.detail_count, 0) AS detail_count FROM a FULL OUTER JOIN d ON a.project_id = d.project_id)
SELECT project_id, {R('total_sf', 4)} AS total_sf, detail_count,
  {R('5.0 + total_sf / 1000 + detail_count * 0.5', 1)} AS est_hours,
  CASE WHEN detail_count > 15 THEN 'High' WHEN detail_count > 8 THEN 'Medium' ELSE 'Low' END AS complexity
FROM x""")
def q_project_effort(t):
    e = TK.with_feet(V.entities(t), V.units(t.spark))
    poly = e.where((F.col("type") == "LWPOLYLINE") & F.col("closed") & (F.size("points") > 2))
    areas = poly.select(F.col("drawing").alias("project_id"),
                        (TK.polygon_area(F.col("points")) * F.col("to_feet") * F.col("to_feet")).alias("sf"))
    details = e.where(F.col("type") == "INSERT").select(F.col("drawing").alias("project_id"))
    out = P.project_effort(areas, details)
    return out.withColumn("total_sf", round_half_up("total_sf", 4))
