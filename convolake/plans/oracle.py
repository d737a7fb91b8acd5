"""DuckDB twins of ``plans/views.py`` for the correctness oracle.

``with_views(sql)`` prefixes an oracle query with the CTEs of every view
it names (dependencies first).  Only the driver tables are assumed to
exist as DuckDB views.
"""

from __future__ import annotations

import re

_SKILL = ("CASE event_id % 5 WHEN 0 THEN 'receptionist' WHEN 1 THEN 'electrician' "
          "WHEN 2 THEN 'plumber' WHEN 3 THEN 'solar' ELSE 'general' END")

# name -> (sql, dependencies); order matters for dependencies.
VIEW_SQL: dict[str, str] = {}

VIEW_SQL["v_interactions"] = f"""
SELECT event_id AS id, ts AS created_at, user_id AS session_id,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE {_SKILL} END AS skill_id,
  '+1555' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS phone_number,
  concat_ws(' ', event_type, props) AS user_input,
  're: ' || event_type AS agent_response,
  CASE WHEN event_type IN ('purchase','signup') THEN 'deep' ELSE 'fast' END AS system_used,
  CASE WHEN event_type IN ('purchase','signup') THEN 'complex_' || event_type END AS routing_reason,
  CASE WHEN event_type IN ('purchase','signup') THEN CAST(50 + event_id % 100 AS INTEGER)
       ELSE CAST(floor(value * 10) AS INTEGER) END AS fast_latency_ms,
  CASE WHEN event_type IN ('purchase','signup') THEN CAST(floor(value * 10) AS INTEGER) END AS deep_latency_ms,
  CAST(NULL AS INTEGER) AS total_latency_ms,
  CAST(80 + event_id % 40 AS INTEGER) AS stt_latency_ms,
  CAST(30 + event_id % 20 AS INTEGER) AS tts_latency_ms,
  CASE WHEN event_id % 3 <> 0 THEN CAST(1 + event_id % 5 AS INTEGER) END AS user_feedback,
  event_id % 4 <> 0 AS call_completed,
  event_type = 'error' AS error_occurred,
  CASE WHEN event_type = 'error' THEN (CASE event_id % 7 WHEN 0 THEN 'TimeoutError: upstream took too long'
    WHEN 1 THEN 'ConnectionError: reset by peer' WHEN 2 THEN 'ValueError: invalid format in payload'
    WHEN 3 THEN 'CUDA out of memory while decoding' WHEN 4 THEN 'model not found: 404'
    WHEN 5 THEN 'No CUDA GPUs are available' ELSE 'unexpected failure' END) || ' #' || CAST(event_id AS VARCHAR)
  END AS error_message,
  CAST(20 + event_id % 180 AS INTEGER) AS input_tokens,
  CAST(10 + (event_id * 7) % 300 AS INTEGER) AS output_tokens,
  event_id % 11 = 0 AS exported_for_training
FROM events"""

VIEW_SQL["v_prices"] = """
SELECT * FROM (VALUES ('fast', CAST('0.00000059' AS DECIMAL(12,10)), CAST('0.00000079' AS DECIMAL(12,10))),
                      ('deep', CAST('0.000003' AS DECIMAL(12,10)), CAST('0.000015' AS DECIMAL(12,10))))
  AS p(system_used, in_price, out_price)"""

VIEW_SQL["v_feedback_log"] = """
SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 10 + turn AS BIGINT)) AS "timestamp",
  text AS user_input, next_text AS agent_response,
  'src' || CAST(conv_id % 20 AS VARCHAR) AS skill_used,
  CAST(1 + conv_id % 5 AS INTEGER) AS rating,
  CASE WHEN 1 + conv_id % 5 <= 2 THEN '[corrected] ' || next_text END AS correction,
  conv_id, turn
FROM (SELECT conv_id, turn, role, text,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
      FROM conversations) x
WHERE role = 'user' AND next_role = 'assistant'"""

VIEW_SQL["v_extracted"] = """
SELECT d.doc_id AS id, d.source AS skill_id, 'qa' AS content_type,
  split_part(d.text, chr(10), 1) AS user_input,
  d.text AS assistant_response, d.text AS raw_content,
  'doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS source_filename,
  'txt' AS source_type, d.lang AS category,
  [d.lang, 's' || CAST(d.n_chars % 7 AS VARCHAR)] AS tags,
  CAST(d.n_chars % 101 AS DOUBLE) AS importance_score,
  0.8 AS confidence, d.n_chars, CAST(d.n_chars // 4 AS INTEGER) AS tokens,
  coalesce(l.quality = 1, false) AS is_approved,
  coalesce(l.toxic = 1, false) AS is_archived,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

VIEW_SQL["v_adapters"] = """
SELECT o_orderkey AS id, 'skill' || CAST(o_custkey % 200 AS VARCHAR) AS skill_id,
  'adapter_' || CAST(o_orderkey AS VARCHAR) AS adapter_name,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1e5 END AS final_loss,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'training' END AS status,
  CAST(1 + o_orderkey % 3 AS INTEGER) AS epochs,
  CAST(60 + o_orderkey % 900 AS INTEGER) AS training_time_seconds,
  o_orderdate AS created_at
FROM orders"""

VIEW_SQL["v_skills"] = """
SELECT source AS id, 'Skill ' || source AS name,
  'You are the ' || source || ' assistant.' AS system_prompt,
  min(doc_id) % 2 = 0 AS is_builtin, count(*) AS n_docs
FROM documents GROUP BY source"""


VIEW_SQL["v_exchanges"] = """
SELECT conv_id, turn, text AS user_input, next_text AS agent_response
FROM (SELECT conv_id, turn, role, text,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
      FROM conversations) x
WHERE role = 'user' AND next_role = 'assistant'"""

VIEW_SQL["v_training_data"] = """
SELECT conv_id * 100 + turn AS id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS skill_id,
  user_input AS user_message, agent_response AS assistant_response,
  CAST(1 + (conv_id + turn) % 5 AS INTEGER) AS rating,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN '[corrected] ' || agent_response WHEN (conv_id + turn) % 4 = 1 THEN '' END
    AS corrected_response,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 10 + turn AS BIGINT)) AS created_at
FROM v_exchanges"""

VIEW_SQL["v_knowledge"] = """
SELECT source AS skill_id, doc_id AS ord, split_part(text, chr(10), 1) AS item FROM documents"""


VIEW_SQL["v_jobs"] = """
SELECT o_orderkey AS id, 'skill' || CAST(o_custkey % 200 AS VARCHAR) AS skill_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  CAST(60 + o_orderkey % 900 AS INTEGER) AS training_time_seconds,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) / 1000 AS DECIMAL(18,5)) AS cost_usd,
  o_orderdate AS created_at
FROM orders"""

VIEW_SQL["v_steps"] = """
SELECT ts AS "timestamp", 'job' || CAST(user_id AS VARCHAR) AS job_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step,
  count(*) OVER (PARTITION BY user_id) AS total_steps,
  value / 100 AS loss, CAST(event_id % 30 + 1 AS DOUBLE) AS step_time_seconds
FROM events"""


VIEW_SQL["v_turns"] = """
SELECT conv_id, turn, role, text,
  CASE conv_id % 6 WHEN 0 THEN 'receptionist' WHEN 1 THEN 'electrician' WHEN 2 THEN 'plumber'
    WHEN 3 THEN 'solar' WHEN 4 THEN 'lawyer' ELSE 'general' END AS skill_id,
  CAST((conv_id * 37 + turn * 101) % 1500 AS INTEGER) AS duration_ms
FROM conversations"""

VIEW_SQL["v_files"] = """
SELECT doc_id AS file_id, source AS project_id,
  CASE doc_id % 14 WHEN 0 THEN 'Scope of Work ' WHEN 1 THEN 'Section 07 5423 ' WHEN 2 THEN '271-mech plan '
    WHEN 3 THEN 'GAF warranty ' WHEN 4 THEN 'field sketch ' WHEN 5 THEN 'taper ' WHEN 6 THEN 'typical '
    WHEN 7 THEN 'takeoff ' WHEN 8 THEN 'contract ' WHEN 9 THEN 'photo ' WHEN 10 THEN 'IMG_'
    WHEN 11 THEN '302-product data ' WHEN 12 THEN '261 plumbing riser ' ELSE '282-E ' END
  || CAST(doc_id AS VARCHAR) ||
  CASE doc_id % 14 WHEN 0 THEN '.docx' WHEN 7 THEN '.xlsx' WHEN 9 THEN '.jpg' WHEN 10 THEN '.dxf'
    WHEN 13 THEN '.dxf' ELSE '.pdf' END AS name,
  text, n_chars AS size
FROM documents"""


VIEW_SQL["v_entities"] = """
SELECT 's' || CAST(l_suppkey AS VARCHAR) AS drawing, l_orderkey * 10 + l_linenumber AS entity_id,
  CASE WHEN l_linenumber <= 2 THEN 'LINE' WHEN l_linenumber = 3 THEN 'CIRCLE' WHEN l_linenumber = 4 THEN 'TEXT'
    WHEN l_linenumber = 5 THEN 'INSERT' WHEN l_linenumber = 6 THEN 'DIMENSION' WHEN l_returnflag = 'R' THEN 'LEADER'
    ELSE 'MTEXT' END AS type,
  'L-' || l_returnflag AS layer, l_linenumber AS color,
  CASE WHEN l_linenumber <= 2 THEN [{'x': CAST(l_quantity AS DOUBLE), 'y': CAST(l_discount * 100 AS DOUBLE)},
                                    {'x': CAST(l_extendedprice / 1000 AS DOUBLE), 'y': CAST(l_tax * 100 AS DOUBLE)}]
       ELSE [{'x': CAST(l_quantity AS DOUBLE), 'y': CAST(l_tax * 100 AS DOUBLE)}] END AS points,
  false AS closed,
  CASE WHEN l_linenumber = 3 THEN l_discount * 100 END AS radius,
  CASE WHEN l_linenumber IN (4, 7) THEN ' NOTE P' || CAST(l_partkey AS VARCHAR) || ' ' END AS text,
  CASE WHEN l_linenumber IN (4, 7) THEN l_tax * 10 END AS height,
  CASE WHEN l_linenumber = 5 THEN 'BLK-' || l_linestatus END AS block_name,
  CASE WHEN l_linenumber = 6 THEN l_extendedprice / 100 END AS measurement,
  CAST(l_suppkey % 7 AS INTEGER) AS units_code
FROM lineitem
UNION ALL
SELECT 'e' || CAST(vec_id % 10 AS VARCHAR), vec_id + 1000000000000, 'LWPOLYLINE', 'POLY-' || CAST(label AS VARCHAR), 7,
  CASE WHEN len(embedding) >= 64 THEN list_transform(range(0, 32), lambda i: {'x': CAST(embedding[i * 2 + 1] AS DOUBLE),
                                                                        'y': CAST(embedding[i * 2 + 2] AS DOUBLE)})
       ELSE [] END,
  vec_id % 2 = 0, NULL, NULL, NULL, NULL, NULL, CAST((vec_id % 10) % 7 AS INTEGER)
FROM embeddings"""

VIEW_SQL["v_units"] = """
SELECT code, name, CAST(f AS DOUBLE) / d AS to_feet FROM (VALUES (0, 'Unitless', 1, 1), (1, 'Inches', 1, 12),
  (2, 'Feet', 1, 1), (3, 'Miles', 5280, 1), (4, 'Millimeters', 0.00328084, 1), (5, 'Centimeters', 0.0328084, 1),
  (6, 'Meters', 3.28084, 1)) AS u(code, name, f, d)"""


VIEW_SQL["v_health"] = """
SELECT event_id AS id, ts AS checked_at, event_id % 7 <> 0 AS groq_healthy, event_id % 11 <> 0 AS anthropic_healthy,
  event_id % 13 <> 0 AS deepgram_healthy, event_id % 17 <> 0 AS cartesia_healthy, event_id % 19 <> 0 AS livekit_healthy,
  CAST(floor(value) AS INTEGER) AS groq_latency_ms, CAST(floor(value * 3) AS INTEGER) AS anthropic_latency_ms
FROM events"""


def _deps(sql: str) -> list[str]:
    found = []
    for name in VIEW_SQL:
        if re.search(rf"\b{name}\b", sql):
            found.append(name)
    return found


def with_views(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every ``v_*`` view it (transitively) uses."""
    needed: list[str] = []
    todo = _deps(sql)
    while todo:
        n = todo.pop()
        if n in needed:
            continue
        needed.append(n)
        todo.extend(d for d in _deps(VIEW_SQL[n]) if d != n)
    ordered = [n for n in VIEW_SQL if n in needed]  # definition order = dependency order
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
