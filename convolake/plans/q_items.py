"""Queries for item ops (31-32, 35, 38, 53-56, 72, 80-81, 90-92, 124)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import items as IT
from convolake.plans import views as V
from convolake.plans.catalog import query
from convolake.plans.q_curation import WORDS_SQL


@query("search_items", """
SELECT id, skill_id FROM v_extracted
WHERE list_contains(tags, 's3') AND importance_score >= 20
  AND (user_input ILIKE '%en%' OR assistant_response ILIKE '%en%') AND is_archived = false""")
def q_search(t):
    return IT.search_items(V.extracted(t), tag="s3", min_importance=20, search="en").select("id", "skill_id")


@query("page_items", """
WITH f AS (SELECT * FROM v_extracted WHERE is_archived = false)
SELECT id, importance_score, (SELECT count(*) FROM f) AS total, 2 AS page,
  CAST(floor(((SELECT count(*) FROM f) + 49) / 50) AS BIGINT) AS pages
FROM f ORDER BY importance_score DESC, id LIMIT 50 OFFSET 50""")
def q_page(t):
    return IT.page_items(V.extracted(t), "importance_score", "desc", 2, 50).select(
        "id", "importance_score", "total", "page", "pages")


@query("valid_qa_items", """
SELECT conv_id, turn FROM v_exchanges
WHERE user_input IS NOT NULL AND agent_response IS NOT NULL AND length(user_input) > 5 AND length(agent_response) > 10""")
def q_valid(t):
    return IT.valid_qa_items(V.exchanges(t), "user_input", "agent_response").select("conv_id", "turn")


def label_scores(t):
    """model scores stand-in ← labels (quality and toxicity)."""
    lab = t.labels
    return lab.select(lab.doc_id.alias("id"), (lab.quality * 60 + 25 - lab.toxic * 20).cast("double").alias("score"))


@query("apply_scores", """
SELECT e.id, coalesce(CAST(l.quality * 60 + 25 - l.toxic * 20 AS DOUBLE), 50.0) AS importance_score
FROM v_extracted e LEFT JOIN labels l ON e.id = l.doc_id""")
def q_apply_scores(t):
    return IT.apply_scores(V.extracted(t).drop("importance_score"), label_scores(t)).select("id", "importance_score")


@query("batch_rows", """
SELECT id, CAST(floor((row_number() OVER (PARTITION BY skill_id ORDER BY importance_score DESC, id) - 1) / 20) AS INTEGER)
  AS batch_no FROM v_extracted""")
def q_batch(t):
    return IT.batch_rows(V.extracted(t), "skill_id", 20, (F.desc("importance_score"), F.asc("id"))).select(
        "id", "batch_no")


@query("item_stats", """
SELECT skill_id, count(*) FILTER (WHERE NOT is_archived) AS total,
  count(*) FILTER (WHERE NOT is_archived AND is_approved) AS approved,
  count(*) FILTER (WHERE NOT is_archived AND NOT is_approved) AS pending,
  count(*) FILTER (WHERE is_archived) AS archived,
  CAST(round(CAST(coalesce(avg(importance_score) FILTER (WHERE NOT is_archived), 0.0) AS DECIMAL(38,10)), 1) AS DOUBLE)
    AS avg_importance,
  CAST(coalesce(sum(tokens) FILTER (WHERE NOT is_archived), 0) AS BIGINT) AS total_tokens,
  count(DISTINCT category) FILTER (WHERE NOT is_archived) AS categories_count,
  count(DISTINCT source_filename) FILTER (WHERE NOT is_archived) AS sources_count
FROM v_extracted GROUP BY skill_id""")
def q_item_stats(t):
    return IT.item_stats(V.extracted(t), ["skill_id"])


@query("category_counts", """
SELECT skill_id, category, count(*) AS count FROM v_extracted WHERE NOT is_archived GROUP BY 1, 2""")
def q_category_counts(t):
    return IT.category_counts(V.extracted(t))


@query("top_tags", """
WITH c AS (SELECT skill_id, tag, count(*) AS count FROM (SELECT skill_id, unnest(tags) AS tag FROM v_extracted
           WHERE NOT is_archived) GROUP BY 1, 2)
SELECT * FROM (SELECT skill_id, tag, count,
  CAST(row_number() OVER (PARTITION BY skill_id ORDER BY count DESC, tag) AS INTEGER) AS rank FROM c) WHERE rank <= 3""")
def q_top_tags(t):
    return IT.top_tags(V.extracted(t), 3)


@query("skill_token_totals", """
SELECT skill_id, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens FROM v_extracted WHERE NOT is_archived
GROUP BY 1""")
def q_skill_tokens(t):
    return IT.skill_token_totals(V.extracted(t))


@query("bulk_edit", """
SELECT id, CASE WHEN importance_score >= 90 AND NOT list_contains(tags, 'hot') THEN list_append(tags, 'hot')
  ELSE tags END AS tags
FROM v_extracted""")
def q_bulk_edit(t):
    x = V.extracted(t)
    ids = x.where(F.col("importance_score") >= 90).select("id")
    return IT.bulk_edit(x, ids, "tag", "hot").select("id", "tags")


@query("promote_items", """
SELECT id, skill_id, GREATEST(1, LEAST(5, CAST(round(CAST(importance_score / 20 AS DECIMAL(38,10)), 0) AS INTEGER)))
  AS quality_score, 'extracted:' || source_filename AS source
FROM v_extracted WHERE is_approved""")
def q_promote(t):
    x = V.extracted(t)
    new_rows, _ = IT.promote_items(x, x.where(F.col("is_approved")).select("id"))
    return new_rows.select("id", "skill_id", "quality_score", "source")


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
CHUNK_SQL = f"""
WITH f AS (
  SELECT doc_id, text, list_reduce(string_split(text, chr(10)), lambda acc, p:
      CASE WHEN length(acc.cur) + length(p) < 2000 THEN {{'done': acc.done, 'cur': acc.cur || p || chr(10)}}
           ELSE {{'done': CASE WHEN acc.cur <> '' THEN list_append(acc.done, {STRIP.format(x='acc.cur')}) ELSE acc.done END,
                 'cur': p || chr(10)}} END,
    {{'done': []::VARCHAR[], 'cur': ''}}) AS acc
  FROM documents),
c AS (
  SELECT doc_id, CASE WHEN length(text) <= 2000 THEN [text]
    ELSE coalesce(nullif(CASE WHEN acc.cur <> '' THEN list_append(acc.done, {STRIP.format(x='acc.cur')}) ELSE acc.done END,
                         []::VARCHAR[]), [left(text, 2000)]) END AS chunks FROM f)
SELECT doc_id, CAST(unnest(range(0, len(chunks))) AS INTEGER) AS chunk_no,
  CAST(unnest(list_transform(chunks, lambda x: length(x))) AS INTEGER) AS chunk_chars FROM c"""


@query("chunk_text", CHUNK_SQL)
def q_chunk(t):
    return IT.chunk_text(t.documents.select("doc_id", "text"), "text", 2000, "\n").select(
        "doc_id", "chunk_no", F.length("chunk").alias("chunk_chars"))


@query("parse_model_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def q_parse_json(t):
    e = IT.parse_model_json(t.events, "props", "k int")
    return e.select("event_id", F.col("parsed.k").alias("k"))


def exchange_items(t):
    x = V.exchanges(t)
    return x.select(F.concat(F.lit("src"), (x.conv_id % 20).cast("string")).alias("skill_id"),
                    F.concat(F.lit("conv_"), x.conv_id.cast("string"), F.lit(".txt")).alias("source_filename"),
                    "user_input", F.col("agent_response").alias("assistant_response"),
                    F.lit("txt").alias("source_type"))


@query("build_items", f"""
SELECT sha256(list_aggregate(list_transform(['src' || CAST(conv_id % 20 AS VARCHAR), 'conv_' || CAST(conv_id AS VARCHAR) || '.txt',
  user_input, agent_response], lambda x: coalesce(CAST(length(x) AS VARCHAR) || ':' || x, '-')), 'string_agg', '')) AS id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS skill_id,
  'qa_pair' AS content_type, 'general' AS category, CAST(50.0 AS DOUBLE) AS importance_score,
  CAST(0.8 AS DOUBLE) AS confidence,
  {WORDS_SQL.format(c='user_input')} + {WORDS_SQL.format(c='agent_response')} AS tokens
FROM v_exchanges""")
def q_build_items(t):
    return IT.build_items(exchange_items(t)).select(
        "id", "skill_id", "content_type", "category", "importance_score", "confidence", "tokens")


@query("extract_qa_pairs", """
WITH notes AS (
  SELECT text FROM documents
  UNION ALL
  SELECT 'Q: ' || split_part(user_input, chr(10), 1) || ' A: ' || split_part(agent_response, chr(10), 1) FROM v_exchanges
  UNION ALL
  SELECT '"' || split_part(user_input, chr(10), 1) || '" -> ' || split_part(agent_response, chr(10), 1) FROM v_exchanges),
lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM notes)
SELECT coalesce(nullif(regexp_extract(line, '^\\s*"(.+?)"\\s*->\\s*(.+?)\\s*$', 1), ''),
                nullif(regexp_extract(line, '^\\s*Q:\\s*(.+?)\\s*A:\\s*(.+?)\\s*$', 1), '')) AS user_input,
  CASE WHEN regexp_extract(line, '^\\s*"(.+?)"\\s*->\\s*(.+?)\\s*$', 1) <> ''
       THEN regexp_extract(line, '^\\s*"(.+?)"\\s*->\\s*(.+?)\\s*$', 2)
       ELSE regexp_extract(line, '^\\s*Q:\\s*(.+?)\\s*A:\\s*(.+?)\\s*$', 2) END AS assistant_response
FROM lines WHERE user_input IS NOT NULL""")
def q_extract_qa(t):
    x = V.exchanges(t)
    first = lambda c: F.split_part(F.col(c), F.lit("\n"), F.lit(1))
    notes = (t.documents.select("text")
             .unionByName(x.select(F.concat(F.lit("Q: "), first("user_input"), F.lit(" A: "),
                                            first("agent_response")).alias("text")))
             .unionByName(x.select(F.concat(F.lit('"'), first("user_input"), F.lit('" -> '),
                                            first("agent_response")).alias("text"))))
    return IT.extract_qa_pairs(notes, "text").select("user_input", "assistant_response")
