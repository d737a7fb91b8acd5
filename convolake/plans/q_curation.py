"""Queries for curation ops (13-21, 29-30, 33, 36, 46, 60, 74, 93-95)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.sizing import param_table

from convolake.operators import curation as C
from convolake.plans import views as V
from convolake.plans.catalog import query

# DuckDB word count equal to Python's str.split()
WORDS_SQL = ("CAST(len(list_filter(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' '), "
             "lambda w: w <> '')) AS INTEGER)")


@query("shape_instruction", """
SELECT 'You are a helpful voice assistant. Respond naturally and conversationally.' AS instruction,
  user_input AS input, agent_response AS output FROM v_exchanges""")
def q_shape_instruction(t):
    return C.shape_instruction(V.exchanges(t))


@query("shape_messages", """
SELECT id, CAST(to_json({'messages': [{'role': 'user', 'content': user_message},
   {'role': 'assistant', 'content': coalesce(nullif(corrected_response, ''), assistant_response)}]}) AS VARCHAR) AS messages
FROM v_training_data""")
def q_shape_messages(t):
    return C.shape_messages(V.training_data(t)).select("id", "messages")


@query("shape_chat_template", """
SELECT skill_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10)
  || system_prompt || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)
  || user_message || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)
  || assistant_response || '<|eot_id|>' AS text
FROM v_training_data JOIN v_skills ON v_training_data.skill_id = v_skills.id""")
def q_chat_template(t):
    joined, _ = C.examples_with_skill(V.training_data(t), V.skills(t))
    return C.shape_chat_template(joined).select("skill_id", "text")


@query("render_prompt", """
WITH x AS (
  SELECT conv_id, turn, role, text,
    list(struct_pack(o := turn, l := upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || coalesce(text, '')))
      OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h
  FROM conversations)
SELECT conv_id, turn,
  array_to_string(list_concat(list_transform(list_sort(coalesce(h, [])), lambda s: s.l),
                  ['User: ' || coalesce(text, ''), 'Assistant:']), chr(10)) AS prompt
FROM x WHERE role = 'user'""")
def q_render_prompt(t):
    return C.render_prompt(t.conversations)


def templates(spark):
    # Invented prompt templates with {key} placeholders (query parameters).
    rows = [("general", "You are a helpful assistant. Caller {phone} asked about {topic}."),
            ("electrician", "You are an electrician's assistant. Caller {phone}: {topic}. Ref {ticket}."),
            ("plumber", "Plumbing desk for {phone} about {topic}.")]
    return param_table(spark, rows, "skill_id string, template string")


@query("fill_template", """
WITH tpl AS (SELECT * FROM (VALUES
  ('general', 'You are a helpful assistant. Caller {phone} asked about {topic}.'),
  ('electrician', 'You are an electrician''s assistant. Caller {phone}: {topic}. Ref {ticket}.'),
  ('plumber', 'Plumbing desk for {phone} about {topic}.')) AS t(skill_id, template))
SELECT i.id, list_reduce(map_entries(MAP(['phone', 'topic'], [i.phone_number, i.agent_response])),
   lambda acc, e: replace(acc, '{' || e.key || '}', coalesce(e.value, '')),
   coalesce(t.template, (SELECT template FROM tpl WHERE skill_id = 'general'))) AS prompt
FROM v_interactions i LEFT JOIN tpl t ON i.skill_id = t.skill_id""")
def q_fill_template(t):
    i = V.interactions(t).withColumn(
        "ctx", F.create_map(F.lit("phone"), F.col("phone_number"), F.lit("topic"), F.col("agent_response")))
    return C.fill_template(i, templates(t.spark), "ctx").select("id", "prompt")


@query("append_knowledge", """
SELECT id, CASE WHEN len(tags) > 0 THEN 'You are the ' || skill_id || ' assistant.' || chr(10) || chr(10)
    || '## Quick Reference' || chr(10) || array_to_string(list_transform(tags, lambda x: '- ' || x), chr(10))
  ELSE 'You are the ' || skill_id || ' assistant.' END AS full_prompt,
  'Hello! I''m ' || skill_id || '. How can I help?' AS greeting_text
FROM v_extracted""")
def q_append_knowledge(t):
    x = V.extracted(t).select("id", F.concat(F.lit("You are the "), "skill_id", F.lit(" assistant."))
                              .alias("system_prompt"), F.col("tags").alias("knowledge"),
                              F.col("skill_id").alias("name"))
    return C.append_knowledge(x).select("id", "full_prompt", "greeting_text")


@query("mask_secrets", """
SELECT id, CASE WHEN length(phone_number) > 8 THEN left(phone_number, 4) || '...' || right(phone_number, 4)
  ELSE '***' END AS phone_number,
  CASE WHEN length(user_input) > 8 THEN left(user_input, 4) || '...' || right(user_input, 4)
  ELSE '***' END AS user_input
FROM v_interactions""")
def q_mask(t):
    return C.mask_secrets(V.interactions(t), ["phone_number", "user_input"]).select(
        "id", "phone_number", "user_input")


@query("time_ago", """
WITH x AS (SELECT id, (epoch_us((SELECT max(created_at) FROM v_interactions)) - epoch_us(created_at)) // 1000000 AS s
           FROM v_interactions)
SELECT id, CASE WHEN s < 60 THEN 'just now'
  WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || ' minutes ago'
  WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || ' hours ago'
  ELSE CAST(s // 86400 AS VARCHAR) || ' days ago' END AS ago
FROM x""")
def q_time_ago(t):
    return C.time_ago(V.interactions(t), "created_at").select("id", "ago")


@query("token_estimates", f"""
SELECT doc_id, {WORDS_SQL.format(c='text')} AS words, CAST(length(text) // 4 AS BIGINT) AS approx_tokens,
  CAST((length(text) // 4) * 1000 // 6000 AS BIGINT) AS prefill_ms
FROM documents""")
def q_tokens(t):
    return C.token_estimates(t.documents, "text").select("doc_id", "words", "approx_tokens", "prefill_ms")


@query("recent_corrections", """
SELECT "timestamp", prompt, chosen, rejected, skill FROM (
  SELECT "timestamp", user_input AS prompt, correction AS chosen, agent_response AS rejected, skill_used AS skill
  FROM v_feedback_log WHERE correction IS NOT NULL AND correction <> '') c
WHERE "timestamp" > (SELECT max("timestamp") FROM v_feedback_log WHERE correction IS NOT NULL AND correction <> '')
                    - INTERVAL 7 DAY""")
def q_recent_corrections(t):
    return C.recent_corrections(C.correction_pairs(V.feedback_log(t)), None, 7)


@query("low_rated", """
SELECT conv_id, turn, skill_used, rating FROM v_feedback_log
WHERE "timestamp" > (SELECT max("timestamp") FROM v_feedback_log) - INTERVAL 7 DAY
  AND rating IS NOT NULL AND rating <> 0 AND rating <= 3""")
def q_low_rated(t):
    return C.low_rated(V.feedback_log(t), None, 7, 3).select("conv_id", "turn", "skill_used", "rating")


@query("correction_pairs", """
SELECT "timestamp", user_input AS prompt, correction AS chosen, agent_response AS rejected, skill_used AS skill
FROM v_feedback_log WHERE correction IS NOT NULL AND correction <> ''""")
def q_correction_pairs(t):
    return C.correction_pairs(V.feedback_log(t))


@query("preference_dataset", """
WITH c AS (
  SELECT "timestamp", user_input AS prompt, correction AS chosen, agent_response AS rejected, skill_used AS skill
  FROM v_feedback_log WHERE correction IS NOT NULL AND correction <> ''),
rc AS (SELECT DISTINCT skill, prompt, chosen, rejected FROM c
       WHERE "timestamp" > (SELECT max("timestamp") FROM c) - INTERVAL 30 DAY),
lows AS (SELECT skill_used AS skill, count(*) AS low_rated_count FROM v_feedback_log
         WHERE "timestamp" > (SELECT max("timestamp") FROM v_feedback_log) - INTERVAL 30 DAY
           AND rating IS NOT NULL AND rating <> 0 AND rating <= 3 GROUP BY 1)
SELECT rc.skill, rc.prompt, rc.chosen, rc.rejected, coalesce(lows.low_rated_count, 0) AS low_rated_count
FROM rc LEFT JOIN lows ON rc.skill = lows.skill""")
def q_preference(t):
    log = V.feedback_log(t)
    return C.preference_dataset(C.correction_pairs(log), log, None, 30)


@query("enough_to_train", """
SELECT skill_used AS skill, count(DISTINCT (user_input, correction, agent_response)) AS n_pairs
FROM v_feedback_log WHERE correction IS NOT NULL AND correction <> ''
GROUP BY 1 HAVING count(DISTINCT (user_input, correction, agent_response)) >= 10""")
def q_enough(t):
    return C.enough_to_train(C.correction_pairs(V.feedback_log(t)), 10)


@query("training_examples_filter", """
SELECT id, skill_id, rating, created_at FROM v_training_data WHERE rating >= 4""")
def q_examples_filter(t):
    return C.training_examples_filter(V.training_data(t), None, 4).select("id", "skill_id", "rating", "created_at")


@query("exchange_pairs", """SELECT conv_id, turn, user_input, agent_response FROM v_exchanges""")
def q_exchange_pairs(t):
    return C.exchange_pairs(t.conversations)


@query("examples_with_skill", """
SELECT e.skill_id, s.system_prompt AS instruction, e.user_message AS input, e.assistant_response AS output
FROM v_training_data e JOIN v_skills s ON e.skill_id = s.id""")
def q_examples_with_skill(t):
    joined, _ = C.examples_with_skill(V.training_data(t), V.skills(t))
    return joined


@query("all_training_examples", """
SELECT skill_id, user_message, assistant_response, 'training_data' AS source FROM v_training_data
UNION ALL
SELECT skill_id, user_input, assistant_response, 'extracted_data' FROM v_extracted WHERE NOT is_archived""")
def q_all_examples(t):
    return C.all_training_examples(V.training_data(t), V.extracted(t))


@query("knowledge_examples", """
WITH sk AS (SELECT id AS skill_id, name, coalesce(system_prompt, 'You are a helpful assistant.') AS instruction
            FROM v_skills)
SELECT skill_id, instruction, g AS input, 'Hello! I''m ' || name || '. How can I help you today?' AS output,
  'greeting' AS kind
FROM sk, (SELECT unnest(['Hello', 'Hi', 'Hey there', 'Good morning', 'I need help']) AS g)
UNION ALL
SELECT k.skill_id, sk.instruction,
  'Tell me about ' || CASE WHEN contains(k.item, ':') THEN split_part(k.item, ':', 1) ELSE k.item END,
  k.item, 'knowledge'
FROM v_knowledge k JOIN sk ON k.skill_id = sk.skill_id
WHERE k.item IS NOT NULL AND trim(k.item) <> ''""")
def q_knowledge_examples(t):
    return C.knowledge_examples(V.skills(t), V.knowledge(t))


@query("recent_activity", """
WITH a AS (SELECT event_id AS id, event_type AS category, props AS description, ts AS created_at FROM events),
top AS (SELECT * FROM a WHERE category = 'error' ORDER BY created_at DESC, id DESC LIMIT 20),
x AS (SELECT id, category, created_at,
        (epoch_us((SELECT max(created_at) FROM a)) - epoch_us(created_at)) // 1000000 AS s FROM top)
SELECT id, category, created_at, CASE WHEN s < 60 THEN 'just now'
  WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || ' minutes ago'
  WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || ' hours ago'
  ELSE CAST(s // 86400 AS VARCHAR) || ' days ago' END AS ago FROM x""")
def q_recent_activity(t):
    e = t.events
    a = e.select(e.event_id.alias("id"), e.event_type.alias("category"), e.props.alias("description"),
                 e.ts.alias("created_at"))
    return C.recent_activity(a, 20, "error").select("id", "category", "created_at", "ago")


@query("nest_children", """
SELECT o.o_orderkey, o.o_orderstatus, coalesce(list(l.l_linenumber ORDER BY l.l_linenumber)
  FILTER (WHERE l.l_linenumber IS NOT NULL), []) AS lines, CAST(count(l.l_linenumber) AS INTEGER) AS n_lines
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey, o.o_orderstatus""")
def q_nest(t):
    par = t.orders.select("o_orderkey", "o_orderstatus")
    kids = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    out = C.nest_children(par, kids, "o_orderkey", ["l_linenumber"], "children")
    return out.select("o_orderkey", "o_orderstatus", F.transform("children", lambda c: c["l_linenumber"]).alias("lines"),
                      F.size("children").alias("n_lines"))
