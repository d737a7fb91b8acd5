"""Queries for rule labelling (39-42, 64, 96-105).

Oracle SQL for the cascades is generated from the same fixed lexicons, so
both engines evaluate the identical rule list.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.sizing import param_table

from convolake.functions import lexicons as L
from convolake.operators import labels as LB
from convolake.plans import views as V
from convolake.plans.catalog import query
from convolake.plans.q_curation import WORDS_SQL


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(expr: str, pats, fn: str = "contains") -> str:
    return "(" + " OR ".join(f"{fn}({expr}, {lit(p)})" for p in pats) + ")"


NORM = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


# Driver-data lexicons: the text is invented, so English keywords never hit;
# frequent syllables of the four languages stand in for them.
DRIVER_EMOTION_RULES = [("urgent", "user", ["tion"]), ("empathetic", "user", ["keit", "ción"]),
                        ("apologetic", "response", ["eau"]), ("cheerful", "response", ["ung", "ent"])]
DRIVER_SIMPLE = ["the", "en", "hello", "hi", "le"]
DRIVER_QUESTION = ["tion", "sch"]
DRIVER_REASONING = ["eau", "keit"]


def emotion_sql(u: str, r: str, skill: str, rules) -> str:
    parts = []
    for label, field, kws in rules:
        parts.append(f"WHEN {any_sql(u if field == 'user' else r, kws)} THEN {lit(label)}")
    sr = L.EMOTION_SKILL_RULES
    tech = ", ".join(lit(s) for s in sr["technical_skills"])
    parts.append(f"WHEN {skill} IN ({tech}) AND length(ra) > {sr['technical_min_chars']} THEN 'confident'")
    parts.append(f"WHEN {skill} IN ({', '.join(lit(s) for s in sr['legal_skills'])}) THEN 'empathetic'")
    parts.append(f"WHEN {skill} IN ({', '.join(lit(s) for s in sr['sales_skills'])}) THEN 'excited'")
    return "CASE " + " ".join(parts) + " ELSE 'warm' END"


EXCH_SQL = """ex AS (
  SELECT conv_id, turn, skill_id, text AS ua, next_text AS ra FROM (
    SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
      lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM v_turns)
  WHERE role = 'user' AND next_role = 'assistant')"""


def exchanges_with_skill(t):
    from convolake.operators.curation import exchange_pairs
    tl = V.turns_labelled(t)
    x = exchange_pairs(tl)
    sk = tl.select("conv_id", "turn", "skill_id")
    return x.join(sk, ["conv_id", "turn"])


@query("label_emotion", "WITH " + EXCH_SQL + f"""
SELECT conv_id, turn, {emotion_sql('lower(ua)', 'lower(ra)', 'skill_id', DRIVER_EMOTION_RULES)} AS emotion FROM ex""")
def q_emotion(t):
    x = exchanges_with_skill(t)
    return LB.label_emotion(x, rules=DRIVER_EMOTION_RULES).select("conv_id", "turn", "emotion")


def query_label_sql(c: str) -> str:
    q = NORM.format(c=c)
    simple = " ".join(
        f"WHEN starts_with({q}, {lit(p)}) OR {q} = {lit(p)} THEN "
        f"{lit('greeting' if p in L.GREETING_PATTERNS else 'acknowledgment')}" for p in DRIVER_SIMPLE)
    si = f"(CASE {simple} END)"
    wc = WORDS_SQL.format(c=c)
    hq, hr = any_sql(q, DRIVER_QUESTION), any_sql(q, DRIVER_REASONING)
    cx = f"(CASE WHEN {wc} <= 5 AND NOT {hq} THEN 'simple' WHEN {hr} OR {wc} > 30 THEN 'complex' ELSE 'medium' END)"
    return (f"CASE WHEN {si} IS NOT NULL THEN 'simple' ELSE {cx} END AS complexity, "
            f"coalesce({si}, CASE WHEN contains({c}, '?') THEN 'question' ELSE 'statement' END) AS intent, "
            f"CASE WHEN {si} IS NOT NULL THEN false ELSE {hr} END AS requires_reasoning, "
            f"CAST(CASE WHEN {si} IS NOT NULL THEN 0.95 ELSE 0.8 END AS DOUBLE) AS confidence")


@query("label_query", f"""
SELECT conv_id, turn, {query_label_sql('text')} FROM conversations WHERE role = 'user'""")
def q_label_query(t):
    u = t.conversations.where(F.col("role") == "user")
    return LB.label_query(u, "text", DRIVER_SIMPLE, DRIVER_QUESTION, DRIVER_REASONING).select(
        "conv_id", "turn", "complexity", "intent", "requires_reasoning", "confidence")


@query("choose_route", f"""
WITH l AS (SELECT turn, {query_label_sql('text')} FROM conversations WHERE role = 'user')
SELECT CASE WHEN complexity = 'simple' THEN 'groq' WHEN complexity = 'complex' OR requires_reasoning THEN 'anthropic'
  WHEN turn % 2 = 0 THEN 'groq' ELSE 'groq' END AS provider, count(*) AS calls
FROM l GROUP BY 1""")
def q_route(t):
    u = t.conversations.where(F.col("role") == "user").withColumn("latency_critical", F.col("turn") % 2 == 0)
    lab = LB.label_query(u, "text", DRIVER_SIMPLE, DRIVER_QUESTION, DRIVER_REASONING)
    return LB.choose_route(lab, ["groq", "anthropic"], "latency_critical").groupBy("provider") \
        .agg(F.count("*").alias("calls"))


@query("choose_route_three", f"""
WITH l AS (SELECT conv_id, turn, {query_label_sql('text')} FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN complexity = 'simple' THEN 'groq' WHEN complexity = 'complex' OR requires_reasoning THEN 'anthropic'
  WHEN turn % 2 = 0 THEN 'groq' ELSE 'openai' END AS provider FROM l""")
def q_route_three(t):
    """Three providers: the branches of the latency flag differ."""
    u = t.conversations.where(F.col("role") == "user").withColumn("latency_critical", F.col("turn") % 2 == 0)
    lab = LB.label_query(u, "text", DRIVER_SIMPLE, DRIVER_QUESTION, DRIVER_REASONING)
    return LB.choose_route(lab, ["groq", "anthropic", "openai"], "latency_critical").select("conv_id", "turn", "provider")


def turn_end_sql(c: str) -> str:
    t = NORM.format(c=c)
    w = L.TURN_SCORE
    end = " + ".join(f"(CASE WHEN regexp_matches({t}, {lit(p)}) THEN {w['end']} ELSE 0.0 END)"
                     for p in L.TURN_END_PATTERNS)
    cont = " + ".join(f"(CASE WHEN regexp_matches({t}, {lit(p)}) THEN {w['continue']} ELSE 0.0 END)"
                      for p in L.TURN_CONTINUE_PATTERNS)
    wc = WORDS_SQL.format(c=t)
    end = (f"(0.0 + {end} + (CASE WHEN {wc} > {w['long_words']} THEN {w['length']} "
           f"WHEN {wc} < {w['short_words']} THEN -{w['length']} ELSE 0.0 END))")
    bc = " OR ".join(f"regexp_matches({t}, {lit(p)})" for p in L.BACKCHANNEL_PATTERNS)
    score = f"greatest(0.0, least(1.0, {w['base']} + {end} - (0.0 + {cont})))"
    return (f"CAST(round(CAST(CASE WHEN coalesce({t}, '') = '' THEN {w['empty']} WHEN {bc} THEN {w['backchannel']} "
            f"ELSE {score} END AS DECIMAL(38,10)), 2) AS DOUBLE)")


@query("turn_end_score", f"""
SELECT conv_id, turn, {turn_end_sql('text')} AS turn_end_score FROM conversations""")
def q_turn_end(t):
    return LB.turn_end_score(t.conversations, "text").select("conv_id", "turn", "turn_end_score")


@query("label_interruption", f"""
SELECT conv_id, turn, CASE
  WHEN duration_ms < 500 AND {any_sql(NORM.format(c='text'), L.BACKCHANNEL_WORDS)} THEN 'backchannel'
  WHEN {any_sql(NORM.format(c='text'), L.CORRECTION_STARTERS, 'starts_with')} THEN 'correction'
  WHEN {any_sql(NORM.format(c='text'), L.CLARIFICATION_STARTERS, 'starts_with')} THEN 'clarification'
  WHEN duration_ms > 300 AND {WORDS_SQL.format(c='text')} > 2 THEN 'barge_in' ELSE 'none' END AS interruption
FROM v_turns""")
def q_interruption(t):
    return LB.label_interruption(V.turns_labelled(t), "text", "duration_ms").select("conv_id", "turn", "interruption")


@query("backchannel_class", """
SELECT conv_id, turn, CASE WHEN length(text) * 40 > 5000 THEN 'encouragement'
  WHEN contains(text, '?') THEN 'understanding' ELSE 'acknowledgment' END AS backchannel_class FROM conversations""")
def q_backchannel(t):
    c = t.conversations.withColumn("speech_ms", F.length("text") * 40)
    return LB.backchannel_class(c, "text", "speech_ms").select("conv_id", "turn", "backchannel_class")


def step_sql(c: str) -> str:
    n = f"lower({c})"
    by_name = " ".join(f"WHEN {any_sql(n, pats)} THEN {step}" for step, pats in sorted(L.FILE_PATTERNS.items()))
    ext = f"lower(regexp_extract({c}, '^.+(\\.[^./\\\\]*)$', 1))"
    by_ext = " ".join(f"WHEN {ext} = {lit(e)} THEN {s}" for e, s in L.EXTENSION_STEPS.items())
    return f"CAST(coalesce(CASE {by_name} END, CASE {by_ext} END, 10) AS INTEGER)"


STEP_NAMES_SQL = "[" + ", ".join(lit(n) for n in L.STEP_NAMES) + "]"


@query("classify_files", f"""
SELECT file_id, {step_sql('name')} AS step, {STEP_NAMES_SQL}[{step_sql('name')}] AS step_name FROM v_files""")
def q_classify_files(t):
    return LB.classify_files(V.files(t)).select("file_id", "step", "step_name")


def taxonomy(spark):
    """code taxonomy: the fixed defaults (priority 2) and one override row (priority 1)."""
    rows = [(k, v, 2) for k, v in L.DOC_CODES.items()] + [("271", "Mechanical Roof Plan", 1)]
    return param_table(spark, rows, "code string, description string, priority int")


TAXONOMY_SQL = ("tx AS (SELECT code, arg_min(description, priority) AS description FROM (VALUES "
                + ", ".join(f"({lit(k)}, {lit(v)}, 2)" for k, v in L.DOC_CODES.items())
                + ", ('271', 'Mechanical Roof Plan', 1)) AS t(code, description, priority) GROUP BY code)")


@query("classify_by_code", f"""
WITH {TAXONOMY_SQL}
SELECT f.file_id, nullif(regexp_extract(f.name, '^(\\d{{3}})', 1), '') AS doc_code,
  CASE WHEN nullif(regexp_extract(f.name, '^(\\d{{3}})', 1), '') IS NULL THEN 'General Document'
       ELSE coalesce(tx.description, 'Project Document') END AS context
FROM v_files f LEFT JOIN tx ON nullif(regexp_extract(f.name, '^(\\d{{3}})', 1), '') = tx.code""")
def q_classify_by_code(t):
    return LB.classify_by_code(V.files(t), taxonomy(t.spark)).select("file_id", "doc_code", "context")


def _dialogue_sql() -> str:
    clean = "regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g')"
    dom = " ".join(
        f"WHEN contains(context, {lit(w)}) OR contains(name, {lit(fr)}) THEN {{'pair_no': 1, 'user': {lit(q)}, "
        f"'assistant': {lit(lead)} || clean}}" for w, fr, q, lead in L.DIALOGUE_RULES)
    return f"""
WITH {TAXONOMY_SQL},
f AS (SELECT file_id, name, text, nullif(regexp_extract(name, '^(\\d{{3}})', 1), '') AS doc_code FROM v_files
      WHERE lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.pdf', '.dxf')),
c AS (SELECT f.file_id, f.name, {clean} AS clean,
        CASE WHEN f.doc_code IS NULL THEN 'General Document' ELSE coalesce(tx.description, 'Project Document') END
          AS context
      FROM f LEFT JOIN tx ON f.doc_code = tx.code
      WHERE NOT (f.doc_code IS NULL AND contains(lower(f.name), 'taxonomy'))),
p AS (SELECT file_id, name, context, list_filter([
        {{'pair_no': 0, 'user': 'What is the file ' || name || '?',
          'assistant': 'This is the ' || context || '. It contains the following technical data: ' || clean
                       || '...'}},
        CASE {dom} END], lambda x: x IS NOT NULL) AS pairs FROM c)
SELECT file_id, name, context, u.pair_no, u.user, u.assistant FROM (SELECT file_id, name, context, unnest(pairs) AS u FROM p)"""


@query("project_dialogue", _dialogue_sql())
def q_project_dialogue(t):
    return LB.project_dialogue(V.files(t), taxonomy(t.spark))


@query("extract_references", """
SELECT doc_id,
  list_sort(list_distinct(regexp_extract_all(text, '0[5-9]\\d{4}[^0-9]', 0))) AS trade_codes,
  list_sort(list_distinct(regexp_extract_all(text, '[A-Z]-?\\d{3}', 0))) AS sheet_refs,
  regexp_extract_all(text, '(?i)SECTION\\s+(\\d{6})[^\\n]*', 1) AS sections,
  CASE WHEN strpos(lower(text), 'exclud') > 0 THEN list_filter(list_transform(
      string_split(split_part(lower(text), 'exclud', 2), chr(10)),
      lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10)
    ELSE [] END AS exclusions
FROM documents""")
def q_extract_refs(t):
    return LB.extract_references(t.documents).select("doc_id", "trade_codes", "sheet_refs", "sections", "exclusions")


# Invented test values: dialled numbers of the skills.
NUMBER_MAP = [("+15550000001", "electrician"), ("+15550000002", "plumber"), ("+15550000003", "solar"),
              ("+15550000004", "receptionist"), ("+15550000005", "lawyer")]


def calls(t):
    """call rooms ← events: a third of the rooms carry the skill in the name."""
    e = t.events
    kind = e.event_id % 3
    skill = V._pick(e.user_id % 6, ["electrician", "plumber", "solar", "receptionist", "lawyer", "unknownskill"])
    room = (F.when(kind == 0, F.concat(F.lit("room_"), skill, F.lit("_cust"), e.user_id.cast("string")))
            .when(kind == 1, F.concat(F.lit("r"), e.event_id.cast("string")))
            .otherwise(F.concat(F.lit("call-"), e.user_id.cast("string"))))
    meta = F.concat(F.lit('{"sip.trunkPhoneNumber": "+1555000000'), (e.user_id % 8).cast("string"), F.lit('"}'))
    return e.select("event_id", room.alias("room_name"), meta.alias("metadata"))


@query("route_skill", """
WITH nm AS (SELECT * FROM (VALUES """ + ", ".join(f"({lit(p)}, {lit(s)})" for p, s in NUMBER_MAP) + """) AS t(phone, skill)),
c AS (SELECT event_id,
  CASE event_id % 3 WHEN 0 THEN 'room_' || (CASE user_id % 6 WHEN 0 THEN 'electrician' WHEN 1 THEN 'plumber'
      WHEN 2 THEN 'solar' WHEN 3 THEN 'receptionist' WHEN 4 THEN 'lawyer' ELSE 'unknownskill' END)
      || '_cust' || CAST(user_id AS VARCHAR)
    WHEN 1 THEN 'r' || CAST(event_id AS VARCHAR) ELSE 'call-' || CAST(user_id AS VARCHAR) END AS room_name,
  '+1555000000' || CAST(user_id % 8 AS VARCHAR) AS phone FROM events),
x AS (SELECT event_id, CASE WHEN contains(room_name, '_') AND len(string_split(room_name, '_')) >= 2
    THEN string_split(room_name, '_')[2] END AS tok, phone FROM c)
SELECT x.event_id, coalesce((SELECT DISTINCT skill FROM nm WHERE nm.skill = x.tok),
  (SELECT skill FROM nm WHERE nm.phone = x.phone), 'receptionist') AS skill
FROM x""")
def q_route_skill(t):
    nm = param_table(t.spark, NUMBER_MAP, "phone string, skill string")
    return LB.route_skill(calls(t), nm, "receptionist").select("event_id", "skill")


# Invented skill patterns in registration order (syllables of the driver text).
SKILL_PATTERNS = [("receptionist", 0, "tion", 0, "Reception can help with that."),
                  ("receptionist", 0, "ouv", 1, "Opening hours are posted."),
                  ("electrician", 1, "keit", 0, "An electrician will call back."),
                  ("plumber", 2, "eau", 0, "A plumber is on the way."),
                  ("plumber", 2, "ción", 1, "Water service noted."),
                  ("solar", 3, "ung", 0, "Solar quotes are free.")]


def patterns_df(spark):
    return param_table(spark, SKILL_PATTERNS, "skill string, skill_ord int, pattern string, pattern_ord int, "
                                                 "response string")


PATTERNS_SQL = ("pt AS (SELECT * FROM (VALUES " + ", ".join(
    f"({lit(a)}, {b}, {lit(c)}, {d}, {lit(e)})" for a, b, c, d, e in SKILL_PATTERNS)
    + ") AS t(skill, skill_ord, pattern, pattern_ord, response))")

MATCH_SQL = f"""WITH {PATTERNS_SQL},
q AS (SELECT conv_id * 100 + turn AS id, text AS query FROM conversations WHERE role = 'user'),
m AS (SELECT q.id, arg_min(pt.skill, (pt.skill_ord, pt.pattern_ord)) AS skill,
        arg_min(pt.response, (pt.skill_ord, pt.pattern_ord)) AS response
      FROM q JOIN pt ON contains(lower(q.query), lower(pt.pattern)) GROUP BY q.id)"""


def user_queries(t):
    c = t.conversations.where(F.col("role") == "user")
    return c.select((c.conv_id * 100 + c.turn).alias("id"), F.col("text").alias("query"))


@query("match_skill", MATCH_SQL + """
SELECT q.id, coalesce(m.skill, 'general') AS matched_skill FROM q LEFT JOIN m ON q.id = m.id""")
def q_match_skill(t):
    return LB.match_skill(user_queries(t), patterns_df(t.spark), current="general").select("id", "matched_skill")


@query("canned_response", MATCH_SQL + """
SELECT count(*) AS queries, count(m.response) AS cache_hits,
  CAST(round(CAST(count(m.response) * 100.0 / count(*) AS DECIMAL(38,10)), 2) AS DOUBLE) AS hit_rate
FROM q LEFT JOIN m ON q.id = m.id""")
def q_canned(t):
    _, rate = LB.canned_response(user_queries(t), patterns_df(t.spark))
    return rate


def error_patterns(spark):
    rows, o = [], 0
    for cat, sev, pats in L.ERROR_CATEGORIES:
        for p in pats:
            rows.append((cat, sev, o, p))
            o += 1
    return param_table(spark, rows, "category string, severity string, ord int, pattern string")


def _error_sql() -> str:
    rows, o = [], 0
    for cat, sev, pats in L.ERROR_CATEGORIES:
        for p in pats:
            rows.append(f"({lit(cat)}, {lit(sev)}, {o}, {lit(p)})")
            o += 1
    return f"""WITH ep AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(category, severity, ord, pattern)),
lg AS (SELECT id, error_message AS message FROM v_interactions WHERE error_occurred),
m AS (SELECT lg.id, arg_min(ep.category, ep.ord) AS category, arg_min(ep.severity, ep.ord) AS severity
      FROM lg JOIN ep ON contains(lower(lg.message), lower(ep.pattern)) GROUP BY lg.id)
SELECT coalesce(m.category, 'unknown') AS category, coalesce(m.severity, 'low') AS severity, count(*) AS count
FROM lg LEFT JOIN m ON lg.id = m.id GROUP BY 1, 2"""


@query("error_classes", _error_sql())
def q_error_classes(t):
    logs = V.interactions(t).where(F.col("error_occurred")).select("id", F.col("error_message").alias("message"))
    return LB.error_classes(logs, error_patterns(t.spark))


# Invented persona descriptions per skill.
PERSONAS = [("general", "A friendly adult voice"), ("electrician", "A steady, practical male voice"),
            ("plumber", "A relaxed, helpful voice"), ("solar", "A bright, upbeat female voice"),
            ("receptionist", "A clear, welcoming female voice")]


@query("voice_context", "WITH " + EXCH_SQL + ", " + """
pe AS (SELECT * FROM (VALUES """ + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in PERSONAS) + """) AS t(skill_id, description)),
mo AS (SELECT * FROM (VALUES """ + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in L.EMOTION_MODIFIERS.items()) + """) AS t(emotion, modifier)),
e AS (SELECT conv_id, turn, skill_id, """ + emotion_sql('lower(ua)', 'lower(ra)', 'skill_id', DRIVER_EMOTION_RULES)
    + """ AS emotion FROM ex)
SELECT e.conv_id, e.turn, e.emotion,
  CASE WHEN coalesce(mo.modifier, '') <> '' THEN coalesce(pe.description, (SELECT description FROM pe WHERE skill_id = 'general'))
         || ', ' || mo.modifier
       ELSE coalesce(pe.description, (SELECT description FROM pe WHERE skill_id = 'general')) END AS voice_description
FROM e LEFT JOIN pe ON e.skill_id = pe.skill_id LEFT JOIN mo ON e.emotion = mo.emotion""")
def q_voice(t):
    x = LB.label_emotion(exchanges_with_skill(t), rules=DRIVER_EMOTION_RULES)
    personas = param_table(t.spark, PERSONAS, "skill_id string, description string")
    mods = param_table(t.spark, list(L.EMOTION_MODIFIERS.items()), "emotion string, modifier string")
    return LB.voice_context(x, personas, mods).select("conv_id", "turn", "emotion", "voice_description")
