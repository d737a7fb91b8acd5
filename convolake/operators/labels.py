"""Rule-based labelling as column expressions (SURVEY §2 ops 39-42, 64,
97-105).

Keyword cascades become generated ``CASE WHEN`` expressions (no Python
UDF, stays in whole-stage codegen).  Rule *tables* (skill patterns, error
patterns) become a multi-pattern automaton that reads each text once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions import lexicons as L
from convolake.functions.automaton import all_matches
from convolake.functions.automaton import first_match as first_match_of
from convolake.functions.columns import round_half_up, strip, word_count
from convolake.functions.patterns import any_contains, first_match
from convolake.functions.sizing import BROADCAST_LIMIT, broadcast_if_small, estimated_bytes


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _norm(c) -> Column:
    """Python ``s.strip().lower()`` for ASCII whitespace."""
    return F.lower(strip(c))


# --- containment join of a rule table -------------------------------------

def contains_join(probe: DataFrame, id_col: str, text: Column, rules: DataFrame, pattern_col: str,
                  limit: int = BROADCAST_LIMIT) -> DataFrame:
    """All distinct (probe id, rule row) pairs where the rule pattern occurs in
    the text: each text is read once by the automaton of the rules, and only
    pairs that match are made.  ``limit`` is kept for callers and has no effect.
    An empty pattern occurs in every text that is not null, as in SQL."""
    found = probe.select(F.col(id_col).alias("__id"), F.explode(all_matches(rules, pattern_col)(text)).alias("__r"))
    return found.select("__id", "__r.*").dropDuplicates()


# --- 39-42: codes, routing, skill matching -------------------------------

def classify_by_code(files: DataFrame, taxonomy: DataFrame, name: str = "name",
                     default_known: str = "Project Document",
                     default_unknown: str = "General Document") -> DataFrame:
    """Op 39: the first three digits of the file name looked up in the code
    taxonomy; unknown code → "Project Document", no code → "General
    Document".  ``taxonomy`` (code, description, priority) may hold
    defaults and overrides – the lowest priority number wins per code."""
    tx = (taxonomy.groupBy("code").agg(F.min_by("description", "priority").alias("__desc")))
    size = estimated_bytes(tx)
    tx = F.broadcast(tx) if size is not None and size <= BROADCAST_LIMIT else tx
    code = F.regexp_extract(F.col(name), r"^(\d{3})", 1)
    x = files.withColumn("doc_code", F.nullif(code, F.lit("")))
    x = x.join(tx, x["doc_code"] == tx["code"], "left").drop("code")
    return x.withColumn("context", F.when(F.col("doc_code").isNull(), default_unknown)
                        .otherwise(F.coalesce(F.col("__desc"), F.lit(default_known)))).drop("__desc")


def route_skill(calls: DataFrame, number_map: DataFrame, default: str, room: str = "room_name",
                meta: str = "metadata") -> DataFrame:
    """Op 40: skill from the room name token (when it is a known skill),
    else from the dialled number in the participant metadata, else default."""
    nm = number_map.select(F.col("phone").alias("__ph"), F.col("skill").alias("__ps"))
    known = number_map.select(F.col("skill").alias("__ks")).distinct()
    sz = estimated_bytes(nm)
    if sz is not None and sz <= BROADCAST_LIMIT:
        nm, known = F.broadcast(nm), F.broadcast(known)
    parts = F.split(F.col(room), "_")
    token = F.when(F.col(room).contains("_") & (F.size(parts) >= 2), parts.getItem(1))
    phone = F.coalesce(F.get_json_object(F.col(meta), "$['sip.trunkPhoneNumber']"),
                       F.get_json_object(F.col(meta), "$.phone_number"))
    x = calls.withColumn("__tok", token).withColumn("__phone", phone)
    x = x.join(known, x["__tok"] == known["__ks"], "left")
    x = x.join(nm, x["__phone"] == nm["__ph"], "left")
    return (x.withColumn("skill", F.coalesce(F.col("__ks"), F.col("__ps"), F.lit(default)))
            .drop("__tok", "__phone", "__ks", "__ph", "__ps"))


def match_skill(queries: DataFrame, patterns: DataFrame, id_col: str = "id", text: str = "query",
                current: str | Column | None = None) -> DataFrame:
    """Op 41: first skill (registration order) with a pattern contained in the
    lower-cased query; else the current skill.

    ``patterns`` (skill, skill_ord, pattern, pattern_ord, response).  Each query
    is looked up where it stands, so repeated ids stay apart.
    """
    rules = patterns.select("skill", "skill_ord", F.lower("pattern").alias("__pat"), "pattern_ord", "response")
    match = first_match_of(rules, "__pat", ["skill_ord", "pattern_ord"], ["skill", "response"])
    cur = F.lit(current) if isinstance(current, str) or current is None else current
    return (queries.withColumn("__m", match(F.lower(F.col(text))))
            .withColumn("matched_skill", F.coalesce(F.col("__m.skill"), cur))
            .withColumn("cached_response", F.col("__m.response")).drop("__m"))


def canned_response(queries: DataFrame, patterns: DataFrame, id_col: str = "id",
                    text: str = "query") -> tuple[DataFrame, DataFrame]:
    """Op 42: the mapped response of the first matching pattern of the first
    matching skill; also the cache hit rate."""
    out = match_skill(queries, patterns, id_col, text)
    rate = out.agg(F.count("*").alias("queries"),
                   F.count("cached_response").alias("cache_hits")) \
        .withColumn("hit_rate", round_half_up(F.col("cache_hits") * 100.0 / F.col("queries"), 2))
    return out, rate


# --- 64: error classes ----------------------------------------------------

def error_classes(logs: DataFrame, patterns: DataFrame, id_col: str = "id", text: str = "message",
                  default: str = "unknown") -> DataFrame:
    """Op 64: first matching error category by pattern order, counted by
    category and severity.  ``patterns`` (category, severity, ord, pattern)."""
    rules = patterns.select("category", "severity", "ord", F.lower("pattern").alias("__pat"))
    match = first_match_of(rules, "__pat", ["ord"], ["category", "severity"])
    x = logs.select(match(F.lower(F.col(text))).alias("__m"))
    return (x.groupBy(F.coalesce(F.col("__m.category"), F.lit(default)).alias("category"),
                      F.coalesce(F.col("__m.severity"), F.lit("low")).alias("severity"))
            .agg(F.count("*").alias("count")))


# --- 97: references --------------------------------------------------------

def extract_references(df: DataFrame, col: str = "text") -> DataFrame:
    """Op 97: distinct trade codes and sheet references, section numbers in the
    order of the text (with repeats, as the platform gives them), and the lines between the first and the second "exclud", all of them."""
    t = F.col(col)
    trades = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"0[5-9]\d{4}[^0-9]"), 0)))
    sheets = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[A-Z]-?\d{3}"), 0)))
    # a match runs to the end of its line, so one line yields at most one section
    sections = F.regexp_extract_all(t, F.lit(r"(?i)SECTION\s+(\d{6})[^\n]*"), 1)
    low = F.lower(t)
    after = F.split_part(low, F.lit("exclud"), F.lit(2))
    exc_lines = F.filter(F.transform(F.split(after, "\n"), strip),
                         lambda s: F.length(s) > 10)
    exclusions = F.when(F.locate("exclud", low) > 0, exc_lines) \
        .otherwise(F.array().cast("array<string>"))
    return (df.withColumn("trade_codes", trades).withColumn("sheet_refs", sheets)
            .withColumn("sections", sections).withColumn("exclusions", exclusions))


# --- 98-103: conversation labels ------------------------------------------

def label_emotion(df: DataFrame, user: str = "user_input", response: str = "agent_response",
                  skill: str = "skill_id", rules=None, skill_rules=None) -> DataFrame:
    """Op 98: ordered keyword cascade over the user text and the agent
    text, then skill and length rules → one of ten emotions."""
    rules = rules or L.EMOTION_RULES
    sr = {**L.EMOTION_SKILL_RULES, **(skill_rules or {})}
    u, r = F.lower(F.col(user)), F.lower(F.col(response))
    e = None
    for label, field, kws in rules:
        cond = any_contains(u if field == "user" else r, kws)
        e = F.when(cond, label) if e is None else e.when(cond, label)
    tech = F.col(skill).isin(*sr["technical_skills"]) & (F.length(response) > sr["technical_min_chars"])
    e = (e.when(tech, "confident").when(F.col(skill).isin(*sr["legal_skills"]), "empathetic")
         .when(F.col(skill).isin(*sr["sales_skills"]), "excited").otherwise("warm"))
    return df.withColumn("emotion", e)


def label_query(df: DataFrame, text: str = "query", simple=None, question_words=None,
                reasoning_words=None, word: bool = False) -> DataFrame:
    """Op 99: complexity, intent, reasoning flag and confidence.

    Simple patterns are prefix matches (Q16: "hi" also hits "history");
    ``word=True`` requires the pattern to end at a word boundary."""
    simple = simple or L.SIMPLE_PATTERNS
    qw, rw = question_words or L.QUESTION_WORDS, reasoning_words or L.REASONING_WORDS
    q = _norm(text)
    def hit(p):
        if word:
            return (q == p) | q.startswith(p + " ") | q.rlike("^" + _re_escape(p) + r"\b")
        return q.startswith(p) | (q == p)
    simple_intent = None
    for p in simple:
        intent = "greeting" if p in L.GREETING_PATTERNS else "acknowledgment"
        simple_intent = F.when(hit(p), intent) if simple_intent is None else simple_intent.when(hit(p), intent)
    wc = word_count(F.col(text))
    has_q, has_r = any_contains(q, qw), any_contains(q, rw)
    qa = L.QUERY_ANALYSIS
    complexity = (F.when((wc <= qa["simple_max_words"]) & ~has_q, "simple")
                  .when(has_r | (wc > qa["complex_min_words"]), "complex").otherwise("medium"))
    is_simple = simple_intent.isNotNull()
    return (df.withColumn("complexity", F.when(is_simple, "simple").otherwise(complexity))
            .withColumn("intent", F.coalesce(simple_intent,
                                             F.when(F.col(text).contains("?"), "question").otherwise("statement")))
            .withColumn("requires_reasoning", F.when(is_simple, F.lit(False)).otherwise(has_r))
            .withColumn("confidence", F.when(is_simple, F.lit(qa["simple_confidence"]))
                        .otherwise(F.lit(qa["default_confidence"]))))


def _re_escape(s: str) -> str:
    import re
    return re.sub(r"([\\^$.|?*+()\[\]{}'])", r"\\\1", s)


def choose_route(df: DataFrame, available: Sequence[str], latency_critical: bool | str = True) -> DataFrame:
    """Op 100: provider from complexity, reasoning flag, latency flag and the
    available providers (input: the output of op 99)."""
    av = set(available)
    fast = "groq" if "groq" in av else "bitnet"
    smart = "anthropic" if "anthropic" in av else ("openai" if "openai" in av else None)
    balanced_slow = "openai" if "openai" in av else "groq"
    lat = F.col(latency_critical) if isinstance(latency_critical, str) else F.lit(bool(latency_critical))
    e = F.when(F.col("complexity") == "simple", F.lit(fast))
    if smart:
        e = e.when((F.col("complexity") == "complex") | F.col("requires_reasoning"), F.lit(smart))
    e = e.when(lat, F.lit(fast)).otherwise(F.lit(balanced_slow))
    return df.withColumn("provider", e)


def turn_end_score(df: DataFrame, text: str = "text", question_pending: str | None = None) -> DataFrame:
    """Op 101: probability that the speaker finished – 0.5 + 0.3 per end
    pattern − 0.4 per continue pattern (+0.2 pending question, ±0.1 by
    length), clamped to 0..1; backchannels score 0.9, empty text 0.5."""
    t = _norm(text)
    w = L.TURN_SCORE
    end = sum((F.when(t.rlike(p), w["end"]).otherwise(0.0) for p in L.TURN_END_PATTERNS), F.lit(0.0))
    if question_pending:
        end = end + F.when(F.col(question_pending), w["question_pending"]).otherwise(0.0)
    wc = word_count(t)
    end = end + F.when(wc > w["long_words"], w["length"]).when(wc < w["short_words"], -w["length"]).otherwise(0.0)
    cont = sum((F.when(t.rlike(p), w["continue"]).otherwise(0.0) for p in L.TURN_CONTINUE_PATTERNS), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(w["base"]) + end - cont))
    backchannel = any_contains(t, L.BACKCHANNEL_PATTERNS, "rlike")
    final = (F.when(F.coalesce(t, F.lit("")) == "", F.lit(w["empty"]))
             .when(backchannel, F.lit(w["backchannel"])).otherwise(score))
    return df.withColumn("turn_end_score", round_half_up(final, 2))


def label_interruption(df: DataFrame, text: str = "text", duration: str = "duration_ms") -> DataFrame:
    """Op 102: backchannel / correction / clarification / barge-in / none
    (correction is tested before clarification, Q17)."""
    t = _norm(text)
    d = F.col(duration)
    th = L.INTERRUPTION
    e = (F.when((d < th["backchannel_max_ms"]) & any_contains(t, L.BACKCHANNEL_WORDS), "backchannel")
         .when(any_contains(t, L.CORRECTION_STARTERS, "startswith"), "correction")
         .when(any_contains(t, L.CLARIFICATION_STARTERS, "startswith"), "clarification")
         .when((d > th["barge_in_min_ms"]) & (word_count(F.col(text)) > th["barge_in_min_words"]), "barge_in")
         .otherwise("none"))
    return df.withColumn("interruption", e)


def backchannel_class(df: DataFrame, text: str = "text", duration: str = "speech_ms") -> DataFrame:
    """Op 103: encouragement (long speech) / understanding (question) /
    acknowledgment."""
    return df.withColumn("backchannel_class",
                         F.when(F.col(duration) > L.BACKCHANNEL_LONG_SPEECH_MS, "encouragement")
                         .when(F.col(text).contains("?"), "understanding").otherwise("acknowledgment"))


# --- 104-105 --------------------------------------------------------------

def classify_files(df: DataFrame, name: str = "name", patterns=None, ext_steps=None) -> DataFrame:
    """Op 104: workflow step from the file name – first pattern in step order
    (Q15: "plan" in step 3 hides "taper plan"), then the extension default,
    else step 10."""
    patterns = patterns or L.FILE_PATTERNS
    ext_steps = ext_steps or L.EXTENSION_STEPS
    fname = F.lower(F.col(name))
    by_name = first_match(fname, [(step, pats) for step, pats in sorted(patterns.items())])
    # suffix as pathlib sees it: a leading dot alone (".dxf") is no suffix
    ext = F.lower(F.regexp_extract(F.col(name), r"^.+(\.[^./\\]*)$", 1))
    by_ext = first_match(ext, [(s, [e]) for e, s in ext_steps.items()], how="equals")
    step = F.coalesce(by_name, by_ext, F.lit(10)).cast("int")
    names = F.array(*[F.lit(n) for n in L.STEP_NAMES])
    return df.withColumn("step", step).withColumn("step_name", F.try_element_at(names, step))


def voice_context(df: DataFrame, personas: DataFrame, modifiers: DataFrame, skill: str = "skill_id",
                  emotion: str = "emotion", default_skill: str = "general") -> DataFrame:
    """Op 105: voice description = persona base (unknown skill → general)
    plus the emotion modifier when it has one."""
    p = broadcast_if_small(personas.select(F.col("skill_id").alias("__ps"), F.col("description").alias("__pd")))
    m = broadcast_if_small(modifiers.select(F.col("emotion").alias("__me"), F.col("modifier").alias("__mm")))
    dflt = personas.where(F.col("skill_id") == default_skill).select("description").scalar()
    x = df.join(p, F.col(skill) == F.col("__ps"), "left").join(m, F.lower(F.col(emotion)) == F.col("__me"), "left")
    base = F.coalesce(F.col("__pd"), dflt)
    desc = F.when(F.coalesce(F.col("__mm"), F.lit("")) != "", F.concat_ws(", ", base, F.col("__mm"))).otherwise(base)
    return x.withColumn("voice_description", desc).drop("__ps", "__pd", "__me", "__mm")


def project_dialogue(files: DataFrame, taxonomy: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Op 96: per drawing/PDF file one identity Q/A pair plus at most one
    domain pair chosen by the context/filename cascade.

    Whitespace is collapsed over the whole text; both answers hold all of it.
    """
    x = classify_by_code(files.where(F.lower(F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)).isin(".pdf", ".dxf")),
                         taxonomy, name)
    x = x.where(~(F.col("doc_code").isNull() & F.lower(F.col(name)).contains("taxonomy")))
    clean = F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    x = x.withColumn("__clean", clean)
    ident = F.struct(F.lit(0).alias("pair_no"),
                     F.concat(F.lit("What is the file "), F.col(name), F.lit("?")).alias("user"),
                     F.concat(F.lit("This is the "), F.col("context"),
                              F.lit(". It contains the following technical data: "),
                              F.col("__clean"), F.lit("...")).alias("assistant"))
    dom = None
    for ctx_word, frag, q, lead in L.DIALOGUE_RULES:
        cond = F.col("context").contains(ctx_word) | F.col(name).contains(frag)
        val = F.struct(F.lit(1).alias("pair_no"), F.lit(q).alias("user"),
                       F.concat(F.lit(lead), F.col("__clean")).alias("assistant"))
        dom = F.when(cond, val) if dom is None else dom.when(cond, val)
    pairs = F.array_compact(F.array(ident, dom))
    return x.select("file_id", name, "context", F.inline(pairs))
