"""Temporary SQL functions for SQL users.

``register_functions(spark)`` defines SQL-bodied functions (no Python at
run time – the bodies are ordinary Spark SQL expressions, inlined by the
analyzer) for the word count / token estimate (op 21), secret masking
(op 19), emotion (op 98), query complexity (op 99), turn-end score (op 101)
and interruption class (op 102).  The bodies are generated from the same
lexicons as the DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from convolake.functions import lexicons as L


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(expr: str, pats, how: str = "contains") -> str:
    if how == "rlike":
        return "(" + " OR ".join(f"{expr} RLIKE {_lit(p)}" for p in pats) + ")"
    return "(" + " OR ".join(f"{how}({expr}, {_lit(p)})" for p in pats) + ")"


WORDS = "size(filter(split(trim(regexp_replace({c}, '\\\\s+', ' ')), ' '), w -> w != ''))"
NORM = "lower(regexp_replace({c}, '^\\\\s+|\\\\s+$', ''))"


def _turn_end(c: str) -> str:
    t = NORM.format(c=c)
    w = L.TURN_SCORE
    end = " + ".join(f"(CASE WHEN {t} RLIKE {_lit(p)} THEN {w['end']} ELSE 0.0 END)" for p in L.TURN_END_PATTERNS)
    cont = " + ".join(f"(CASE WHEN {t} RLIKE {_lit(p)} THEN {w['continue']} ELSE 0.0 END)"
                      for p in L.TURN_CONTINUE_PATTERNS)
    wc = WORDS.format(c=t)
    adj = (f"(CASE WHEN {wc} > {w['long_words']} THEN {w['length']} WHEN {wc} < {w['short_words']} "
           f"THEN -{w['length']} ELSE 0.0 END)")
    score = f"greatest(0.0, least(1.0, {w['base']} + (0.0 + {end} + {adj}) - (0.0 + {cont})))"
    return (f"CAST(round(CAST(CASE WHEN coalesce({t}, '') = '' THEN {w['empty']} "
            f"WHEN {_any(t, L.BACKCHANNEL_PATTERNS, 'rlike')} THEN {w['backchannel']} ELSE {score} END "
            f"AS DECIMAL(38,10)), 2) AS DOUBLE)")


def _interruption(c: str, ms: str) -> str:
    t = NORM.format(c=c)
    th = L.INTERRUPTION
    return (f"CASE WHEN {ms} < {th['backchannel_max_ms']} AND {_any(t, L.BACKCHANNEL_WORDS)} THEN 'backchannel' "
            f"WHEN {_any(t, L.CORRECTION_STARTERS, 'startswith')} THEN 'correction' "
            f"WHEN {_any(t, L.CLARIFICATION_STARTERS, 'startswith')} THEN 'clarification' "
            f"WHEN {ms} > {th['barge_in_min_ms']} AND {WORDS.format(c=c)} > {th['barge_in_min_words']} "
            f"THEN 'barge_in' ELSE 'none' END")


def _emotion(u: str, r: str, skill: str) -> str:
    parts = [f"WHEN {_any('lower(' + (u if f == 'user' else r) + ')', kws)} THEN {_lit(lab)}"
             for lab, f, kws in L.EMOTION_RULES]
    sr = L.EMOTION_SKILL_RULES
    inl = lambda xs: ", ".join(_lit(x) for x in xs)
    parts += [f"WHEN {skill} IN ({inl(sr['technical_skills'])}) AND length({r}) > {sr['technical_min_chars']} "
              f"THEN 'confident'",
              f"WHEN {skill} IN ({inl(sr['legal_skills'])}) THEN 'empathetic'",
              f"WHEN {skill} IN ({inl(sr['sales_skills'])}) THEN 'excited'"]
    return "CASE " + " ".join(parts) + " ELSE 'warm' END"


def _complexity(c: str) -> str:
    q = NORM.format(c=c)
    simple = " OR ".join(f"startswith({q}, {_lit(p)})" for p in L.SIMPLE_PATTERNS)
    wc = WORDS.format(c=c)
    qa = L.QUERY_ANALYSIS
    return (f"CASE WHEN {simple} THEN 'simple' "
            f"WHEN {wc} <= {qa['simple_max_words']} AND NOT {_any(q, L.QUESTION_WORDS)} THEN 'simple' "
            f"WHEN {_any(q, L.REASONING_WORDS)} OR {wc} > {qa['complex_min_words']} THEN 'complex' ELSE 'medium' END")


FUNCTIONS = {
    "cl_word_count": ("s STRING", "INT", WORDS.format(c="s")),
    "cl_token_estimate": ("s STRING", "BIGINT", "CAST(floor(length(s) / 4) AS BIGINT)"),
    "cl_mask_secret": ("s STRING", "STRING",
                       "CASE WHEN s IS NULL THEN NULL WHEN length(s) > 8 THEN concat(left(s, 4), '...', right(s, 4)) "
                       "ELSE '***' END"),
    "cl_turn_end_score": ("t STRING", "DOUBLE", _turn_end("t")),
    "cl_interruption": ("t STRING, ms DOUBLE", "STRING", _interruption("t", "ms")),
    "cl_emotion": ("u STRING, r STRING, skill STRING", "STRING", _emotion("u", "r", "skill")),
    "cl_query_complexity": ("q STRING", "STRING", _complexity("q")),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
