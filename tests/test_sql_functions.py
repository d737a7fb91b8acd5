"""The SQL functions agree with the DataFrame operators."""

from convolake.functions.sql_functions import register_functions
from convolake.operators import labels as LB


def test_sql_functions_match_operators(spark):
    register_functions(spark)
    texts = ["Hi, I need help with my plumbing because", "okay", "what time?", "", "actually I meant Tuesday",
             "I need it today please", "uh-huh"]
    df = spark.createDataFrame([(t, 400 + 150 * i) for i, t in enumerate(texts)], "text string, duration_ms int")
    df.createOrReplaceTempView("t_texts")
    sql = spark.sql("SELECT text, cl_turn_end_score(text) AS s, cl_interruption(text, duration_ms) AS i, "
                    "cl_word_count(text) AS w, cl_mask_secret(text) AS m FROM t_texts").collect()
    ops = LB.label_interruption(LB.turn_end_score(df), "text", "duration_ms").collect()
    assert [(r.s, r.i) for r in sql] == [(r.turn_end_score, r.interruption) for r in ops]
    assert sql[0].w == 8 and sql[1].m == "***"


def test_sql_emotion_and_complexity(spark):
    register_functions(spark)
    r = spark.sql("SELECT cl_emotion('There are sparks!', 'ok', 'electrician') AS e, "
                  "cl_query_complexity('Explain why my bill is high because I think it doubled') AS c").collect()[0]
    assert (r.e, r.c) == ("urgent", "complex")
