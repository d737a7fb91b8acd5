"""Cases that an oracle with the same formula would not notice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from convolake.functions.columns import word_count
from convolake.operators import analytics as AN
from convolake.operators import items as IT


def test_struct_schema_reaches_the_span(spark):
    df = spark.createDataFrame([('Here is it: {"k": 1} thanks',), ('```json\n{"k": 2}\n```',), ('{"k": 3}',), ("none",)], "t string")
    got = [r.parsed.k if r.parsed else None for r in IT.parse_model_json(df, "t", "k int").collect()]
    assert got == [1, 2, 3, None]


def test_question_with_a_colon_inside_a_word(spark):
    df = spark.createDataFrame([("Q: Is this made in the USA: yes or no? A: Yes it is",)], "text string")
    r = IT.extract_qa_pairs(df).collect()[0]
    assert (r.user_input, r.assistant_response) == ("Is this made in the USA: yes or no?", "Yes it is")


def test_item_ids_tell_fields_apart(spark):
    df = spark.createDataFrame([("s", "a_b", "c", "d"), ("s", "a", "b_c", "d"), ("s", None, "a", "d"), ("s", "a", None, "d")],
                               "skill_id string, source_filename string, user_input string, assistant_response string")
    ids = [r.id for r in IT.build_items(df).collect()]
    assert len(set(ids)) == 4 and all(len(i) == 64 for i in ids)


@pytest.mark.parametrize("alpha", [0.5, 0.1, 0.01])
def test_ewma_for_any_alpha(spark, alpha):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", t0 + dt.timedelta(seconds=40 * i), i, float((i * 37) % 101)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, x double")
    got = {r.id: r.ewma for r in AN.ewma(df, "k", ["ts", "id"], "x", alpha).collect()}
    s = 0.0
    for _, _, i, x in rows:
        s = (1 - alpha) * s + alpha * x
        assert got[i] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_word_count_splits_at_every_blank(spark):
    text = "a b  c\td e\n"
    assert spark.range(1).select(word_count(F.lit(text)).alias("n")).first().n == len(text.split())
