"""One test per quirk decision of SURVEY §2.13 (Q1-Q21; Q22 is about API
naming only)."""

import datetime as dt

from pyspark.sql import functions as F

from convolake.operators import adapters as AD
from convolake.operators import changes as CH
from convolake.operators import curation as C
from convolake.operators import interactions as I
from convolake.operators import items as IT
from convolake.operators import labels as LB
from convolake.operators import projects as P
from convolake.operators import takeoff as TK
from convolake.plans import views as V
from convolake.sources import logs as SL

from tests.test_interactions import mk


def costed(spark, rows):
    return I.interaction_cost(I.derive_interaction(mk(spark, rows)), V.prices(spark))


def test_q1_recompute_aligned_to_hour(spark):
    t = dt.datetime
    df = costed(spark, [{"created_at": t(2024, 1, 1, 8, 10)}, {"created_at": t(2024, 1, 1, 8, 40)}])
    assert I.hourly_metrics(df, since="2024-01-01 08:35:00").collect()[0].total_calls == 2


def test_q2_trailing_window_on_as_of(spark):
    t = dt.datetime
    df = costed(spark, [{"created_at": t(2024, 1, 1, 8)}, {"created_at": t(2024, 1, 3, 8)}])
    r = {x.window_hours: x.total_calls for x in I.dashboard_metrics(df, "2024-01-03 09:00:00", (24, 72)).collect()}
    assert r == {24: 1, 72: 2}


def test_q3_days_branch_reachable(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts timestamp_ntz")
    assert C.time_ago(df, "ts", "2024-01-05 00:00:00").collect()[0].ago == "4 days ago"


def test_q4_candidate_flag_is_derived(spark):
    r = I.derive_interaction(mk(spark, [{"system_used": "deep"}, {"system_used": "deep", "error_occurred": True}]))
    assert [x.is_training_candidate for x in r.orderBy("id").collect()] == [True, False]


def test_q5_merged_output_not_counted(spark, tmp_path):
    d = str(tmp_path / "ds")
    df = spark.createDataFrame([("p", "c", "r", "s")], "prompt string, chosen string, rejected string, skill string")
    SL.write_training_set(df, d, "dpo", as_of="20240101")
    SL.write_training_set(df, d, "dpo", as_of="merged")
    assert SL.read_part_files(spark, d).count() == 1


def _items(spark, rows):
    return spark.createDataFrame(rows, "id string, skill_id string, user_input string, assistant_response string, "
                                       "category string, tags array<string>, importance_score double, tokens int, "
                                       "source_filename string, is_approved boolean, is_archived boolean")


def test_q6_archived_counted_before_filter(spark):
    df = _items(spark, [("1", "s", "q", "a", "c", [], 1.0, 1, "f", True, True)])
    r = IT.item_stats(df).collect()[0]
    assert (r.total, r.archived) == (0, 1)


def test_q7_total_uses_filters_and_promote_respects_skill(spark):
    df = _items(spark, [("1", "s", "q", "a", "x", [], 1.0, 1, "f", True, False),
                        ("2", "t", "q", "a", "y", [], 1.0, 1, "f", True, False)])
    assert IT.page_items(df, category="x").collect()[0].total == 1
    _, updated = IT.promote_items(df, df.select("id"), skill="s")
    assert {r.id: r.is_archived for r in updated.collect()} == {"1": True, "2": False}


def test_q8_priority_is_a_parameter(spark):
    a = spark.createDataFrame([("k", "from-a")], "id string, v string")
    b = spark.createDataFrame([("k", "from-b")], "id string, v string")
    assert CH.merge_by_priority([("a", a), ("b", b)], "id").collect()[0].v == "from-a"
    assert CH.merge_by_priority([("a", a), ("b", b)], "id", ["b", "a"]).collect()[0].v == "from-b"


def test_q9_same_content_same_id(spark):
    df = spark.createDataFrame([("s", "f", "q", "a"), ("s", "f", "q", "a")],
                               "skill_id string, source_filename string, user_input string, assistant_response string")
    assert IT.build_items(df).select("id").distinct().count() == 1


def test_q10_half_away_from_zero(spark):
    df = _items(spark, [("1", "s", "q", "a", "c", [], 50.0, 1, "f", True, False)])
    assert IT.promote_items(df, df.select("id"))[0].collect()[0].quality_score == 3


def test_q11_dashboard_counts_missing_latency_as_zero(spark):
    df = costed(spark, [{"total_latency_ms": 100}, {"fast_latency_ms": None}])
    r = I.dashboard_metrics(df, "2024-01-01 09:00:00", (24,)).collect()[0]
    h = I.hourly_metrics(df).collect()[0]
    assert r.avg_latency_ms == 50 and h.avg_latency_ms == 100


def test_q12_miles_factor(spark):
    assert {r.code: r.to_feet for r in V.units(spark).collect()}[3] == 5280.0


def test_q13_chord_length(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (3.0, 4.0)], False)], "points array<struct<x:double,y:double>>, c boolean")
    assert df.select(TK.path_length(F.col("points"), F.col("c")).alias("l")).collect()[0].l == 5.0


def test_q14_no_area_rows_is_zero(spark):
    areas = spark.createDataFrame([], "project_id string, sf double")
    details = spark.createDataFrame([("p",)], "project_id string")
    r = P.project_effort(areas, details).collect()[0]
    assert (r.total_sf, r.est_hours) == (0.0, 5.5)


def test_q15_first_match_in_step_order(spark):
    df = spark.createDataFrame([("taper plan.pdf",), ("cad detail.pdf",)], "name string")
    assert [r.step for r in LB.classify_files(df).collect()] == [3, 3]


def test_q16_prefix_matching(spark):
    df = spark.createDataFrame([("history of rome",)], "query string")
    assert LB.label_query(df).collect()[0].intent == "greeting"
    assert LB.label_query(df, word=True).collect()[0].intent == "statement"


def test_q17_sorry_is_correction(spark):
    df = spark.createDataFrame([("sorry what", 600)], "text string, duration_ms int")
    assert LB.label_interruption(df).collect()[0].interruption == "correction"


def test_q20_export_keeps_ids(spark):
    df = mk(spark, [{"system_used": "deep", "user_feedback": 5}])
    assert "id" in I.export_candidates(df).columns


def test_q21_two_keep_best_rules(spark):
    schema = "id string, skill_id string, final_loss double, created_at timestamp_ntz, status string"
    df = spark.createDataFrame([("a", "s", 1200.0, dt.datetime(2024, 1, 1), "c"),
                                ("b", "s", None, dt.datetime(2024, 1, 2), "c")], schema)
    assert (AD.best_adapter(df).collect()[0].id, AD.keep_best_or_newest(df).collect()[0].id) == ("b", "a")
