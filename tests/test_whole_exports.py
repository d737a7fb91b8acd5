"""Exports without a cap."""

import datetime as dt

from convolake.operators import interactions as I


def test_a_hot_skill_is_exported_whole(spark):
    cols = "id bigint, skill_id string, user_input string, agent_response string, user_feedback int, created_at timestamp, system_used string, error_occurred boolean, exported_for_training boolean"
    df = spark.createDataFrame([(i, "hot", "q", "a", 5, dt.datetime(2024, 1, 1), "deep", False, False) for i in range(1200)], cols)
    assert I.export_candidates(df).count() == 1200
    assert I.export_candidates(df, 4, 7).count() == 7
    marked = I.mark_exported(df, I.export_candidates(df).select("id"))
    assert marked.where("exported_for_training").count() == 1200
