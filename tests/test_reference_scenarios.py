"""The platform's own demo scenarios, replayed through our operators."""

import datetime as dt

from convolake.operators import curation as C
from convolake.operators import labels as LB


def test_skill_center_demo_cached_answer(spark):
    patterns = spark.createDataFrame([
        ("receptionist", 0, "hours", 0, "We're open Monday through Friday, 9 AM to 5 PM."),
        ("receptionist", 0, "appointment", 1, "I'd be happy to help you schedule an appointment!"),
        ("receptionist", 0, "location", 2, "We're located at 123 Main Street.")],
        "skill string, skill_ord int, pattern string, pattern_ord int, response string")
    q = spark.createDataFrame([(1, "What are your hours?")], "id int, query string")
    out, rate = LB.canned_response(q, patterns)
    r = out.collect()[0]
    assert (r.matched_skill, r.cached_response) == ("receptionist", "We're open Monday through Friday, 9 AM to 5 PM.")
    assert rate.collect()[0].hit_rate == 100.0


def test_continuous_learner_demo(spark):
    ts = dt.datetime(2024, 1, 10)
    log = spark.createDataFrame([
        (ts, "What time do you close?", "We close at 5pm.", "plumber", 2,
         "We're open 24/7 for emergencies! Regular hours are 8am to 6pm Monday through Friday."),
        (ts, "Do you fix water heaters?", "Yes, we fix water heaters.", "plumber", 5, None)],
        "timestamp timestamp_ntz, user_input string, agent_response string, skill_used string, rating int, "
        "correction string")
    pairs = C.correction_pairs(log)
    assert pairs.count() == 1
    assert C.low_rated(log, "2024-01-11 00:00:00").count() == 1
    assert C.enough_to_train(pairs, 5).count() == 0
