"""Hand-worked cases for interaction analytics (FIXTURES §2)."""

import datetime as dt
from decimal import Decimal

import numpy as np

from convolake.operators import interactions as I
from convolake.plans import views as V

SCHEMA = ("id bigint, created_at timestamp_ntz, session_id bigint, skill_id string, user_input string, "
          "agent_response string, system_used string, fast_latency_ms int, deep_latency_ms int, "
          "total_latency_ms int, user_feedback int, call_completed boolean, error_occurred boolean, "
          "error_message string, input_tokens int, output_tokens int, exported_for_training boolean")


def mk(spark, rows):
    base = dict(id=0, created_at=dt.datetime(2024, 1, 1, 8), session_id=1, skill_id="plumber", user_input="q",
                agent_response="a", system_used="fast", fast_latency_ms=85, deep_latency_ms=None,
                total_latency_ms=None, user_feedback=None, call_completed=False, error_occurred=False,
                error_message=None, input_tokens=0, output_tokens=0, exported_for_training=False)
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    data = [tuple({**base, "id": i, **r}[c] for c in cols) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def test_op10_total_latency(spark):
    df = I.derive_interaction(mk(spark, [{}, {"system_used": "deep", "deep_latency_ms": 1950}]))
    got = {r.id: (r.total_latency_ms, r.is_training_candidate) for r in df.collect()}
    assert got == {0: (85, False), 1: (2035, True)}


def test_op11_cost_rounding(spark):
    df = mk(spark, [{"input_tokens": 100, "output_tokens": 50},
                    {"system_used": "deep", "input_tokens": 100, "output_tokens": 50}])
    out = I.interaction_cost(df, V.prices(spark)).orderBy("id").collect()
    assert [r.estimated_cost_usd for r in out] == [Decimal("0.000099"), Decimal("0.001050")]


def test_op12_validation(spark):
    df = mk(spark, [{}, {"skill_id": None}, {"system_used": "slow"}, {"user_feedback": 9}, {"user_feedback": 5}])
    ok, bad = I.validate_interactions(df)
    assert sorted(r.id for r in ok.collect()) == [0, 4]
    assert {r.id: r.reject_reason for r in bad.collect()} == {
        1: "skill_id is null", 2: "system_used not in (fast, deep)", 3: "user_feedback not in 1..5"}


def test_op22_throughput(spark):
    df = mk(spark, [{"output_tokens": 50, "total_latency_ms": 250}, {"output_tokens": 0, "total_latency_ms": 250}])
    assert [r.tokens_per_sec for r in I.throughput_metrics(df).orderBy("id").collect()] == [200.0, None]


def test_op26_candidates(spark):
    df = mk(spark, [
        {"system_used": "deep", "user_feedback": 5},
        {"system_used": "deep", "user_feedback": 3},
        {"system_used": "fast", "user_feedback": 5},
        {"system_used": "deep", "user_feedback": 5, "error_occurred": True},
        {"system_used": "deep", "user_feedback": 4, "exported_for_training": True}])
    assert [r.id for r in I.training_candidates(df).collect()] == [0]


def test_op27_op28_export_then_mark(spark):
    df = mk(spark, [{"system_used": "deep", "user_feedback": 5, "skill_id": "a"},
                    {"system_used": "deep", "user_feedback": 4, "skill_id": "a"},
                    {"system_used": "deep", "user_feedback": 5, "skill_id": "b"}])
    exp = I.export_candidates(df, 4, 1)
    assert sorted(r.id for r in exp.collect()) == [0, 2]   # ids kept (Q20), cap 1 per skill
    marked = I.mark_exported(df, exp.select("id"))
    assert {r.id: r.exported_for_training for r in marked.collect()} == {0: True, 1: False, 2: True}


def test_op45_session_feedback(spark):
    df = mk(spark, [{"session_id": 1}, {"session_id": 1}, {"session_id": 1}, {"session_id": 2}])
    fb = spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 1, 9)), (1, 9, dt.datetime(2024, 1, 1, 10))],
                               "session_id bigint, rating int, ts timestamp_ntz")
    out = {r.id: (r.user_feedback, r.call_completed) for r in I.session_feedback(df, fb).collect()}
    assert out == {0: (5, True), 1: (5, True), 2: (5, True), 3: (None, False)}


def test_op47_q1_aligned_recompute(spark):
    t = dt.datetime
    df = I.derive_interaction(mk(spark, [{"created_at": t(2024, 1, 1, 8, 10)}, {"created_at": t(2024, 1, 1, 8, 40)},
                                         {"created_at": t(2024, 1, 1, 10, 30)}]))
    df = I.interaction_cost(df, V.prices(spark))
    # as_of 10:35, recompute the last 2 hours: the 08 bucket is recomputed whole
    out = {r.hour_bucket: r.total_calls for r in I.hourly_metrics(df, since="2024-01-01 08:35:00").collect()}
    assert out == {t(2024, 1, 1, 8): 2, t(2024, 1, 1, 10): 1}


def test_op48_dashboard(spark):
    rows = [{"system_used": "fast" if i < 18 else "deep", "error_occurred": i < 2} for i in range(20)]
    df = I.interaction_cost(I.derive_interaction(mk(spark, rows)), V.prices(spark))
    r = I.dashboard_metrics(df, "2024-01-01 09:00:00", (24,)).collect()[0]
    assert (r.total_calls, r.system1_percentage, r.error_rate, r.system1_count) == (20, 90.0, 10.0, 18)


def test_op49_unknown_skill(spark):
    df = mk(spark, [{"skill_id": None}, {"skill_id": "a"}])
    assert sorted(tuple(r) for r in I.calls_by_skill(df).collect()) == [("a", 1), ("unknown", 1)]


def test_op51_exact_percentiles_match_numpy(spark):
    vals = [5, 1, 9, 9, 3, 7, 100, 2]
    df = mk(spark, [{"total_latency_ms": v} for v in vals])
    r = I.latency_percentiles(df, ("skill_id",)).collect()[0]
    assert r.p50 == round(float(np.percentile(vals, 50)), 3)
    assert r.p99 == round(float(np.percentile(vals, 99)), 3)


def test_op52_rollup_levels(spark):
    df = I.interaction_cost(I.derive_interaction(mk(spark, [{}, {"system_used": "deep"}])), V.prices(spark))
    levels = sorted(r.grouping_level for r in I.routing_rollup(df).collect())
    assert levels == [0, 0, 1, 3]


def test_band_percentiles_exact_on_continuous_values(spark):
    rng = np.random.default_rng(7)
    rows = [("big", float(v)) for v in rng.exponential(300.0, 20000)] + \
           [("small", float(v)) for v in rng.normal(50.0, 5.0, 37)] + [("one", 3.25)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.p50, r.p99) for r in I.band_percentiles(df, ["g"], "x", (0.5, 0.99), accuracy=1000).collect()}
    for g in ("big", "small", "one"):
        vals = [v for k, v in rows if k == g]
        want = (round(float(np.percentile(vals, 50)), 3), round(float(np.percentile(vals, 99)), 3))
        assert got[g] == want, (g, got[g], want)
