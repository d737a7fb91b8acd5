"""Hand-worked cases for the adapter registry and rule labelling."""

import datetime as dt

import pytest

from convolake.functions import lexicons as L
from convolake.operators import adapters as AD
from convolake.operators import analytics as AN
from convolake.operators import labels as LB

AD_SCHEMA = "id string, skill_id string, final_loss double, created_at timestamp_ntz, status string"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def test_q21_two_keep_best_rules(spark):
    df = spark.createDataFrame([("a", "s", 1200.0, T1, "completed"), ("b", "s", None, T2, "failed")], AD_SCHEMA)
    assert AD.best_adapter(df).collect()[0].id == "b"          # null counts as 999
    assert AD.keep_best_or_newest(df).collect()[0].id == "a"   # lowest non-null loss


def test_op65_tie_takes_newer(spark):
    df = spark.createDataFrame([("a", "s", 0.3, T1, "completed"), ("b", "s", 0.3, T2, "completed")], AD_SCHEMA)
    assert AD.best_adapter(df).collect()[0].id == "b"


def test_op67_cleanup_report(spark):
    df = spark.createDataFrame([("a", "s", 0.3, T1, "c"), ("b", "s", 0.2, T2, "c"), ("c", "t", 0.1, T1, "c")],
                               AD_SCHEMA)
    r = AD.adapter_cleanup_report(df).collect()
    assert [(x.skill_id, x.kept_id, x.deleted) for x in r] == [("s", "b", 1)]


def test_op23_loss_rating(spark):
    df = spark.createDataFrame([(v,) for v in (0.266, 0.423, 0.5, 1.0)], "final_loss double")
    assert [r.loss_rating for r in AD.loss_rating(df).collect()] == ["Excellent", "Great", "Good", "Needs More Data"]


def test_op24_budget(spark):
    counts = spark.createDataFrame([("s", 50), ("t", 120)], "skill_id string, n_examples int")
    times = spark.createDataFrame([(50, 12)], "n_examples int, minutes int")
    rates = spark.createDataFrame([("a10g", 1.10)], "gpu string, hourly_rate double")
    out = {r.skill_id: (r.est_minutes, r.est_cost_usd, r.confidence) for r in
           AD.training_budget(counts, times, rates).collect()}
    assert out == {"s": (12.0, 0.22, "high"), "t": (24.0, 0.44, "medium")}


def test_op73_loss_curve(spark):
    steps = spark.createDataFrame([(T1, "j", 1, 10, 3.38, 1.0), (T2, "j", 5, 10, 0.1751, 1.0)],
                                  "timestamp timestamp_ntz, job_id string, step int, total_steps int, loss double, "
                                  "step_time_seconds double")
    r = AD.loss_curve(steps).collect()[0]
    assert (r.improvement_pct, r.progress_pct, r.eta_seconds) == (94.8, 50.0, 5)


def test_op125_versions(spark):
    df = spark.createDataFrame([("a", "s", 0.5, T1, "completed"), ("b", "s", 0.4, T2, "completed")], AD_SCHEMA)
    out = [(r.version, r.is_active, r.loss_change) for r in AD.adapter_versions(df).orderBy("version").collect()]
    assert out == [(1, False, None), (2, True, -0.1)]


def test_op126_success_rate(spark):
    jobs = spark.createDataFrame([("s", "completed", 60, 1.0)] * 3 + [("s", "failed", 0, 0.0)],
                                 "skill_id string, status string, training_time_seconds int, cost_usd double")
    rows = {r.level: r.success_rate for r in AD.training_job_summary(jobs).collect()}
    assert rows == {"skill": 75.0, "overall": 75.0}


def test_op70_ewma(spark):
    df = spark.createDataFrame([("k", T1, 1, 100), ("k", T2, 2, 200)], "k string, ts timestamp_ntz, id int, x int")
    out = [round(r.ewma, 6) for r in AN.ewma(df, "k", ["ts", "id"], "x").orderBy("id").collect()]
    assert out == [10.0, 29.0]


def test_op70_ewma_matches_recurrence_across_blocks(spark):
    import random
    random.seed(1)
    rows = [("k", T1 + dt.timedelta(minutes=7 * i), i, random.randint(0, 1000)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, x int")
    s, want = 0.0, []
    for _, _, _, x in rows:
        s = 0.9 * s + 0.1 * x
        want.append(s)
    got = [r.ewma for r in AN.ewma(df, "k", ["ts", "id"], "x").orderBy("id").collect()]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9


def test_op71_last_turns_cap(spark):
    df = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(15)], "conv_id int, turn int, role string, text string")
    r = AN.last_turns(df, 10).collect()[0]
    assert len(r.last_turns) == 10 and r.last_turns[0] == "user: t5" and r.last_turns[-1] == "user: t14"


@pytest.mark.parametrize("user,skill,resp,want", [
    ("There's sparks coming from my outlet!", "electrician", "ok", "urgent"),
    ("I'm really frustrated with the service", "receptionist", "ok", "empathetic"),
    ("What are your hours?", "receptionist", "We open at 9.", "warm"),
    ("Great, I'd like to schedule an appointment", "solar", "Wonderful! See you then.", "cheerful"),
])
def test_op98_emotion(spark, user, skill, resp, want):
    df = spark.createDataFrame([(user, resp, skill)], "user_input string, agent_response string, skill_id string")
    assert LB.label_emotion(df).collect()[0].emotion == want


def test_op99_query_labels(spark):
    df = spark.createDataFrame([("hello there",), ("What are your hours?",), ("history of rome",),
                                ("Explain why my bill is high because I think it doubled",)], "query string")
    got = [(r.complexity, r.intent, r.confidence, r.requires_reasoning) for r in LB.label_query(df).collect()]
    assert got == [("simple", "greeting", 0.95, False), ("simple", "question", 0.8, False),
                   ("simple", "greeting", 0.95, False), ("complex", "statement", 0.8, True)]
    word = LB.label_query(df.limit(3), word=True).collect()
    assert (word[2].complexity, word[2].intent) == ("simple", "statement")   # Q16


def test_op100_route(spark):
    df = spark.createDataFrame([("simple", False), ("complex", True), ("medium", False)],
                               "complexity string, requires_reasoning boolean")
    assert [r.provider for r in LB.choose_route(df, ["groq", "anthropic"]).collect()] == ["groq", "anthropic", "groq"]


@pytest.mark.parametrize("text,want", [
    ("Hi, I need help with my plumbing because", 0.1),
    ("Hi, I need help with my plumbing because my sink is leaking.", 0.9),
    ("okay", 0.9), ("what time?", 0.7), ("", 0.5)])
def test_op101_turn_end(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert LB.turn_end_score(df).collect()[0].turn_end_score == want


@pytest.mark.parametrize("text,ms,want", [
    ("uh-huh", 300, "backchannel"), ("actually I meant Tuesday", 900, "correction"),
    ("sorry what", 600, "correction"), ("what was that", 600, "clarification"),
    ("I need it today please", 700, "barge_in"), ("hmm", 200, "none")])
def test_op102_interruption(spark, text, ms, want):
    df = spark.createDataFrame([(text, ms)], "text string, duration_ms int")
    assert LB.label_interruption(df).collect()[0].interruption == want


def test_op103_backchannel_class(spark):
    df = spark.createDataFrame([("go on", 6000), ("really?", 100), ("ok", 100)], "text string, speech_ms int")
    assert [r.backchannel_class for r in LB.backchannel_class(df).collect()] == [
        "encouragement", "understanding", "acknowledgment"]


def test_op104_file_classes(spark):
    cases = {"Scope of Work.docx": 1, "Section 07 5423.pdf": 2, "taper plan.pdf": 3, "GAF warranty.pdf": 4,
             "typical.pdf": 7, "takeoff.xlsx": 8, "contract.pdf": 9, "photo.jpg": 10, "IMG_22.dxf": 3, "x.pdf": 10}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r.name: r.step for r in LB.classify_files(df).collect()} == cases


def test_op39_codes_and_overrides(spark):
    files = spark.createDataFrame([("271-x.pdf",), ("999-a.pdf",), ("plain.pdf",)], "name string")
    tx = spark.createDataFrame([(k, v, 2) for k, v in L.DOC_CODES.items()] + [("999", "Override", 1)],
                               "code string, description string, priority int")
    got = {r.name: r.context for r in LB.classify_by_code(files, tx).collect()}
    assert got == {"271-x.pdf": "Mechanical Plan", "999-a.pdf": "Override", "plain.pdf": "General Document"}


def test_op96_dialogue(spark):
    files = spark.createDataFrame([("1", "271-x.pdf", "unit  RTU-1\n on roof")], "file_id string, name string, text string")
    tx = spark.createDataFrame([(k, v, 2) for k, v in L.DOC_CODES.items()], "code string, description string, priority int")
    out = LB.project_dialogue(files, tx).orderBy("pair_no").collect()
    assert len(out) == 2 and out[1].user == "Where are the RTUs or mechanical units located?"
    assert out[0].assistant.endswith("technical data: unit RTU-1 on roof...")


def test_op40_route_skill(spark):
    calls = spark.createDataFrame([("room_electrician_cust1", None),
                                   ("r1", '{"sip.trunkPhoneNumber": "+1555"}'), ("r2", None)],
                                  "room_name string, metadata string")
    nm = spark.createDataFrame([("+1555", "plumber"), ("+1666", "electrician")], "phone string, skill string")
    assert [r.skill for r in LB.route_skill(calls, nm, "receptionist").collect()] == [
        "electrician", "plumber", "receptionist"]


def test_op41_op42_match(spark):
    q = spark.createDataFrame([(1, "What are your hours?"), (2, "nothing")], "id int, query string")
    pats = spark.createDataFrame([("recep", 0, "hours", 0, "9 to 5"), ("recep", 0, "appointment", 1, "book"),
                                  ("other", 1, "hour", 0, "x")],
                                 "skill string, skill_ord int, pattern string, pattern_ord int, response string")
    out, rate = LB.canned_response(q, pats)
    got = {r.id: (r.matched_skill, r.cached_response) for r in out.collect()}
    assert got == {1: ("recep", "9 to 5"), 2: (None, None)} and rate.collect()[0].hit_rate == 50.0


def test_contains_join_fallback_is_exact(spark):
    q = spark.createDataFrame([(1, "abcabc"), (2, "xyz")], "id int, t string")
    rules = spark.createDataFrame([("bca",), ("z",), ("q",)], "p string")
    small = LB.contains_join(q, "id", q["t"], rules, "p")
    big = LB.contains_join(q, "id", q["t"], rules, "p", limit=-1)   # force the equi-join path
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect())) == [(1, "bca"), (2, "z")]


def test_op97_references(spark):
    df = spark.createDataFrame([("SECTION 075423 roofing\nsheet A-101 and A101\nExcluded: the following long line\n",)],
                               "text string")
    r = LB.extract_references(df).collect()[0]
    assert r.sections == ["075423"] and r.sheet_refs == ["A-101", "A101"]
    assert r.trade_codes == ["075423 "]


def test_qgram_join_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    alpha = "abcde "
    texts = [(i, "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    pats = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 7))) for _ in range(60)})
    q = spark.createDataFrame(texts, "id int, t string")
    rules = spark.createDataFrame([(p,) for p in pats], "p string")
    got = sorted(map(tuple, LB.contains_join(q, "id", q["t"], rules, "p", limit=-1).collect()))
    assert got == sorted({(i, p) for i, t in texts for p in pats if p in t})


def test_op97_one_section_per_line(spark):
    df = spark.createDataFrame([("SECTION 072200 and SECTION 075423\nsection 081100",)], "text string")
    assert LB.extract_references(df).collect()[0].sections == ["072200", "081100"]
