"""Hand-worked cases for curation and item ops (FIXTURES §2)."""

import datetime as dt

from pyspark.sql import functions as F

from convolake.operators import curation as C
from convolake.operators import items as IT
from convolake.operators import changes as CH


def test_op14_messages_prefers_correction(spark):
    df = spark.createDataFrame([(1, "q", "a", "better"), (2, "q", "a", ""), (3, "q", "a", None)],
                               "id int, user_message string, assistant_response string, corrected_response string")
    got = {r.id: r.messages for r in C.shape_messages(df).collect()}
    assert '"content":"better"' in got[1] and '"content":"a"' in got[2] and '"content":"a"' in got[3]


def test_op16_render_prompt(spark):
    t = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "help")],
                              "conv_id int, turn int, role string, text string")
    out = {r.turn: r.prompt for r in C.render_prompt(t, system_prompt="Be brief").collect()}
    assert out[2] == "System: Be brief\nUser: hi\nAssistant: hello\nUser: help\nAssistant:"


def test_op17_fill_template_unknown_keys_stay(spark):
    tpl = spark.createDataFrame([("general", "Hi {name}, {x}")], "skill_id string, template string")
    df = spark.createDataFrame([("lawyer",)], "skill_id string").withColumn(
        "ctx", F.create_map(F.lit("name"), F.lit("A")))
    assert C.fill_template(df, tpl, "ctx").collect()[0].prompt == "Hi A, {x}"


def test_op18_append_knowledge(spark):
    df = spark.createDataFrame([("P", ["a", "b"], "Bob"), ("P", [], "Ann")],
                               "system_prompt string, knowledge array<string>, name string")
    out = C.append_knowledge(df).collect()
    assert out[0].full_prompt == "P\n\n## Quick Reference\n- a\n- b"
    assert out[1].full_prompt == "P" and out[1].greeting_text == "Hello! I'm Ann. How can I help?"


def test_op19_mask(spark):
    df = spark.createDataFrame([("abcdefghij",), ("short",)], "k string")
    assert [r.k for r in C.mask_secrets(df, ["k"]).collect()] == ["abcd...ghij", "***"]


def test_op20_q3_days_reachable(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 4, 0, 0, 30),)], "ts timestamp_ntz")
    out = [r.ago for r in C.time_ago(df, "ts", "2024-01-04 00:01:00").orderBy("ts").collect()]
    assert out == ["3 days ago", "just now"]


def test_op21_tokens(spark):
    df = spark.createDataFrame([("one  two\tthree\n",)], "text string")
    r = C.token_estimates(df).collect()[0]
    assert (r.words, r.approx_tokens) == (3, 15 // 4)


def test_op30_low_rated(spark):
    ts = dt.datetime(2024, 1, 10)
    df = spark.createDataFrame([(ts, r) for r in (None, 0, 2, 3, 5)], "timestamp timestamp_ntz, rating int")
    assert sorted(r.rating for r in C.low_rated(df, "2024-01-11 00:00:00", 7, 3).collect()) == [2, 3]


def test_op93_op94_pairs_and_dedup(spark):
    ts = dt.datetime(2024, 1, 10)
    log = spark.createDataFrame([
        (ts, "What are your hours?", "9-5", "electrician", 5, None),
        (ts, "Do you do panels?", "No.", "electrician", 2, "Yes, we install panels."),
        (ts, "Do you do panels?", "No.", "electrician", 2, "Yes, we install panels.")],
        "timestamp timestamp_ntz, user_input string, agent_response string, skill_used string, rating int, "
        "correction string")
    pairs = C.correction_pairs(log)
    assert pairs.count() == 2
    ds = C.preference_dataset(pairs, log, "2024-01-11 00:00:00", 7).collect()
    assert len(ds) == 1 and ds[0].low_rated_count == 2      # duplicates dropped (Q5)


def test_op46_exchange_pairs(spark):
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
                               (1, 3, "user", "d"), (1, 4, "assistant", "e")],
                              "conv_id int, turn int, role string, text string")
    assert [(r.turn, r.agent_response) for r in C.exchange_pairs(t).orderBy("turn").collect()] == [(0, "b"), (3, "e")]


def test_op74_union_ignores_approval(spark):
    manual = spark.createDataFrame([("s", "q1", "a1"), ("s", "q2", "a2")],
                                   "skill_id string, user_message string, assistant_response string")
    ext = spark.createDataFrame([("s", "q3", "a3", False, False), ("s", "q4", "a4", True, False),
                                 ("s", "q5", "a5", False, True)],
                                "skill_id string, user_input string, assistant_response string, is_archived boolean, "
                                "is_approved boolean")
    assert C.all_training_examples(manual, ext).count() == 4


def test_op95_knowledge_examples(spark):
    sk = spark.createDataFrame([("s", "Sam", "P")], "id string, name string, system_prompt string")
    kn = spark.createDataFrame([("s", 1, "Hours: 9-5"), ("s", 2, "x" * 60)], "skill_id string, ord int, item string")
    out = C.knowledge_examples(sk, kn).collect()
    assert len(out) == 7
    inputs = {r.input for r in out if r.kind == "knowledge"}
    assert inputs == {"Tell me about Hours", "Tell me about " + "x" * 60}


ITEM_SCHEMA = ("id string, skill_id string, user_input string, assistant_response string, category string, "
               "tags array<string>, importance_score double, tokens int, source_filename string, "
               "is_approved boolean, is_archived boolean")


def items(spark, rows):
    return spark.createDataFrame(rows, ITEM_SCHEMA)


def test_op35_valid_items(spark):
    df = spark.createDataFrame([("12345", "a" * 11), ("123456", "a" * 11), ("123456", "short")], "user_input string, "
                               "assistant_response string")
    assert IT.valid_qa_items(df).count() == 1


def test_op38_scores(spark):
    it = spark.createDataFrame([("a",), ("b",)], "id string")
    sc = spark.createDataFrame([("a", 85)], "id string, score int")
    assert [(r.id, r.importance_score) for r in IT.apply_scores(it, sc).collect()] == [("a", 85.0), ("b", 50.0)]


def test_op53_q6_archived_counted(spark):
    df = items(spark, [("1", "s", "q", "a", "c", [], 50.0, 10, "f", True, False),
                       ("2", "s", "q", "a", "c", [], 60.0, 10, "f", False, False),
                       ("3", "s", "q", "a", "c", [], 70.0, 10, "f", True, True)])
    r = IT.item_stats(df).collect()[0]
    assert (r.total, r.approved, r.pending, r.archived, r.avg_importance) == (2, 1, 1, 1, 55.0)


def test_op32_paging_total_uses_filters(spark):
    df = items(spark, [(str(i), "s", "q", "a", "c" if i < 5 else "d", [], float(i), 1, "f", False, False)
                       for i in range(12)])
    p = IT.page_items(df, "importance_score", "desc", 2, 2, category="c").collect()
    assert [r.id for r in p] == ["2", "1"] and p[0].total == 5 and p[0].pages == 3


def test_op55_top_tags_ties_by_tag(spark):
    df = items(spark, [("1", "s", "q", "a", "c", ["b", "a"], 1.0, 1, "f", False, False),
                       ("2", "s", "q", "a", "c", ["c"], 1.0, 1, "f", False, False)])
    assert [r.tag for r in IT.top_tags(df, 2).orderBy("rank").collect()] == ["a", "b"]


def test_op76_insert_idempotent(spark):
    base = spark.createDataFrame([("1", "x")], "id string, v string")
    new = spark.createDataFrame([("2", "y"), ("2", "y"), ("1", "z")], "id string, v string")
    t1, ins1 = CH.insert_new_only(base, new)
    t2, ins2 = CH.insert_new_only(t1, new)
    assert ins1.count() == 1 and ins2.count() == 0 and t2.count() == 2


def test_op80_tag_no_duplicate(spark):
    df = items(spark, [("1", "s", "q", "a", "c", ["x"], 1.0, 1, "f", False, False),
                       ("2", "s", "q", "a", "c", [], 1.0, 1, "f", False, False)])
    out = IT.bulk_edit(df, df.select("id"), "tag", "x", skill="s")
    assert sorted(tuple(r.tags) for r in out.collect()) == [("x",), ("x",)]


def test_op81_quality_rounding(spark):
    df = items(spark, [(str(i), "s", "q", "a", "c", [], v, 1, "f.txt", True, False) for i, v in enumerate((0., 50., 100.))])
    new_rows, updated = IT.promote_items(df, df.select("id"), skill="s")
    assert [r.quality_score for r in new_rows.orderBy("id").collect()] == [1, 3, 5]
    assert new_rows.first().source == "extracted:f.txt" and updated.where("is_archived").count() == 3


def test_op90_chunking(spark):
    df = spark.createDataFrame([("aaaa\n\nbbbb\n\ncccc",), ("short",)], "text string")
    out = IT.chunk_text(df, "text", 10).collect()
    assert [r.chunk for r in out if r.text != "short"] == ["aaaa", "bbbb", "cccc"]
    assert [r.chunk for r in out if r.text == "short"] == ["short"]


def test_op90_chunks_keep_all_paragraphs(spark):
    text = "\n\n".join(f"para{i} " + "w" * (i * 7 % 40) for i in range(40))
    df = spark.createDataFrame([(text,)], "text string")
    chunks = [r.chunk for r in IT.chunk_text(df, "text", 120).orderBy("chunk_no").collect()]
    assert "\n\n".join(chunks) == text and all(len(c) < 120 for c in chunks)


def test_op91_model_json(spark):
    df = spark.createDataFrame([("```json\n[{\"q\": \"a\"}]\n```",), ("Here: [{\"q\": \"b\"}] ok",), ("nothing",)],
                               "reply string")
    out = [r.parsed for r in IT.parse_model_json(df, "reply", "array<struct<q string>>").collect()]
    assert out[0][0].q == "a" and out[1][0].q == "b" and out[2] == []


def test_op92_content_hash_stable(spark):
    df = spark.createDataFrame([("s", "f", "What is X?", "It is Y.")],
                               "skill_id string, source_filename string, user_input string, assistant_response string")
    a, b = IT.build_items(df).collect()[0], IT.build_items(df).collect()[0]
    assert a.id == b.id and len(a.id) == 64 and a.tokens == 6 and a.importance_score == 50.0


def test_op124_qa_lines(spark):
    df = spark.createDataFrame([('"What is X?" -> Y.\nQ: What is X? A: Y.\nplain line',)], "text string")
    out = [(r.user_input, r.assistant_response) for r in IT.extract_qa_pairs(df).collect()]
    assert out == [("What is X?", "Y."), ("What is X?", "Y.")]


def test_op34_recent_activity(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "error" if i % 2 else "view", base + dt.timedelta(hours=i)) for i in range(10)],
                               "id int, category string, created_at timestamp_ntz")
    out = C.recent_activity(df, 2, "error").collect()
    assert [r.id for r in out] == [9, 7] and out[0].ago == "just now" and out[1].ago == "2 hours ago"


def test_op37_nest_children(spark):
    par = spark.createDataFrame([(1, "p"), (2, "q")], "k int, name string")
    kid = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, ord int, v string")
    out = {r.k: [c.v for c in r.children] for r in C.nest_children(par, kid, "k", ["ord"]).collect()}
    assert out == {1: ["a", "b"], 2: []}


def test_row_number_within_hot_key_matches_window(spark):
    from pyspark.sql import Window
    from convolake.functions.ordering import row_number_within
    rows = [("hot" if i % 5 < 3 else f"k{i % 7}", i, (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id int, v int")
    got = row_number_within(df, ["k"], [F.desc("v"), F.asc("id")], "rn", num_partitions=16)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id")))
    assert sorted(map(tuple, got.select("k", "id", "rn").collect())) == \
        sorted(map(tuple, want.select("k", "id", "rn").collect()))


def test_op46_balanced_equals_window(spark):
    t = spark.createDataFrame([(c, i, "user" if i % 2 == 0 else "assistant", f"t{c}{i}")
                               for c in range(3) for i in range(0, 40, 3)],
                              "conv_id int, turn int, role string, text string")
    a = sorted(map(tuple, C.exchange_pairs(t, balanced=False).collect()))
    b = sorted(map(tuple, C.exchange_pairs(t, balanced=True, bucket=4).collect()))
    assert a == b and len(a) > 0


def test_op16_full_history_option(spark):
    t = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(30)],
                              "conv_id int, turn int, role string, text string")
    full = {r.turn: r.prompt for r in C.render_prompt(t, history=None).collect()}
    capped = {r.turn: r.prompt for r in C.render_prompt(t).collect()}
    assert full[28].count("\n") == 29 and capped[28].count("\n") == 11


def test_op44_null_in_keep_set_does_not_empty_result(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    keep = spark.createDataFrame([(1,), (None,)], "id int")
    assert sorted(r.id for r in CH.rows_to_retire(df, keep).collect()) == [2, 3]   # SQL NOT IN would give nothing


def test_op43_select_ids_within_skill(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, skill_id string")
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert sorted(r.id for r in CH.select_ids(df, ids, "a").collect()) == [1]
    assert sorted(r.id for r in CH.select_ids(df, ids).collect()) == [1, 2]
