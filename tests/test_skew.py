"""Hot-key behaviour: one key holding a large share of the rows.

The balanced plans must give exactly the results of the default plans on
a skewed input derived from the driver tables (a third of all
conversation turns / events mapped onto one key)."""

from pyspark.sql import functions as F

from convolake.operators import curation as C
from convolake.operators import interactions as I
from convolake.operators import items as IT
from convolake.plans import views as V

SF = "/root/testdata/sf0.01"


def hot_turns(spark):
    c = V.Tables(spark, SF).conversations
    # a third of the conversations are folded into conversation 0 (turns renumbered apart)
    hot = c.conv_id % 3 == 0
    return c.select(F.when(hot, F.lit(0)).otherwise(c.conv_id).alias("conv_id"),
                    F.when(hot, c.conv_id * 100 + c.turn).otherwise(c.turn).alias("turn"), "role", "text")


def test_balanced_exchange_pairs_on_hot_conversation(spark):
    t = hot_turns(spark)
    a = sorted(map(tuple, C.exchange_pairs(t, balanced=False).collect()))
    b = sorted(map(tuple, C.exchange_pairs(t, balanced=True).collect()))
    assert a == b and len(a) > 100


def test_balanced_render_prompt_on_hot_conversation(spark):
    t = hot_turns(spark)
    a = sorted(map(tuple, C.render_prompt(t, balanced=False).collect()))
    b = sorted(map(tuple, C.render_prompt(t, balanced=True).collect()))
    c = sorted(map(tuple, C.render_prompt(t, balanced=True, bucket=16).collect()))
    assert a == b == c


def test_batch_rows_hot_skill(spark):
    x = V.extracted(V.Tables(spark, SF)).withColumn(
        "skill_id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("skill_id")))
    out = IT.batch_rows(x, "skill_id", 20, (F.desc("importance_score"), F.asc("id")))
    sizes = out.where(F.col("skill_id") == "hot").groupBy("batch_no").count().orderBy("batch_no").collect()
    assert all(r["count"] == 20 for r in sizes[:-1]) and sum(r["count"] for r in sizes) == x.where(
        F.col("skill_id") == "hot").count()


def test_session_feedback_hot_session(spark):
    t = V.Tables(spark, SF)
    inter = V.interactions(t).withColumn("session_id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(
        F.col("session_id")))
    fb = t.events.select(F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("session_id"),
                         (F.floor(F.col("value")) % 7).cast("int").alias("rating"), F.col("ts"))
    out = I.session_feedback(inter, fb)
    assert out.count() == inter.count()
    assert out.where(F.col("session_id") == -1).select("user_feedback").distinct().count() == 1


def test_salted_session_feedback_equals_plain(spark):
    t = V.Tables(spark, SF)
    inter = V.interactions(t).withColumn("session_id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(
        F.col("session_id")))
    fb = t.events.select(F.col("user_id").alias("session_id"), (F.floor(F.col("value")) % 7).cast("int").alias("rating"),
                         F.col("ts"))
    fb = fb.unionByName(fb.where(F.col("session_id") == 7).withColumn("session_id", F.lit(-1).cast("bigint")))
    cols = ["id", "session_id", "user_feedback", "call_completed"]
    a = sorted(map(tuple, I.session_feedback(inter, fb).select(*cols).collect()))
    b = sorted(map(tuple, I.session_feedback(inter, fb, salt_buckets=8).select(*cols).collect()))
    assert a == b


def test_bucketed_lead_across_range_boundaries(spark):
    # turns straddle several 4-turn ranges, with gaps and an empty range
    rows = [(1, t, "user" if i % 2 == 0 else "assistant", f"m{t}") for i, t in enumerate([0, 1, 3, 4, 7, 8, 17, 18, 19, 20])]
    t = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    a = sorted(map(tuple, C.exchange_pairs(t, balanced=False).collect()))
    b = sorted(map(tuple, C.exchange_pairs(t, balanced=True, bucket=4).collect()))
    assert a == b and len(a) == 5



def test_render_prompt_ranges_with_gaps(spark):
    turns = [0, 1, 2, 5, 9, 10, 11, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 60]
    rows = [(1, t, "user" if i % 3 != 1 else "assistant", f"m{t}") for i, t in enumerate(turns)]
    t = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    for k in (1, 3, 10):
        a = sorted(map(tuple, C.render_prompt(t, history=k, balanced=False).collect()))
        b = sorted(map(tuple, C.render_prompt(t, history=k, balanced=True, bucket=4).collect()))
        assert a == b
