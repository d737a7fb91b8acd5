"""One containment join at every size of the rules."""

from convolake.operators import labels as LB


def test_an_empty_pattern_matches_every_text_at_every_size(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id int, t string")
    rules = spark.createDataFrame([("", "any"), ("bc", "some"), (None, "none")], "p string, name string")
    for limit in (LB.BROADCAST_LIMIT, -1):
        got = LB.contains_join(texts, "id", texts["t"], rules, "p", limit=limit)
        assert sorted((r["__id"], r["name"]) for r in got.collect()) == [(1, "any"), (1, "some"), (2, "any")]


def test_only_empty_patterns(spark):
    texts = spark.createDataFrame([(1, "abc")], "id int, t string")
    rules = spark.createDataFrame([("", "any")], "p string, name string")
    assert [r["name"] for r in LB.contains_join(texts, "id", texts["t"], rules, "p").collect()] == ["any"]
