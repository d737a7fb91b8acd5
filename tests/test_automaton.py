"""First and all rules of a text, over shards of any size."""

import random

import pytest
from pyspark.sql import functions as F

from convolake.functions import automaton
from convolake.operators import labels as LB

RULES = "skill string, skill_ord int, pattern string, pattern_ord int, response string"


def _rules(rng, n):
    return [(f"s{rng.randrange(9)}", rng.randrange(6), rng.choice([None, "".join(rng.choice("abcÉ日") for _ in range(rng.randint(0 if i % 40 == 0 else 1, 4)))]),
             rng.randrange(3), rng.choice([None, "r1", "r2"])) for i in range(n)]


def _best(text, rules):
    if text is None:
        return None
    found = [((r[1], r[3]), r[0], (r[4] is not None, r[4] or ""), r[2].lower(), r) for r in rules if r[2] is not None and r[2].lower() in text.lower()]
    return min(found)[-1] if found else None


@pytest.mark.parametrize("shard", [100_000, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_match_skill_is_the_first_rule(spark, shard, seed, monkeypatch):
    monkeypatch.setattr(automaton, "SHARD_PATTERNS", shard)
    rng = random.Random(seed)
    rules = _rules(rng, 41 if seed == 1 else 30)[seed:]
    texts = [(i % 90, rng.choice([None, "", "".join(rng.choice("abcdÉé日") for _ in range(rng.randint(1, 9)))])) for i in range(120)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(texts)], "id int, query string, n int").repartition(4)
    got = {r.n: (r.matched_skill, r.cached_response) for r in LB.match_skill(df, spark.createDataFrame(rules, RULES), current="now").collect()}
    assert len(got) == len(texts)
    for n, (_, text) in enumerate(texts):
        best = _best(text, rules)
        assert got[n] == ((best[0], best[4]) if best else ("now", None)), text


def test_no_rules_and_no_join(spark):
    df = spark.createDataFrame([(1, "abc"), (1, None)], "id int, query string")
    none = LB.match_skill(df, spark.createDataFrame([], RULES), current="now")
    assert [r.matched_skill for r in none.collect()] == ["now", "now"]
    plan = LB.match_skill(df, spark.createDataFrame([("s", 1, "b", 1, "r")], RULES))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan


@pytest.mark.parametrize("shard", [100_000, 5])
def test_all_rules_of_a_text(spark, shard, monkeypatch):
    monkeypatch.setattr(automaton, "SHARD_PATTERNS", shard)
    rng = random.Random(4)
    rules = _rules(rng, 60)
    texts = [(i, rng.choice([None, "", "".join(rng.choice("abcd日") for _ in range(9))])) for i in range(40)]
    got = LB.contains_join(spark.createDataFrame(texts, "id int, t string"), "id", F.col("t"), spark.createDataFrame(rules, RULES), "pattern").collect()
    want = {(i, *r) for i, t in texts for r in rules if t is not None and r[2] is not None and r[2] in t}
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
