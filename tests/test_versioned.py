"""Copy-on-write tables and ordered patches."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from convolake.operators import changes as CH
from convolake.sources.versioned import ConflictError, VersionedTable

SCHEMA = "id int, v string, n int"


@pytest.fixture
def table(spark):
    rows = spark.createDataFrame([(i, f"v{i}", i) for i in range(100)], SCHEMA)
    made = VersionedTable(spark, tempfile.mkdtemp(dir="/tmp") + "/t", rows.schema)
    assert made.read().count() == 0 and made.append(rows.repartitionByRange(5, "id")) == 1
    return made


def _rows(table, version=None):
    return {r.id: (r.v, r.n) for r in table.read(version).collect()}


def test_untouched_files_stay(spark, table):
    before, old = set(table.files()), _rows(table)
    assert len(before) == 5
    new = spark.createDataFrame([(3, "x", None, 1), (3, "y", None, 2), (3, "w", None, 0), (5, None, 50, 1), (200, "new", 1, 1)], SCHEMA + ", seq int")
    assert table.upsert(new, "id", order=["seq"]) == 2
    after = set(table.files())
    assert len(before & after) == 4 and len(after - before) >= 1  # 3 and 5 lie in one file, 200 in none
    assert _rows(table) == old | {3: ("y", 3), 5: ("v5", 50), 200: ("new", 1)}
    assert _rows(table, 1) == old and table.version() == 2


def test_patches_and_deletes(spark, table):
    before, old = set(table.files()), _rows(table)
    patches = spark.createDataFrame([(99, "a", None, 1), (99, "b", None, 2), (99, None, ["n"], 3), (7, None, ["v", "id"], 1), (500, "no", None, 1)],
                                    "id int, v string, set_null array<string>, seq int")
    table.schema = table.schema.add("updated_at", "timestamp_ntz")
    table.patch(patches, "id", ["v", "n"], "2024-01-02 00:00:00", ["seq"])
    assert _rows(table) == old | {99: ("b", None), 7: (None, 7)}
    assert {r.id for r in table.read().where("updated_at is not null").collect()} == {7, 99}
    assert len(before & set(table.files())) == 3
    table.delete(spark.createDataFrame([(0,), (1,), (9999,)], "id int"), "id")
    assert len(_rows(table)) == 98
    table.delete(spark.createDataFrame([], "id int"), "id")
    assert len(_rows(table)) == 98


def test_a_change_that_dies_leaves_the_old_version(spark, table, monkeypatch):
    old = _rows(table)

    def dies(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(table, "_publish", dies)
    with pytest.raises(RuntimeError):
        table.delete(spark.createDataFrame([(0,)], "id int"), "id")
    assert _rows(table) == old and table.version() == 1


def test_the_second_of_two_changes_fails(spark, table):
    other = VersionedTable(spark, table.path, table.schema)
    other.version = lambda: 1  # it began before
    table.delete(spark.createDataFrame([(0,)], "id int"), "id")
    with pytest.raises(ConflictError):
        other.delete(spark.createDataFrame([(1,)], "id int"), "id")
    assert set(_rows(table)) == set(range(1, 100)) and table.version() == 2


@pytest.mark.parametrize("seed", range(3))
def test_newest_patch_wins_column_by_column(spark, seed):
    rng = random.Random(seed)
    base = [(i, "old", i, dt.datetime(2023, 1, 1)) for i in range(12)]
    patches = [(rng.randrange(14), rng.choice([None, "a", "b"]), rng.choice([None, 7, 8]), rng.choice([None, [], ["v"], ["n", "v"]]), seq) for seq in range(40)]
    rng.shuffle(patches)
    got = CH.patch_rows(spark.createDataFrame(base, "id int, v string, n int, updated_at timestamp_ntz"),
                        spark.createDataFrame(patches, "id int, v string, n int, set_null array<string>, seq int"), "id", ["v"], "2024-01-01 00:00:00", order=["seq"])
    want = {i: ["old", n] for i, _, n, _ in base}
    for i, v, _, gone, _ in sorted(patches, key=lambda p: p[4]):
        if i in want:
            want[i][0] = None if gone and "v" in gone else want[i][0] if v is None else v
    assert {r.id: [r.v, r.n] for r in got.collect()} == want
    assert {r.id for r in got.where("updated_at >= '2024-01-01'").collect()} == {p[0] for p in patches} & set(want)


def test_order_inside_a_source(spark):
    a = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", None)], "id int, v string, seq int")
    b = spark.createDataFrame([(1, "other"), (3, "y")], "id int, v string")
    out = {r.id: (r.v, r.source) for r in CH.merge_by_priority([("a", a), ("b", b)], "id", order=["seq"]).collect()}
    assert out == {1: ("new", "a"), 2: ("x", "a"), 3: ("y", "b")}
    _, fresh = CH.insert_new_only(b.where("id = 3").withColumn("seq", F.lit(0)), a, order=["seq"])
    assert {r.id: r.v for r in fresh.collect()} == {1: "new", 2: "x"}
