"""Hand-worked takeoff and project cases (FIXTURES §2)."""

from pyspark.sql import functions as F

from convolake.operators import labels as LB
from convolake.operators import projects as P
from convolake.operators import takeoff as TK
from convolake.plans import views as V

ENT = ("drawing string, entity_id bigint, type string, layer string, color int, "
       "points array<struct<x:double,y:double>>, closed boolean, radius double, text string, height double, "
       "block_name string, measurement double, units_code int")


def ent(spark, rows):
    base = dict(drawing="d", entity_id=0, type="LINE", layer="L", color=1, points=[], closed=False, radius=None,
                text=None, height=None, block_name=None, measurement=None, units_code=2)
    cols = [c.split()[0] for c in ENT.split(", ")]
    return spark.createDataFrame([tuple({**base, "entity_id": i, **r}[c] for c in cols) for i, r in enumerate(rows)], ENT)


def test_op111_linear_feet(spark):
    sq = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    df = ent(spark, [
        {"drawing": "a", "points": [(0.0, 0.0), (3.0, 4.0)], "units_code": 1},
        {"drawing": "b", "type": "LWPOLYLINE", "points": sq, "closed": True},
        {"drawing": "c", "type": "LWPOLYLINE", "points": sq, "closed": False}])
    out = {r.drawing: r.linear_feet for r in TK.linear_feet(df, V.units(spark)).where("is_total").collect()}
    assert out == {"a": 0.42, "b": 40.0, "c": 30.0}


def test_q12_miles(spark):
    assert {r.code: r.to_feet for r in V.units(spark).collect()}[3] == 5280.0


def test_op110_bounds_circle(spark):
    df = ent(spark, [{"type": "CIRCLE", "points": [(1.0, 1.0)], "radius": 2.0}])
    r = TK.entity_bounds(df).collect()[0]
    assert (r.min_x, r.min_y, r.max_x, r.max_y) == (-1.0, -1.0, 3.0, 3.0)


def test_op109_preview(spark):
    df = ent(spark, [{"type": "TEXT", "text": "hello", "layer": "T"}, {"type": "INSERT", "block_name": "DRAIN"},
                     {"points": [(0.0, 0.0), (1.0, 1.0)]}])
    r = TK.entity_preview(df).collect()[0]
    assert r.layers == ["L", "T"] and r.block_names == ["DRAIN"] and r.text_samples == ["hello"]
    assert r.entity_counts == ["INSERT:1", "LINE:1", "TEXT:1"] and len(r.recommendations) == 4


def test_op112_op113(spark):
    df = ent(spark, [{"type": "INSERT", "block_name": "DRAIN"}, {"type": "INSERT", "block_name": "DRAIN"}, {}])
    assert TK.block_counts(df).collect()[0]["count"] == 2
    m = TK.entity_matrix(df).collect()[0]
    assert (m.insert, m.line, m.circle) == (2, 1, 0)


def test_op114_op115(spark):
    df = ent(spark, [{"type": "DIMENSION", "measurement": 24.0, "units_code": 1},
                     {"type": "TEXT", "text": "  NOTE  ", "points": [(1.234, 2.0)], "height": 0.25}])
    notes = {r.kind: r for r in TK.spec_notes(df, V.units(spark)).collect()}
    assert notes["dimension"].value_feet == 2.0 and notes["note"].text == "NOTE" and notes["note"].x == 1.23
    full = {r.type: r for r in TK.entity_full(df, V.units(spark)).collect()}
    assert full["DIMENSION"].value_raw == 24.0 and full["TEXT"].content == "  NOTE  "


def files(spark, names):
    df = spark.createDataFrame([("p", n) for n in names], "project_id string, name string")
    return LB.classify_files(df)


def test_op107_scores(spark):
    three = P.project_score(P.project_steps(files(spark, ["scope.pdf", "spec.pdf", "plan.pdf"]))).collect()[0]
    assert three.score == 61 and not three.ready and three.missing_docs == ["Manufacturer Specifications"]
    four = P.project_score(P.project_steps(files(spark, ["scope.pdf", "spec.pdf", "plan.pdf", "gaf.pdf"]))).collect()[0]
    assert four.score == 82 and four.ready


def test_op106_steps_grid(spark):
    s = P.project_steps(files(spark, ["scope.pdf"]))
    assert s.count() == 10 and s.where("status = 'complete'").count() == 1


def test_op108_effort(spark):
    areas = spark.createDataFrame([("p", 12500.0), ("p", 800.0), ("p", 450.0)], "project_id string, sf double")
    details = spark.createDataFrame([("p",)] * 4, "project_id string")
    r = P.project_effort(areas, details).collect()[0]
    assert (r.est_hours, r.complexity) == (20.8, "Low")


def test_polygon_area(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)],)],
                               "points array<struct<x:double,y:double>>")
    assert df.select(TK.polygon_area(F.col("points")).alias("a")).collect()[0].a == 12.0


def test_entities_with_missing_points_do_not_fail(spark):
    df = ent(spark, [{"type": "TEXT", "text": "x", "points": []}, {"type": "LWPOLYLINE", "points": []},
                     {"points": []}])
    assert TK.entity_full(df, V.units(spark)).count() == 3
    assert TK.spec_notes(df, V.units(spark)).collect()[0].x is None
    assert TK.linear_feet(df, V.units(spark)).where("is_total").collect()[0].linear_feet == 0.0


def test_all_lenses_from_one_scan(spark):
    df = ent(spark, [{"points": [(0.0, 0.0), (3.0, 4.0)]}, {"type": "INSERT", "block_name": "B"}])
    lenses = TK.takeoff_lenses(df, V.units(spark))
    assert lenses["blocks"].count() == 1 and lenses["full"].count() == 2
    lenses["_entities"].unpersist()


def test_op107_scope_exclusion_finding(spark):
    f = files(spark, ["scope.pdf"])
    scope = spark.createDataFrame([("p", "scope.pdf", "Work items\nExcluded:\nroof drains by others\n"
                                    "electrical work by owner\nshort\n")], "project_id string, name string, text string")
    r = P.project_score(P.project_steps(f), scope_files=scope).collect()[0]
    assert r.key_findings == ["Scope excludes: roof drains by others, electrical work by owner"]
    assert P.project_score(P.project_steps(f)).collect()[0].key_findings == []
