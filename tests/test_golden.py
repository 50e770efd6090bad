"""Answers worked out by hand: states of small scenarios, containment of categories, assignments, and the builders' rules."""

import math

import pytest
from pyspark.sql import functions as F

from drivelake.functions import models
from drivelake.functions.models import PARAMETERS
from drivelake.operators import builders, containment, segments, states
from drivelake.operators.catalog import Catalog, append_missing, resolve_acts, upsert
from drivelake.sources import json_db

# (actor, variable, place, model, xstart, xend, from, to)
CUTIN = [
    ("ego", "SPEED", 0, "Constant", 28.0, None, 0.0, 5.0), ("ego", "SPEED", 1, "Sinusoidal", 28.0, 20.0, 5.0, 10.0), ("ego", "SPEED", 2, "Linear", 20.0, 22.0, 10.0, 13.0), ("ego", "SPEED", 3, "Constant", 22.0, None, 13.0, 15.0),
    ("target", "LATERAL_POSITION", 4, "Linear", -1.6, -1.5, 0.0, 3.0), ("target", "LATERAL_POSITION", 5, "Sinusoidal", -1.5, 1.5, 3.0, 7.0), ("target", "LATERAL_POSITION", 6, "Linear", 1.5, 1.6, 7.0, 15.0),
]


def acts(spark):
    rows = [("s", a, v, k, m, f'{{"xstart": {x}, "xend": {"null" if y is None else y}}}', t, u) for a, v, k, m, x, y, t, u in CUTIN]
    df = spark.createDataFrame(rows, "scenario string, actor string, state_variable string, act_pos int, modelname string, parameters string, t_start double, t_end double")
    return states.with_parameters(df)


def at(spark, actor, variable, times, dot=False):
    asked = spark.createDataFrame([("s", actor, variable, float(t)) for t in times], "scenario string, actor string, state_variable string, t double")
    return {r["t"]: r[3 + 1] for r in states.scenario_states(acts(spark), asked, dot).collect()}


def test_states(spark):
    speed = at(spark, "ego", "SPEED", [0, 5, 7.5, 10, 11.5, 13, 15])
    assert {k: round(v, 9) for k, v in speed.items()} == {0: 28, 5: 28, 7.5: 24, 10: 20, 11.5: 21, 13: 22, 15: 22}
    assert math.isclose(at(spark, "ego", "SPEED", [7.5], True)[7.5], -4 * math.pi / 5)
    place = at(spark, "target", "LATERAL_POSITION", [0, 3, 5, 7, 15])
    assert {k: round(v, 9) for k, v in place.items()} == {0: -1.6, 3: -1.5, 5: 0, 7: 1.5, 15: 1.6}
    slope = at(spark, "target", "LATERAL_POSITION", [3, 7], True)
    assert abs(slope[3.0]) < 1e-12 and math.isclose(slope[7.0], 0.0125)
    out = at(spark, "target", "LATERAL_POSITION", [15, 16])
    assert out[15.0] == 1.6 and math.isnan(out[16.0])
    assert at(spark, "target", "LATERAL_POSITION", [16, 17]) == {} == at(spark, "ego", "HEADING", [1])


@pytest.mark.parametrize(("matrix", "reference", "assignment"), [
    ([], True, True), ([[1], [0]], False, True), ([[1], [1]], True, True), ([[1, 0], [1, 0]], False, False), ([[1, 0], [1, 0], [0, 1]], True, True),
    ([[0, 1], [0, 1], [1, 0], [1, 0]], False, True), ([[1, 1], [0, 1], [0, 1]], True, True),
])
def test_assignments(spark, matrix, reference, assignment):
    columns = len(matrix[0]) if matrix else 0
    rows = [{c for c, x in enumerate(r) if x} for r in matrix]
    assert (containment.eliminate(rows, columns), containment.assignable(rows, columns)) == (reference, assignment)
    # The same through tags: each category object asks for a tag of its own, in reversed order of ids, so that only pos sorts.
    tags = ["Weather_Rain", "Lighting_Dark"]
    cats = [("c", "ActorCategory", f"own{9 - k}", k, [tags[k]]) for k in range(columns)] or [("c", "ScenarioCategory", "c", 0, ["EgoVehicle"])]
    cands = [("x", "Actor", f"other{9 - k}", k, [tags[c] for c in r] or ["EgoVehicle"]) for k, r in enumerate(rows)] + [("x", "Scenario", "x", 0, ["EgoVehicle"])]
    frame = lambda v: spark.createDataFrame(v, "owner string, class string, object_uid string, pos int, tags array<string>")
    for mode, expected in (("reference", reference), ("assignment", assignment)):
        assert containment.contains(frame(cats), frame(cands), mode).count() == expected


def test_includes(spark):
    def category(name, change):
        return [(name, "ActorCategory", f"{name}-ego", 0, ["EgoVehicle", "RoadUserType_Vehicle"]), (name, "ActorCategory", f"{name}-target", 1, ["RoadUserType_Vehicle", change])]

    both = spark.createDataFrame(category("cutin", "VehicleLateralActivity_ChangingLane") + category("left", "VehicleLateralActivity_ChangingLane_Left"), "owner string, class string, object_uid string, pos int, tags array<string>")
    got = {(r["category"], r["candidate"]) for r in containment.contains(both, both).collect()}
    assert got == {("cutin", "cutin"), ("left", "left"), ("cutin", "left")}


def test_open_category(spark):
    """A category that asks for nothing comprises every candidate."""
    frame = lambda v: spark.createDataFrame(v, "owner string, class string, object_uid string, tags array<string>")
    got = containment.contains(frame([("c", "ScenarioCategory", "c", [])]), frame([("x", "Scenario", "x", ["EgoVehicle"]), ("y", "Scenario", "y", [])]))
    assert {(r["category"], r["candidate"]) for r in got.collect()} == {("c", "x"), ("c", "y")}


def test_missing_actor(spark, tmp_path):
    c = Catalog.empty(spark)
    row = lambda schema, *v: spark.createDataFrame([v], schema)
    actor = row("uid string, name string, tags array<string>, properties string, category_uid string, initial_states array<struct<state_variable:string,value:array<double>>>, desired_states array<struct<state_variable:string,value:array<double>>>", "1", "ego", [], None, "2", [], [])
    c = c.add("actor", actor).add("actor_category", row("uid string, name string, tags array<string>, description string, actor_type string, actor_type_value int", "2", "car", ["EgoVehicle"], "", "Vehicle", 1))
    assert c.get("actor", "1").first()["all_tags"] == ["EgoVehicle"]
    with pytest.raises(KeyError, match="2"):
        c.delete("actor_category", "2").get("actor", "1")
    with pytest.raises(KeyError):
        c.delete("actor", "9")
    with pytest.raises(TypeError):
        c.add("nothing", actor)
    json_db.write_tables(c, str(tmp_path / "t"))
    assert json_db.read_tables(spark, str(tmp_path / "t")).get("actor", "1").count() == 1
    (tmp_path / "db.json").write_text(json_db.db_json(c).first()["db"])
    back = json_db.read_db(spark, str(tmp_path / "db.json"))
    assert back.get("actor", "1").first()["category_name"] == "car" and {r["collection"]: r["count"] for r in back.counts().collect()} == {"actor": 1, "actor_category": 1}
    json_db.write_documents(c, str(tmp_path / "docs"))
    (tmp_path / "bad.json").write_text('{"actor": {}}')
    with pytest.raises(KeyError):
        json_db.read_db(spark, str(tmp_path / "bad.json"))


def test_full_form(spark, tmp_path):
    """The first copy of an id counts, an override replaces what was read."""
    event = '{"name": "", "id": 5, "tags": [], "conditions": {"time": 1.5}}'
    doc = f'{{"name": "a", "id": 1, "tags": [], "start": {event}, "end": {event.replace("1.5", "9")}, "category": {{"name": "c", "id": 3, "tags": [], "description": "", "model": {{"name": "m", "id": 4, "tags": [], "description": "", "modelname": "Linear", "default_options": {{}}}}, "state": {{"name": "SPEED", "value": "v"}}}}, "parameters": {{"xstart": 1}}}}'
    (tmp_path / "a.json").write_text(doc)
    parts = json_db.shred(json_db.read_full(spark, str(tmp_path / "a.json"), "activity"), "activity")
    assert sorted(parts) == ["activity", "activity_category", "event", "model"]
    assert [r["conditions"] for r in parts["event"].collect()] == ['{"time": 1.5}']
    c = Catalog.empty(spark).add_all(parts)
    a = c.get("activity", "1").first()
    assert (a["t_start"], a["t_end"], a["state"], a["modelname"]) == (1.5, 1.5, "SPEED", "Linear")
    other = spark.createDataFrame([("7", "other", [], "{}")], "uid string, name string, tags array<string>, conditions string")
    assert json_db.shred(json_db.read_full(spark, str(tmp_path / "a.json"), "activity"), "activity", {"event": other})["event"].first()["uid"] == "7"


def test_builders(spark):
    df = spark.createDataFrame([("a", 1, [1, 2]), ("b", None, [])], "uid string, t int, v array<int>")
    own, events = builders.events_at(df, {"start_uid": "t"})
    assert events.count() == 1 and [r["start_uid"] is None for r in own.orderBy("uid").collect()] == [False, True]
    assert df.filter("uid = 'a'").select(builders.checked("v", "array<double>", at_least_one=True).alias("v")).first()["v"] == [1.0, 2.0]
    assert df.select(builders.state_values(df, "t").alias("v")).first()["v"] == [1.0]
    for wrong in (df.select(builders.checked("v", "array<int>", at_least_one=True)), df.select(builders.checked("t", "int")), df.select(builders.state_values(df, "v"))):
        with pytest.raises(Exception, match="must not be null|needs"):
            wrong.collect()
    assert df.select(builders.checked("t", "int", can_be_none=True).alias("t")).count() == 2
    new = spark.createDataFrame([("a", 5), ("a", 7), ("c", 1)], "uid string, t int")
    assert {(r["uid"], r["t"]) for r in upsert(df.select("uid", "t"), new).collect()} == {("a", 7), ("b", None), ("c", 1)}
    assert {(r["uid"], r["t"]) for r in upsert(df.select("uid", "t"), new, overwrite=False).collect()} == {("a", 1), ("b", None), ("c", 1)}
    members = spark.createDataFrame([("s", 0, "x")], "owner string, pos int, uid string")
    done = spark.createDataFrame([("s", 0, "y", "k"), ("s", 1, "x", "k"), ("s", 2, "z", "k")], "owner string, pos int, actor string, activity string")
    assert [(r["pos"], r["uid"]) for r in append_missing(members, done, "actor").orderBy("pos").collect()] == [(0, "x"), (1, "y"), (2, "z")]
    with pytest.raises(Exception, match="no such member: y"):
        resolve_acts(done, members, spark.createDataFrame([("k",)], "uid string"), strict=True).collect()


def test_models(spark):
    """Data without noise gives its own parameters; far from the epoch too; models without a state raise."""
    base = 1.7e9
    rows = [(k, base + 10 * i + 0.5, v(i / 10)) for k, v in (("line", lambda s: 3 + 2 * s), ("sine", lambda s: 2 * math.cos(math.pi * s) + 5)) for i in range(11)]
    df = spark.createDataFrame(rows, "k string, t double, y double")
    got = {r["k"]: (r["xstart"], r["xend"]) for r in models.fit("Linear", df.filter("k = 'line'"), ["k"]).unionByName(models.fit("Sinusoidal", df.filter("k = 'sine'"), ["k"])).collect()}
    assert all(math.isclose(a, b, rel_tol=1e-6) for k, v in {"line": (3, 5), "sine": (7, 3)}.items() for a, b in zip(got[k], v))
    one = spark.createDataFrame([("k", 1.0, 2.0), ("k", 1.0, 4.0)], "k string, t double, y double")
    assert models.fit("Linear", one, ["k"]).first()[1:] == (3.0, 3.0)
    for wrong in ({"degree": 2}, {"endpoint": True}):
        with pytest.raises(ValueError):
            models.fit("Linear", one, ["k"], **wrong)
    p = one.withColumn("p", F.from_json(F.lit('{"xstart": 1}'), PARAMETERS.removeprefix("struct<").removesuffix(">").replace(":", " ")))
    for name in ("Messages", "Nothing"):
        with pytest.raises(Exception, match=name):
            p.select(models.value(F.lit(name), F.col("p"), F.col("t"))).collect()
    spline = models.fit("Spline3Knots", spark.createDataFrame([("k", i / 20, (i / 20) ** 3) for i in range(21)], "k string, t double, y double"), ["k"], endpoints=True).first()
    assert [round(v, 6) + 0.0 for v in spline[1:]] == [1, 0, 0, 0, 1, 0, 0, 0]


def test_runs(spark):
    """A run's first sample ends the run before; samples_in agrees for the samples' own runs."""
    df = spark.createDataFrame([("a", float(i), "xxyyyxz"[i], i) for i in range(7)] + [("b", 0.0, "x", 9)], "actor string, t double, label string, y int")
    got = sorted((r["actor"], r["run"], r["run_label"], r["t"], r["t_start"], r["t_end"]) for r in segments.in_runs(df).collect())
    assert got == sorted((r["actor"], r["run"], r["run_label"], r["t"], r["t_start"], r["t_end"]) for r in segments.samples_in(df, segments.segments(df)).collect())
    assert ("a", 1, "x", 2.0, 0.0, 2.0) in got and ("a", 4, "z", 6.0, 6.0, 6.0) in got and ("b", 1, "x", 0.0, 0.0, 0.0) in got
