"""What keeps work in proportion to the input: whole results, and plans without steps that grow faster."""

from oracle import SMALL, spark_rows
from pyspark.sql import functions as F

from drivelake.functions.vocabulary import TAGS, covers
from drivelake.operators import builders, containment, states
from drivelake.operators.catalog import Catalog, append_missing, time_of
from drivelake.plans import queries, store_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_closure(spark):
    """Every pair of the closure is there, those without a line or an order too."""
    rows = queries.tag_closure_rows(spark, SMALL).collect()
    assert {(r["sup"], r["sub"]) for r in rows} == {(a, b) for a in TAGS for b in TAGS if covers(a, b)} and len(rows) == len({(r["sup"], r["sub"]) for r in rows})
    assert {r["n"] > 0 for r in rows} == {True, False}


def test_curves_are_not_broadcast(spark):
    """A curve is hundreds of bytes a part, of which Spark's estimate from the table knows nothing."""
    for name in ("state_multi_splines", "state_dot_bspline", "state_bspline"):
        assert "Broadcast" not in plan(queries.QUERIES[name](spark, SMALL)), name


def test_listed_instants(spark):
    """Instants in a list give what a frame of them gives, without a join; later acts win, uncovered ones are NaN."""
    acts = spark.createDataFrame([("s", "a", "SPEED", 0, "Linear", 0.0, 2.0, 0.0, 4.0), ("s", "a", "SPEED", 1, "Constant", 9.0, None, 4.0, 6.0), ("s", "b", "SPEED", 0, "Constant", 1.0, None, 50.0, 60.0), ("s", "c", "SPEED", 0, "Linear", 1.0, 2.0, 3.0, 3.0)], "scenario string, actor string, state_variable string, act_pos int, modelname string, x0 double, x1 double, t_start double, t_end double")
    acts = acts.withColumn("p", queries.parameters(xstart=F.col("x0"), xend=F.col("x1"))).drop("x0", "x1")
    ts = [3.0, 0.0, 4.0, 7.0, 3.0]
    frame = acts.select("scenario", "actor", "state_variable").distinct().crossJoin(spark.createDataFrame([(t,) for t in ts], "t double"))
    for uncovered in (True, False):
        for dot in (True, False):
            listed = states.scenario_states(acts, ts, dot, uncovered)
            assert spark_rows(listed) == spark_rows(states.scenario_states(acts, frame, dot, uncovered)) and "Join" not in plan(listed)
    assert len(spark_rows(states.scenario_states(acts, ts))) == 8


def test_objects_by_sets(spark):
    """Objects with one set of tags are decided once; tags from outside the vocabulary cover nothing, and count as asked."""
    own = spark.createDataFrame([("c", "1", "RoadUserType_Vehicle"), ("c", "1", "Weather_Rain"), ("c", "2", "nowhere"), ("d", "1", "Weather_Rain")], "category string, own_uid string, tag string")
    some = [("s", f"{k}", t) for k in range(3) for t in ("RoadUserType_CategoryM_Bus", "Weather_Rain_Light", "nowhere")] + [("t", "7", "Weather_Rain"), ("t", "7", "Weather_Rain")]
    got = containment.covered(own, spark.createDataFrame(some, "candidate string, other_uid string, tag string"))
    assert sorted(map(tuple, got.collect())) == sorted([(c, "s", "1", f"{k}") for c in "cd" for k in range(3)] + [("d", "t", "1", "7")])


def test_signatures_are_short(spark):
    """Tags are kept by number, others as they are, and come back as they were."""
    tags = ["RoadUserType_CategoryM_Bus", "a,b;c:\u00e9", "x1"]
    df = spark.createDataFrame([("o", "Actor", "1", 0, tags), ("o", "Scenario", "o", 0, ["Weather_Rain"]), ("p", "Actor", "1", 0, [])], "owner string, class string, object_uid string, pos int, tags array<string>")
    sigs = containment.signatures(df, "reference")
    assert max(len(r["objects"]) for r in sigs.collect()) < 60
    back = {(r["class"], r["pos"]): set(r["tags"]) for r in containment.representatives(sigs.filter("owner = 'o'")).collect()}
    assert back == {("Scenario", 0): {"Weather_Rain"}, ("Actor", 1): set(tags)}
    assert [(r["class"], r["tags"]) for r in containment.representatives(sigs.filter("owner = 'p'")).collect()] == [("Scenario", [])]


def test_appended_members(spark):
    """Members stay as they are, also those there twice; a null name is no member's."""
    members = spark.createDataFrame([("o", 0, "x"), ("o", 3, "x"), ("q", 5, "y"), ("q", 6, None)], "owner string, pos int, uid string")
    acts = spark.createDataFrame([("o", 2, "z"), ("o", 1, "w"), ("o", 0, "x"), ("q", 0, None), ("r", 4, "k"), ("r", 4, "k")], "owner string, pos int, actor string")
    out = append_missing(members, acts, "actor")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("o", 0, "x"), ("o", 3, "x"), ("o", 4, "w"), ("o", 5, "z"), ("q", 5, "y"), ("q", 6, None), ("q", 7, None), ("r", 0, "k")], key=str)
    assert "Join" not in plan(out)


def test_one_shuffle_of_lines(spark):
    """Scenarios, activities and events come from orders that were put together with their lines once."""
    c = store_queries.lifted(spark, SMALL)
    for k in ("scenario", "activity", "event"):
        assert "Exchange" not in plan(c[k]), k
    assert "t_start" not in c.hydrated("activity", times=False).columns


def test_events_from_numbers(spark):
    """Items meet their events by two joins alone; what the empty catalog had is no part of the plan, and no id is hashed."""
    p = plan(store_queries.events_from_numbers(spark, SMALL))
    assert p.count("LeftOuter") == 2 and not any(x in p for x in ("LeftAnti", "Union", "sha2")), p
    assert all("LocalTableScan <empty>" in plan(df) for df in Catalog.empty(spark).frames.values())


def test_ids_of_events(spark):
    """An event has one id for each item and number, and no other; times come back as they were, also of unusual numbers."""
    nan, far = float("nan"), 1704067200.123456
    rows = [("a", 1.0, 11.0), ("a:1", 1.0, 1.0), ("b", -0.0, 0.0), ("c", None, nan), ("d", far, 1e300), ("", 2.0, float("inf")), ("a", 1.0, 11.0), (None, 5.5, None)]
    own, events = builders.events_at(spark.createDataFrame(rows, "uid string, t0 double, t1 double"), {"start_uid": "t0", "end_uid": "t1"})
    assert events.count() == events.select("uid").distinct().count() == 10
    back = Catalog.empty(spark).add("event", events)._times(own)
    assert back.columns == ["end_uid", "start_uid", "uid", "t0", "t1", "t_start", "t_end"]
    assert spark_rows(back.select("uid", "t_start", "t_end")) == spark_rows(own.select("uid", F.col("t0").alias("t_start"), F.col("t1").alias("t_end")))


def test_time_of_conditions(spark):
    """What the pattern reads and what it leaves to the JSON parser give the same times."""
    some = ['{"time":3.9}', '{"time":-0.0}', '{"time":1.704067200123456E9}', '{"time":1.0E-5}', '{"time":7}', '{"time": 7}', '{"time":"3.5"}', '{"time":"NaN"}', '{"time":null}', '{"time":1,"x":2}', '{"x":1,"time":2}', '{"time":1d}', '{"time":01}', '{"time":3.9}\n', '{"time":12345678901234567890}', "{}", "", "no", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(some)], "i int, conditions string")
    got = df.select("i", time_of("conditions").alias("t"), F.get_json_object("conditions", "$.time").cast("double").alias("by_parser")).collect()
    assert [str(r["t"]) for r in got] == [str(r["by_parser"]) for r in got]


def test_near_parts(spark):
    """What is near a scenario is as the collections have it; where some isn't near, all is joined by ids, with the same rows."""
    for c in (store_queries.lifted(spark, SMALL), store_queries._with_vectors(store_queries.lifted(spark, SMALL))):
        known = c["scenario"].select(F.explode("activities").alias("uid"))
        assert spark_rows(c.near.select(F.inline("near_activities"))) == spark_rows(c["activity"].join(known, "uid", "left_semi"))
        ends = c["scenario"].select(F.explode(F.array("start_uid", "end_uid")).alias("uid")).unionByName(known.select(F.explode(F.array(F.concat("uid", F.lit(":s")), F.concat("uid", F.lit(":e")))).alias("uid")))
        assert spark_rows(c.near.select(F.inline("near_events"))) == spark_rows(c["event"].join(ends, "uid", "left_semi").select("uid", "conditions"))
        assert spark_rows(c.near.select(*c["scenario"].columns)) == spark_rows(c["scenario"])
    assert c.all_near() and Catalog(c.frames, c.near).all_near() and not Catalog(c.frames).all_near()
    away = Catalog(c.frames, c.near.withColumn("near_events", F.slice("near_events", 1, 3)))
    assert not away.all_near()
    expected = [spark_rows(f(c)) for f in (Catalog.acts, lambda x: x.hydrated("scenario"), containment.derived_tags)]
    for other in (away, Catalog(c.frames)):
        assert [spark_rows(f(other)) for f in (Catalog.acts, lambda x: x.hydrated("scenario"), containment.derived_tags)] == expected


def test_acts_meet_categories_only(spark):
    """Acts meet their categories and then their scenario: no event, and no activity's id, is shuffled; states need no other shuffle."""
    for name in ("store_states", "store_state_dots", "store_states_uncovered", "store_vector_dots"):
        p = plan(queries.QUERIES[name](spark, SMALL))
        assert p.count("Exchange hashpartitioning(scenario") == 1 and not any(f"hashpartitioning({x}" in p for x in ("event", "activity", "uid")), p


def test_derived_tags_meet_once(spark):
    """An owner's actors and acts meet in one shuffle, without a join; who is listed twice is there twice, who isn't listed not at all."""
    actors = spark.createDataFrame([("o", 0, "1", "n", ["a"]), ("o", 1, "2", "n", []), ("o", 2, "1", "n", ["a"]), ("o", 3, "3", "n", []), ("p", 0, "1", None, None)], "owner string, pos int, uid string, name string, tags array<string>")
    acts = spark.createDataFrame([("o", "2", ["b", None, "a"]), ("o", "2", ["b"]), ("o", "9", ["c"]), ("p", "1", ["d"])], "owner string, actor string, tags array<string>")
    out = containment.derived_actor_tags(actors, acts, None)
    p = plan(out)
    assert p.count("Exchange") == 1 and "Join" not in p, p
    assert sorted((r["owner"], str(r["key"]), r["object_uid"], r["pos"], ",".join(r["tags"])) for r in out.collect()) == [("o", "n2::Actor", "2", 1, "a,b"), ("o", "n3::Actor", "1", 2, "a"), ("o", "n::Actor", "1", 0, "a"), ("p", "None", "1", 0, "d")]
