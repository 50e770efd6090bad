"""Documents taken apart with parts of one's own, signatures of containment, and matching of many objects."""

import json
import random
from itertools import permutations

from pyspark.sql import functions as F

from drivelake.operators import containment
from drivelake.operators.catalog import SCHEMAS, Catalog
from drivelake.sources import json_db


def event(uid, t):
    return {"name": f"e{uid}", "id": uid, "tags": [], "conditions": {"time": t}}


def test_given_parts(spark):
    """Parts given for one document stand for those read: they aren't taken from it, and others keep theirs."""
    element = lambda uid: {"name": f"p{uid}", "id": uid, "tags": [], "properties": {}, "category": {"name": "c", "id": 50, "tags": [], "description": ""}}
    docs = [{"name": f"s{k}", "id": k, "tags": ["EgoVehicle"], "start": event(10 + k, 0), "end": event(20 + k, 9), "physical_elements": [element(30 + k), element(40)], "actors": [], "activities": [], "acts": [{"actor": "1", "activity": "2"}]} for k in (1, 2)]
    parsed = json_db.parse_full(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"), "scenario")
    given = spark.createDataFrame([("1", "start", [("other", "99")]), ("1", "physical_elements", [("a", "7"), ("b", "8")])], "owner string, field string, parts array<struct<name:string,uid:string>>")
    parts = json_db.shred(parsed, "scenario", given=given)
    rows = {r["uid"]: r for r in parts["scenario"].collect()}
    assert (rows["1"]["start_uid"], rows["1"]["end_uid"], rows["1"]["physical_elements"]) == ("99", "21", ["7", "8"])
    assert (rows["2"]["start_uid"], rows["2"]["end_uid"], rows["2"]["physical_elements"]) == ("12", "22", ["32", "40"])
    assert {r["uid"] for r in parts["event"].collect()} == {"21", "12", "22"}
    assert {r["uid"] for r in parts["physical_element"].collect()} == {"32", "40"} and parts["physical_element_category"].count() == 1
    assert [(a["actor"], a["activity"]) for a in rows["2"]["acts"]] == [("1", "2")]
    plain = json_db.shred(parsed, "scenario")
    assert {r["uid"] for r in plain["event"].collect()} == {"11", "21", "12", "22"} and plain["physical_element"].count() == 3


def test_full_form_back_again(spark):
    """A full document has its parts' texts inside as they are: escapes, numbers and missing parts."""
    c = Catalog.empty(spark)
    row = lambda schema, *v: spark.createDataFrame([v], schema)
    c = c.add("model", row("uid string, name string, tags array<string>, description string, modelname string, default_options string", "4", 'm "q"\\', [], "", "Linear", '{"a": [1, {"b": "}"}]}'))
    c = c.add("activity_category", row("uid string, name string, tags array<string>, description string, model_uid string, state string", "3", "c", ["x"], "", "4", "SPEED"))
    c = c.add("activity", row("uid string, name string, tags array<string>, start_uid string, end_uid string, category_uid string, parameters string", "1", "a", [], "5", None, "3", '{"xstart": 1.50}'))
    doc = json.loads(json_db.full_document(c, "activity").first()["doc"])
    assert doc["category"]["model"]["name"] == 'm "q"\\' and doc["category"]["model"]["default_options"] == {"a": [1, {"b": "}"}]}
    assert (doc["start"], doc["end"], doc["parameters"], doc["category"]["state"]["name"]) == (None, None, {"xstart": 1.5}, "SPEED")


def test_signatures(spark):
    """Owners that differ in ids alone have one signature; order counts in the reference mode only; rows of one object are one."""
    rows = [("a", "Actor", "1", 0, ["x"]), ("a", "Actor", "2", 1, ["y", "z"]), ("b", "Actor", "8", 3, ["x"]), ("b", "Actor", "9", 5, ["z", "y", "y"]), ("c", "Actor", "1", 1, ["x"]), ("c", "Actor", "2", 0, ["y", "z"]), ("d", "Actor", "1", 0, ["x"]), ("d", "Actor", "2", 1, ["y"]), ("d", "Actor", "2", 1, ["z"]), ("e", "Actor", "1", 0, [])]
    df = spark.createDataFrame(rows, "owner string, class string, object_uid string, pos int, tags array<string>")
    for mode, same in (("reference", "abd"), ("assignment", "abcd")):
        sig = {r["owner"]: r["sig"] for r in containment.signatures(df, mode).collect()}
        assert {o for o, s in sig.items() if s == sig["a"]} == set(same) and len(sig) == 5
    assert containment.representatives(containment.signatures(df, "assignment")).select("owner").distinct().count() == 2


def test_contains_against_each_pair(spark):
    """Random categories and candidates, both modes, against the decision of each pair on its own."""
    r = random.Random(8)
    tags = ["RoadUserType_Vehicle", "RoadUserType_CategoryM_Bus", "RoadUserType_VRU", "RoadUserType_VRU_Cyclist", "Weather_Rain", "Weather_Rain_Light"]
    make = lambda name, n: [(f"{name}{k}", kind, f"{name}{k}-{kind}{j}", j, r.sample(tags, r.randint(1, 2))) for k in range(n) for kind in ("Scenario", "Actor") for j in range(r.randint(0, 1 if kind == "Scenario" else 3))]
    own, other = make("q", 8), make("s", 30)
    frame = lambda rows: spark.createDataFrame(rows, "owner string, class string, object_uid string, pos int, tags array<string>")
    from drivelake.functions.vocabulary import covers

    def each(mode):
        for q in {x[0] for x in own}:
            for s in {x[0] for x in other}:
                ok = True
                for kind in ("Scenario", "Actor"):
                    mine, theirs = ([x for x in rows if x[0] == o and x[1] == kind] for rows, o in ((own, q), (other, s)))
                    if mine:
                        may = [{i for i, m in enumerate(mine) if all(any(covers(t, u) for u in x[4]) for t in m[4])} for x in theirs]
                        test = containment.eliminate if mode == "reference" else containment.assignable
                        ok &= any(may) if kind == "Scenario" else len(mine) <= len(theirs) and set().union(*may) == set(range(len(mine))) and test(may, len(mine))
                if ok:
                    yield q, s

    for mode in ("reference", "assignment"):
        got = {(x["category"], x["candidate"]) for x in containment.contains(frame(own), frame(other), mode).collect()}
        assert got == set(each(mode)) and got


def test_matching():
    """Against all orders on small tables; a chain of 2000 objects without recursion."""
    r = random.Random(1)
    for _ in range(3000):
        n, m = r.randint(0, 5), r.randint(0, 5)
        rows = [{c for c in range(m) if r.random() < 0.4} for _ in range(n)]
        assert containment.assignable(rows, m) == (m <= n and any(all(c in rows[p[c]] for c in range(m)) for p in permutations(range(n), m)))
    n = 2000
    assert containment.assignable([{i, i + 1} if i + 1 < n else {i} for i in range(n)], n)
    assert not containment.assignable([{i, min(i + 1, n - 1)} for i in range(n - 1)], n)


def test_derived_tags_in_documents(spark):
    """A document's derived tags come from its own parts, and are what the catalog's are: names that occur twice, missing
    categories and models, acts of activities that aren't listed, actors without tags."""
    named = "uid string, name string, tags array<string>"
    frame = lambda more, *rows: spark.createDataFrame(list(rows), named + more)
    full = {
        "event": frame(", conditions string", ("e1", None, [], '{"time": 1}')), "model": frame(", description string, modelname string, default_options string", ("m", "m", [], "", "Linear", "{}")),
        "activity_category": frame(", description string, model_uid string, state string", ("k", "k", ["cat"], "", "m", "SPEED"), ("l", "l", ["lost"], "", "none", "SPEED")),
        "activity": frame(", start_uid string, end_uid string, category_uid string, parameters string", ("1", "x", ["a"], "e1", None, "k", "{}"), ("2", "y", ["b", "a"], "e1", "e1", "l", "{}"), ("3", "z", None, None, None, "k", "{}"), ("4", "far", ["c"], None, None, "k", "{}")),
        "actor_category": frame(", description string, actor_type string, actor_type_value int", ("car", "car", [], "", "Vehicle", 1), ("van", "van", ["v", None], "", "Vehicle", 1)),
        "physical_element_category": frame(", description string", ("wall", "wall", ["w"], "")),
    }
    actor = ", properties string, category_uid string, initial_states array<struct<state_variable:string,value:array<double>>>, desired_states array<struct<state_variable:string,value:array<double>>>"
    full["actor"] = frame(actor, *((u, n, t, None, c, [], []) for u, n, t, c in (("p", "one", ["t"], "car"), ("q", "one", [], "car"), ("r", "one", ["u"], "van"), ("s", "two", [], "car"), ("t", "one", ["t"], "gone"))))
    full["physical_element"] = frame(", properties string, category_uid string", *((u, n, t, None, c) for u, n, t, c in (("5", "same", ["f"], "wall"), ("6", "same", ["g"], "wall"), ("7", "other", [], "gone"))))
    scenario = ", start_uid string, end_uid string, physical_elements array<string>, actors array<string>, activities array<string>, acts array<struct<actor:string,activity:string>>"
    full["scenario"] = frame(scenario, ("A", "first", ["own"], "e1", "gone", ["5", "6", "7"], ["p", "q", "r", "s", "t", "p"], ["1", "2", "3"], [("q", "1"), ("q", "2"), ("p", "4"), ("s", "2"), ("t", "1"), ("r", "3"), ("none", "1")]), ("B", "bare", [], None, None, [], [], [], []), ("C", "null", ["own"], None, None, None, ["q"], ["1"], None))
    category = ", description string, image string, physical_element_categories array<string>, actor_categories array<string>, activity_categories array<string>, acts array<struct<actor:string,activity:string>>"
    full["scenario_category"] = frame(category, ("Z", "z", ["own"], "", "", ["wall"], ["car", "van"], ["k"], [("car", "k"), ("van", "l")]))
    c = Catalog(Catalog.empty(spark).frames | full)
    for collection in ("scenario", "scenario_category"):
        docs = {r["uid"]: json.loads(r["doc"]) for r in json_db.full_document(c, collection).collect()}
        want = {u: {} for u in docs}
        for r in containment.derived_tags(c, collection).collect():
            want[r["owner"]][r["key"]] = r["tags"]
        assert {u: d["derived_tags"] for u, d in docs.items()} == want and any(want.values())
    a = {r["uid"]: json.loads(r["doc"]) for r in json_db.full_document(c, "scenario").collect()}["A"]
    assert (a["start"]["id"], a["end"], [x["id"] for x in a["activities"]], [x["id"] for x in a["actors"]]) == ("e1", None, ["1", "2", "3"], ["p", "q", "r", "s", "t", "p"])
    assert a["derived_tags"]["one3::Actor"] == ["u", "v"] and len(a["derived_tags"]["one::Actor"]) == 3


def test_few_shuffles_of_documents(spark):
    """Parts of a scenario meet it in one shuffle, with no other for its derived tags; events without names aren't met at all."""
    c = Catalog.empty(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
        items = lambda k: spark.range(9).select(*(F.col("id").cast("string").alias(x) if x == "uid" else F.expr(f"if(id < 0, null, cast(null as {t}))").alias(x) for x, t in (f.split(" ", 1) for f in SCHEMAS[k].split(", "))))
        c = Catalog({k: items(k) for k in c.frames})
        assert n(json_db.full_document(c, "scenario")) <= 22
        nameless = c["event"].withColumn("name", F.lit(None).cast("string"))
        assert "Join" not in json_db.document(Catalog(c.frames | {"event": nameless, "activity_category": nameless}), "activity")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
