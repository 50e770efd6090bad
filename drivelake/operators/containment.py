"""Derived tags, and which categories comprise which scenarios or include which categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import TAGS, tag_closure
from ..sources.staging import staged


def derived_actor_tags(actors: DataFrame, acts: DataFrame, activity_tags: DataFrame | None, kind: str = "Actor") -> DataFrame:
    """owner, class, key, object_uid, pos, tags: an actor's own tags and those of the activities it performs, each once.

    actors: owner, pos, uid, name, tags; acts: owner, actor, activity; activity_tags: activity, tags, or None where acts have
    their tags. Actors without tags are left out; of several with a name, the second and later get its number in the key."""
    of_acts = (acts if activity_tags is None else acts.join(activity_tags, "activity")).select("owner", F.col("actor").alias("uid"), "tags")
    # An act's tags stay together, so that a row an act is shuffled, not one a tag. All of an owner meets once: who an actor is
    # comes along, so that neither a join nor another shuffle follows.
    own = actors.select("owner", "uid", "tags", F.struct("pos", "name").alias("who"))
    every = own.unionByName(of_acts.withColumn("who", F.lit(None).cast(own.schema["who"].dataType))).filter(F.col("owner").isNotNull() & F.col("uid").isNotNull())
    tags = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("tags")))))
    per = every.repartition("owner").groupBy("owner", "uid").agg(tags.alias("tags"), F.collect_list("who").alias("who")).filter(F.size("tags") > 0)
    w = Window.partitionBy("owner", "name").orderBy("pos")
    tagged = per.select("owner", "uid", "tags", F.inline("who")).withColumn("i", F.row_number().over(w))
    suffix = F.when(F.col("i") > 1, F.col("i").cast("string")).otherwise(F.lit(""))
    return tagged.select("owner", F.lit(kind).alias("class"), F.concat("name", suffix, F.lit(f"::{kind}")).alias("key"), F.col("uid").alias("object_uid"), F.col("pos").cast("long").alias("pos"), "tags")


def derived_own_tags(things: DataFrame, kind: str) -> DataFrame:
    """The same for things (owner, pos, uid, name, tags) that only have tags of their own; of those with one name the
    last stays."""
    some = things.filter(F.size("tags") > 0).withColumn("last", F.max("pos").over(Window.partitionBy("owner", "name"))).filter("pos = last")
    return some.select("owner", F.lit(kind).alias("class"), F.concat("name", F.lit(f"::{kind}")).alias("key"), F.col("uid").alias("object_uid"), F.col("pos").cast("long").alias("pos"), "tags")


def covered(own: DataFrame, candidate: DataFrame) -> DataFrame:
    """category, candidate, own_uid, other_uid: each object of a candidate that has, for every tag of an object of a
    category, that tag or one below it. own: category, own_uid, tag; candidate: candidate, other_uid, tag. An equi-join
    with the closure of tags stands for the comparison of names."""
    wanted = own.groupBy("category", "own_uid").agg(F.count_distinct("tag").alias("wanted"))
    closure = tag_closure(own.sparkSession)
    # An object is decided by its set of tags: each set once, and what it has goes back to the objects. One shuffle, by
    # candidate, also serves who groups the result by candidates.
    objects = candidate.repartition("candidate").groupBy("candidate", "other_uid").agg(F.array_sort(F.collect_set("tag")).alias("set"))
    sets = candidate.groupBy("candidate", "other_uid").agg(F.array_sort(F.collect_set("tag")).alias("set")).select("set").distinct()
    hits = own.join(F.broadcast(closure), own["tag"] == closure["sup"]).select("category", "own_uid", F.col("tag").alias("own_tag"), "sub").join(sets.select("set", F.explode("set").alias("has")), F.col("sub") == F.col("has"))
    n = hits.groupBy("category", "own_uid", "set").agg(F.size(F.collect_set("own_tag")).alias("n"))
    # Written, as only then it is known whether the sets are few.
    found = staged(n.join(wanted, ["category", "own_uid"]).filter("n = wanted").select("category", "own_uid", "set"))
    return objects.join(found, "set").select("category", "candidate", "own_uid", "other_uid")


def eliminate(rows: list[set[int]], columns: int) -> bool:
    """The step-by-step assignment: rows are candidate objects, with the category objects each may stand for."""
    left, open_columns = [set(r) for r in rows], set(range(columns))
    while left and open_columns:
        if any(not r for r in left):
            return False
        n = 1
        while True:
            c = next((c for c in sorted(open_columns) if sum(c in r for r in left) == n), None)
            if c is not None:
                r = next(i for i, x in enumerate(left) if c in x)
                break
            r = next((i for i, x in enumerate(left) if len(x) == n), None)
            if r is not None:
                c = min(left[r])
                break
            n += 1
        del left[r]
        open_columns.discard(c)
        for x in left:
            x.discard(c)
    return True


def assignable(rows: list[set[int]], columns: int) -> bool:
    """Whether every category object can have a candidate object of its own: Hopcroft and Karp's matching. Each round finds, level
    by level, how far free candidate objects are, and then as many disjoint shortest ways to them as there are, without
    recursion; there are no more rounds than about twice the root of the number of objects."""
    may: list[list[int]] = [[] for _ in range(columns)]
    for r, some in enumerate(rows):
        for c in some:
            may[c].append(r)
    partner, holder = [-1] * columns, [-1] * len(rows)
    while free := [c for c in range(columns) if partner[c] < 0]:
        level = [-1] * columns
        for c in free:
            level[c] = 0
        reached, wave = False, free
        while wave and not reached:
            new = []
            for c in wave:
                for r in may[c]:
                    d = holder[r]
                    if d < 0:
                        reached = True
                    elif level[d] < 0:
                        level[d] = level[c] + 1
                        new.append(d)
            wave = new
        if not reached:
            return False
        at = [0] * columns
        for start in free:
            way = [start]
            while way:
                c = way[-1]
                if at[c] == len(may[c]):
                    level[c] = -1
                    way.pop()
                    continue
                r = may[c][at[c]]
                d = holder[r]
                if d < 0:
                    # The way ends free: each object on it takes the one that it looked at.
                    for c in way:
                        r = may[c][at[c]]
                        partner[c], holder[r] = r, c
                        level[c] = -1
                    break
                if level[d] == level[c] + 1:
                    way.append(d)
                else:
                    at[c] += 1
    return True


def matched(edges: DataFrame, n_own: DataFrame, n_other: DataFrame, mode: str = "reference") -> DataFrame:
    """category, candidate of the pairs whose objects can be assigned. edges: category, candidate, own_uid, own_pos, other_uid,
    other_pos, where the positions give the order of the steps; n_own and n_other have the numbers of objects by category and
    by candidate. mode `reference` goes step by step, and an unmatched candidate object fails the pair; `assignment` asks only
    that each category object has a candidate object of its own."""
    if mode not in ("reference", "assignment"):
        raise ValueError(mode)
    test = eliminate if mode == "reference" else assignable
    kinds = dict(edges.dtypes)

    def decide(batches):
        for pdf in batches:
            ok = []
            for pair, n_own, n_other in zip(pdf["edges"], pdf["n_own"], pdf["n_other"]):
                own = {u: k for k, (_, u) in enumerate(sorted({(e["own_pos"], e["own_uid"]) for e in pair}))}
                rows: dict = {}
                for e in pair:
                    rows.setdefault((e["other_pos"], e["other_uid"]), set()).add(own[e["own_uid"]])
                every = [rows[u] for u in sorted(rows)] + [set()] * (n_other - len(rows))
                ok.append(len(own) == n_own and test(every, n_own))
            yield pdf.loc[ok, ["category", "candidate"]]

    # A pair's edges are bounded by the objects of one category and one candidate.
    pairs = edges.groupBy("category", "candidate").agg(F.collect_list(F.struct("own_uid", "own_pos", "other_uid", "other_pos")).alias("edges"))
    some = pairs.join(n_own, "category").join(n_other, "candidate").filter("n_own <= n_other")
    return some.select("category", "candidate", "n_own", "n_other", "edges").mapInPandas(decide, f"category {kinds['category']}, candidate {kinds['candidate']}")


def objects(tags: DataFrame, kind: str) -> DataFrame:
    """owner, uid, pos, tag of the objects of a class, told apart by its begin. Without a column pos all have 0, and objects
    come in order of their uid."""
    pos = F.col("pos").cast("long") if "pos" in tags.columns else F.lit(0).cast("long")
    return tags.filter(F.col("class").isin(kind, f"{kind}Category")).select("owner", F.col("object_uid").alias("uid"), pos.alias("pos"), F.explode("tags").alias("tag"))


KINDS = ("Scenario", "Actor", "PhysicalElement")


def _coded(tag: Column) -> Column:
    """A tag as its place in the vocabulary; one from elsewhere as x and its letters' numbers."""
    places = F.create_map(*(F.lit(x) for k, t in enumerate(TAGS) for x in (t, str(k))))
    return F.coalesce(F.try_element_at(places, tag), F.concat(F.lit("x"), F.hex(tag)))


def _decoded(code: Column) -> Column:
    names = F.array(*map(F.lit, TAGS))
    return F.when(code.startswith("x"), F.decode(F.unhex(F.substr(code, F.lit(2))), "UTF-8")).otherwise(F.try_element_at(names, code.cast("int") + 1))


def signatures(tags: DataFrame, mode: str) -> DataFrame:
    """owner, sig, objects: what of an owner decides about it, for each owner of tags (see contains). objects has, by class, the
    sets of tags of its objects, without their ids, as a short text (see representatives); in mode `reference` in the order of
    the steps, pos then id, else in order of themselves. sig is a digest of it. Owners that differ in names, ids or numbers
    only share one."""
    pos = F.col("pos").cast("long") if "pos" in tags.columns else F.lit(0).cast("long")
    kind = F.when(F.col("class").isin("Scenario", "ScenarioCategory"), 0).when(F.col("class").isin("Actor", "ActorCategory"), 1).when(F.col("class").isin("PhysicalElement", "PhysicalElementCategory"), 2)
    tagged = F.when(kind.isNotNull() & (F.size("tags") > 0), F.struct(kind.alias("kind"), F.col("object_uid").alias("uid"), pos.alias("pos"), F.array_join(F.transform("tags", _coded), ",").alias("tags")))
    # An owner's objects are those of one scenario or category. Rows of one object are one: its tags together, its least pos.
    own = tags.select("owner", tagged.alias("row")).groupBy("owner").agg(F.collect_list("row").alias("rows"))
    named = F.array_distinct(F.transform("rows", lambda r: F.struct(r["kind"], r["uid"])))
    of = lambda n: F.filter("rows", lambda r: (r["kind"] == n["kind"]) & r["uid"].eqNullSafe(n["uid"]))
    whole = F.transform(named, lambda n: F.struct(n["kind"].alias("kind"), F.array_min(F.transform(of(n), lambda r: r["pos"])).alias("pos"), n["uid"].alias("uid"), F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(of(n), lambda r: F.split(r["tags"], ","))), lambda c: c != ""))).alias("tags")))
    plain = F.transform(F.array_sort(whole), lambda x: F.concat(x["kind"].cast("string"), F.lit(":"), F.array_join(x["tags"], ",")))
    own = own.select("owner", F.array_join(plain if mode == "reference" else F.array_sort(plain), ";").alias("objects"))
    return own.select("owner", F.sha2("objects", 256).alias("sig"), "objects")


def representatives(sigs: DataFrame) -> DataFrame:
    """The rows of contains() for one owner of each signature, under the signature's name. One without objects has one row."""
    one = sigs.groupBy("sig").agg(F.max("objects").alias("objects"))
    x = one.select("sig", F.posexplode(F.split("objects", ";")).alias("pos", "x"))
    name = F.try_element_at(F.array(*map(F.lit, KINDS)), F.substr("x", F.lit(1), F.lit(1)).try_cast("int") + 1)
    codes = F.filter(F.split(F.substr("x", F.lit(3)), ","), lambda c: c != "")
    return x.select(F.col("sig").alias("owner"), F.coalesce(name, F.lit(KINDS[0])).alias("class"), F.format_string("%08d", "pos").alias("object_uid"), "pos", F.transform(codes, _decoded).alias("tags"))


def contains(categories: DataFrame, candidates: DataFrame, mode: str = "reference", reflexive: bool = True) -> DataFrame:
    """category, candidate: the candidates that a category comprises (scenarios) or includes (categories).

    Both have rows owner, class, object_uid, tags and, for the order of the reference mode, pos, with class Scenario or
    ScenarioCategory for the owner's own tags, Actor or ActorCategory, and PhysicalElement or PhysicalElementCategory; an
    owner without tags of a class has no row of it. Each signature of categories is decided once against each distinct
    signature of candidates, and the pairs found go back to the owners; so the work grows with the signatures, and only the
    answer with the pairs."""
    if mode not in ("reference", "assignment"):
        raise ValueError(mode)
    # Short texts, written once; every class of objects and the way back to the owners read them.
    coded = lambda tags: staged(signatures(tags, mode).select("owner", "objects")).select("owner", F.sha2("objects", 256).alias("sig"), "objects")
    own, other = coded(categories), coded(candidates)
    found = decided(staged(representatives(own)), staged(representatives(other)), mode)
    found = found.join(own.select("sig", F.col("owner").alias("own")), found["category"] == F.col("sig")).drop("sig")
    found = found.join(other.select("sig", F.col("owner").alias("other")), found["candidate"] == F.col("sig"))
    found = found.select(F.col("own").alias("category"), F.col("other").alias("candidate"))
    return found if reflexive else found.filter("category <> candidate")


def decided(categories: DataFrame, candidates: DataFrame, mode: str) -> DataFrame:
    """category, candidate for each owner of the one and the other (see contains). Every class of which a category has objects
    gives the pairs that it allows, by an equi-join over tags; a pair stands where all classes of the category give it. Only a
    category that asks for nothing goes with all candidates."""
    asked, given = [], []
    for kind in KINDS:
        a, b = objects(categories, kind), objects(candidates, kind)
        wanted = a.groupBy(F.col("owner").alias("category")).agg(F.count_distinct("uid").alias("n_own"))
        edges = covered(a.select(F.col("owner").alias("category"), F.col("uid").alias("own_uid"), "tag"), b.select(F.col("owner").alias("candidate"), F.col("uid").alias("other_uid"), "tag"))
        if kind == "Scenario":
            pairs = edges.select("category", "candidate").distinct()
        else:
            held = b.groupBy(F.col("owner").alias("candidate")).agg(F.count_distinct("uid").alias("n_other"))
            # Objects of a representative are named by their place.
            edges = edges.withColumns({"own_pos": F.lit(0), "other_pos": F.lit(0)})
            pairs = matched(edges, wanted, held, mode)
        asked.append(wanted.select("category", F.lit(kind).alias("kind")))
        given.append(pairs.select("category", "candidate"))
    asks = asked[0].unionByName(asked[1]).unionByName(asked[2]).groupBy("category").agg(F.count("*").alias("n"))
    gives = given[0].unionByName(given[1]).unionByName(given[2]).groupBy("category", "candidate").agg(F.count("*").alias("m"))
    found = gives.join(asks, "category").filter("m = n").select("category", "candidate")
    open_ones = categories.select(F.col("owner").alias("category")).distinct().join(asks, "category", "left_anti")
    return found.unionByName(open_ones.join(candidates.select(F.col("owner").alias("candidate")).distinct()))


def derived_tags(catalog, collection: str = "scenario") -> DataFrame:
    """owner, class, key, object_uid, pos, tags of all scenarios, or scenario categories, of a catalog: their own tags where
    they have some, those of their actors with what these do, and those of their physical elements."""
    full = collection == "scenario_category"
    more = "Category" if full else ""
    name = lambda kind: f"{kind}_category" if full else kind
    plural = {"actor": "actor_categories" if full else "actors", "physical_element": "physical_element_categories" if full else "physical_elements"}
    df = catalog[collection]
    own = derived_own_tags(df.select(F.col("uid").alias("owner"), F.lit(0).cast("long").alias("pos"), "uid", "name", "tags"), f"Scenario{more}")
    tagged = lambda c: catalog.hydrated(c, times=False).select("uid", "name", (F.col("tags") if full else F.col("all_tags")).alias("tags"))

    def members(kind: str) -> DataFrame:
        some = df.select(F.col("uid").alias("owner"), F.posexplode(plural[kind]).alias("pos", "uid"))
        return some.join(tagged(name(kind)), "uid").select("owner", F.col("pos").cast("long").alias("pos"), "uid", "name", "tags")

    if not full and catalog.all_near():
        acts, did = catalog.near_activities("acts").select("owner", "actor", F.col("all_tags").alias("tags")), None
    else:
        acts = df.select(F.col("uid").alias("owner"), F.explode("acts").alias("act")).select("owner", "act.actor", "act.activity")
        did = tagged(name("activity")).select(F.col("uid").alias("activity"), "tags")
    actors = derived_actor_tags(members("actor"), acts, did, f"Actor{more}")
    return own.unionByName(actors).unionByName(derived_own_tags(members("physical_element"), f"PhysicalElement{more}"))


def supertag_counts(facts: DataFrame, tag: str = "tag") -> DataFrame:
    """How many facts lie under each tag, those below it included."""
    closure = tag_closure(facts.sparkSession)
    per = facts.groupBy(F.col(tag).alias("sub")).agg(F.count("*").alias("n"))
    return per.join(F.broadcast(closure), "sub").groupBy("sup").agg(F.sum("n").alias("n"))
