"""The store of ten collections: upsert, delete, lookup, hydration and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "0.2"
_BASE = "uid string, name string, tags array<string>"
_STATES = "array<struct<state_variable:string,value:array<double>>>"
_ACTS = "acts array<struct<actor:string,activity:string>>"
#: uid is text: ids have up to 39 digits.
SCHEMAS = {
    "actor": f"{_BASE}, properties string, category_uid string, initial_states {_STATES}, desired_states {_STATES}",
    "actor_category": f"{_BASE}, description string, actor_type string, actor_type_value int",
    "activity": f"{_BASE}, start_uid string, end_uid string, category_uid string, parameters string",
    "activity_category": f"{_BASE}, description string, model_uid string, state string",
    "event": f"{_BASE}, conditions string",
    "model": f"{_BASE}, description string, modelname string, default_options string",
    "physical_element": f"{_BASE}, properties string, category_uid string",
    "physical_element_category": f"{_BASE}, description string",
    "scenario": f"{_BASE}, start_uid string, end_uid string, physical_elements array<string>, actors array<string>, activities array<string>, {_ACTS}",
    "scenario_category": f"{_BASE}, description string, image string, physical_element_categories array<string>, actor_categories array<string>, activity_categories array<string>, {_ACTS}",
}
#: collection, column, collection that it refers to.
REFERENCES = [
    ("actor", "category_uid", "actor_category"), ("activity", "category_uid", "activity_category"), ("activity", "start_uid", "event"), ("activity", "end_uid", "event"),
    ("activity_category", "model_uid", "model"), ("physical_element", "category_uid", "physical_element_category"), ("scenario", "start_uid", "event"), ("scenario", "end_uid", "event"),
    ("scenario", "actors", "actor"), ("scenario", "activities", "activity"), ("scenario", "physical_elements", "physical_element"),
    ("scenario_category", "actor_categories", "actor_category"), ("scenario_category", "activity_categories", "activity_category"), ("scenario_category", "physical_element_categories", "physical_element_category"),
]


def upsert(old: DataFrame, new: DataFrame, key: str = "uid", overwrite: bool = True) -> DataFrame:
    """old with new's rows, which replace those of the same key, or with overwrite=False only fill gaps. Of rows of new that
    repeat a key the greatest counts."""
    rest = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("_rest")).select(key, "_rest.*") if rest else new.distinct()
    if overwrite:
        return old.join(one, key, "left_anti").unionByName(one)
    return old.unionByName(one.join(old, key, "left_anti"))


def delete(old: DataFrame, keys: DataFrame, key: str = "uid") -> DataFrame:
    return old.join(keys, key, "left_anti")


def first_of_each(rows: DataFrame, key: str = "uid", order: str = "pos") -> DataFrame:
    """Of rows that repeat a key, the first by order; the others may differ and are left out."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def append_missing(members: DataFrame, acts: DataFrame, column: str) -> DataFrame:
    """members (owner, pos, uid) and, after them, what the acts of an owner name and its members lack, in acts' order."""
    kind, none = dict(members.dtypes), F.lit(None)
    pos = F.col("pos").cast(kind["pos"])
    # A null name is no member's. All that is known of an owner meets once; no join and no other shuffle follows.
    act = acts.select("owner", F.col(column).alias("uid"), none.cast(kind["pos"]).alias("pos"), pos.alias("p"), F.col(column).isNull().alias("lost"))
    every = members.select("owner", "uid", "pos", none.cast(kind["pos"]).alias("p"), F.lit(False).alias("lost")).unionByName(act)
    per = every.repartition(many_tasks(members.sparkSession), "owner").groupBy("owner", "uid", "lost").agg(F.collect_list("pos").alias("own"), F.min("p").alias("p"))
    w = Window.partitionBy("owner")
    new = F.coalesce(F.max(F.array_max("own")).over(w), F.lit(-1)) + F.row_number().over(w.orderBy(F.size("own") > 0, "p"))
    return per.withColumn("new", new).select("owner", F.explode(F.when(F.size("own") > 0, F.transform("own", lambda x: x.cast("long"))).otherwise(F.array(F.col("new").cast("long")))).alias("pos"), "uid")


def many_tasks(spark: SparkSession) -> int:
    """A number of partitions for rows that are short and compress well: of these Spark would join many partitions into tasks of
    one size on disk, whose rows need far more memory. A number that is given stays."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)


def resolve_acts(acts: DataFrame, actors: DataFrame, activities: DataFrame, strict: bool = False) -> DataFrame:
    """acts (owner, pos, actor, activity) whose both members are there; with strict, one whose member is missing raises when
    the frame is computed."""
    if strict:
        known = acts.join(actors.select(F.col("uid").alias("actor"), F.lit(True).alias("_a")).distinct(), "actor", "left").join(activities.select(F.col("uid").alias("activity"), F.lit(True).alias("_b")).distinct(), "activity", "left")
        lost = F.raise_error(F.concat(F.lit("no such member: "), F.when(F.col("_a").isNull(), F.col("actor").cast("string")).otherwise(F.col("activity").cast("string"))))
        return known.withColumn("owner", F.when(F.col("_a") & F.col("_b"), F.col("owner")).otherwise(lost.cast(dict(acts.dtypes)["owner"]))).select(*acts.columns)
    return acts.join(actors.select(F.col("uid").alias("actor")), "actor", "left_semi").join(activities.select(F.col("uid").alias("activity")), "activity", "left_semi")


#: Conditions that are nothing but a time, as events from numbers have them.
_ONLY_TIME = r'^\{"time":(-?(?:0|[1-9][0-9]{0,15})(?:\.[0-9]{1,17})?(?:E-?[0-9]{1,2})?)\}$'


def time_of(conditions: str) -> Column:
    """The time in an event's conditions. A time alone is read by a pattern, which spares most rows a JSON parser of their own."""
    return F.coalesce(F.regexp_extract(conditions, _ONLY_TIME, 1).try_cast("double"), F.get_json_object(conditions, "$.time").cast("double"))


def first_with(items: str, uid: Column) -> Column:
    """The first of an array of items that has that uid; null where there is none."""
    return F.get(F.filter(items, lambda x: x["uid"] == uid), 0)


def by_name(members: DataFrame, name: str) -> DataFrame:
    """Each owner's first member of that name."""
    return first_of_each(members.filter(F.col("name") == name), "owner", "pos")


class Catalog:
    """Ten frames, one for each collection. Every change gives a new catalog; nothing is cached, so nothing is stale.

    near has the rows of scenario, and with each, as far as they were stored along with it, activities and events as the collections
    have them: near_activities, structs of all columns, and near_events, structs of uid and conditions. As an id is there once
    in a collection, what is found near needn't be looked for elsewhere; where anything isn't near, all is joined by ids (see
    all_near, which needn't look where whole says so). A catalog that was changed has no near."""

    def __init__(self, frames: dict[str, DataFrame], near: DataFrame | None = None, whole: bool | None = None) -> None:
        self.frames, self.near, self._all_near = frames, near, whole

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        # With limit(0), Spark knows before it runs that there are no rows, and leaves out joins and unions with them.
        return cls({c: spark.createDataFrame([], s).limit(0) for c, s in SCHEMAS.items()})

    def __getitem__(self, collection: str) -> DataFrame:
        return self.frames[collection]

    def add(self, collection: str, items: DataFrame, overwrite: bool = True) -> Catalog:
        if collection not in SCHEMAS:
            raise TypeError(f"no collection named {collection}")
        return Catalog(self.frames | {collection: upsert(self[collection], items.select(*self[collection].columns), overwrite=overwrite)})

    def add_all(self, parts: dict[str, DataFrame]) -> Catalog:
        """Adds items and what they consist of (see sources.json_db.shred); copies of one id count once."""
        return reduce(lambda c, x: c.add(*x), parts.items(), self)

    def delete(self, collection: str, uid: str) -> Catalog:
        if self[collection].filter(F.col("uid") == uid).isEmpty():
            raise KeyError(f"{collection} {uid}")
        return Catalog(self.frames | {collection: self[collection].filter(F.col("uid") != uid)})

    def counts(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (df.select(F.lit(c).alias("collection")) for c, df in self.frames.items())).groupBy("collection").count()

    def dangling(self) -> DataFrame:
        """collection, uid, refers_to, missing: references to what is not there."""
        out = []
        for c, column, to in REFERENCES:
            value = F.explode(column) if dict(self[c].dtypes)[column].startswith("array") else F.col(column)
            refs = self[c].select(F.lit(c).alias("collection"), "uid", F.lit(to).alias("refers_to"), value.alias("missing")).filter("missing is not null")
            out.append(refs.join(self[to].select(F.col("uid").alias("missing")), "missing", "left_anti").select("collection", "uid", "refers_to", "missing"))
        return reduce(DataFrame.unionByName, out)

    def get(self, collection: str, uid: str) -> DataFrame:
        """The item with what it refers to; KeyError where it or a part is not there."""
        item = self[collection].filter(F.col("uid") == uid)
        if item.isEmpty():
            raise KeyError(f"{collection} {uid}")
        lost = Catalog(self.frames | {collection: item}).dangling().filter(F.col("collection") == collection).first()
        if lost:
            raise KeyError(f"{lost['refers_to']} {lost['missing']}")
        return self.hydrated(collection).filter(F.col("uid") == uid)

    def all_near(self) -> bool:
        """Whether all activities that scenarios list or act, and the events of both, are near; found out once."""
        if self._all_near is None and self.near is not None:
            some = lambda *c: F.array_compact(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in c)))
            each = lambda c, f: F.transform(c, lambda x: x[f])
            activities = F.array_except(some(F.col("activities"), each("acts", "activity")), some(each("near_activities", "uid")))
            events = F.array_except(some(F.array("start_uid", "end_uid"), each("near_activities", "start_uid"), each("near_activities", "end_uid")), some(each("near_events", "uid")))
            self._all_near = self.near.filter((F.size(activities) > 0) | (F.size(events) > 0)).isEmpty()
        return bool(self._all_near)

    def near_activities(self, column: str) -> DataFrame:
        """owner, pos and the hydrated activity of each of a scenario's acts, with their actor, or activities, from what is near:
        only their categories are joined. A look goes through the scenario's own parts."""
        own = self.near.select(F.col("uid").alias("owner"), "near_activities", "near_events", F.posexplode(column).alias("pos", "_r"))
        own = own.withColumn("_a", first_with("near_activities", F.col("_r.activity") if column == "acts" else F.col("_r")))
        own = own.withColumns({f"_{x}": first_with("near_events", F.col(f"_a.{x}_uid")) for x in ("start", "end")})
        # As a generator's output, so that a filter of times doesn't repeat what they are made of.
        times = F.inline(F.array(F.struct(*(time_of(f"_{x}.conditions").alias(f"t_{x}") for x in ("start", "end")))))
        return self._with_category(own.select("owner", "pos", *(["_r.actor"] if column == "acts" else []), "_a.*", times))

    def acts(self) -> DataFrame:
        """scenario, actor, state_variable, act_pos, modelname, parameters, t_start, t_end of every act of every scenario."""
        last = ("scenario", "actor", "state_variable", "act_pos", "modelname", "parameters", "t_start", "t_end")
        if self.all_near():
            return self.near_activities("acts").withColumnsRenamed({"owner": "scenario", "pos": "act_pos", "state": "state_variable"}).select(*last)
        a = self["scenario"].select(F.col("uid").alias("scenario"), F.posexplode("acts").alias("act_pos", "act")).select("scenario", "act_pos", "act.actor", "act.activity")
        h = self.hydrated("activity", times=False)
        # The events of both ends are met in one join, and their times meet the rest where that comes together by activity.
        refs = self["activity"].select("uid", F.explode(F.array(*(F.struct(F.lit(x).alias("end"), F.col(f"{x}_uid").alias("event")) for x in ("start", "end")))).alias("e")).select("uid", "e.end", "e.event")
        times = refs.join(self._event_times(), "event").groupBy(F.col("uid").alias("activity")).agg(*(F.max(F.when(F.col("end") == x, F.col("time"))).alias(f"t_{x}") for x in ("start", "end")))
        h = h.select(F.col("uid").alias("activity"), F.col("state").alias("state_variable"), "modelname", "parameters")
        return a.join(h, "activity").join(times, "activity", "left").select(*last)

    def hydrated(self, collection: str, times: bool = True, only: dict[str, list[str]] | None = None) -> DataFrame:
        """The items with what they refer to; of activities and scenarios, with times=False, without the times of their events. only has, by column, which fields of members are
        asked for; others aren't carried along. A scenario has its times and, in order, its actors, activities and physical
        elements; a scenario category likewise its categories. An item whose category is missing is left out, and so is a
        missing member (see dangling)."""
        df = self[collection]
        if collection in ("actor", "physical_element"):
            c = self[f"{collection}_category"]
            more = ["actor_type"] if collection == "actor" else []
            return df.join(c.select(F.col("uid").alias("category_uid"), F.col("name").alias("category_name"), F.col("tags").alias("category_tags"), *more), "category_uid").withColumn("all_tags", F.concat("tags", "category_tags"))
        if collection == "activity_category":
            return df.join(self["model"].select(F.col("uid").alias("model_uid"), "modelname", "default_options"), "model_uid")
        if collection == "activity":
            out = self._with_category(df)
            return out if not times else self._times(out).withColumn("duration", F.col("t_end") - F.col("t_start"))
        if collection == "scenario":
            near = self.all_near()
            out = df if not times else self._near_times() if near else self._times(df)
            for column, kind, fields in (("actors", "actor", ["uid", "name", "category_name", "actor_type", "all_tags"]), ("activities", "activity", ["uid", "name", "category_name", "state", "modelname", "parameters", "t_start", "t_end", "all_tags"]), ("physical_elements", "physical_element", ["uid", "name", "category_name", "all_tags"])):
                met = self.near_activities(column) if near and kind == "activity" else self._met(df, column, self.hydrated(kind))
                out = self._members(out, column, met, (only or {}).get(column, fields))
            return out
        if collection == "scenario_category":
            out = df
            for column, kind, fields in (("actor_categories", "actor_category", ["uid", "name", "tags", "actor_type"]), ("activity_categories", "activity_category", ["uid", "name", "tags", "state", "modelname"]), ("physical_element_categories", "physical_element_category", ["uid", "name", "tags"])):
                out = self._members(out, column, self._met(df, column, self.hydrated(kind)), (only or {}).get(column, fields))
            return out
        return df

    def _with_category(self, activities: DataFrame) -> DataFrame:
        c = self.hydrated("activity_category").select(F.col("uid").alias("category_uid"), F.col("name").alias("category_name"), F.col("tags").alias("category_tags"), "state", "modelname")
        return activities.join(c, "category_uid").withColumn("all_tags", F.concat("tags", "category_tags"))

    def _near_times(self) -> DataFrame:
        """The scenarios with t_start and t_end, of the events near them."""
        own = self.near.withColumns({f"_{x}": first_with("near_events", F.col(f"{x}_uid")) for x in ("start", "end")})
        return own.select(*self["scenario"].columns, *(time_of(f"_{x}.conditions").alias(f"t_{x}") for x in ("start", "end")))

    def _times(self, df: DataFrame) -> DataFrame:
        """df with t_start and t_end, the times of its start and end events; null where one has none."""
        # Conditions are parsed where an item has met its event, not for every event in each join.
        for x in ("start", "end"):
            df = df.join(self["event"].select(F.col("uid").alias(f"{x}_uid"), F.col("conditions").alias("_conditions")), f"{x}_uid", "left").withColumn(f"t_{x}", time_of("_conditions")).drop("_conditions")
        return df

    def _event_times(self) -> DataFrame:
        return self["event"].select(F.col("uid").alias("event"), time_of("conditions").alias("time"))

    @staticmethod
    def _met(df: DataFrame, column: str, of: DataFrame) -> DataFrame:
        """owner, pos and the columns of each item that a column of df lists."""
        return df.select(F.col("uid").alias("owner"), F.posexplode(column).alias("pos", "uid")).join(of, "uid")

    @staticmethod
    def _members(df: DataFrame, column: str, met: DataFrame, fields: list[str]) -> DataFrame:
        """df with structs of those fields of met (owner, pos and others) in place of a column's ids, in their order. An owner's
        members are its own."""
        per = met.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("_m"))
        joined = df.join(per, df["uid"] == per["owner"], "left").drop("owner")
        plain = F.transform(F.coalesce("_m", F.array().cast(per.schema["_m"].dataType)), lambda m: F.struct(*(m[f].alias(f) for f in fields)))
        return joined.withColumn(column, plain).drop("_m")
