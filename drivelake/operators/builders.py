"""What makes rows of the store from plain values: ids, events from numbers, checked lists, members and acts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import append_missing


def _number(t: str) -> Column:
    """The number as a double; -0.0 is 0.0."""
    return F.col(t).cast("double") + F.lit(0.0)


def event_uid(uid: str, t: str) -> Column:
    """The id of an item's event at a number: both as text, so that reruns give the same, and no two of different items or
    numbers are equal."""
    return F.when(F.col(t).isNotNull(), F.concat_ws(":", F.col(uid).cast("string"), _number(t).cast("string")))


def events_at(df: DataFrame, times: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """df with a uid for each number of a time, and the events that these stand for. times: column of numbers, by the name of
    the uid's column. A null number has no event; equal numbers of one item share one."""
    out = df.withColumns({uid: event_uid("uid", t) for uid, t in times.items()})
    each = F.explode(F.array(*(F.struct(F.col(u).alias("uid"), _number(t).alias("time")) for u, t in times.items()))).alias("e")
    events = out.select(each).select("e.*").filter("uid is not null").distinct()
    return out, events.select("uid", F.lit("").alias("name"), F.array().cast("array<string>").alias("tags"), F.to_json(F.struct("time")).alias("conditions"))


def ego(actors: DataFrame) -> DataFrame:
    """Actors that are ego vehicles: with the tag EgoVehicle after their own, once."""
    return actors.withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("EgoVehicle"))))


def checked(column: str, kind: str, can_be_none: bool = False, at_least_one: bool = False) -> Column:
    """The column cast to an array or struct type of given elements; rows that break the rule raise when computed: a null
    where none may be, an empty array where one element is asked, or an element that the cast loses."""
    c, to = F.col(column), F.col(column).cast(kind)
    wrong = lambda why: F.raise_error(F.lit(f"{column}: {why}")).cast(kind)
    out = F.when(c.isNull(), to if can_be_none else wrong("must not be null"))
    if kind.startswith("array"):
        if at_least_one:
            out = out.when(F.size(c) == 0, wrong("needs an element"))
        out = out.when(F.exists(to, lambda x: x.isNull()), wrong(f"has what is not of type {kind}"))
    else:
        out = out.when(to.isNull(), wrong(f"is not of type {kind}"))
    return out.otherwise(to)


def state_values(df: DataFrame, column: str) -> Column:
    """A state's values: a number as an array of one, an array as doubles; an empty one raises when computed."""
    if not dict(df.dtypes)[column].startswith("array"):
        return F.array(F.col(column).cast("double"))
    return F.when(F.size(column) == 0, F.raise_error(F.lit(f"{column}: a state needs a value")).cast("array<double>")).otherwise(F.col(column).cast("array<double>"))


def set_members(scenarios: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """scenarios with a list of ids replaced, for the owners in members (owner, pos, uid); others keep theirs."""
    per = members.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "uid"))), lambda m: m["uid"]).alias("_new"))
    out = scenarios.join(per, scenarios["uid"] == per["owner"], "left").drop("owner")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_new").select(*scenarios.columns)


def set_acts(scenarios: DataFrame, acts: DataFrame, actors: str = "actors", activities: str = "activities") -> DataFrame:
    """scenarios with their acts replaced by acts (owner, pos, actor, activity), for the owners there; what the acts name and
    the lists lack is appended to these."""
    own = acts.join(scenarios.select(F.col("uid").alias("owner")), "owner", "left_semi")
    out = scenarios
    for column, part in ((actors, "actor"), (activities, "activity")):
        members = scenarios.select(F.col("uid").alias("owner"), F.posexplode(column).alias("pos", "uid"))
        whole = append_missing(members, own, part)
        out = set_members(out, column, whole.join(own.select("owner").distinct(), "owner", "left_semi"))
    per = own.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "actor", "activity"))), lambda a: F.struct(a["actor"].alias("actor"), a["activity"].alias("activity"))).alias("_acts"))
    out = out.join(per, out["uid"] == per["owner"], "left").drop("owner")
    return out.withColumn("acts", F.coalesce("_acts", "acts")).drop("_acts").select(*scenarios.columns)


def with_position(df: DataFrame, owner: str, order: str) -> DataFrame:
    """df with pos, from 0, of each row among its owner's."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(owner).orderBy(order)) - 1)
