"""States of actors at instants: grids, interval joins and model evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import PARAMETERS, derivative, multi_value, value, with_multi_pieces, with_pieces
from .segments import at_instants

VECTOR_DDL = "xstart array<double>, knots array<array<double>>, coefficients array<array<double>>, degree array<int>"


def grid(t0: Column, t1: Column, n: int = 100) -> Column:
    """An array of n equidistant instants, both ends included."""
    if n == 1:
        return F.array(t0)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: t0 + i * (t1 - t0) / (n - 1))


def normal_time(t: Column, t0: Column, t1: Column) -> Column:
    """t within an activity from 0 to 1; t itself where an end is unknown; null where the activity has no length."""
    return F.when(t0.isNotNull() & t1.isNotNull(), (t - t0) / F.when(t1 != t0, t1 - t0)).otherwise(t)


def activity_states(activities: DataFrame, n: int = 100) -> DataFrame:
    """activities (uid, modelname, p, t_start, t_end) with s, state and state_dot at n instants from start to end. Splines are put
    in powers once an activity, before the instants are laid out."""
    s = F.explode(grid(F.lit(0.0), F.lit(1.0), n)).alias("s")
    length = F.coalesce(F.col("t_end") - F.col("t_start"), F.lit(1.0))
    of = lambda f: f(F.col("modelname"), F.col("p"), F.col("s"), F.col("pieces"))
    return with_pieces(activities).select("*", s).withColumns({"state": of(value), "state_dot": of(derivative) / F.when(length != 0, length)}).drop("pieces")


def scenario_states(acts: DataFrame, instants: DataFrame | list[float], dot: bool = False, uncovered: bool = True, vector: bool = False) -> DataFrame:
    """scenario, actor, state_variable, t and state (or state_dot) for each instant.

    acts: scenario, actor, state_variable, act_pos, modelname, p, t_start, t_end; those without both ends are left out.
    instants: scenario, actor, state_variable, t; or a list of numbers, which are asked of every actor and variable with acts:
    then each act gives its own instants, without a join, and what is shuffled grows with those covered. Both ends of an act
    belong to it; where acts meet, the later in the scenario's order wins. An instant that no act covers has NaN, or with
    uncovered=False no row. An actor without any act of that variable has no row, nor has one none of whose acts covers any of
    the asked instants. With vector, p is that of with_vector_parameters, the state an array over the components, and null where no act covers an instant.
    """
    keys, name = ["scenario", "actor", "state_variable"], "state_dot" if dot else "state"
    known = acts.filter(F.col("t_start").isNotNull() & F.col("t_end").isNotNull()).select(*keys, "act_pos", "modelname", "p", "t_start", "t_end")
    known = (with_multi_pieces if vector else with_pieces)(known)
    given = not isinstance(instants, DataFrame)
    if given:
        # Acts are shuffled before their instants are laid out; what follows groups by scenario and more, and needs no other shuffle.
        known = known.repartition("scenario")
        every = F.array(*(F.lit(float(t)) for t in sorted(set(instants)))).cast("array<double>")
        met = known.withColumn("t", F.explode(F.filter(every, lambda t: t.between(F.col("t_start"), F.col("t_end")))))
    else:
        asked = instants.select(*keys, "t").distinct()
        met = at_instants(asked, known, keys, "t", how="left" if uncovered else "inner")
    s = normal_time(F.col("t"), F.col("t_start"), F.col("t_end"))
    length = F.col("t_end") - F.col("t_start")
    length = F.when(length != 0, length)
    if vector:
        v = _vector_value(s, dot)
        v = F.transform(v, lambda x: x / length) if dot else v
    else:
        v = (derivative if dot else value)(F.col("modelname"), F.col("p"), s, F.col("pieces"))
        v = v / length if dot else v
    won = met.groupBy(*keys, "t").agg(F.max_by(F.struct(v.alias("v")), "act_pos").alias("w"), F.count("act_pos").alias("n"))
    if not uncovered:
        return won.select(*keys, "t", F.col("w.v").alias(name))
    none = F.lit(None) if vector else F.lit(float("nan"))
    if given:
        # An actor and a variable have no more rows here than there are instants.
        per = won.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("w.v")))).alias("found"))
        at = per.select(*keys, F.explode(every).alias("t"), "found").withColumn("w", F.try_element_at("found", F.col("t")))
        return at.select(*keys, "t", F.when(F.col("w").isNull(), none).otherwise(F.col("w.v")).alias(name))
    some = won.filter("n > 0").select(*keys).distinct()
    return won.join(some, keys, "left_semi").select(*keys, "t", F.when(F.col("n") == 0, none).otherwise(F.col("w.v")).alias(name))


def _vector_value(s: Column, dot: bool) -> Column:
    """The value, or slope, at s of a vector activity with p and pieces; of a constant its xstart, or zeros."""
    constant = F.transform("p.xstart", lambda x: F.lit(0.0)) if dot else F.col("p.xstart")
    return F.when(F.col("modelname") == "Constant", constant).otherwise(multi_value(F.col("p"), s, dot, F.col("pieces")))


def with_parameters(acts: DataFrame, schema: str = PARAMETERS) -> DataFrame:
    """acts of a catalog with p, the struct of their parameters, read from their JSON. What isn't a number of its kind is
    null; vector and message activities, which these parameters can't hold, are left out (see vector_states)."""
    return acts.filter(~F.col("modelname").isin("MultiBSplines", "Messages")).withColumn("p", F.from_json("parameters", schema.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")))


def with_vector_parameters(acts: DataFrame) -> DataFrame:
    """The vector acts of a catalog, those of vector models and constants with an array as xstart, with p, the struct of their
    parameters."""
    own = acts.filter(F.col("modelname").isin("MultiBSplines", "Constant")).withColumn("p", F.from_json("parameters", VECTOR_DDL))
    return own.filter((F.col("modelname") == "MultiBSplines") | F.col("p.xstart").isNotNull())


def vector_states(activities: DataFrame, n: int = 100, dot: bool = False) -> DataFrame:
    """activities (modelname, parameters, t_start, t_end) of vector models with s and state, an array over the components, at
    n instants; with dot the derivative. Constants with a vector as xstart count as such. Splines are put in powers once an
    activity."""
    s = F.explode(grid(F.lit(0.0), F.lit(1.0), n)).alias("s")
    own = with_multi_pieces(with_vector_parameters(activities)).select("*", s)
    v = _vector_value(F.col("s"), dot)
    length = F.coalesce(F.col("t_end") - F.col("t_start"), F.lit(1.0))
    return own.withColumn("state_dot" if dot else "state", F.transform(v, lambda x: x / F.when(length != 0, length)) if dot else v).drop("pieces")


def rmse(df: DataFrame, keys: list[str], found: str, truth: str) -> DataFrame:
    e = F.col(found) - F.col(truth)
    return df.groupBy(*keys).agg(F.sqrt(F.sum(e * e) / F.count(e)).alias("rmse"))
