"""Splines in powers, fits to functions of one's own, a model that a user registers, and what had no test of its own."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivelake.functions import models, vocabulary
from drivelake.functions.models import PARAMETERS
from drivelake.operators import builders, states
from drivelake.sources import json_db

P = PARAMETERS.removeprefix("struct<").removesuffix(">").replace(":", " ", 1).replace(":", " ")


def test_power_form():
    """Equal to the basis between knots, at them, beyond both ends, for repeated knots and for padded coefficients."""
    r = np.random.default_rng(1)
    for _ in range(200):
        p, inner = int(r.integers(0, 5)), np.sort(r.random(int(r.integers(0, 6))))
        if len(inner) > 2 and p > 1:
            inner[1] = inner[0]
        knots = np.concatenate([np.zeros(p + 1), inner, np.ones(p + 1)])
        n = len(knots) - p - 1
        c = r.normal(size=n + p + 1)
        starts, power, slope = models.power_form(knots, c, p)
        s = np.concatenate([r.uniform(-0.5, 1.5, 50), inner, [0, 1]])
        at = np.maximum((starts[None, :] <= s[:, None]).sum(1), 1) - 1
        want = models.bspline_basis(knots, p, s) @ c[:n]
        assert np.allclose([np.polyval(power[k], x - starts[k]) for k, x in zip(at, s)], want, atol=1e-9 * (1 + abs(want).max()))
        assert np.allclose([np.polyval(np.polyder(power[k]), x) for k, x in zip(at, s - starts[at])], [np.polyval(slope[k], x) for k, x in zip(at, s - starts[at])])


def test_pieces_in_columns(spark):
    """Values and slopes by pieces are those of the recursion; a row without splines has none."""
    rows = [([0.0, 0.0, 0.0, 0.5, 1.0, 1.0, 1.0], [20.0, 21.0, 19.0, 22.0, 9.0, 9.0, 9.0], 2, s / 8) for s in range(-2, 11)] + [(None, None, None, 0.5)]
    df = spark.createDataFrame(rows, "knots array<double>, coefficients array<double>, degree int, s double").withColumn("p", F.struct("knots", "coefficients", "degree"))
    own = models.with_pieces(df).filter("knots is not null")
    both = own.select(models._spline_value(F.col("knots"), F.col("coefficients"), F.col("degree"), F.col("s")).alias("a"), models.piece_value(F.col("pieces"), F.col("s")).alias("b"), models._spline_slope(F.col("knots"), F.col("coefficients"), F.col("degree"), F.col("s")).alias("c"), models.piece_value(F.col("pieces"), F.col("s"), True).alias("d")).collect()
    assert len(both) == 13 and all(math.isclose(r["a"], r["b"], abs_tol=1e-9) and math.isclose(r["c"], r["d"], abs_tol=1e-9) for r in both)
    assert models.with_pieces(df).filter("knots is null").select(models.piece_value(F.col("pieces"), F.col("s"))).first()[0] is None


def test_fit_nonlinear(spark):
    """Planted frequencies and phases are found; a group that can't converge in time is marked; one without values has nulls."""
    r = random.Random(4)
    plant = {f"g{k}": (r.uniform(1, 3), r.uniform(0.9, 1.1), r.uniform(0, 0.6)) for k in range(6)}
    rows = [(g, i / 40, a * math.sin(2 * math.pi * f * i / 40 + q)) for g, (a, f, q) in plant.items() for i in range(41)]
    df = spark.createDataFrame([*rows, ("none", 0.5, None), ("none", None, 1.0)], "g string, t double, y double")
    wave = lambda p, t: p["a"] * F.sin(2 * F.pi() * p["f"] * t + p["q"])
    out = {x["g"]: x for x in models.fit_nonlinear(df, ["g"], wave, {"a": 1.0, "f": 1.0, "q": 0.2}).collect()}
    for g, want in plant.items():
        assert np.allclose([out[g][c] for c in "afq"], want, atol=1e-5) and out[g]["converged"] and out[g]["rmse"] < 1e-6 and out[g]["rounds"] < 30
    assert (out["none"]["a"], out["none"]["rmse"], out["none"]["converged"]) == (None, None, False)
    few = models.fit_nonlinear(df.filter("g = 'g0'"), ["g"], wave, {"a": 1.0, "f": 1.0, "q": 0.2}, rounds=2).first()
    assert not few["converged"] and few["rounds"] == 2
    noisy = df.filter("g = 'g1'").withColumn("y", F.col("y") + F.when(F.col("t") * 40 % 2 < 1, 0.1).otherwise(-0.1))
    got = models.fit_nonlinear(noisy, ["g"], wave, {"a": 1.0, "f": 1.0, "q": F.lit(0.2)}).first()
    assert got["converged"] and 0.09 < got["rmse"] < 0.11 and abs(got["f"] - plant["g1"][1]) < 0.02


def test_model_of_ones_own(spark):
    """A registered model is fitted and evaluated by name."""
    fit = lambda df, keys, t, y: df.groupBy(*keys).agg(F.max(y).alias("xstart"))
    models.register(models.Model("Peak", lambda p, s: p["xstart"] * s, lambda p, s: p["xstart"] + 0 * s, fit))
    try:
        df = spark.createDataFrame([("k", 0.0, 1.0), ("k", 1.0, 4.0)], "k string, t double, y double")
        acts = models.fit("Peak", df, ["k"]).select("k", F.lit("Peak").alias("modelname"), F.from_json(F.to_json(F.struct("xstart")), P).alias("p"), F.lit(2.0).alias("t_start"), F.lit(4.0).alias("t_end"))
        assert [(r["s"], r["state"], r["state_dot"]) for r in states.activity_states(acts, 3).orderBy("s").collect()] == [(0.0, 0.0, 2.0), (0.5, 2.0, 2.0), (1.0, 4.0, 2.0)]
    finally:
        del models.MODELS["Peak"]


def test_functions_in_sql(spark):
    """States and slopes are those of the columns' functions; what is no model raises."""
    from drivelake.functions.sql import STATES, register_sql

    register_sql(spark)
    values = {"xstart": 2.0, "xend": 5.0, **{f"{c}{k}": float(i + k) for i, c in enumerate("abcd") for k in (1, 2)}}
    p = spark.createDataFrame([(m, values) for m in STATES], "modelname string, v map<string,double>").select("modelname", F.from_json(F.to_json("v"), P).alias("p"))
    out = spark.sql("SELECT modelname, p, t, state_value(modelname, p, t) AS a, state_slope(modelname, p, t) AS b FROM {p} AS p, LATERAL instants(-0.5, 1.5, 9) AS g", p=p)
    got = out.select("a", "b", models.value(F.col("modelname"), F.col("p"), F.col("t")).alias("c"), models.derivative(F.col("modelname"), F.col("p"), F.col("t")).alias("d")).collect()
    assert len(got) == 36 and all(math.isclose(r["a"], r["c"]) and math.isclose(r["b"], r["d"], abs_tol=1e-12) for r in got)
    assert [tuple(r) for r in spark.sql("SELECT * FROM instants(3, 4, 1)").collect()] == [(0, 3.0)]
    with pytest.raises(Exception, match="Messages"):
        spark.sql("SELECT state_value('Messages', p, 0.5) FROM {p}", p=p).collect()


def test_spline_with_endpoints(spark):
    """With endpoints the curve goes through the values at the least and greatest time, in whatever order the rows come."""
    rows = [("k", i / 10, math.sin(3 * i / 10)) for i in range(11)]
    random.Random(1).shuffle(rows)
    p = models.fit("Spline3Knots", spark.createDataFrame(rows, "k string, t double, y double"), ["k"], endpoints=True).first()
    assert math.isclose(p["d1"], 0, abs_tol=1e-9) and math.isclose(p["a2"] + p["b2"] + p["c2"] + p["d2"], math.sin(3), abs_tol=1e-9)


def test_acts_without_both_ends(spark):
    """They have no state at any instant; an instant that others cover has theirs."""
    rows = [("s", "a", "SPEED", 0, "Constant", '{"xstart": 1}', 0.0, None), ("s", "a", "SPEED", 1, "Constant", '{"xstart": 2}', 1.0, 2.0)]
    acts = states.with_parameters(spark.createDataFrame(rows, "scenario string, actor string, state_variable string, act_pos int, modelname string, parameters string, t_start double, t_end double"))
    asked = acts.select("scenario", "actor", "state_variable").distinct().select("*", F.explode(F.array(F.lit(0.5), F.lit(1.5))).alias("t"))
    out = {r["t"]: r["state"] for r in states.scenario_states(acts, asked).collect()}
    assert math.isnan(out[0.5]) and out[1.5] == 2.0
    assert [r["t"] for r in states.scenario_states(acts, asked, uncovered=False).collect()] == [1.5]


def test_signals_and_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("t,y\n0.5,1\n1.5,\n")
    assert [tuple(r) for r in json_db.read_signals(spark, str(tmp_path / "s.csv"), "t double, y double").collect()] == [(0.5, 1.0), (1.5, None)]
    assert {r["name"]: r["unit"] for r in vocabulary.state_variable_table(spark).collect()} == vocabulary.STATE_VARIABLES
    types = {r["name"]: r["value"] for r in vocabulary.actor_type_table(spark).collect()}
    assert types["Vehicle"] == 1 and types["VRU_Cyclist"] == 11 and types["NetworkIts"] == 194 and len(types) == 14
    tags = spark.createDataFrame([("o", "b::Actor", ["y", "x"]), ("o", "a::Actor", ["z"])], "owner string, key string, tags array<string>")
    assert json_db.tag_text(tags).first()["text"] == "a::Actor\n - z\nb::Actor\n - x\n - y"


@pytest.mark.parametrize("kind, ok", [("struct<a:int>", True), ("array<struct<a:int>>", True)])
def test_checked_structs(spark, kind, ok):
    df = spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("s")).select("s", F.array("s").alias("l"))
    assert (df.select(builders.checked("l" if kind.startswith("array") else "s", kind).alias("v")).first()["v"] is not None) == ok
    with pytest.raises(Exception, match="must not be null"):
        spark.range(1).select(F.lit(None).cast(kind).alias("s")).select(builders.checked("s", kind)).collect()
