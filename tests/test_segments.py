"""Runs by a scan in two levels against one sort an actor, and the dyadic interval join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from drivelake.operators import segments


def frame(spark, rows):
    return spark.createDataFrame(rows, "actor string, t double, label string, y int")


def found(df):
    return sorted(((r["actor"], r["t"], r["label"], r["y"], r["run"], r["run_label"], r["t_start"], r["t_end"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_two_levels(spark, ranges):
    r = random.Random(ranges)
    rows = [("hot", float(r.randrange(120)), r.choice(["a", "b", "b", None]), k) for k in range(300)]
    rows += [("hot2", float(k), "a" if k < 150 else "b", k) for k in range(200)]
    rows += [(f"few{k % 7}", float(r.randrange(5)), r.choice("ab"), k) for k in range(40)] + [(None, 1.0, "a", 1), ("one", 1.0, None, 1)]
    df = frame(spark, list({(a, t, x): (a, t, x, y) for a, t, x, y in rows}.values()))
    assert found(segments.in_runs_ranged(df, ranges)) == found(segments.in_runs(df))


def test_equal_samples(spark):
    """Rows that repeat a sample, a third of all among them, are each in its run."""
    df = frame(spark, [("a", 1.0, "x", k % 3) for k in range(50)] + [("a", float(k), "xy"[k % 2], k) for k in range(100)])
    count = lambda d: sorted((tuple(r) for r in d.groupBy("actor", "t", "run", "run_label", "t_start", "t_end").count().collect()), key=repr)
    assert count(segments.in_runs_ranged(df, 12)) == count(segments.in_runs(df))


def test_one_actor_in_all_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("actor"), F.col("id").cast("double").alias("t"), F.when(F.col("id") < n * 0.6, "long").otherwise((F.col("id") / 1000).cast("long").cast("string")).alias("label"))
    out = segments.in_runs_ranged(df, 32).groupBy("run").agg(F.min("t_start").alias("a"), F.max("t_end").alias("b"), F.count("*").alias("n"), F.count_distinct("t_start", "t_end").alias("same")).orderBy("run").collect()
    assert len(out) == 401 and (out[0]["a"], out[0]["b"], out[0]["n"]) == (0.0, 600000.0, 600001)
    assert all((r["a"], r["b"], r["n"], r["same"]) == (599000.0 + 1000 * k, min(600000.0 + 1000 * k, n - 1.0), 1001 if k < 400 else 1000, 1) for k, r in enumerate(out) if k)


def test_no_samples(spark):
    assert segments.in_runs_ranged(frame(spark, []), 4).collect() == []


def test_dyadic_join(spark):
    """Very long beside very short intervals, of no length too, at negative and large times."""
    r = random.Random(3)
    spans = [(k, "ab"[k % 2], (s := r.choice([r.uniform(-50, 50), float(r.randrange(-8, 8)), 1.7e9])), s + r.choice([0.0, 1e-9, 0.25, 1.0, 3.7, 64.0, 1e6])) for k in range(120)] + [(900, "a", None, 1.0), (901, "a", 5.0, 4.0)]
    points = [(k, "abc"[k % 3], r.choice([r.uniform(-60, 60), float(r.randrange(-8, 8)), 1.7e9, 1.7e9 + 3])) for k in range(200)]
    a = spark.createDataFrame(spans, "id int, who string, t_start double, t_end double")
    p = spark.createDataFrame(points, "p int, who string, at double")
    want = sorted((q, k) for q, w, t in points for k, v, s, e in spans if w == v and s is not None and s <= t <= e)
    assert sorted((x["p"], x["id"]) for x in segments.at_instants(p, a, ["who"], "at", how="inner").collect()) == want
    left = segments.at_instants(p, a, ["who"], "at").collect()
    assert sorted((x["p"], x["id"]) for x in left if x["id"] is not None) == want and {x["p"] for x in left} == set(range(200))
