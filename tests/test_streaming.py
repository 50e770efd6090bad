"""Runs of a stream against runs of all its samples: late, repeated and disordered rows, timers, and a restart."""

import datetime as dt
import random

from oracle import SMALL
from pyspark.sql import functions as F

from drivelake.operators import segments
from drivelake.plans import queries
from drivelake.streaming import runs

SCHEMA = "actor string, ts timestamp, label string"
START = dt.datetime(2024, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


def files(spark, path, batches, n=0):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(a, at(t), x) for a, t, x in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in/{n + k:03d}")


def stream(spark, path, delay="10 seconds", silence="100 seconds"):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    runs.to_files(runs.stream_segments(source, delay, silence), f"{path}/out", f"{path}/check")
    return {(r["actor"], r["run"], r["label"], r["t_start"], r["t_end"]) for r in spark.read.parquet(f"{path}/out").collect() if r["actor"] != "end"}


def batch(spark, rows):
    df = spark.createDataFrame([(a, at(t), x) for a, t, x in rows], SCHEMA).withColumn("t", F.unix_micros("ts"))
    return {(r["actor"], r["run"], r["label"], r["a"], r["b"]) for r in segments.segments(df).withColumns({"a": F.timestamp_micros("t_start"), "b": F.timestamp_micros("t_end")}).collect()}


def test_equal_to_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(300) + r.choice([0.0, 0.25]), r.choice(["x", "y", "y", None])) for _ in range(150)]
    rows = list({(a, t): (a, t, x) for a, t, x in rows}.values()) + [("a", 50.5, "p"), ("a", 50.5, "o")]
    late = sorted(rows, key=lambda x: x[1] + r.uniform(0, 9))
    parts = [late[k : k + 40] + late[k : k + 5] for k in range(0, len(late), 40)]
    files(spark, tmp_path, [*parts, [("end", 2000, "")], [("end", 2001, "")]])
    assert stream(spark, tmp_path) == batch(spark, rows)


def test_too_late_and_silence(spark, tmp_path):
    """A sample older than the watermark is left out; after a silence the actor begins anew; a restart goes on."""
    files(spark, tmp_path, [[("a", 0, "x"), ("a", 5, "y")], [("b", 60, "x")], [("a", 70, "y")], [("a", 1, "z")]])
    first = stream(spark, tmp_path)
    assert first == {("a", 1, "x", at(0), at(5))}
    files(spark, tmp_path, [[("b", 250, "x")], [("a", 260, "y")], [("end", 900, "")], [("end", 901, "")]], 4)
    assert stream(spark, tmp_path) == first | {("a", 2, "y", at(5), at(70)), ("a", 1, "y", at(260), at(260)), ("b", 1, "x", at(60), at(60)), ("b", 1, "x", at(250), at(250))}


def test_files_of_all_cores(spark, tmp_path, monkeypatch):
    """Events are written and read by as many tasks as there are cores, and give the same runs."""
    monkeypatch.setattr(queries, "new_folder", lambda spark: str(tmp_path))
    got = queries.stream_segment_runs(spark, SMALL)
    assert len(list((tmp_path / "in" / "0").glob("*.parquet"))) == spark.sparkContext.defaultParallelism
    own = segments.segments(queries.samples(spark, SMALL))
    assert got.count() == own.count()
