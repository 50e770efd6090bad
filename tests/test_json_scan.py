"""A database file read in parallel against Python's own reader, whatever stands in its texts and however it is cut."""

import json
import random

import pytest
from pyspark.sql import functions as F

from drivelake.operators.catalog import SCHEMAS, Catalog
from drivelake.sources import json_db, json_scan

ODD = ["}", "{", '"', "\\", '\\"}', '": {', "[}]", "}}{{", "é 日本", "", 'a "b": {"c": 1}', "\n}", "\\\\", "//{"]


def database(seed, n=60):
    r = random.Random(seed)
    value = lambda d=0: r.choice([r.choice(ODD), 1.5, None, [r.choice(ODD), {}], {r.choice(ODD): r.choice(ODD)}] if d < 2 else ["x"])
    doc = lambda key: {"name": r.choice(ODD), "id": int(key), "tags": [], "conditions": {"time": r.random(), r.choice(ODD): value()}, "more": [value(), value()]}
    db = {c: {} for c in SCHEMAS}
    for _ in range(n):
        key = str(r.randrange(10**38, 10**39))
        db[r.choice(["event", "event", "model", "scenario"])][key] = doc(key)
    return db


@pytest.mark.parametrize("indent, block, n", [(None, 40, 5), (1, 1000, 60), (4, 1 << 20, 60)])
def test_entries(spark, tmp_path, indent, block, n):
    db = database(block, n)
    (tmp_path / "db.json").write_text(json.dumps(db, indent=indent, ensure_ascii=indent == 4) + ("\n" if indent else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        found, named = json_scan.entries(spark, str(tmp_path / "db.json"))
        got = {(r["collection"], r["key"]): json.loads(r["doc"]) for r in found.collect()}
        assert [r["collection"] for r in named.orderBy("n").collect()] == list(db)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(c, k): v for c, docs in db.items() for k, v in docs.items()}


def test_load(spark, tmp_path):
    """Equal to read_db, ids of 39 digits too; what is missing raises."""
    (tmp_path / "db.json").write_text(json.dumps(database(9)))
    a, b = json_scan.load_json_db(spark, str(tmp_path / "db.json")), json_db.read_db(spark, str(tmp_path / "db.json"))
    plain = lambda v: json.loads(v) if v and v[0] == "{" and v[-1] == "}" and v[1] in '"}' else v
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df.select(*(F.col(c).cast("string") for c in df.columns)).collect())
    for c in SCHEMAS:
        assert rows(a[c]) == rows(b[c])
    assert all(len(r["uid"]) == 39 for r in a["event"].collect())
    (tmp_path / "bad.json").write_text('{"actor": {}, "event": {"1": {"name": "model", "id": 1, "tags": []}}}')
    with pytest.raises(KeyError):
        json_scan.load_json_db(spark, str(tmp_path / "bad.json"))


def test_write(spark, tmp_path):
    """One file that any JSON reader reads, and both of ours."""
    (tmp_path / "db.json").write_text(json.dumps(database(4)))
    c = json_db.read_db(spark, str(tmp_path / "db.json"))
    json_scan.write_json_db(c, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    plain = json.loads(file.read_text())
    assert {k: len(v) for k, v in plain.items()} == {r: c[r].count() for r in SCHEMAS}
    assert {r["uid"] for r in json_scan.load_json_db(spark, str(tmp_path / "out"))["event"].collect()} == set(plain["event"])
    json_scan.write_json_db(Catalog.empty(spark), str(tmp_path / "none"))
    assert json_scan.load_json_db(spark, str(tmp_path / "none")).counts().collect() == []
