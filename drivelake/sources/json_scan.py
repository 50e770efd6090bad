"""One large JSON database file read and written in parallel: entries found by prefix sums over its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.catalog import SCHEMAS, Catalog
from .json_db import DOCUMENTS, document, parse
from .staging import staged


def _before(df: DataFrame, **sums: Column) -> DataFrame:
    """df (block, i) with the sum of each column over all rows before a row: those of its own block, and those of earlier blocks,
    of which there is one row each."""
    own = df.withColumns({f"_{name}": c for name, c in sums.items()})
    in_block = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("block").agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums)).select("block", *(F.coalesce(F.sum(f"_{name}").over(blocks), F.lit(0)).alias(f"_all_{name}") for name in sums))
    own = own.withColumns({f"_in_{name}": F.coalesce(F.sum(f"_{name}").over(in_block), F.lit(0)) for name in sums}).join(F.broadcast(totals), "block")
    return own.withColumns({name: F.col(f"_in_{name}") + F.col(f"_all_{name}") for name in sums}).drop(*(f"{p}{name}" for name in sums for p in ("_", "_in_", "_all_")))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The entries of a database file, one JSON object of collections, as collection, key, doc; and its collections, empty ones
    too, as collection, n (their place).

    Spark's text reader cuts the file at every closing brace, in as many tasks as it has blocks, and wherever its file systems
    reach. Whether a piece begins within a string depends on the number of quotes before it, how deep it lies on the braces
    outside of strings before it, and which entry it belongs to on how many ended before it. These are prefix sums: over each
    block in a task, and over the blocks' totals, a row each. An entry's pieces then meet by its number. Keys are read as text
    and have no escapes."""
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    # Without escapes a quote begins or ends a string.
    clean = F.regexp_replace("value", r"\\.", "")
    rows = staged(raw.withColumn("clean", clean).withColumn("quotes", _count(F.col("clean"), '"').cast("long")))
    rows = _before(rows, inside=F.col("quotes")).withColumns({"inside": F.col("inside") % 2 == 1, "left_inside": (F.col("inside") + F.col("quotes")) % 2 == 1})
    bare = F.regexp_replace(F.when(F.col("inside"), F.regexp_replace("clean", '^[^"]*("|$)', "")).otherwise(F.col("clean")), '"[^"]*("|$)', "")
    rows = rows.withColumns({"opens": _count(bare, "{").cast("long"), "closes": F.when(F.col("left_inside"), 0).otherwise(1).cast("long")})
    rows = staged(_before(rows, depth=F.col("opens") - F.col("closes")).withColumn("after", F.col("depth") + F.col("opens") - F.col("closes")).select("block", "i", "value", "depth", "after", "opens", "closes"))
    opened = (F.col("depth") <= 1) & (F.col("depth") + F.col("opens") >= 2)
    rows = _before(rows, entry=((F.col("closes") == 1) & (F.col("after") == 2)).cast("long"), n=opened.cast("long")).withColumn("n", F.col("n") + opened.cast("long"))
    named = rows.filter(opened).select("n", F.regexp_extract("value", r'"([^"]*)"\s*:\s*\{', 1).alias("collection"))
    text = F.when(opened, F.regexp_replace("value", r'^[^"]*"[^"]*"\s*:\s*\{', "")).otherwise(F.col("value"))
    piece = rows.filter("after >= 2").groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("block", "i", F.concat(text, F.lit("}")).alias("text")))).alias("pieces"), F.max("n").alias("n"))
    whole = piece.select("n", F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("text"))
    key, doc = F.regexp_extract("text", r'^[\s,]*"([^"]*)"', 1), F.regexp_replace("text", r'^[\s,]*"[^"]*"\s*:\s*', "")
    return whole.join(F.broadcast(named), "n").select("collection", key.alias("key"), doc.alias("doc")), named


def load_json_db(spark: SparkSession, path: str) -> Catalog:
    """The catalog in one database file, as read_db gives it, whatever the file's size: its entries are found in parallel and
    written once, by collection. A file without one of the ten collections raises KeyError."""
    found, named = entries(spark, path)
    there = {r["collection"] for r in named.filter(F.col("collection").isin(list(SCHEMAS))).select("collection").distinct().collect()}  # ten at most
    if gone := [c for c in SCHEMAS if c not in there]:
        raise KeyError(gone[0])
    found = staged(found.filter(F.col("collection").isin(list(DOCUMENTS))), "collection")
    return Catalog({c: parse(found.filter(F.col("collection") == c), c) for c in SCHEMAS})


def write_json_db(catalog: Catalog, path: str) -> None:
    """The catalog as one JSON object, in the one file that the folder `path` then has beside the mark of its commit.

    Documents are made where they lie; only their texts go to the one task that writes, which sorts them with spills."""
    every = first = None
    for k, c in enumerate(SCHEMAS):
        least = catalog[c].agg(F.lit(k).alias("_k"), F.min("uid").alias("_first"))
        first = least if first is None else first.unionByName(least)
        docs = document(catalog, c).select(F.lit(k).alias("k"), F.lit(1).alias("part"), "uid", F.concat(F.lit('"'), "uid", F.lit('": '), "doc").alias("text"))
        every = docs if every is None else every.unionByName(docs)
    lines = every.join(F.broadcast(first), F.col("k") == F.col("_k")).select("k", "part", "uid", F.concat(F.when(F.col("uid") == F.col("_first"), "").otherwise(","), "text").alias("value"))
    heads = [(k, 0, "", ("{" if not k else "},") + f'"{c}": {{') for k, c in enumerate(SCHEMAS)] + [(len(SCHEMAS), 0, "", "}}")]
    lines = lines.unionByName(catalog["scenario"].sparkSession.createDataFrame(heads, "k int, part int, uid string, value string"))
    lines.repartition(1).sortWithinPartitions("k", "part", "uid").select("value").write.text(path)
