"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_of


def mix_sources(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7, rows_per_range: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document a mix takes, so that sources meet target weights.

    Sources by code point, null last, weigh `weights` in turn and together get `share` of all words; no target is above
    `most` times its source's words, and what is over goes to the others by weight. Within a source documents are
    ordered by a SHA-256 of seed, id and text. Whole epochs take every document; in the last, unfinished epoch the
    documents before the cut are taken whole, the one at the cut in part, so that each source's total is the floor of
    its target. The prefix sums run in two steps, over ranges of the hash and within each, so no source is sorted in
    one task. Only one row per source passes through a single task.

    Returns doc_id, source, size, source_size, target, taken. A null text has size 0; equal rows are ordered by a
    count of their own, so one may be taken more often than its twin; an empty table gives no rows; other columns are
    ignored. Raises ValueError unless 0 <= share <= most.
    """
    return _taken(docs, weights, share, most, seed, rows_per_range, id_col, text_col, source_col).drop("key")


def _key(seed: int, id_col: str, text_col: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text_of(id_col), F.lit(":"), text_of(text_col)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _taken(docs: DataFrame, weights, share: float, most: float, seed: int, rows_per_range: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """mix_sources with the key that orders the rows."""
    if not 0 <= share <= most:
        raise ValueError("share must lie between 0 and most")
    key = _key(seed, id_col, text_col)
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), key.alias("key")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))

    # The targets are min(most * size, level * weight), with the level at which they add up to share of all.
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    targets = (
        per_source.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("rest", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
        .withColumn("w_rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
        .withColumn("own_level", F.col("rest") / F.col("w_rest"))
        .withColumn("level", F.max("own_level").over(every))  # it rises while sources are capped and falls afterwards
        .withColumn("target", F.least("cap", F.col("level") * F.col("w")))
        .withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_range)))
        .select("source", "source_size", "target", "ranges")
    )
    targets = stored(targets)
    # A source's row is small and there is one for each: the join is broadcast only where Spark finds it small enough.
    ranged = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select("doc_id", sized["source"], "size", "key", "source_size", "target", F.floor(F.col("key") / F.lit(float(1 << 60)) * F.col("ranges")).alias("range"))
    before = (
        ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("range").alias("r"), "before")
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    at = summed.join(before, summed["source"].eqNullSafe(before["s"]) & (summed["range"] == before["r"])).withColumn("at", F.col("inner") + F.col("before"))
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("at")))
    return at.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), taken.cast("long").alias("taken"), "key")


def mixed_documents(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7, rows_per_range: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, with the columns of docs: a row for each whole time a document is taken, and for the
    part at a source's cut a row with its first words. n_chars, where there is such a column, is that of the row's text.

    Each row of docs comes as often as mix_sources takes it; of rows with one id, text and source, the words that all of them
    are to give are dealt in any order. Rows without words are kept once. Other columns may have any names; an empty table
    gives no rows."""
    taken = _taken(docs, weights, share, most, seed, rows_per_range, id_col, text_col, source_col).groupBy("key", "source").agg(F.sum("taken").alias("total"), F.count("*").alias("twins"), F.first("size").alias("size"))
    own = docs.select(F.struct("*").alias("row"), _key(seed, id_col, text_col).alias("own_key"), F.col(source_col).cast("string").alias("own_source"))
    j = own.join(taken, (F.col("own_key") == F.col("key")) & F.col("own_source").eqNullSafe(F.col("source"))).withColumn("twin", F.row_number().over(Window.partitionBy("own_key", "own_source").orderBy(F.xxhash64("row"))))
    each = F.floor(F.col("total") / (F.col("twins") * F.col("size")))
    over = F.col("total") - each * F.col("twins") * F.col("size")
    whole = each + (F.col("twin") <= F.floor(over / F.col("size"))).cast("int")
    rest = F.when(F.col("twin") == F.floor(over / F.col("size")) + 1, over % F.col("size")).otherwise(F.lit(0))
    some = F.col("size") > 0
    cuts = F.concat(F.array_repeat(F.lit(0), F.when(some, whole).otherwise(F.lit(1)).cast("int")), F.when(some & (rest > 0), F.array(rest.cast("int"))).otherwise(F.array().cast("array<int>")))
    rows = j.select("row", F.explode(cuts).alias("words"))
    text = F.col("row").getField(text_col)
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col("words")), "")
    cut = F.when(F.col("words") > 0, first).otherwise(text)
    new = {text_col: cut, "n_chars": F.when(F.col("words") > 0, F.length(cut)).otherwise(F.col("row").getField("n_chars"))} if "n_chars" in docs.columns else {text_col: cut}
    return rows.select(*(new.get(c, F.col("row").getField(c)).cast(kind).alias(c) for c, kind in docs.dtypes))
