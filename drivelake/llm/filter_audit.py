"""Filter interaction audit: what each filter removes in every order of the filters, by the edges of their lattice."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, text_of


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


#: Conditions on the text under which a document fails; by the letter of the filter.
CONDITIONS: dict[str, Callable[[Column], Column]] = {
    "A": lambda t: F.size(_words(t)) < 100,
    "B": lambda t: 100 * F.size(F.array_distinct(_words(t))) < 80 * F.size(_words(t)),
    "C": lambda t: 100 * (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.length(t),
    "D": lambda t: t.rlike(r"[#$%&*|]"),
}
DUPLICATES = "E"
#: More filters would give more than 40,320 orders, and their steps no longer a small table.
MOST_FILTERS = 8


def failures(docs: DataFrame, conditions: dict[str, Callable[[Column], Column]] = CONDITIONS, duplicates: str | None = DUPLICATES, labels: DataFrame | None = None, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, good, toxic, n: how many documents fail just the filters in mask, a bit for each letter in order.

    A document fails `duplicates` where its text is that of a document with a lesser id. As copies fail the same conditions on
    the text, rows are counted by text before anything is compared: what is shuffled is a digest a document, a text with very
    many copies comes as one row from each task, and the least id of a text is sought among those counts."""
    letters = sorted([*conditions, *([duplicates] if duplicates else [])])
    bit = {c: 1 << i for i, c in enumerate(letters)}
    text = text_of(text_col)
    # A condition that is null doesn't fail anything.
    mask = sum((F.when(of(text), F.lit(bit[c])).otherwise(F.lit(0)) for c, of in conditions.items()), F.lit(0))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    own = own.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    if labels is None:
        own = own.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        one = labels.groupBy(F.col(id_col).alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
        own = own.join(one, "doc_id", "left").fillna(False, ["good", "toxic"])
    group = ["part", "mask", "good", "toxic"]
    if not duplicates:
        return own.groupBy(*group).agg(F.sum("n").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    per_text = own.groupBy("digest", *group).agg(F.sum("n").alias("n"), F.min(named).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("unnamed"))
    least = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passed = F.col("unnamed") + F.when(F.col("least.doc_id") == least, F.col("least.n")).otherwise(F.lit(0))
    split = per_text.withColumn("passed", passed).select(*group, F.explode(F.array(F.struct(F.lit(0).alias("more"), F.col("passed").alias("m")), F.struct(F.lit(bit[duplicates]).alias("more"), (F.col("n") - F.col("passed")).alias("m")))).alias("x"))
    return split.filter("x.m > 0").groupBy("part", (F.col("mask") + F.col("x.more")).alias("mask"), "good", "toxic").agg(F.sum("x.m").alias("n"))


def edges(counts: DataFrame, letters: str) -> DataFrame:
    """part, applied, next and what the filter `next` does to the documents of a part after the filters in `applied`: one row
    for each of the n * 2 ** (n - 1) edges of the lattice of sets of filters. Counts of failures go to each edge."""
    every = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(c).alias("next"), F.lit(1 << i).alias("bit")) for i, c in enumerate(letters) for s in range(1 << len(letters)) if not s >> i & 1))
    on = counts.select("*", F.explode(every).alias("e")).select("*", "e.*")
    open_, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda which, name: F.sum(F.when(which, F.col("n")).otherwise(F.lit(0))).alias(name)
    removed = open_ & fails
    return on.groupBy("part", "applied", "next").agg(total(open_ & ~fails, "kept"), total(removed, "removed"), total(fails & ~open_, "redundant"), total(F.col("mask") == F.col("bit"), "unique_fails"), total(removed & F.col("good"), "good_lost"), total(removed & F.col("toxic"), "toxic_lost"))


def filter_audit(docs: DataFrame, labels: DataFrame | None = None, conditions: dict[str, Callable[[Column], Column]] = CONDITIONS, duplicates: str | None = DUPLICATES, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: what each
    step of every order of the filters does to each part of docs.

    conditions maps letters to functions of the text that say whether a document fails; `duplicates` is the letter of the
    filter for texts that a document with a lesser id has, anywhere in the table, or None. Orders are paths in the lattice of
    sets of filters, so documents are counted once for each edge and the steps join those counts; shapley weighs an edge by
    the number of orders that take it. The table of steps depends on the filters alone, of which there are at most
    MOST_FILTERS (ValueError beyond).

    A null text is empty, a null part the empty text. Rows that repeat a document count each; they don't fail as duplicates of
    each other, as neither has a lesser id. A null id is neither lesser nor greater than another, so such a row never fails as
    a duplicate and never makes one. A document is good or toxic if any of its labels has a 1. A document without labels is neither.
    An empty table gives no rows; other columns are ignored under any names."""
    letters = "".join(sorted([*conditions, *([duplicates] if duplicates else [])]))
    if len(letters) > MOST_FILTERS or any(len(c) != 1 for c in conditions):
        raise ValueError(f"filters have one letter each, and there are at most {MOST_FILTERS}")
    found = edges(failures(docs, conditions, duplicates, labels, part_col, id_col, text_col), letters)
    bits = {c: 1 << i for i, c in enumerate(letters)}
    steps = [("".join(order), k + 1, sum(bits[c] for c in order[:k]), order[k]) for order in permutations(letters) for k in range(len(letters))]
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next string")
    before = F.bit_count("applied").cast("int")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(letters) - 1 - k)) for k in range(len(letters)))), before + 1)
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    weighed = found.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "next")))
    return weighed.join(F.broadcast(table), ["applied", "next"]).select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in [*counts, "shapley"]))
