"""Line dedup: a suffix array over line ids by distributed prefix doubling, and the repeated runs that its intervals show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, store, stored, text_of


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, p, id, words, i, at of each line that isn't blank: row tells texts apart, p is the line's place in its
    text, i that among the lines that aren't blank, id a 64-bit hash of it, at the words before it. Equal rows give one."""
    lines = F.split(text_of(text_col), "\n", -1)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("string"), text_of(text_col)).alias("row"), F.posexplode(lines).alias("p", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    own = own.select("doc_id", "row", "p", F.xxhash64("line").alias("id"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")).dropDuplicates(["row", "p"])
    in_text = Window.partitionBy("row").orderBy("p")
    before = in_text.rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumns({"i": F.row_number().over(in_text) - 1, "at": F.coalesce(F.sum("words").over(before), F.lit(0))})


def first_ranks(lines: DataFrame, ids_per_range: int = 20_000) -> DataFrame:
    """row, i, r, left, open of the lines that occur again: r is one more than the number of such lines with a lesser id, left
    the number of them in a row from there on. The sums run over ranges of the id, of about ids_per_range ids, and within
    each."""
    n = stored(lines.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"))
    ranges = max(1, (n.count() // ids_per_range).bit_length())
    n = n.withColumn("range", F.shiftright("id", 64 - ranges))
    within = Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = n.groupBy("range").agg(F.sum("n").alias("m")).select("range", F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = n.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, "range").select("id", (1 + F.col("before") + F.col("inner")).alias("r"))
    own = lines.join(ranked, "id").select("row", F.col("i").cast("long").alias("i"), "r")
    gap = F.col("i") - F.row_number().over(Window.partitionBy("row").orderBy("i"))
    left = F.max("i").over(Window.partitionBy("row", "gap")) - F.col("i") + 1
    return own.withColumn("gap", gap).select("row", "i", "r", left.alias("left"), F.lit(True).alias("open"))


def doubled(level: DataFrame, h: int, ranks_per_range: int = 20_000) -> DataFrame:
    """The ranks of suffixes by their first 2h lines from those by their first h: suffixes of one rank are sorted by the rank
    that stands h lines further on, 0 where no line that occurs again is there. A rank is one more than the number of
    lesser suffixes, so what no other suffix shares keeps its place; open says that others share the rank and that all its
    2h lines occur again. Equal pairs of ranks are counted before they are sorted, over ranges of the second rank and
    within each, so that a line that many texts have is sorted by what follows it, not by its places."""
    x, y = level.filter("open").alias("x"), level.alias("y")
    pairs = stored(x.join(y, (F.col("x.row") == F.col("y.row")) & (F.col("x.i") + h == F.col("y.i")), "left").select("x.row", "x.i", "x.r", "x.left", F.coalesce("y.r", F.lit(0)).alias("r2")))
    n = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("r2") / ranks_per_range))
    above = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = n.groupBy("r", "range").agg(F.sum("n").alias("m")).select("r", "range", F.coalesce(F.sum("m").over(above("r", "range")), F.lit(0)).alias("before"))
    ranked = n.withColumn("inner", F.coalesce(F.sum("n").over(above("r", "range", "r2")), F.lit(0))).join(before, ["r", "range"])
    ranked = ranked.select("r", "r2", (F.col("r") + F.col("before") + F.col("inner")).alias("to"), (F.col("n") > 1).alias("shared"))
    return pairs.join(ranked, ["r", "r2"]).select("row", "i", F.col("to").alias("r"), "left", (F.col("shared") & (F.col("left") >= 2 * h)).alias("open")).unionByName(level.filter("not open"))


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, row, a, b: for each line the shortest run [a, b) of at least min_words words that begins with it, and the
    shortest that ends with it where that is another. As each line has a word, none is longer than min_words lines."""
    ended = lines.withColumn("until", F.col("at") + F.col("words"))
    on, back = Window.partitionBy("row").orderBy("at").rangeBetween(0, min_words - 1), Window.partitionBy("row").orderBy("until").rangeBetween(1 - min_words, 0)
    frames = ended.withColumns({"n": F.count("*").over(on), "to": F.max("until").over(on), "m": F.count("*").over(back), "since": F.min("at").over(back)})
    begun = F.when(F.col("to") - F.col("at") >= min_words, F.struct(F.col("i").alias("a"), (F.col("i") + F.col("n")).alias("b")))
    # One that is long enough without its last line isn't the shortest from where it begins.
    closed = F.when(F.col("at") - F.col("since") >= min_words, F.struct((F.col("i") + 1 - F.col("m")).alias("a"), (F.col("i") + 1).alias("b")))
    return frames.select("doc_id", "row", F.explode(F.array_compact(F.array(begun, closed))).alias("run")).select("doc_id", "row", F.col("run.a").cast("long").alias("a"), F.col("run.b").cast("long").alias("b"))


def suffix_ranks(lines: DataFrame, depth: int) -> list[tuple[int, DataFrame]]:
    """h and the ranks (row, i, r, open) of suffixes by their first h lines, for h = 1, 2, 4, ... up to depth, or until no
    rank is open. The last ones are the suffix array of the lines that occur again, inverted and sorted to that depth:
    r is a suffix's place in it, and equal suffixes share the first of their places."""
    out, h = [(1, stored(first_ranks(lines)))], 1
    while 2 * h <= depth and not out[-1][1].filter("open").isEmpty():
        out.append((2 * h, stored(doubled(out[-1][1], h))))
        h *= 2
    return out


def repeated_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", lines: DataFrame | None = None) -> DataFrame:
    """row, i of every line that lies in a later copy of a run of lines with at least min_words words.

    The suffix array over line ids comes from distributed prefix doubling (suffix_ranks). The longest common prefix of two
    suffixes has n lines or more, h <= n < 2h, just where they agree in the ranks by h lines of their beginnings and of the
    places n - h further on, so an interval of the array with that common prefix is known by n and these two ranks. Intervals
    are asked for the shortest runs of min_words words that begin or end with a line; of each interval the first place
    stays and the runs at all others are removed, but for lines of the first place itself, which a copy that overlaps it has:
    of one line ten times over as many stay as make a run. These cover every longer run with an earlier place: the shortest
    one from its first line, and for each line after that the shortest one that ends with it, lie in it and have first places
    that end no later. So their union is that of the intervals from each start over its longest common prefix with any earlier
    place, and doubling ends at min_words lines. An earlier place is one with a lesser id, or in the same text further up.
    """
    lines = stored(line_table(docs, id_col, text_col)) if lines is None else lines
    runs = stored(shortest_runs(lines, max(min_words, 1)))
    size = F.col("b") - F.col("a")
    longest = runs.agg(F.max(size)).first()[0] or 0
    if not longest:
        return lines.select("row", "i").limit(0)
    named = []
    for h, level in suffix_ranks(lines, longest):
        x, y = (level.filter("open").alias(k) for k in "xy")
        own = runs.filter((size >= h) & (size < 2 * h)).alias("own")
        own = own.join(x, (F.col("own.row") == F.col("x.row")) & (F.col("own.a") == F.col("x.i"))).join(y, (F.col("own.row") == F.col("y.row")) & (F.col("own.b") - h == F.col("y.i")))
        named.append(store(own.select("own.doc_id", "own.row", "own.a", "own.b", size.alias("n"), F.col("x.r").alias("head"), F.col("y.r").alias("tail"))))
    every = docs.sparkSession.read.schema("doc_id long, row long, a long, b long, n long, head long, tail long").parquet(*named)
    interval = ["n", "head", "tail"]
    first = every.groupBy(*interval).agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "row", "a")).alias("first")).filter("m > 1").drop("m")
    ended = F.when(F.col("first.row") == F.col("row"), F.col("first.a") + F.col("n")).otherwise(F.lit(0))
    later = every.join(first, interval).withColumn("a", F.greatest("a", ended)).filter("a < b")
    by = Window.partitionBy("row").orderBy("a", "b")
    gap = F.coalesce(F.col("a") > F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = later.select("row", "a", "b", gap.cast("long").alias("gap")).withColumn("island", F.sum("gap").over(by)).groupBy("row", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return islands.select("row", F.explode(F.sequence("a", F.col("b") - 1)).alias("i"))


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, n_words, words_removed, text for each row of docs: the text without the lines that
    lie in later copies of repeated runs (see repeated_lines); blank lines stay.

    A null text is empty, and has no lines; equal rows lose the same lines, none to each other; copies that overlap the first place lose only what lies beyond it; an empty table gives no
    rows; other columns are ignored; a very long text is one row per line throughout. Only DataFrame functions run.
    """
    lines = stored(line_table(docs, id_col, text_col))
    gone = repeated_lines(docs, min_words, id_col, text_col, lines).select("row", "i", F.lit(True).alias("gone"))
    per_row = lines.join(gone, ["row", "i"], "left").groupBy("row").agg(F.count("*").alias("n_lines"), F.count("gone").alias("n_removed"), F.sum("words").alias("n_words"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("words"))), F.lit(0)).alias("words_removed"), F.collect_list(F.when(F.col("gone"), F.col("p"))).alias("which"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_of(text_col)).alias("row"))
    j = own.join(per_row, "row", "left")
    parts = F.split("text", "\n", -1)
    # The places that stay, in order; array_except looks them up by hash, so that a long text costs no more than its length.
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "which")
    without = F.array_join(F.transform(stay, lambda p: F.element_at(parts, p + 1)), "\n")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    kept = F.when(F.coalesce(F.col("n_removed"), F.lit(0)) == 0, F.col("text")).otherwise(without)
    return j.select("doc_id", zero("n_lines"), zero("n_removed"), zero("n_words"), zero("words_removed"), kept.alias("text"))
