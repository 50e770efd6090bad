"""Segmentation of labelled signals into activities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def change_points(samples: DataFrame, actor: str = "actor", t: str = "t", label: str = "label") -> DataFrame:
    """The samples where an actor's label differs from the one before; the first always does. Samples of one instant come in
    order of their labels."""
    w = Window.partitionBy(actor).orderBy(t, label)
    return samples.withColumn("_i", F.row_number().over(w)).withColumn("_p", F.lag(label).over(w)).filter((F.col("_i") == 1) | ~F.col("_p").eqNullSafe(F.col(label))).drop("_i", "_p")


def segments(samples: DataFrame, actor: str = "actor", t: str = "t", label: str = "label") -> DataFrame:
    """actor, run, label, t_start, t_end: runs of equal labels. A run ends where the next starts, the last at the last
    sample, so that neighbours share an instant."""
    last = samples.groupBy(actor).agg(F.max(t).alias("_last"))
    w = Window.partitionBy(actor).orderBy(t, label)
    starts = change_points(samples, actor, t, label).join(last, actor)
    return starts.select(actor, F.row_number().over(w).alias("run"), label, F.col(t).alias("t_start"), F.coalesce(F.lead(t).over(w), F.col("_last")).alias("t_end"))


def samples_in(samples: DataFrame, runs: DataFrame, actor: str = "actor", t: str = "t") -> DataFrame:
    """Each sample with every run of its actor that holds its instant, both ends included, for any runs (see in_runs for
    the samples' own)."""
    r = runs.select(F.col(actor).alias("_actor"), "run", F.col("label").alias("run_label"), "t_start", "t_end")
    return at_instants(samples.withColumns({"_actor": F.col(actor), "_t": F.col(t)}), r, ["_actor"], "_t", how="inner").drop("_actor", "_t")


def at_instants(instants: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str = "t_start", end: str = "t_end", how: str = "left") -> DataFrame:
    """instants joined with the intervals of equal keys that hold them, both ends included; with how="left" an instant that none
    holds stays, once or more often, with nulls. The two frames share no other column names.

    Time is cut dyadically: an interval belongs to the least level whose pieces, of length 2 ** level, are no shorter than it, and so
    touches two of them at most; an instant meets one piece of each level that its keys have. Very long and very short intervals
    don't get in each other's way, nothing has to be known of their lengths, and a piece holds no more intervals than overlap
    within twice their length."""
    length = F.col(end) - F.col(start)
    level = F.greatest(F.coalesce(F.ceil(F.log2(F.when(length > 0, length))), F.lit(LEAST_LEVEL)), F.lit(LEAST_LEVEL)).cast("int")
    piece = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
    known = intervals.filter(F.col(start) <= F.col(end)).withColumn("_level", level)
    levels = known.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    own = known.select("*", F.explode(F.sequence(piece(start), piece(end))).alias("_piece")).alias("own")
    asked = instants.join(levels, keys, how).withColumn("_level", F.explode_outer("_levels")).drop("_levels").withColumn("_piece", piece(t)).alias("asked")
    by = [*keys, "_level", "_piece"]
    on = [F.col(f"asked.{k}") == F.col(f"own.{k}") for k in by] + [F.col(f"asked.{t}").between(F.col(f"own.{start}"), F.col(f"own.{end}"))]
    return asked.join(own, on, how).select("asked.*", *(F.col(f"own.{c}") for c in intervals.columns if c not in keys)).drop("_level", "_piece")


#: The level of pieces of about a millionth of a second; shorter intervals are of this level too.
LEAST_LEVEL = -20


def in_runs(samples: DataFrame, actor: str = "actor", t: str = "t", label: str = "label") -> DataFrame:
    """samples with run, run_label, t_start and t_end: each sample in its run, and those at a run's first instant also in the
    run before, which ends there. Samples of one instant come in order of their labels. One sort of an actor's samples and no
    join, so that an actor must fit a task; see in_runs_ranged for others."""
    w = Window.partitionBy(actor).orderBy(t, label)
    sofar, later = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    marked = samples.withColumns({"_i": F.row_number().over(w), "_p": F.lag(label).over(w), "_last": F.max(t).over(Window.partitionBy(actor))})
    marked = marked.withColumn("_new", (F.col("_i") == 1) | ~F.col("_p").eqNullSafe(F.col(label)))
    starts = F.when(F.col("_new"), F.col(t))
    runs = marked.withColumns({"_run": F.sum(F.col("_new").cast("int")).over(sofar), "_from": F.max(starts).over(sofar), "_to": F.coalesce(F.min(starts).over(later), F.col("_last"))})
    runs = runs.withColumn("_lag", F.lag("_from").over(w)).withColumn("_b", F.last(F.when(F.col("_new"), F.struct(F.col("_p").alias("label"), F.col("_lag").alias("since"))), ignorenulls=True).over(sofar))
    return _in_both(runs.select(*samples.columns, "_run", "_from", "_to", F.col("_b.label").alias("_before"), F.col("_b.since").alias("_since")), samples.columns, t, label)


def _in_both(runs: DataFrame, columns: list[str], t: str, label: str) -> DataFrame:
    """Each sample in its run, and at the run's first instant also in the run before: _run, _from, _to, _before, _since."""
    own = F.struct(F.col("_run").alias("run"), F.col(label).alias("run_label"), F.col("_from").alias("t_start"), F.col("_to").alias("t_end"))
    ended = F.when((F.col("_run") > 1) & (F.col(t) == F.col("_from")), F.struct((F.col("_run") - 1).alias("run"), F.col("_before").alias("run_label"), F.col("_since").alias("t_start"), F.col("_from").alias("t_end")))
    return runs.withColumn("_r", F.explode(F.array_compact(F.array(own, ended)))).select(*columns, "_r.*")


def in_runs_ranged(samples: DataFrame, ranges: int, actor: str = "actor", t: str = "t", label: str = "label") -> DataFrame:
    """As in_runs, where an actor may have more samples than a task can hold: a scan in two levels.

    Samples are sorted into `ranges` ranges of actor, instant and label, each of which a task scans on its own; what it knows is
    written, as the ranges are drawn only once. Only the first and the last actor of a range can go on in others. The ranges
    of such an actor, a row each, are scanned in turn for what a range must know of those before and after: how many runs
    there were, since when the last one lasts, which was before it, and when the next begins. These rows, two a range at
    most, go to all tasks."""
    kinds = dict(samples.dtypes)
    columns = samples.columns
    rest = F.xxhash64(*(c for c in columns if c not in (actor, t, label))) if len(columns) > 3 else F.lit(0)
    ordered = samples.withColumn("_rest", rest).repartitionByRange(ranges, actor, t, label, "_rest").sortWithinPartitions(actor, t, label, "_rest").drop("_rest")
    more = f"_run long, _from {kinds[t]}, _to {kinds[t]}, _before {kinds[label]}, _since {kinds[t]}, _edge boolean, _i long"
    schema = ", ".join([*(f"`{c}` {k}" for c, k in samples.dtypes), more])
    found = staged(ordered.mapInArrow(_scan(actor, t, label), schema).withColumn("_part", F.spark_partition_id()))
    at = lambda c, f: f(c, "_i")
    edges = found.filter("_edge").groupBy("_part", actor).agg(
        at(F.col(label), F.min_by).alias("first_label"), at(F.col(label), F.max_by).alias("last_label"), at(F.col(t), F.min_by).alias("first_t"), at(F.col(t), F.max_by).alias("last_t"),
        F.max("_run").alias("runs"), at(F.col("_from"), F.max_by).alias("last_from"), F.min(F.when(F.col("_run") == 2, F.col("_from"))).alias("second_from"), at(F.col("_before"), F.max_by).alias("before"), at(F.col("_since"), F.max_by).alias("since"),
    )
    fixed = edges.groupBy(actor).applyInPandas(_across(actor), f"_part int, `{actor}` {kinds[actor]}, offset long, joined boolean, carried {kinds[t]}, before {kinds[label]}, since {kinds[t]}, next {kinds[t]}")
    fixed = fixed.select(F.col("_part").alias("_p"), F.col(actor).alias("_a"), *(F.col(c).alias(f"_{c}_") for c in ("offset", "joined", "carried", "before", "since", "next")))
    own = found.join(F.broadcast(fixed), (F.col("_part") == F.col("_p")) & F.col(actor).eqNullSafe(F.col("_a")), "left")
    one, two = F.col("_run") == 1, (F.col("_run") == 2) & F.coalesce("_joined_", F.lit(False))
    first = one & F.coalesce("_joined_", F.lit(False))
    out = own.select(
        *columns, (F.col("_run") + F.coalesce("_offset_", F.lit(0))).alias("_run"), F.when(first, F.col("_carried_")).otherwise(F.col("_from")).alias("_from"), F.coalesce("_to", "_next_").alias("_to"),
        F.when(one, F.col("_before_")).otherwise(F.col("_before")).alias("_before"), F.when(one, F.col("_since_")).when(two, F.col("_carried_")).otherwise(F.col("_since")).alias("_since"),
    )
    return _in_both(out, columns, t, label)


def _scan(actor: str, t: str, label: str):
    """A range's samples, in order, with the numbers and bounds of their runs as far as the range itself shows them."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        who, what = (pd.factorize(table[c].to_pandas(), use_na_sentinel=True)[0] for c in (actor, label))
        n = len(who)
        begins = np.r_[True, who[1:] != who[:-1]]
        starts = np.flatnonzero(begins | np.r_[True, what[1:] != what[:-1]])
        number = np.searchsorted(starts, np.arange(n), "right") - 1  # of the run, in the range
        first = number[np.flatnonzero(begins)]  # each actor's first run
        turn = np.cumsum(begins) - 1  # of the actor
        last = np.r_[first[1:], len(starts)] - 1
        ends = np.r_[np.flatnonzero(begins)[1:], n] - 1  # each actor's last sample
        edge = (turn == 0) | (turn == turn[-1])
        final = number == last[turn]
        pick = lambda column, at, ok: table[column].combine_chunks().take(pa.array(at, mask=~ok))
        following = np.where(final, ends[turn], starts[np.minimum(number + 1, len(starts) - 1)])
        earlier = starts[np.maximum(number - 1, 0)]
        more = number > first[turn]
        every = np.ones(n, bool)
        new = [pa.array(number - first[turn] + 1), pick(t, starts[number], every), pick(t, following, ~(final & edge)), pick(label, earlier, more), pick(t, earlier, more), pa.array(edge), pa.array(np.arange(n))]
        for name, column in zip(("_run", "_from", "_to", "_before", "_since", "_edge", "_i"), new):
            table = table.append_column(name, column)
        yield from table.to_batches(max_chunksize=50_000)

    return run


def _across(actor: str):
    """For each range of one actor what it must know of the others, from a row for each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_part").to_dict("records")
        same = lambda a, b: a == b or (pd.isna(a) and pd.isna(b))
        out, runs, start, last, before = [], 0, None, None, (None, None)
        for k, r in enumerate(rows):
            joined = k > 0 and same(r["first_label"], last)
            carried = start if joined else r["first_t"]
            previous = before if joined else (last, start)  # of the run that is on as the range begins
            out.append({"_part": r["_part"], actor: r[actor], "offset": runs - joined, "joined": joined, "carried": carried, "before": previous[0], "since": previous[1], "next": None})
            runs += r["runs"] - joined
            if r["runs"] > 1:
                before = r["before"], carried if r["runs"] == 2 else r["since"]
                start = r["last_from"]
            else:
                before, start = previous, carried
            last = r["last_label"]
        next_start = rows[-1]["last_t"]
        for k in range(len(rows) - 1, -1, -1):
            out[k]["next"] = next_start
            if not out[k]["joined"]:
                next_start = rows[k]["first_t"]
            if out[k]["joined"] and rows[k]["runs"] > 1:
                next_start = rows[k]["second_from"]
        return pd.DataFrame(out)

    return run


def adjacent(runs: DataFrame, actor: str = "actor") -> DataFrame:
    """Pairs of runs of an actor where the second starts as the first ends."""
    a, b = runs.alias("a"), runs.alias("b")
    return a.join(b, (F.col(f"a.{actor}") == F.col(f"b.{actor}")) & (F.col("a.t_end") == F.col("b.t_start")) & (F.col("a.run") < F.col("b.run"))).select(F.col(f"a.{actor}").alias(actor), F.col("a.run").alias("run"), F.col("b.run").alias("next_run"))
