"""Segmentation of a stream of labelled samples: runs are given out as soon as nothing can change them any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is kept of an actor: samples that may still be preceded by others, and the run that is on.
STATE = "waiting array<long>, labels array<string>, run long, label string, since long, until long, seen long"
OUT = "actor string, run long, label string, t_start long, t_end long"


def stream_segments(samples: DataFrame, delay: str, silence: str, actor: str = "actor", ts: str = "ts", label: str = "label") -> DataFrame:
    """actor, run, label, t_start, t_end (timestamps) of a stream of samples: what segments() gives for all of them.

    Samples may come in any order within `delay`; one that comes when its actor's samples of that time have been looked at, or that
    the watermark bars, is left out, and one that comes twice changes nothing. A sample waits until the watermark has passed it, so that samples are looked at in order of
    time, those of one instant in order of their labels. A run is given out when the next begins, and ends there; the last one,
    with its last sample as its end, by a timer once the watermark is `silence` past it. Then the actor is forgotten: what
    comes after a longer silence begins with run 1 again, however the samples come in. So state is bounded by the samples within `delay` and the actors within `silence`."""
    quiet = int(pd.Timedelta(silence) / pd.Timedelta("1us"))
    own = samples.select(F.coalesce(F.col(actor).cast("string"), F.lit("")).alias("actor"), F.col(ts).cast("timestamp").alias("ts"), F.col(label).cast("string").alias("label")).withWatermark("ts", delay)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, labels, run, now, since, until, seen = state.get if state.exists else ([], [], 0, None, None, None, -(2**63))
        pending = list(zip(waiting, labels))
        for f in frames:
            # An actor has few samples a batch, so that what counts is a call's own cost.
            new = zip(f["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), f["label"].tolist())
            pending += [(t, what if isinstance(what, str) else None) for t, what in new if t > seen]
        passed = state.getCurrentWatermarkMs() * 1000
        order = lambda x: (x[0], x[1] is not None, x[1] or "")  # noqa: E731  (nulls first, as in a sort)
        ready, pending = sorted((x for x in pending if x[0] <= passed), key=order), [x for x in pending if x[0] > passed]
        out = []
        for t, what in ready:
            if run and t - until > quiet:
                out.append((*key, run, now, since, until))
                run = 0
            if not run:
                run, now, since = 1, what, t
            elif what != now:
                out.append((*key, run, now, since, t))
                run, now, since = run + 1, what, t
            until = t
        if run and not pending and passed >= until + quiet:
            out.append((*key, run, now, since, until))
            state.remove()
        else:
            state.update(([t for t, _ in pending], [x for _, x in pending], run, now, since, until, passed))
            wake = min((t for t, _ in pending), default=until + quiet if run else passed)
            state.setTimeoutTimestamp(max(wake // 1000, passed // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["actor", "run", "label", "t_start", "t_end"])

    found = own.groupBy("actor").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("actor", "run", "label", *(F.timestamp_micros(c).alias(c) for c in ("t_start", "t_end")))


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now, and writes what it gives to path as Parquet. Started again with the same
    checkpoint it goes on where it ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
