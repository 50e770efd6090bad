"""Exact dedup: Grace hash deduplication."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, text_of, unused

RECORD = pa.schema([("h", pa.int64()), ("sha", pa.string()), ("text", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])
FANOUT = 16


class Table:
    """An open-addressing table, with linear probing, from whole texts to their least id and number."""

    def __init__(self) -> None:
        self.slots, self.rows, self.bytes = np.full(1024, -1, np.int64), [], 0

    def add(self, h: int, sha: str, text: str, keep: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        i = h & mask
        while (k := self.slots[i]) >= 0:
            row = self.rows[k]
            if row[0] == h and row[2] == text:
                row[3] = keep if row[3] is None else row[3] if keep is None else min(row[3], keep)
                row[4] += n
                return
            i = (i + 1) & mask
        self.slots[i] = len(self.rows)
        self.rows.append([h, sha, text, keep, n])
        self.bytes += 2 * len(text) + 300
        if 3 * len(self.rows) > 2 * len(self.slots):
            self.grow()

    def grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for k, row in enumerate(self.rows):
            i = row[0] & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = k

    def batches(self, rows: list | None = None) -> Iterator[pa.RecordBatch]:
        rows = self.rows if rows is None else rows
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 1000]), RECORD)], schema=RECORD)


def _insert(table: Table, batch: pa.RecordBatch) -> None:
    for row in zip(*(c.to_pylist() for c in batch.columns)):
        table.add(*row)


def grace(batches: Iterator[pa.RecordBatch], limit: int, level: int = 0) -> Iterator[pa.RecordBatch]:
    """The distinct texts of the records with least id and number. What outgrows limit bytes goes to spill files by the
    next bits of the hash, each of which is treated alike; beyond the last bits only copies and equal hashes are left."""
    table, files = Table(), []
    with tempfile.TemporaryDirectory() as folder:

        def spill() -> None:
            if not files:
                files.extend(pa.ipc.new_file(os.path.join(folder, str(k)), RECORD, options=pa.ipc.IpcWriteOptions(compression="lz4")) for k in range(FANOUT))
            parts: list[list] = [[] for _ in files]
            for row in table.rows:
                parts[row[0] >> (60 - 4 * level) & (FANOUT - 1)].append(row)
            for f, rows in zip(files, parts):
                for b in table.batches(rows):
                    f.write_batch(b)
            table.__init__()

        for batch in batches:
            _insert(table, batch)
            if table.bytes > limit and level < 15:
                spill()
        if not files:
            yield from table.batches()
            return
        spill()
        for k, f in enumerate(files):
            f.close()
            with pa.OSFile(path := os.path.join(folder, str(k))) as source:
                reader = pa.ipc.open_file(source)
                yield from grace((reader.get_batch(i) for i in range(reader.num_record_batches)), limit, level + 1)
            os.remove(path)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (least id), group_size.

    Texts are equal when identical after each run of white space is one space; null counts as empty. Copies in one batch
    of rows are merged before the shuffle, which deals records by a hash of the text, so a text with very many copies
    costs its bucket one record a batch. Each bucket then goes through Grace hashing: an open-addressing table that
    compares complete texts, recursively partitioned to spill files in the task's temporary folder when it outgrows
    `bucket_bytes`. A task that is lost is simply run again.
    """
    norm = F.regexp_replace(text_of(text_col), WHITE, " ")
    rows = docs.select(F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("sha"), norm.alias("text"), F.col(id_col).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("n"))

    def merge(batches):
        for batch in batches:
            table = Table()
            _insert(table, batch)
            yield from table.batches()

    def dedup(batches):
        yield from grace(batches, bucket_bytes)

    schema = "h long, sha string, text string, keep_id long, n long"
    merged = rows.mapInArrow(merge, schema).repartition("h")
    return merged.mapInArrow(lambda b: (x.drop_columns(["text"]) for x in dedup(b)), "h long, sha string, keep_id long, n long").select(F.col("sha").alias("text_sha256"), "keep_id", F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the least id of each group of equal texts is kept; rows that repeat that id with the same text are
    each marked kept. Ids are integers; a null id is never the least unless all of a group are null, and is then kept.
    An empty table gives no rows; other columns are ignored. Groups come back to their rows by the SHA-256 of the text;
    a group with very many rows is split by Spark's skew join.
    """
    groups = exact_groups(docs, id_col, text_col, bucket_bytes)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.regexp_replace(text_of(text_col), WHITE, " "), 256).alias("text_sha256"))
    return own.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs, unchanged, that exact_dedup keeps; of rows that repeat id and text, one. All columns stay, whatever
    their names; an empty table gives an empty one; a null id counts as less than any other only where all of a text's are."""
    least = F.lit(-(2**63))
    keys = unused(docs, "keep_id", "keep_sha")
    kept = exact_groups(docs, id_col, text_col, bucket_bytes).select(F.coalesce("keep_id", least).alias(keys[0]), F.col("text_sha256").alias(keys[1]))
    own = docs.withColumns({keys[0]: F.coalesce(F.col(id_col).cast("long"), least), keys[1]: F.sha2(F.regexp_replace(text_of(text_col), WHITE, " "), 256)})
    return own.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
