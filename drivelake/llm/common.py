"""What the operators share: stored intermediate tables, null-safe columns and vectorised word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine (tests); on a cluster, where
    executors would not see it, RuntimeError."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        found = sc.getCheckpointDir()
    return found


#: For rows of megabytes: a row group ends after so few rows, as readers take up to 4096 of a row group at once, whatever their size.
LARGE_ROWS = {"parquet.block.row.count.limit": "4"}


def store(df: DataFrame, **options: str) -> str:
    """Where df has been written as Parquet, in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path


def stored(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends there, and lost executors lose nothing. With
    large_rows, memory to read it doesn't grow with the rows that a task wrote."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, **(LARGE_ROWS if large_rows else {})))


def part(column: str | Column, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many _ before each as it takes to be none of df's columns, in upper case or lower."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# Word hashes. A word's hash is a polynomial of its bytes (A-Z folded to a-z) modulo 2**64, mixed at the end, so that
# whole batches are hashed from prefix sums without making one Python object per word.

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer with well spread high and low bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _table() -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    t[65:91] = t[97:123]
    return t


_BYTES = _table()
_P, _POW, _INV = 0x5851F42D4C957F2D | 1, np.ones(1, _U), np.ones(1, _U)
IS_WORD = np.ones(256, bool)
IS_WORD[[32, *range(9, 14)]] = False
IS_LINE = np.ones(256, bool)
IS_LINE[10] = False
BLOCK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        for base, name in ((_P, "_POW"), (pow(_P, -1, 1 << 64), "_INV")):
            a = np.full(max(n, BLOCK), base, _U)
            a[0] = 1
            globals()[name] = np.cumprod(a)
    return _POW, _INV


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls as empty, and where each row starts (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked in inside, which never cross rows, and the first run of each row."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    m = inside[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    starts = m.copy()
    starts[1:] &= ~m[:-1] | first[1:-1]
    ends = m.copy()
    ends[:-1] &= ~m[1:] | first[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each run of bytes; equal runs (A-Z and a-z alike) have equal hashes."""
    out = np.empty(len(s), _U)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK, "right")))
        a, b = s[i], e[j - 1]
        power, inverse = _powers(int(b - a) + 1)
        total = np.zeros(b - a + 1, _U)
        np.cumsum(_BYTES[buf[a:b]] * power[: b - a], out=total[1:])
        x, y = s[i:j] - a, e[i:j] - a
        out[i:j] = mix((total[y] - total[x]) * inverse[x] + (y - x).astype(_U))
        i = j
    return out


def words(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and where each row's begin (one more than rows)."""
    buf, off = raw(column)
    s, e, at = spans(buf, off)
    return hashes(buf, s, e), at


def shingles(h: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's runs of n words, or of all its words where it has fewer; and where each row's begin."""
    count = np.diff(at)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(many)])
    if not to[-1]:
        return np.zeros(0, _U), to
    k = np.arange(n, dtype=np.int64)
    begin = np.repeat(at[:-1] - to[:-1], many) + np.arange(to[-1])
    size = np.repeat(np.minimum(count, n), many)
    out = size.astype(_U)
    for i in k:
        w = h[np.minimum(begin + i, len(h) - 1)]
        out = np.where(i < size, mix(out * _U(0x9E3779B97F4A7C15) + w), out)
    return out, to


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each item, from where each row's items begin."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def pieces(batch: pa.RecordBatch, text: str, most: int = 8 << 20, rows: int = 1 << 20):
    """The batch in runs of at most `rows` rows whose texts hold about `most` bytes; one longer text comes alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = min(i + rows, max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, "right"))))
        yield batch.slice(i, j - i)
        i = j


def by_key(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """function(columns as numpy arrays) -> columns by name, or None, over each group of df, as applyInPandas does, but with
    many small groups to a batch. Groups must be small enough for a task's memory."""

    def run(batches):
        rest = None
        for b in batches:
            got = b.to_pandas()
            pdf = got if rest is None or not len(rest) else pd.concat([rest, got], ignore_index=True)
            new = np.zeros(len(pdf), bool)
            new[:1] = True
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cut = np.flatnonzero(new)
            rest = pdf.iloc[cut[-1] :] if len(cut) else pdf
            yield from apply(pdf, cut)
        if rest is not None and len(rest):
            yield from apply(rest, np.array([0, len(rest)]))

    def apply(pdf: pd.DataFrame, cut: np.ndarray):
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        out = [function({c: v[i:j] for c, v in columns.items()}) for i, j in zip(cut[:-1], cut[1:])]
        out = [x for x in out if x]
        if out:
            joined = {c: np.concatenate([x[c] for x in out]) if isinstance(out[0][c], np.ndarray) else [v for x in out for v in x[c]] for c in out[0]}
            if len(next(iter(joined.values()))):
                yield pa.RecordBatch.from_pydict(joined)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
