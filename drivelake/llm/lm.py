"""Language-model scoring: a log-frequency Bloom filter of quantised bigram counts beside exact word counts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, part, pieces, stored, words

_U = np.uint64
END = mix(np.array([0xE2D], _U))[0]
BASE, PROBES, BITS = 1.5, 5, 12


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every text's word hashes and then END, and where each text's begin."""
    h, at = words(column)
    n = len(at) - 1
    to = at + np.arange(n + 1)
    out = np.full(len(h) + n, END, _U)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(at))] = h
    return out, to


def pairs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; before a text's first token stands END."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = END
    return mix(before * _U(0x9E3779B97F4A7C15) + h)


def quantised(c: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(c) / math.log(BASE) + 1e-9)).astype(np.int64)


def expected(q: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 for none."""
    return np.where(q > 0, (np.ceil(BASE ** (q - 1.0) - 1e-9) + np.ceil(BASE**q - 1e-9) - 1) / 2, 0.0)


def _places(h: np.ndarray, level: int, probe: int, m: np.ndarray) -> np.ndarray:
    return (mix(h + _U((level * 0x9E3779B97F4A7C15 + probe * 0xD1B54A32D192ED03) & (2**64 - 1))) % m).astype(np.int64)


def filter_of(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The bits, as bytes, of a Bloom filter that holds (h, 1) to (h, quantised count) for each h."""
    q = quantised(c)
    m = max(64, -(-int(q.sum()) * BITS // 64) * 64)
    bits = np.zeros(m, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        own = h[q >= level]
        for i in range(PROBES):
            bits[_places(own, level, i, _U(m))] = True
    return np.packbits(bits, bitorder="little")


class Pack:
    """Word counts and filter segments of some shards; a shard is a value of a hash's leading bits."""

    def __init__(self, rows: Iterable[tuple[int, int, bytes, bytes]], bits: int) -> None:
        rows = sorted(rows, key=lambda r: r[:2])
        self.bits = bits
        self.h = np.concatenate([np.zeros(0, _U), *(np.frombuffer(r[2], _U) for r in rows if r[0] == 1)])
        self.c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[3], np.int64) for r in rows if r[0] == 1)])
        if len(self.c) and self.c.max() < 2**31:
            self.c = self.c.astype(np.int32)
        self.m, self.base, self.seg = np.zeros(1 << bits, _U), np.zeros(1 << bits, np.int64), []
        at = 0
        for kind, shard, seg, _ in rows:
            if kind == 2:
                self.m[shard], self.base[shard] = len(seg) * 8, at
                self.seg.append(np.frombuffer(seg, np.uint8))
                at += len(seg) * 8
        self.seg = np.concatenate([np.zeros(0, np.uint8), *self.seg])

    def counts(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        u, inverse = np.unique(h, return_inverse=True)
        i = np.minimum(np.searchsorted(self.h, u), len(self.h) - 1)
        return np.where(self.h[i] == u, self.c[i], 0).astype(np.int64)[inverse]

    def levels(self, h: np.ndarray) -> np.ndarray:
        """How many levels of each hash the filter holds, from repeated probes."""
        out = np.zeros(len(h), np.int64)
        shard = (h >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        live = np.flatnonzero(self.m[shard] > 0)
        level = 1
        while len(live):
            for i in range(PROBES):
                s = shard[live]
                p = self.base[s] + _places(h[live], level, i, self.m[s])
                live = live[(self.seg[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0]
            out[live] = level
            level += 1
        return out


class Counter:
    """Sums counts of hashes, in sorted arrays."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, h: np.ndarray) -> bool:
        self.held.append(np.unique(h, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > self.most:
            self.held = [merged(self.held)]
            self.size = len(self.held[0][0])
        return 2 * self.size > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        h, c = merged(self.held)
        self.held, self.size = [], 0
        return h, c


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h, c = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


COUNTS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("h", pa.binary()), ("c", pa.binary())])


def tables(train: DataFrame, text_col: str, min_pair: int = 1, shard_chars: int = 16_000_000) -> tuple[DataFrame, int]:
    """The model's shards, written: kind 1, word hashes and counts; kind 2, filter segments over the pairs seen at least
    min_pair times. Tasks count their own rows first; what they found is shuffled in blocks, one for each shard."""
    chars = train.agg(F.sum(F.length(text_col))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, chars / shard_chars))))

    def blocks(kind: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        cut = np.searchsorted(h, np.arange(1 << bits, dtype=_U) << _U(64 - bits)) if bits else np.zeros(1, np.int64)
        cut = np.concatenate([cut, [len(h)]])
        rows = [(kind, k, h[a:b].tobytes(), c[a:b].astype(np.int64).tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return pa.RecordBatch.from_pylist([dict(zip(COUNTS.names, r)) for r in rows], schema=COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {1: Counter(), 2: Counter()}
        for b in batches:
            for x in pieces(b, "text", 4 << 20):
                h, at = sequence(x.column(0))
                for kind, v in ((1, h), (2, pairs(h, at))):
                    if held[kind].add(v):
                        yield blocks(kind, *held[kind].take())
        for kind in held:
            yield blocks(kind, *held[kind].take())

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        h, c = merged([(np.frombuffer(a, _U), np.frombuffer(b, np.int64)) for a, b in zip(pdf["h"], pdf["c"])])
        kind, shard = int(pdf["kind"].iloc[0]), int(pdf["shard"].iloc[0])
        if kind == 1:
            return pd.DataFrame([(kind, shard, h.tobytes(), c.tobytes(), len(h), int(c.sum()))], columns=["kind", "shard", "h", "c", "n", "total"])
        seg = filter_of(h[c >= min_pair], c[c >= min_pair])
        return pd.DataFrame([(kind, shard, seg.tobytes(), b"", int((c >= min_pair).sum()), int(c.sum()))], columns=["kind", "shard", "h", "c", "n", "total"])

    rows = train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "kind int, shard int, h binary, c binary")
    return stored(rows.groupBy("kind", "shard").applyInPandas(reduce, "kind int, shard int, h binary, c binary, n long, total long")), bits


def packs(shards: DataFrame, limit: int) -> list[list[int]]:
    """Runs of shards whose tables hold at most `limit` bytes together (or one shard, which is bounded by its making)."""
    sizes = shards.groupBy("shard").agg(F.sum(F.length("h") + F.length("c")).alias("bytes")).orderBy("shard").collect()  # a short row per shard
    out, held = [[]], 0
    for shard, size in sizes:
        if out[-1] and held + size > limit:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += size
    return out


def score_texts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 256 << 20, prior: float = 20.0, min_pair: int = 1, shard_chars: int = 16_000_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs, by counts of train.

    Tokens are the words, A-Z folded, and one end. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))). score is the
    log10 probability under a bigram model: (c2 + prior * p) / (c1 + prior), where p is a token's base probability, c1
    the exact count of the token before it (the end before a text's first) and c2 the count of the pair as the
    log-frequency Bloom filter tells it. Hashes have 64 bits; words that share one would count as one. The tables are
    broadcast where they hold at most `limit` bytes; beyond that, packs of shards of at most that size are broadcast one
    after another, and each pass adds the counts that its shards hold. A null text is empty; with an empty train, N and
    V are 0; an empty table gives no rows; other columns are ignored.
    """
    shards, bits = tables(train, text_col, min_pair, shard_chars)
    total = {r["kind"]: r for r in shards.groupBy("kind").agg(F.sum("n").alias("v"), F.sum("total").alias("n")).collect()}
    n_train, v_train = (total[1]["n"], total[1]["v"]) if 1 in total else (0, 0)
    sc, runs = docs.sparkSession.sparkContext, packs(shards, limit)
    log_all, one = math.log10(n_train + 0.1 * (v_train + 1)), n_train + 0.1 * (v_train + 1)
    pack_of = lambda run: sc.broadcast(Pack(map(tuple, shards.filter(F.col("shard").isin(run)).select("kind", "shard", "h", "c").toLocalIterator()), bits))  # noqa: E731  at most limit bytes, fetched a partition at a time

    def finish(at: np.ndarray, c: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(at))
        base = np.log10(c + 0.1) - log_all
        before = np.empty_like(c)
        before[1:] = c[:-1]
        ends = c[at[1:] - 1] if n else c[:0]
        before[at[:-1]] = ends
        pair = np.minimum(np.minimum(expected(q), c), before)
        p = (pair + prior * (c + 0.1) / one) / (before + prior)
        sums = [np.bincount(row, v, n) for v in (base, np.log10(p))]
        return [np.diff(at), np.bincount(row, c > 0, n).astype(np.int64), np.full(n, n_train), *sums]

    names, kinds = ["n_tokens", "n_known", "train_tokens", "base_score", "score"], (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    final = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if len(runs) == 1:
        pack = pack_of(runs[0])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in pieces(b, "text", 4 << 20):
                    h, at = sequence(x.column(1))
                    out = finish(at, pack.value.counts(h), pack.value.levels(pairs(h, at)))
                    yield pa.RecordBatch.from_arrays([x.column(0), *map(pa.array, out, kinds)], ["doc_id", *names])

        return own.mapInArrow(score, final)

    ragged = lambda at, v: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v))
    state = own.withColumns({"c": F.lit(None).cast("array<bigint>"), "q": F.lit(None).cast("array<bigint>")})
    for run in runs:
        pack = pack_of(run)

        def add(batches: Iterator[pa.RecordBatch], pack=pack) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in pieces(b, "text", 4 << 20):
                    h, at = sequence(x.column(1))
                    c, q = pack.value.counts(h), pack.value.levels(pairs(h, at))
                    if x.column(2).null_count == 0:
                        c, q = (v + old.flatten().to_numpy() for v, old in ((c, x.column(2)), (q, x.column(3))))
                    yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), ragged(at, c), ragged(at, q)], ["doc_id", "text", "c", "q"])

        state = stored(state.mapInArrow(add, f"doc_id {kind}, text string, c array<bigint>, q array<bigint>"))
        pack.unpersist()

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())]).astype(np.int64)
            out = finish(at, b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, kinds)], ["doc_id", *names])

    return state.select("doc_id", "c", "q").mapInArrow(end, final)


def score_held_out(docs: DataFrame, **how) -> DataFrame:
    """score_texts() with counts of the rows whose crc32 of the id, modulo 10, is not 0; with held_out."""
    out = score_texts(docs, docs.filter(part("doc_id", 10) != 0), **how)
    return out.withColumn("held_out", part("doc_id", 10) == 0)
