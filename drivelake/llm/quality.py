"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_LINE, hashes, mix, part, pieces, raw, spans, stored

SYMBOLS = "!|#$%&*.,\n@<>{}/:;?-_\"'"


def statistics(column: pa.Array) -> np.ndarray:
    """One row of float32 statistics per text; null counts as empty."""
    buf, off = raw(column)
    s, e, at = spans(buf, off)
    h = hashes(buf, s, e)
    ls, le, lat = spans(buf, off, IS_LINE)
    lh = hashes(buf, ls, le)
    two = mix(h[:-1] * np.uint64(31) + h[1:]) if len(h) > 1 else h[:0]
    same = h[:-1] == h[1:] if len(h) > 1 else np.zeros(0, bool)
    out = np.zeros((len(off) - 1, 20 + len(SYMBOLS)), np.float32)
    symbols = [ord(c) for c in SYMBOLS]
    for i in range(len(out)):
        a, b = off[i], off[i + 1]
        n = b - a
        if not n:
            continue
        f = np.bincount(buf[a:b], minlength=256) / n
        x, y = at[i], at[i + 1]
        w = max(1, y - x)
        letters = f[65:91].sum() + f[97:123].sum() + f[128:].sum()
        _, c = np.unique(h[x:y], return_counts=True)
        _, lc = np.unique(lh[lat[i] : lat[i + 1]], return_counts=True)
        lines = max(1, lat[i + 1] - lat[i])
        p = f[f > 0]
        pairs = max(1, y - x - 1)
        out[i, :20] = [
            np.log1p(n), np.log1p(y - x), (e[x:y] - s[x:y]).mean() if y > x else 0, len(c) / w, f[65:91].sum() / max(letters, 1e-9), f[48:58].sum(),
            1 - letters - f[48:58].sum() - f[9:14].sum() - f[32], f[128:].sum(), c.max() / w if len(c) else 0, same[x : max(x, y - 1)].sum() / pairs,
            len(np.unique(two[x : max(x, y - 1)])) / pairs, 1 - len(lc) / lines, np.log1p(lines), w / lines, -(p * np.log(p)).sum(), f[32], lc.max() / lines if len(lc) else 0,
            (e[x:y] - s[x:y]).std() if y > x else 0, (e[x:y] - s[x:y]).max() / n if y > x else 0, len(c) / np.sqrt(w),
        ]
        out[i, 20:] = f[symbols]
    return out


@dataclass
class Forest:
    """Trees of equal depth as flat arrays: node k of a tree has children 2k+1 and 2k+2; a row goes right where its
    statistic is above the threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            k = np.zeros(len(x), np.int64)
            while len(k) and k[0] < inner:
                k = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
            f += leaf[k - inner]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5) -> Forest:
    """Boosts trees on the logistic loss, from histograms over quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    inner = 2**depth - 1
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    f = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for t in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, w = y - q, q * (1 - q)
        k = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = (k - first) * bins
            best = np.full(nodes, 1e-9)
            cut = np.full(nodes, bins)
            for j in range(len(b)):
                gs, ws, ns = (np.bincount(key + b[j], v, nodes * bins).reshape(nodes, bins).cumsum(1) for v in (g, w, None))
                gain = gs**2 / (ws + l2) + (gs[:, -1:] - gs) ** 2 / (ws[:, -1:] - ws + l2) - gs[:, -1:] ** 2 / (ws[:, -1:] + l2)
                gain[(ns < least) | (ns[:, -1:] - ns < least)] = -1
                at = gain.argmax(1)
                top = gain[np.arange(nodes), at]
                for n in np.flatnonzero(top > best):
                    best[n], cut[n] = top[n], at[n]
                    feature[t, first + n] = j
                    threshold[t, first + n] = edges[j][at[n]] if at[n] < len(edges[j]) else np.inf
            k = 2 * k + 1 + (b[feature[t, k], np.arange(len(y))] > cut[k - first])
        k -= inner
        leaf[t] = rate * np.bincount(k, g, inner + 1) / (np.bincount(k, w, inner + 1) + l2)
        f += leaf[t][k]
    return Forest(base, feature, threshold, leaf)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, **how) -> Forest:
    """Trees from labelled documents. About `sample_rows` of the labelled rows are drawn by a hash of the id where there
    are more, and where many documents share a drawn id, about as many of those documents, so that what reaches the driver is
    bounded: one short row of statistics each, equal ones as one with their number."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    n = known.count()
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample_rows / max(n, 1))).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("y")).groupBy("_id").agg(F.max("y").alias("y"))
    own = docs.select(F.col(id_col).alias("_own"), F.col(text_col).cast("string").alias("text"))
    # drawn holds about sample_rows rows at most, whatever the input.
    train = own.join(F.broadcast(drawn), F.col("_own") == F.col("_id")).select("y", "text")

    def stats(batches):
        for b in batches:
            for x in pieces(b, "text"):
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([r.tobytes() for r in statistics(x.column(1))], pa.binary())], ["y", "x"])

    rows = stored(train.mapInArrow(stats, "y int, x binary").groupBy("y", "x").agg(F.count("*").alias("n")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    rate = sample_rows / total if total > 2 * sample_rows else 1.0
    # Each distinct row as often as its share of the sample, rounded up or down by a hash.
    often = F.floor(F.col("n") * rate + F.pmod(F.xxhash64("y", "x"), F.lit(1_000_000)) / 1_000_000 * int(rate < 1))
    got = rows.select("y", "x", often.cast("int").alias("n")).filter("n > 0").toPandas().sort_values(["y", "x"], kind="stable")
    got = got.loc[got.index.repeat(got["n"])]
    if not len(got):
        return Forest(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1), np.float32), np.zeros((0, 2)))
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1)
    return grow(x, got["y"].to_numpy(dtype=float), **how)


def score_quality(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row of docs; predicted is 1 where score >= 0.5.

    Only the text counts. A null text scores as an empty one; without any labelled row every score is 0.5; equal texts
    score alike; an empty table gives no rows; very long texts are read whole; other columns are ignored.
    """

    def predict(batches):
        for b in batches:
            for x in pieces(b, "text"):
                score = model.score(statistics(x.column(1)))
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(predict, f"doc_id {kind}, score double, predicted int")


def score_held_out(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """score_quality() with trees learned from the labels whose crc32 of the id, modulo 3, is not 1; with held_out."""
    model = fit(docs, labels.filter(part("doc_id", 3) != 1), **how)
    return score_quality(docs, model).withColumn("held_out", part("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted")
