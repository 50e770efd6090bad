"""Language ID: nearest centroid over TF-IDF n-gram vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import part, pieces, raw, row_of

DIM = 2048
#: Bytes and rows counted at once: a row's counts are dense, so that short texts need a bound of their own.
PIECE = 1 << 20, 512
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)


def counts(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of each text, its letters folded and all between them as one gap; and which texts have a letter."""
    buf, off = raw(column)
    n = len(off) - 1
    c = _CODE[buf]
    if len(buf):
        c[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)] += 32  # capital letters of Latin-1
    row = row_of(off)
    wide = np.zeros(len(buf) + n + 2, np.uint32)
    wide[np.arange(len(buf)) + row + 1] = c
    rows = np.zeros(len(wide), np.int64)
    rows[np.arange(len(buf)) + row + 1] = row
    mid = np.flatnonzero(wide)
    idx = (wide[mid - 1] * np.uint32(0x9E3779B1) ^ wide[mid] * np.uint32(0x85EBCA77) ^ wide[mid + 1] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    idx = (idx ^ idx >> np.uint32(15)) % np.uint32(dim)
    out = np.bincount(rows[mid] * dim + idx, minlength=n * dim)[: n * dim].reshape(n, dim)
    ascii_letter = (c > 0) & (c < 27)
    letter = np.bincount(row[ascii_letter], minlength=n)[:n] > 0
    for i in np.flatnonzero(~letter):
        t = column[int(i)].as_py()
        letter[i] = t is not None and any(map(str.isalpha, t))
    return out, letter


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf).astype(np.float32) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


@dataclass
class Centroids:
    """Several unit centroids for each language, the idf weights, and the cosine below which a text is rejected, by the
    binary logarithm of its number of n-grams, 8 at most."""

    langs: list[str]
    idf: np.ndarray
    centre: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos = vectors(tf, self.idf) @ self.centre.T
        best = cos.argmax(1)
        score = cos[np.arange(len(cos)), best]
        return self.owner[best], np.clip(score, 0, 1).astype(float), score < self.least[_length(tf)]


def _length(tf: np.ndarray) -> np.ndarray:
    """From 256 n-grams on texts count as equally long: few are very long, and how near they come to a centroid varies."""
    return np.minimum(np.log2(np.maximum(tf.sum(1, dtype=np.int64), 1)).astype(int), 8)


def _clusters(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means that starts from points far from each other."""
    centre = [v.mean(0)]
    for _ in range(min(k, len(v)) - 1):
        centre.append(v[np.argmin(np.max(v @ np.array(centre).T, axis=1))])
    centre = np.array(centre)
    for _ in range(rounds):
        own = (v @ centre.T).argmax(1)
        centre = np.array([v[own == j].mean(0) if (own == j).any() else centre[j] for j in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return centre


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 6000, clusters: int = 3, rejection: float = 0.7) -> Centroids | None:
    """Centroids from rows with a language, from a sample by a hash of id and text of about `sample_rows` rows, an equal
    share for each language. A text is rejected where its cosine is below `rejection` times that which 998 in 1000 texts of
    its length or longer reach in training. None without such rows."""
    train = train.filter(F.col(lang_col).isNotNull())
    n = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}  # a row per language
    if not n:
        return None
    share = max(50, sample_rows // len(n))
    rate = F.element_at(F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, min(1.0, share / v)))), F.col(lang_col))
    drawn = train.filter(F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)), F.lit(1_000_000)) < rate * 1_000_000)

    def count(batches):
        for b in batches:
            for x in pieces(b, "text", *PIECE):
                tf, letter = counts(x.column(1))
                keep = np.flatnonzero(letter)
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(keep)), pa.array([np.minimum(tf[i], 65535).astype(np.uint16).tobytes() for i in keep], pa.binary())], ["lang", "tf"])

    got = drawn.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "lang string, tf binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "tf"], kind="stable")
    tf = np.frombuffer(b"".join(got["tf"]), np.uint16).reshape(len(got), DIM)
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    langs, own = np.unique(got["lang"].to_numpy(dtype=str), return_inverse=True)
    centre, owner, near = [], [], np.zeros(len(tf))
    for i in range(len(langs)):
        v = vectors(tf[own == i], idf)
        c = _clusters(v, clusters)
        centre.append(c)
        owner += [i] * len(c)
        near[own == i] = (v @ c.T).max(1)
    size, least = _length(tf), np.full(64, np.inf)
    for k in np.unique(size):
        if (size == k).sum() >= 5:
            least[k] = rejection * np.quantile(near[size == k], 0.002)
    least = np.minimum.accumulate(least[::-1])[::-1]
    least = np.where(np.isinf(least), least[np.isfinite(least)].max(initial=0), least)
    return Centroids([str(x) for x in langs], idf, np.concatenate(centre).astype(np.float32), np.array(owner), least)


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs.

    lang_pred is `und`, with score 0 and rejected, where the text is null or has no letter or there is no model;
    otherwise the language of the nearest centroid. score is the cosine, cut to 0..1; ties go to the language first by
    code point. rejected marks texts too far from every centroid. Rows do not depend on each other; an empty table gives
    no rows; very long texts are read whole; other columns are ignored.
    """

    def predict(batches):
        for b in batches:
            for x in pieces(b, "text", *PIECE):
                tf, letter = counts(x.column(1))
                if model is None:
                    best, score, far, names = np.zeros(len(tf), int), np.zeros(len(tf)), ~letter, ["und"]
                    letter = letter & False
                else:
                    (best, score, far), names = model.predict(tf), model.langs
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([names[i] if ok else "und" for i, ok in zip(best, letter)]), pa.array(np.where(letter, score, 0.0)), pa.array(far | ~letter)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, model: Centroids | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged and with all columns whatever their names, whose text is neither `und` (null, empty or
    without a letter) nor too far from every centroid; without a model those with a letter. Repeated rows all stay or all
    go; an empty table gives an empty one; very long texts are read whole."""

    def keep(batches):
        for b in batches:
            for x in pieces(b, text_col, *PIECE):
                tf, letter = counts(x.column(x.schema.get_field_index(text_col)))
                far = model.predict(tf)[2] if model else np.zeros(len(tf), bool)
                yield x.filter(pa.array(letter & ~far))

    return docs.mapInArrow(keep, docs.schema)


def identify_held_out(docs: DataFrame, **how) -> DataFrame:
    """identify() with a model learned from the rows whose crc32 of the id, modulo 3, is not 1; with held_out."""
    model = fit(docs.filter(part("doc_id", 3) != 1), **how)
    return identify(docs, model).withColumn("held_out", part("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "rejected")
