"""Phrase collocations: hierarchical naming of adjacent pairs, from words to pairs of words and on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes that end a piece become a line end, a tab a space.
_CUT = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
BLOCK = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])
PAIRS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])


def packed(ids: np.ndarray) -> bytes:
    """How many ids there are and their bytes, the lowest of all first, in zstd: a stream is written and shuffled once a level."""
    planes = np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(ids).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


class _Numbers(dict):
    """Numbers words as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def block_of(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of pieces, one a line; how often each occurs; and the words' numbers in turn, -1 between pieces."""
    numbers = _Numbers({b"\n": 0, b"": 1})
    tokens = data.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
    ids = ids[ids != 1] - 2
    ids[ids < 0] = -1
    ids = ids[(ids >= 0) | np.append(ids[1:] >= 0, False)]  # one mark between pieces is enough
    return [w.decode() for w in list(numbers)[2:]], np.bincount(ids[ids >= 0], minlength=len(numbers) - 2), ids


def blocks(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """lang, words, counts, stream: the texts in blocks of one language and about block_bytes, each with its own numbering of
    words. Long texts are cut between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            data, at = b"\n".join(held.pop(lang)), 0
            del sizes[lang]
            while at < len(data):
                to = len(data)
                if to - at > 2 * block_bytes and (to := data.rfind(b"\n", at, at + block_bytes)) < 0 and (to := data.find(b"\n", at)) < 0:
                    to = len(data)
                words, counts, ids = block_of(data[at:to])
                at = to + 1
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([lang], [words], [counts], [packed(ids)]), BLOCK)], schema=BLOCK)

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                lang, data = lang.as_py(), text.as_py().encode().lower().translate(_CUT)
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                if sizes[lang] >= block_bytes:
                    yield from flush(lang)
                elif sum(sizes.values()) >= 4 * block_bytes:
                    yield from flush(max(sizes, key=sizes.__getitem__))
        for lang in list(held):
            yield from flush(lang)

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return own.mapInArrow(run, "lang string, words array<string>, counts array<long>, stream binary")


def named_pairs(stream: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left names, right names and counts of a block's distinct adjacent pairs of named items, and the pairs' numbers in turn,
    -1 where there is none. stream has the items' numbers, names the global id of each or -1."""
    a, b = stream[:-1], stream[1:]
    ok = (a >= 0) & (b >= 0)
    ok[ok] = (names[a[ok]] >= 0) & (names[b[ok]] >= 0)
    found, number, count = np.unique(a[ok].astype(np.int64) * len(names) + b[ok], return_inverse=True, return_counts=True)
    out = np.full(len(a), -1, np.int32)
    out[ok] = number
    return names[found // max(len(names), 1)], names[found % max(len(names), 1)], count, out


def next_level(level: DataFrame, keys: list[str], names: DataFrame, last: bool) -> DataFrame:
    """The blocks of one level as those of the next: items become pairs of items that have names. Only a block's distinct
    items meet the names, one row each, so that no item has more rows than there are blocks."""
    items = F.posexplode(F.arrays_zip(*(["words"] if keys == ["lang", "word"] else keys))).alias("item", "x")
    x = F.col("x.words").alias("word") if keys == ["lang", "word"] else None
    rows = level.select("block", "lang", items).select("block", "item", *(["lang", x] if x is not None else [F.col(f"x.{k}").alias(k) for k in keys]))
    per_block = rows.join(names.select(*keys, "id"), keys).groupBy("block").agg(F.collect_list("item").alias("items"), F.collect_list("id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lang, size, stream, items, ids in zip(*(b.column(i) for i in range(6))):
                name = np.full(size.as_py(), -1, np.int64)
                name[items.values.to_numpy()] = ids.values.to_numpy()
                left, right, count, pairs = named_pairs(unpacked(stream.as_py()), name)
                if len(left):
                    rows = ([block.as_py()], [lang.as_py()], [left], [right], [count], [None if last else packed(pairs)])
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, PAIRS)], schema=PAIRS)

    own = level.select("block", "lang", F.size("counts").alias("size"), "stream").join(per_block, "block")
    return own.mapInArrow(run, "block long, lang string, left array<long>, right array<long>, counts array<long>, stream binary")


def named_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 4 << 20) -> tuple[list[DataFrame], DataFrame]:
    """For k = 1 to max_words a frame of the phrases of k words that occur min_count times or more, and the number of words of
    each language. A phrase has an id, f (its occurrences), phrase, the ids left and right of its first and last k - 1 words
    (parent pointers), and heads and tails, the occurrences of its first and last 1 to k - 1 words.

    A phrase of k words is a pair of adjacent phrases of k - 1, and is as rare as either at least; so only pairs of phrases
    that have a name are counted, in blocks and then globally, and those that are frequent get names of their own."""
    level = stored(blocks(docs, text_col, lang_col, block_bytes).withColumn("block", F.monotonically_increasing_id()), large_rows=True)
    counted = level.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    counted = stored(counted)
    total = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.array().cast("array<bigint>")
    frequent = counted.filter(F.col("f") >= min_count)
    out = [stored(frequent.select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f", F.col("word").alias("phrase"), none.alias("heads"), none.alias("tails")))]
    keys = ["lang", "word"]
    for k in range(2, max_words + 1):
        level = next_level(level, keys, out[-1], k == max_words)
        level = level if k == max_words else stored(level, large_rows=True)
        pair = level.select(F.explode(F.arrays_zip("left", "right", "counts")).alias("x")).groupBy("x.left", "x.right").agg(F.sum("x.counts").alias("f")).filter(F.col("f") >= min_count)
        a = out[-1].select(F.col("id").alias("left"), "lang", F.concat("heads", F.array("f")).alias("heads"), F.col("phrase").alias("start"))
        b = out[-1].select(F.col("id").alias("right"), F.concat("tails", F.array("f")).alias("tails"), F.substring_index("phrase", " ", -1).alias("end"))
        pair = pair.join(a, "left").join(b, "right").select(F.monotonically_increasing_id().alias("id"), "lang", "left", "right", "f", F.concat_ws(" ", "start", "end").alias("phrase"), "heads", "tails")
        out.append(stored(pair))
        keys = ["left", "right"]
    return out, total


def scored(phrases: DataFrame, k: int) -> DataFrame:
    """phrases of k words with l, r and score of their lowest-scoring cut, of equal ones that after the fewest words. The
    products are decimals of 38 digits, exact up to a count of 10 ** 15; the score is a long, as a is at most l and r."""
    wide = lambda c: c.cast("decimal(15,0)")
    a = wide(F.col("f"))

    def cut(i: int):
        left, right = F.col("heads")[i - 1], F.col("tails")[k - i - 1]
        return F.struct(F.call_function("div", (a * a * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")).alias("score"), F.lit(i).alias("i"), left.alias("l"), right.alias("r"))

    return phrases.withColumn("cut", F.array_min(F.array(*map(cut, range(1, k))))).select("id", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def best(rows: DataFrame, top: int, per_bucket: int = 100_000) -> DataFrame:
    """rows (lang, phrase, a, score) with rank, the first `top` of each language. Large languages are first narrowed in
    buckets of about per_bucket rows, the first `top` of each, until few are left; only those meet in one task."""
    n = rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    while n > 2 * max(per_bucket, top) and (buckets := -(-n // max(per_bucket, 4 * top))) > 1:
        w = Window.partitionBy("lang", "_b").orderBy(*order)
        rows = rows.withColumn("_b", F.pmod(F.xxhash64("phrase", F.lit(buckets)), F.lit(buckets))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("_b", "rank")
        n = buckets * top
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, contained_pct: int = 50, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 4 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to max_words words that occur at least
    min_count times, by score, then a, both descending, then phrase in order of its bytes.

    Pieces end at . , ; : ! ? and line ends, words at spaces and tabs; A-Z count as a-z. A phrase is cut in two where the score
    a * a * 1000000 / (l * r), rounded down, is least; l and r are the occurrences of its parts, n the words of its language. A phrase
    within a longer one with at least contained_pct of a hundred of its occurrences is left out; as counts fall with length, only
    phrases of one word more need to be looked at, by their parent pointers.

    A null text has no words, a null language is `und`; rows that repeat a text count each; a language with too few words has no
    rows, and an empty table gives none; other columns are ignored under any names. A very long text is cut between pieces."""
    names, total = named_phrases(docs, max_words, min_count, text_col, lang_col, block_bytes)
    found = None
    for k in range(2, max_words + 1):
        own = scored(names[k - 1], k)
        if k < max_words:
            longer = names[k].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
            own = own.join(longer, "id", "left").filter(F.col("most").isNull() | (100 * F.col("most") < contained_pct * F.col("a"))).drop("most")
        own = own.drop("id")
        found = own if found is None else found.unionByName(own)
    return best(stored(found), top).join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
