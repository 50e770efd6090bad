"""Phrase collocations against a count of every phrase, and exact arithmetic beyond 64 bits."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from drivelake.llm import common, phrases

DOCS = "doc_id long, text string, lang string, word string, id int"


def brute(docs, max_words, min_count, top, pct):
    """docs: (text, lang)."""
    count, size = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    some = {p: f for p, f in count.items() if f >= min_count and len(p[1]) > 1}
    out = []
    for (lang, p), a in some.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(o == lang and len(q) > len(p) and inside(q) and 100 * f >= pct * a for (o, q), f in some.items()):
            continue
        score, _, left, r = min((10**6 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, r, size[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], n + 1, *x[1:]) for n, x in enumerate(own[:top])]
    return sorted(ranked)


def texts(seed, n=120):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "hall", "é", "日本", "\x00", "a b", "x-y", "'s"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; ", "\x0b"]
    fixed = ["new york city hall", "New York City", "of the new york"]
    make = lambda: "".join((r.choice(fixed) if r.random() < 0.3 else r.choice(words)) + r.choice(marks) for _ in range(r.randrange(40)))
    return [(make(), r.choice(["en", "en", "de", None, ""])) for _ in range(n)] + [(None, "en"), ("", None), (" .\n ", "en"), ("alone", "fr")]


def frame(spark, docs, parts=4):
    return spark.createDataFrame([(k, t, lang, "w", 1) for k, (t, lang) in enumerate(docs)], DOCS).repartition(parts)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_brute_force(spark):
    for seed, max_words, size in ((1, 3, 8 << 20), (2, 3, 64), (3, 4, 500), (4, 2, 1)):
        docs = texts(seed)
        got = found(phrases.collocations(frame(spark, docs), max_words, block_bytes=size))
        assert got == brute(docs, max_words, 10, 2000, 50) and got


def test_a_third_of_all_rows_equal(spark):
    docs = texts(5) + [("new york city. of the", "en")] * 60
    assert found(phrases.collocations(frame(spark, docs), contained_pct=80)) == brute(docs, 3, 10, 2000, 80)


def test_top_in_buckets(spark):
    rows = [("en" if i % 3 else "de", f"p {i}", i % 7, i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    plain = sorted((r["lang"], r["rank"], r["phrase"]) for r in phrases.best(df, 20).collect())
    assert plain == sorted((r["lang"], r["rank"], r["phrase"]) for r in phrases.best(df, 20, per_bucket=90).collect())
    assert len(plain) == 40


def test_exact_products(spark):
    """Counts whose products pass 64 bits, and floors that double arithmetic would miss."""
    cases = [(10**12, 10**12 + 1, 10**12 + 7), (3_000_000_019, 3_000_000_037, 3_000_000_077), (999_999_999_999, 10**12, 10**12), (10, 10, 10), (7 * 10**9, 7 * 10**9, 7 * 10**9 + 1)]
    df = spark.createDataFrame([(k, "en", "a b", a, [left], [r]) for k, (a, left, r) in enumerate(cases)], "id long, lang string, phrase string, f long, heads array<long>, tails array<long>")
    got = {r["id"]: r["score"] for r in phrases.scored(df, 2).collect()}
    assert got == {k: 10**6 * a * a // (left * r) for k, (a, left, r) in enumerate(cases)}
    assert dict(phrases.scored(df, 2).dtypes)["score"] == "bigint"


def test_block():
    words, counts, stream = phrases.block_of(b"\n\na b  a\n\nb\n")
    assert words == ["a", "b"] and counts.tolist() == [2, 2] and stream.tolist() == [-1, 0, 1, 0, -1, 1]
    left, right, n, pairs = phrases.named_pairs(np.array([0, 1, 0, 1, -1, 1, 2], np.int32), np.array([70, 80, -1]))
    assert (left.tolist(), right.tolist(), n.tolist(), pairs.tolist()) == ([70, 80], [80, 70], [2, 1], [0, 1, 0, -1, -1, -1])


def test_streams_are_short(spark):
    """A block's stream comes back as it was, in less than half of its four bytes a word."""
    for ids in ([-1], [0, 70_000, -1, 2**31 - 1], np.random.default_rng(1).zipf(1.5, 50_000).clip(max=90_000)):
        assert phrases.unpacked(phrases.packed(np.array(ids, np.int32))).tolist() == list(ids)
    r = random.Random(9)
    docs = frame(spark, [(" ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(500)), "en") for _ in range(100)], 1)
    for b in phrases.blocks(docs, "text", "lang", 4 << 20).collect():
        assert len(b["stream"]) < 2 * sum(b["counts"])


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.collocations(frame(spark, [("one two", "en")] * 9)).collect() == []
    assert phrases.collocations(frame(spark, [("one two", "en")] * 10)).select(F.col("phrase")).collect()[0][0] == "one two"


def test_levels_are_read_a_few_blocks_at_a_time(spark, monkeypatch):
    """Readers take up to 4096 rows of a row group at once, so a level's row groups have few blocks, however many a task writes."""
    levels = []

    def stored(df, **options):
        out = common.stored(df, **options)
        levels.extend([out] if "stream" in df.columns else [])
        return out

    monkeypatch.setattr(phrases, "stored", stored)
    docs = spark.createDataFrame([("a b c d e. " * 40, "en")] * 60, "text string, lang string").coalesce(1)
    names, _ = phrases.named_phrases(docs, block_bytes=400)
    assert sorted((r["phrase"], r["f"]) for r in names[2].collect()) == [("a b c", 2400), ("b c d", 2400), ("c d e", 2400)]
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for df in levels for f in df.inputFiles()]
    assert len(levels) == 2 and sum(m.num_rows for m in files) > 60
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 4
