"""The pipeline's stages on a small table with copies, near copies, other languages, nulls and shared ids."""

import re

import pytest

import corpus_pipeline
from drivelake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, words string, total string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs]
    long = max((r for r in rows if r[1] and 100 < len(words(r[1])) < 400), key=lambda r: len(words(r[1])))
    body = words(long[1])
    near = " ".join([*body[:50], "changed", *body[51:]])
    rows += [(9001, long[1].replace(" ", "  "), long[2], long[3], 1), (9002, near, long[2], None, 1), (9003, None, None, "s", None), (9004, "12 34 56", None, "s", 8), (9005, "", "en", "s", 0)]
    rows += [(9006, "deadbeef0123456789abcdef" * 60, None, "s", 1440), (None, rows[0][1] + " and one more", rows[0][2], rows[0][3], 1), (9007, "alpha beta gamma in some other words", "en", "s", 36), (9007, "quite another text under the same number", "en", "s", 40)]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame([(*r, "k", "r", "w", "t") for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, kept = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        kept = spark.createDataFrame(rows, docs.schema)
        seen.append((name, rows))
    by = dict(seen)
    assert [n for n, _ in seen] == ["language_id", "exact_dedup", "ngram_jaccard_join", "mix_sources"]
    ids = lambda n: [r["doc_id"] for r in by[n]]
    assert not {9003, 9004, 9005, 9006} & set(ids("language_id"))
    clean = docs.filter("doc_id < 9000 and text rlike '[a-z]'").count()
    assert len([i for i in ids("language_id") if i is not None and i < 9000]) >= 0.99 * clean
    assert 9001 not in ids("exact_dedup") and 9002 in ids("exact_dedup") and ids("exact_dedup").count(9007) == 2
    assert 9002 not in ids("ngram_jaccard_join")
    assert all(" ".join(words(r["text"])) for r in by["ngram_jaccard_join"])
    before, after = {}, {}
    for n, out in (("ngram_jaccard_join", before), ("mix_sources", after)):
        for r in by[n]:
            out[r["source"]] = out.get(r["source"], 0) + len(words(r["text"]))
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) <= len(before) and all(after[k] <= 2 * before[k] for k in after)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(by["mix_sources"])
    full: dict = {}
    for r in packed:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert max(full.values()) <= 4096 and tokenizer_path()


@pytest.mark.parametrize("names", [("_id", "keep_id", "keep_sha", "kept_id"), ("_ID", "Keep_Id", "__keep_id", "__keep_sha")])
def test_clashing_names(spark, names):
    """Every stage but the last gives back all columns, whatever they are called."""
    text = "the committee met again in the old town hall and spoke of the new bridge over the river "
    rows = [(k, f"{text}{k // 2}", "en", "s", 1, *(f"{n}{k}" for n in names)) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.dtypes == docs.dtypes
        for r in kept.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
        if name == "exact_dedup":
            assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6]
    assert kept.count() > 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
