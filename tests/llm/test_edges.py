"""Every operator on nulls, empty and long texts, repeated rows, empty tables and columns with clashing names."""

import math

import pytest

from drivelake.llm import embedding_dedup, exact_dedup, jaccard, langid, line_dedup, lm, mixing, packing, pii, quality
from drivelake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, n string, row string, size string, taken string, keep_id string, rep string, g string"
LONG = "the cat sat on 10.0.0.1 and a mat.\n" * 3000
TEXTS = [(1, "A few words in English here", "en"), (1, "A few words in English here", "en"), (2, None, None), (3, "", "en"), (None, "A few words in English here", None), (4, " \t\n", None), (5, LONG, "en"), (6, LONG, "en"), (7, "12 34", None), (8, "Ein paar deutsche Wörter", "de")]

OPERATORS = {
    "quality": lambda d, s: quality.score_held_out(d, s.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")),
    "exact": lambda d, s: exact_dedup.exact_dedup(d),
    "lm": lambda d, s: lm.score_held_out(d),
    "jaccard": lambda d, s: jaccard.jaccard_groups(d),
    "mixing": lambda d, s: mixing.mix_sources(d),
    "pii": lambda d, s: pii.digested(pii.find_pii(d, pii.fit(d))),
    "lines": lambda d, s: line_dedup.line_dedup(d),
    "langid": lambda d, s: langid.identify_held_out(d),
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None if i == 3 else "s", None, *"abcdefghi") for i, t, lang in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(spark, name):
    assert OPERATORS[name](frame(spark, TEXTS), spark).count() == len(TEXTS)
    assert OPERATORS[name](frame(spark, []), spark).count() == 0


def test_packing(spark):
    got = packing.pack(frame(spark, TEXTS), tokenizer_path()).collect()
    assert sum(r["piece"] == 0 for r in got) == len(TEXTS)
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x"), (2, [1.0, 0.01], "x"), (3, [0.0, 0.0], "x"), (4, None, "x"), (5, [float("nan"), 1.0], "x"), (6, [None, 1.0], "x"), (None, [1.0, 0.0], "x"), (7, [0.0, 1.0], "x"), (8, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, k string")
    out = embedding_dedup.near_vectors(df).filter("vec_id is not null").collect()
    assert {(r["vec_id"], r["component_id"]) for r in out} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8)}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_exact_groups_spill(spark):
    df = spark.createDataFrame([(i, f"text  {i % 700}\n" + "x" * 2000) for i in range(3000)], "doc_id long, text string").coalesce(1)
    out = exact_dedup.exact_dedup(df, bucket_bytes=100_000).collect()
    assert len(out) == 3000 and sum(r["kept"] for r in out) == 700 and all(r["keep_id"] == r["doc_id"] % 700 for r in out)


def rows(spark, name):
    return OPERATORS[name](frame(spark, TEXTS), spark).collect()


def by_id(found, *fields):
    """The distinct values of each id; null is an id like any other."""
    out = {}
    for r in found:
        out.setdefault(r["doc_id"], set()).add(tuple(r[f] for f in fields))
    return out


def test_exact_values(spark):
    found = by_id(rows(spark, "exact"), "keep_id", "group_size", "kept")
    assert {k: {v[:2] for v in x} for k, x in found.items()} == {1: {(1, 3)}, None: {(1, 3)}, 2: {(2, 2)}, 3: {(2, 2)}, 4: {(4, 1)}, 5: {(5, 2)}, 6: {(5, 2)}, 7: {(7, 1)}, 8: {(8, 1)}}
    assert {i for i, x in found.items() if (True,) in {v[2:] for v in x}} >= {1, 2, 4, 5, 7, 8}


def test_jaccard_values(spark):
    found = by_id(rows(spark, "jaccard"), "n_shingles", "component_id")
    assert found == {1: {(2, 1)}, None: {(2, 1)}, 2: {(0, 2)}, 3: {(0, 3)}, 4: {(0, 4)}, 5: {(8, 5)}, 6: {(8, 5)}, 7: {(1, 7)}, 8: {(1, 8)}}


def test_mixing_values(spark):
    found = rows(spark, "mixing")
    words = {1: 6, None: 6, 2: 0, 3: 0, 4: 0, 5: 24000, 6: 24000, 7: 2, 8: 4}
    assert all(r["size"] == words[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in found)
    total = sum(r["size"] for r in found)
    assert sum(r["taken"] for r in found) == math.floor(1.5 * total)
    assert {(r["source"], r["target"]) for r in found if r["doc_id"] == 3} == {(None, 0.0)}


def test_mixed_documents(spark):
    """Rows that share an id are taken each by its own words, and so often as the mix says; columns keep their names."""
    data = [(1, "a b c d", "x", None, "k"), (1, "e", "x", None, "k"), (2, "same words", "y", 10, "k"), (2, "same words", "y", 10, "k"), (2, "same words", "y", 10, "k"), (3, None, "y", None, "k")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars int, key string")
    out = mixing.mixed_documents(docs).collect()
    per = {}
    for r in mixing.mix_sources(docs).collect():
        per[r["source"]] = per.get(r["source"], 0) + r["taken"]
    got = {}
    for r in out:
        got[r["source"]] = got.get(r["source"], 0) + len((r["text"] or "").split())
        assert r["n_chars"] in (None, len(r["text"] or "")) and r["key"] == "k"
    assert got == per and sum(r["doc_id"] == 3 for r in out) == 1


def test_pii_values(spark):
    found = by_id(rows(spark, "pii"), "n_email", "n_ip", "n_card", "n_phone")
    assert found == {i: {(0, 3000 if i in (5, 6) else 0, 0, 0)} for i in (1, None, 2, 3, 4, 5, 6, 7, 8)}


def test_lines_values(spark):
    found = by_id(rows(spark, "lines"), "n_lines", "n_removed", "n_words", "words_removed")
    assert found[1] == {(1, 0, 6, 0)} and found[2] == found[3] == found[4] == {(0, 0, 0, 0)}
    assert found[6] == {(3000, 3000, 24000, 24000)}
    (lines, removed, n, gone), = found[5]
    assert lines == 3000 and removed < 3000 and n - gone < 120  # its own beginning stays


def test_langid_values(spark):
    found = by_id(rows(spark, "langid"), "lang_pred")
    assert all(found[i] == {("und",)} for i in (2, 3, 4, 7)) and found[5] == found[6] and found[5] <= {("en",), ("de",)}


def test_lm_values(spark):
    found = by_id(rows(spark, "lm"), "n_tokens")
    assert found == {1: {(7,)}, None: {(7,)}, 2: {(1,)}, 3: {(1,)}, 4: {(1,)}, 5: {(24001,)}, 6: {(24001,)}, 7: {(3,)}, 8: {(5,)}}


def test_quality_values(spark):
    found = rows(spark, "quality")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    same = by_id(found, "score")
    assert same[2] == same[3] and same[5] == same[6] and len(same[1]) == 1


def test_quality_sample_is_bounded(spark):
    """Many documents, and many copies, under one id: about as many rows as asked for are learned from."""
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    grow, quality.grow = quality.grow, lambda x, y, **how: seen.append(len(y)) or grow(x, y, **how)
    try:
        for rows in ([(1, f"text {'word ' * (k % 50)} {k}") for k in range(3000)] + [(2, "other")], [(1, "same")] * 3000 + [(2, "other")] * 3000):
            quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample_rows=100)
    finally:
        quality.grow = grow
    assert all(20 < n < 300 for n in seen) and len(seen) == 2


def test_a_tokenizer_that_splits_words(tmp_path):
    """Chunks of which the tokenizer makes several words are encoded one by one."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"ab": 0, "c": 1, "[UNK]": 2, "|": 3}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Split("b", "merged_with_previous")])
    t.save(str(tmp_path / "t.json"))
    own = packing.Ids(str(tmp_path / "t.json"))
    assert own(["abc ab c", "abcc x"]) == [own.encode("abc ab c"), own.encode("abcc x")]


def test_equal_texts_are_tokenized_once():
    """Equal texts of a batch are encoded once, and each has its ids."""
    import public_tokenizers

    from drivelake.llm.packing import Ids

    ids, asked = Ids(public_tokenizers.path("word_bpe_49k.json")), []
    plain = ids.encode
    ids.encode = lambda t: asked.append(t) or plain(t)
    odd = "a\x1cb c"
    assert ids([odd, "a b", "", odd, "a b"]) == [plain(t) for t in (odd, "a b", "", odd, "a b")] and asked == [odd]


def test_words_in_any_case_are_learned_once():
    """Latin-1 words are asked of the tokenizer once, in lower case and without the marks after them; ids stay the tokenizer's."""
    import random

    from drivelake.llm.packing import Ids
    from drivelake.llm.queries import tokenizer_path

    own, asked = Ids(tokenizer_path()), []
    plain = own.learn_words
    own.learn_words = lambda words: (asked.extend(words), plain(words))
    texts = ["Größe größe, GRÖSSE grösse!! Größe.", "größe don't ÀÉ àé;", "Ā Σς İx ﬁ x́ ª1 a×b"]
    assert own(texts) == [own.encode(t) for t in texts]
    assert sorted(asked) == sorted(["größe", "grösse", "àé"])
    r = random.Random(3)
    letters = "abzAZßÀéÿªµº×÷ĀΣσςİ̇́'s.,!|?;:#$%&*19 \x1c日"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(5000)]
    assert own(texts) == [own.encode(t) for t in texts]
