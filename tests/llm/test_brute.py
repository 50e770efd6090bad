"""Queries without SQL against brute force, an exact round trip or held-out accuracy, on whole small tables."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from oracle import SMALL

from drivelake.llm import langid, lm, pii, quality, queries
from drivelake.llm.line_dedup import line_dedup, line_table, suffix_ranks

DATA = "/root/testdata/sf0.01"
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def part(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def table(spark, name, folder=DATA):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels")}
    out = queries.op1_quality(spark, DATA).collect()
    assert len(out) == len(table(spark, "documents"))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (part(r["doc_id"], 3) == 1) for r in out)
    held = [(r["score"], labels[r["doc_id"]]) for r in out if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.8


def test_language_model_base(spark):
    docs = table(spark, "documents", SMALL)
    seen = Counter(w for d in docs if part(d["doc_id"], 10) for w in [*words(d["text"]), None])
    n, v = sum(seen.values()), len(seen)
    out = {r["doc_id"]: r for r in queries.op4_lm(spark, SMALL).collect()}
    for d in docs:
        r, tokens = out[d["doc_id"]], [*words(d["text"]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(seen[t] > 0 for t in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((seen[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel_tol=1e-9)
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_spans(text):
    """The base spans by the contract's patterns, tried everywhere."""
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: max(map(int, s.split("."))) <= 255),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 14 <= len(d) <= 19 and sum(sum(map(int, str(2 * x))) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 10 <= len(d) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns) for m in re.finditer(p, text) if ok(m[0], [int(c) for c in m[0] if c in "0123456789"])]
    return ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in sorted(found))


ODD = ["1.2.3.4.5.6.7.8", "12.3.4.256 0.0.0.0", "4111 1111 1111 1111-4111111111111111", "4111-1111-1111-1111 4111  1111", "+1 (743) 555-3824+49 30 1234567", "a@b.c@d.e x@y a..b@c.d.e. @ @@a@b.cc", "+12 3456789 (", "١٢٣٤ é@é.é u@é.com 5+5", "00000001.2.3.4 1.02.3.4", ""]


def test_personal_data_base(spark):
    out = {r["doc_id"]: r for r in queries.op7_pii(spark, DATA).collect()}
    for d in table(spark, "documents"):
        own = plain_spans(d["text"] or "")
        assert out[d["doc_id"]]["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        assert set(filter(None, own.split(","))) <= set(out[d["doc_id"]]["spans"].split(","))
        assert out[d["doc_id"]]["n_spans"] == len(list(filter(None, out[d["doc_id"]]["spans"].split(","))))
    for text in ODD:
        assert ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(text)) == plain_spans(text)


def test_personal_data_long_tokens():
    """Time grows with the length, however long a token is."""
    field = pii.Field(np.zeros((len(pii.features("0", 0, 1)), pii.LABELS)), np.zeros((pii.LABELS,) * 2), np.zeros((pii.LABELS,) * 2))
    for text in ("a" * 1_000_000 + " 1", "7" * 1_000_000, "a1." * 300_000, "(at" * 300_000 + "1", "+1" + " " * 500_000, "1" * 500_000 + "@" + "x" * 500_000):
        began = time.process_time()
        pii.added_spans(text, pii.base_spans(text), field)
        assert time.process_time() - began < 4


def test_personal_data_many_tokens():
    """Memory for a long text of little but numbers: all edges of a kind share their potential."""
    import tracemalloc

    field = pii.Field(np.ones((len(pii.features("0", 0, 1)), pii.LABELS)), np.eye(pii.LABELS), np.eye(pii.LABELS))
    text = "1 a " * 100_000
    tracemalloc.start()
    pii.added_spans(text, [], field)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_personal_data_by_hand(spark):
    """Mentions that no generator wrote: each is near or far from a clear one of the same form, and is found for it."""
    field = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    filler = " and the committee met again in the old town hall" * 30
    for kind, clear, mention in (
        ("email", "jane.roe@example.org", "jane.roe [at] example.org"),
        ("email", "sales@shop.example.com", "sales (at) shop (dot) example (dot) com"),
        ("ip", "192.168.10.77", "192[.]168[.]10[.]77"),
        ("phone", "+44 20 7946 0958", "(020) 7946-0958"),
    ):
        text = f"You can reach it as {clear} at all times.{filler} Old notes say {mention} instead."
        a = text.index(mention)
        added = pii.added_spans(text, pii.base_spans(text), field)
        assert any(k == KINDS[kind] and s < a + len(mention) and a < e for s, k, e in added), (mention, added)
    plain = f"In 2019 there were 12,400 visits, 3.5 per day more than in 1998.{filler} Room 214 holds 80."
    assert pii.added_spans(plain, pii.base_spans(plain), field) == []


def test_personal_data_field(spark):
    """On texts it hasn't learned from: weaker mentions of what a text also has in clear are found, other numbers aren't; and
    a mention counts because of a clear one far off, not without it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = pii.fit(docs.filter("doc_id % 2 = 0"))
    rng, found, weak, other, false = np.random.default_rng(3), 0, 0, 0, 0
    for d in docs.filter("doc_id % 2 = 1 and text rlike '[0-9@]'").collect():
        if pii.base_spans(d["text"]):
            text, entities = pii.practice(d["text"], rng)
            base = pii.base_spans(text)
            added = pii.added_spans(text, base, field)
            hidden = [e for e in entities if not any(a < e[2] and e[0] < b for a, _, b in base)]
            hit = lambda e: any(k == e[1] and a < e[2] and e[0] < b for a, k, b in added)
            weak += len(hidden)
            found += sum(map(hit, hidden))
            false += sum(not any(a < e[2] and e[0] < b for e in entities) for a, _, b in added if a >= len(d["text"]))
            other += len(added)
    assert weak > 200 and found >= 0.8 * weak and false <= 0.1 * other
    words = " and some more words of a text" * 200
    for clear, mention in (("+1 (743) 555-3824", "743.555.3824"), ("+49 30 1234 5678", "1234 5678")):
        alone, both = f"call {mention} now{words}", f"call {mention} now{words} at {clear} today"
        at = (5, KINDS["phone"], 5 + len(mention))
        assert at in pii.added_spans(both, pii.base_spans(both), field)
        assert at not in pii.added_spans(alone, pii.base_spans(alone), field)


KINDS = {k: i for i, k in enumerate(pii.KINDS)}


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    pieces, places = {}, {}
    for r in queries.op9_packing(spark, DATA).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for d in table(spark, "documents"):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[d["doc_id"]], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for k, i in enumerate(range(0, len(ids), 4096))]
        total += len(ids)
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 4096
    assert len(places) <= 1.02 * total / 4096 + 1


def test_language_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in table(spark, "documents")}
    held = [r for r in queries.op10_langid(spark, DATA).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def plain_trigrams(text):
    """Counts of hashed trigrams, a byte at a time."""
    code, b, out = [0], (text or "").encode(), Counter()
    for k, c in enumerate(b):
        upper = k and b[k - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97
        code.append(c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else c - 101 + 32 * bool(upper) if c >= 128 else 0)
    code.append(0)
    for x, y, z in zip(code, code[1:], code[2:]):
        if y:
            h = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) * 0x27D4EB2F % 2**32
            out[(h ^ h >> 15) % langid.DIM] += 1
    return out


def test_language_by_hand(spark):
    """Each row's language and score by cosines with every centroid, computed text by text; and its rejection."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 ..."), (-4, "ÄÖÜ straße"), (-5, "日本"), (-6, "a")], "doc_id long, text string")
    every = docs.select("doc_id", "text").filter("doc_id < 300").unionByName(odd)
    out = {r["doc_id"]: r for r in langid.identify(every, model).collect()}
    for d in every.collect():
        tf, got = plain_trigrams(d["text"]), out[d["doc_id"]]
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (got["lang_pred"], got["score"], got["rejected"]) == ("und", 0.0, True)
            continue
        v = {k: math.log1p(n) * float(model.idf[k]) for k, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model.centre]
        assert math.isclose(got["score"], max(cos), abs_tol=1e-5) and max(c for c, o in zip(cos, model.owner) if model.langs[o] == got["lang_pred"]) > max(cos) - 1e-5
        least = model.least[min(int(math.log2(sum(tf.values()))), 8)]
        assert abs(max(cos) - least) < 1e-5 or got["rejected"] == (max(cos) < least)
    kept = {r["doc_id"] for r in langid.recognised(every, model).collect()}
    assert kept == {k for k, r in out.items() if not r["rejected"]}
    assert {r["doc_id"] for r in langid.recognised(odd, None).collect()} == {-4, -5, -6}


def test_line_dedup(spark):
    passage = "\n".join(f"line {k} of a passage that more than one of the documents has" for k in range(6))
    docs = [(1, f"one\n\n{passage}\nend"), (2, f"two\n{passage}\n \nlast"), (3, "one\nshort"), (4, "one\nother"), (5, f"x\n{passage}\ny\n{passage}"), (6, None), (7, "")]
    out = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: r["text"] for k, r in out.items()} == {1: docs[0][1], 2: "two\n \nlast", 3: docs[2][1], 4: docs[3][1], 5: "x\ny", 6: "", 7: ""}
    assert (out[5]["n_lines"], out[5]["n_removed"]) == (14, 12)


def test_line_dedup_sources(spark):
    """A passage whose beginning an earlier document has too, one with lines of very different lengths, and random texts
    against brute force: of every run of min_words words the first place stays, and the lines of all others that aren't of
    that first place go."""

    def brute(docs, least):
        lines = {d: [x for x in t.split("\n") if x.split()] for d, t in docs}
        first, gone = {}, {d: set() for d in lines}
        for d in sorted(lines):
            for i in range(len(lines[d])):
                for j in range(i + 1, len(lines[d]) + 1):
                    run = tuple(lines[d][i:j])
                    if sum(len(x.split()) for x in run) >= least:
                        e, k = first.setdefault(run, (d, i))
                        gone[d] |= {n for n in range(i, j) if not (e == d and k <= n < k + j - i)}
        return {d: "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) for d in lines}

    line = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(5)]
    docs = [(1, "\n".join(line[:4])), (2, "\n".join(line)), (3, "a\n" + "\n".join(line) + "\nb")]
    out = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute(docs, 50) == {1: docs[0][1], 2: docs[1][1], 3: "a\nb"}
    rng = np.random.default_rng(5)
    lines = [" ".join(f"v{k}x{j}" for j in range([1, 2, 3, 9, 14][k % 5])) for k in range(7)]
    docs = [(d, "\n".join(lines[k] for k in rng.integers(0, 7, rng.integers(1, 30)))) for d in range(40)]
    out = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 12).collect()}
    assert out == brute(docs, 12)


def test_line_dedup_overlaps(spark):
    """Copies that overlap the one that stays."""
    one, two = (" ".join(f"{c}{j}" for j in range(20)) for c in "xy")
    docs = [(1, "\n".join([one] * 10)), (2, "\n".join([one, two] * 6)), (3, "\n".join([two, two])), (4, "\n".join([one] * 2))]
    out = {r["doc_id"]: r["text"].split("\n") for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: [one] * 3, 2: [one, two, one], 3: [two, two], 4: [one] * 2}
    many = [(d, "\n".join(f"a{k} b c" for k in range(d, d + 40))) for d in range(0, 100, 10)]
    few = line_dedup(spark.createDataFrame(many, "doc_id long, text string"), 6)
    assert sorted(x for r in few.collect() for x in r["text"].split("\n") if x) == sorted(f"a{k} b c" for k in range(130))


def test_first_ranks_ranges(spark):
    """The same ranks by one range of ids and by many."""
    from drivelake.llm import line_dedup as own

    docs = [(d, "\n".join(f"line {k % 97}" for k in range(d, d + 60))) for d in range(40)]
    lines = own.line_table(spark.createDataFrame(docs, "doc_id long, text string"))
    few, many = ({(r["row"], r["i"]): r["r"] for r in own.first_ranks(lines, n).collect()} for n in (1, 20_000))
    assert few == many and len(few) == 2400 and min(few.values()) == 1


def test_suffix_array(spark):
    """Ranks by 1, 2, 4 and 8 lines are places in the sorted suffixes, cut to as many lines; a line that occurs once ends one."""
    rng = np.random.default_rng(11)
    docs = [(d, "\n".join("abcx"[k] if k < 3 else f"only {d} {j}" for j, k in enumerate(rng.choice(4, rng.integers(1, 40), p=[0.5, 0.3, 0.15, 0.05])))) for d in range(30)]
    lines = line_table(spark.createDataFrame(docs, "doc_id long, text string"))
    ids, count = {}, Counter()
    for r in lines.collect():
        ids[r["row"], r["i"]] = r["id"]
        count[r["id"]] += 1

    def suffix(row, i, h):
        out = []
        while len(out) < h and (v := ids.get((row, i + len(out)))) is not None and count[v] > 1:
            out.append(v)
        return tuple(out)

    places = [p for p, v in ids.items() if count[v] > 1]
    found = suffix_ranks(lines, 8)
    assert [h for h, _ in found] == [1, 2, 4, 8]
    for h, level in found:
        own = {p: suffix(*p, h) for p in places}
        order = sorted(own.values())
        first = {v: order.index(v) + 1 for v in set(order)}
        same = Counter(order)
        assert {(r["row"], r["i"]): (r["r"], r["open"]) for r in level.collect()} == {p: (first[v], same[v] > 1 and len(v) == h) for p, v in own.items()}


def test_quality_trees():
    """Scores by arrays are those of a walk down each tree, row by row; splits separate what a statistic tells apart."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    y = ((x[:, 1] > 0.3) | (x[:, 4] < -0.2)).astype(float)
    forest = quality.grow(x, y, trees=25, depth=3)

    def walk(row):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if row[feature[k]] > threshold[k] else 1)
            total += leaf[k - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert np.mean((forest.score(x) >= 0.5) == y) > 0.97
    stats = quality.statistics(pa.array(["One two  two.\nOne", None, ""]))
    assert math.isclose(stats[0, 1], math.log1p(4), rel_tol=1e-6) and not stats[1:].any()


def test_language_model_filter():
    """A pair's level is never under that of its count, and seldom above."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    c = rng.geometric(0.2, len(h)).astype(np.int64)
    pack = lm.Pack([(2, 0, lm.filter_of(h, c).tobytes(), b"")], 0)
    found, true = pack.levels(h), lm.quantised(c)
    assert (found >= true).all() and np.mean(found > true) < 0.05
    assert np.mean(pack.levels(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0) < 0.05


def test_language_model_packs(spark):
    """Counts in several packs, each a pass of its own, give the scores of one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, some = ({r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score_held_out(docs, **how).collect()} for how in ({"shard_chars": 20_000}, {"shard_chars": 20_000, "limit": 20_000}))
    assert one == some


def test_language_rejection(spark):
    """Held-out clean texts, short ones too, stay; other languages and base64 go."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    clean = docs.filter("doc_id % 2 = 1 and lang is not null and text rlike '[a-z]{3}'")
    assert langid.recognised(clean, model).count() >= 0.985 * clean.count()
    rng = np.random.default_rng(6)
    odd = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.", base64.b64encode(rng.bytes(900)).decode()]
    assert langid.recognised(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string"), model).count() == 0
