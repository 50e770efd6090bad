"""The filter audit against a walk of every document through every order, and its edge cases."""

import re
from itertools import permutations

from drivelake.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask string, n int"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels, letters="ABCDE"):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    failing = []
    for i, t, _ in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": re.search(r"[#$%&*|]", t) is not None}
        fails["E"] = any((u or "") == t and j is not None and i is not None and j < i for j, u, _ in docs)
        failing.append({c for c in letters if fails[c]})
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {lang or "" for *_, lang in docs}:
        own = [(d[0], f) for d, f in zip(docs, failing) if (d[2] or "") == part]
        for order in map("".join, permutations(letters)):
            left = own
            for k, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                failed = sum(c in f for _, f in own)
                left = [x for x in left if c not in x[1]]
                out[part, order, k + 1] = [len(left), len(gone), failed - len(gone), sum(f == {c} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for c in letters:
            at = [key for key in out if key[0] == part and key[1][key[2] - 1] == c]
            total = sum(out[key][1] for key in at)
            for key in at:
                out[key].append(total)
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(120))
SOME = [
    (1, LONG, "en"), (2, LONG, "de"), (3, LONG, None), (3, LONG, "en"), (None, LONG, "en"), (None, LONG, "en"),
    (4, "UPPER CASE", "en"), (5, "upper case", ""), (6, None, "en"), (7, "", "de"), (8, "a " * 200, "en"), (9, "A " * 200 + "$", "en"),
    (10, LONG + " |", "de"), (11, LONG.upper(), "en"), (12, "\t \n" + LONG, "en"), (13, "É" * 50, "fr"), (-5, "UPPER CASE", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (6, 1, None), (9, 0, 1), (99, 1, 1), (None, 1, 1)]


def test_against_a_walk(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in SOME], DOCS)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert found(filter_audit.filter_audit(docs, labels)) == brute(SOME, LABELS)


def test_other_filters(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in SOME], DOCS)
    some = {c: filter_audit.CONDITIONS[c] for c in "BD"}
    assert found(filter_audit.filter_audit(docs, None, some, None)) == brute(SOME, [], "BD")
    assert found(filter_audit.filter_audit(docs, None, some)) == brute(SOME, [], "BDE")


def test_many_copies(spark):
    """A text with a third of all rows, ties and repeated rows among them."""
    some = [(i // 2, LONG, "en" if i % 3 else "de") for i in range(400)] + [(1000 + i, f"{LONG} {i}", "en") for i in range(300)]
    docs = spark.createDataFrame([(*d, "x", 1) for d in some], DOCS).repartition(8)
    got = found(filter_audit.filter_audit(docs, None, {c: filter_audit.CONDITIONS[c] for c in "A"}))
    assert got == brute(some, [], "AE")


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
