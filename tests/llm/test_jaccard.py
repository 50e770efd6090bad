"""The Jaccard join against brute force: groups near the threshold, and lists cut into blocks and dealt over tasks."""

import numpy as np
import pytest

from drivelake.llm.jaccard import jaccard_groups


def near_copies(rng):
    """Groups of copies of a template with some words changed, many pairs of which have a similarity just under 0.8."""
    docs = []
    for _ in range(6):
        template = [f"w{k}" for k in rng.integers(0, 100_000, 120)]
        for _ in range(40):
            own = list(template)
            for k in rng.choice(120, rng.integers(0, 4), replace=False):
                own[k] = f"v{rng.integers(0, 10**9)}"
            docs.append(" ".join(own))
    docs += ["", None, "one two", "one two", "One TWO ", " ".join(f"x{k}" for k in range(300))]
    return list(enumerate(docs))


def brute(docs):
    shingles, sizes = {}, {}
    for i, t in docs:
        w = (t or "").lower().split()
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        shingles[i], sizes[i] = s, len(s)
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in docs if shingles[i]]
    under = 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(shingles[a] & shingles[b])
            union = sizes[a] + sizes[b] - both
            under += 70 * union <= 100 * both < 80 * union
            if 100 * both >= 80 * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert under > 500
    return {i: (sizes[i], find(i)) for i, _ in docs}


@pytest.mark.parametrize("how", [{}, {"most_rows": 8}, {"most_rows": 6, "split_rows": 5, "shard_chars": 20_000}])
def test_groups(spark, how):
    docs = near_copies(np.random.default_rng(8))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(df, **how).collect()} == brute(docs)
