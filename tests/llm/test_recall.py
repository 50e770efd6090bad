"""Recall of the embedding search against brute force, on planted near vectors beside a hot blob."""

import numpy as np

from drivelake.llm.embedding_dedup import graph, near_vectors, recall, search, starts


def test_search_of_another_cut():
    """Queries that are no nodes, as in another cut of a cell: from the medoid alone, which lies in the blob, they found
    none of the planted groups."""
    dim, rng = 64, np.random.default_rng(7)

    def around(centre, n, spread):
        return centre + spread * rng.normal(size=(n, dim)) * np.linalg.norm(centre) / np.sqrt(dim)

    v = np.concatenate([around(rng.normal(size=dim), 1500, 0.33), *(around(rng.normal(size=dim), 4, 0.2) for _ in range(600)), rng.normal(size=(1000, dim))])
    v = v[rng.permutation(len(v))]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    node = rng.random(len(v)) < 0.5
    nodes = v[node]
    itself = np.full(len(v), -1)
    itself[node] = np.arange(len(nodes))
    true = v @ nodes.T >= 0.9
    found = np.zeros(true.shape, bool)
    for r, c in search(nodes, graph(nodes), v, starts(nodes, v, itself), 0.9):
        found[r, c] = True
    n = true.sum(1)
    few = (n > 0) & (n <= 4)
    assert not (found & ~true).any()
    for own in (node, ~node, node & few, ~node & few):
        assert found[own].sum() >= 0.9 * true[own].sum() > 0


def planted(dim=32, seed=5):
    """ids and vectors: small groups, large ones, a dense blob, others, and two other lengths."""
    rng = np.random.default_rng(seed)

    def around(n, spread):
        c = rng.normal(size=dim)
        return c + spread * rng.normal(size=(n, dim)) * np.linalg.norm(c) / np.sqrt(dim)

    v = np.concatenate([*(around(4, 0.2) for _ in range(150)), *(around(200, 0.25) for _ in range(3)), around(500, 0.33), rng.normal(size=(600, dim))])
    rows = [[float(x) for x in r] for r in v[rng.permutation(len(v))]]
    short = rng.normal(size=(20, 5))
    rows += [[1.0], [2.0], [-1.0], *(r.tolist() for r in short), *((r + 0.01).tolist() for r in short), [0.0] * dim, [float("nan")] * dim, rows[0]]
    return list(enumerate(rows))


def truth(rows):
    links = np.zeros(len(rows), int)
    root = list(range(len(rows)))
    by_length = {}
    for i, v in rows:
        if np.isfinite(v).all() and np.any(v):
            by_length.setdefault(len(v), []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for ids in by_length.values():
        m = np.array([rows[i][1] for i in ids])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near = m @ m.T >= 0.9
        np.fill_diagonal(near, False)
        links[ids] = near.sum(1)
        for a, b in zip(*np.nonzero(np.triu(near))):
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return links, [find(i) for i in range(len(rows))]


def test_many_cells(spark):
    """Small cells, cut ones and parts of queries: recall of the search, and no loss at all in exact mode."""
    rows = planted()
    links, component = truth(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    how = dict(shard_rows=120, most_rows=200, part_rows=100, sample_rows=800)
    exact = {r["vec_id"]: r for r in near_vectors(df, exact=True, **how).collect()}
    assert [exact[i]["n_links"] for i, _ in rows] == links.tolist()
    assert [exact[i]["component_id"] for i, _ in rows] == component
    found = near_vectors(df, **how)
    out = {r["vec_id"]: r for r in found.collect()}
    n = np.array([out[i]["n_links"] for i, _ in rows])
    assert (n <= links).all()
    for some in (links > 0, (links > 0) & (links < 5), links > 100):
        assert n[some].sum() >= 0.9 * links[some].sum() > 0
    audit = recall(df, found, every=1).first()
    assert audit["links"] == links.sum() and audit["recall"] >= 0.9
