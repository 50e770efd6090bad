"""Embedding near-dedup: a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, stored
from .components import Forest, components


def _unit(rows) -> np.ndarray:
    v = np.stack([np.asarray(r, float) for r in rows])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def graph(v: np.ndarray, degree: int = 24, nearest: int = 48, alpha: float = 1.2, seed: int = 3) -> np.ndarray:
    """Neighbours of each vector: its pruned nearest and some random ones, -1 where there are fewer."""
    n, rng = len(v), np.random.default_rng(seed)
    out = []
    for a in range(0, n, 500):
        sim = v[a : a + 500] @ v.T
        own = np.arange(a, min(a + 500, n))
        sim[own - a, own] = -2
        k = min(nearest, n - 1)
        top = np.argpartition(-sim, k - 1, 1)[:, :k] if k else np.zeros((len(own), 0), np.int64)
        cand = np.concatenate([top, rng.integers(0, n, (len(own), 16))], 1)
        cand[cand == own[:, None]] = -1
        near = np.where(cand >= 0, np.take_along_axis(sim, np.maximum(cand, 0), 1), -2)
        order = np.lexsort((cand, -near), axis=1)
        cand = np.take_along_axis(cand, order, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        out.append((own, cand))
    return np.concatenate([prune(v, own, cand, degree, alpha) for own, cand in out]) if out else np.zeros((0, degree), np.int64)


def prune(v: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of the candidates (-1: none) of the vectors `own`: of those left the nearest is kept, and drops all
    that are alpha times nearer to it than to the vector."""
    rows = np.arange(len(own))
    near = v[np.maximum(cand, 0)]
    to_point = np.where(cand >= 0, 2 - 2 * np.einsum("nd,nkd->nk", v[own], near), np.inf)
    alive, out = cand >= 0, np.full((len(own), degree), -1, np.int64)
    for r in range(degree):
        if not alive.any():
            break
        pick = np.where(alive, to_point, np.inf).argmin(1)
        some = alive[rows, pick]
        out[some, r] = cand[rows[some], pick[some]]
        between = 2 - 2 * np.einsum("nd,nkd->nk", near[rows, pick], near)
        alive &= ~(some[:, None] & (alpha * alpha * between <= to_point))
        alive[rows, pick] = False
    return out


def starts(v: np.ndarray, q: np.ndarray, itself: np.ndarray, most: int = 24) -> np.ndarray:
    """The nodes each query starts from (-1: none): the medoid and the query itself where it is a node (itself >= 0), else
    its nearest nodes, by one product per block as in `graph`: from the medoid alone a search ends in a dense blob."""
    out = np.full((len(q), max(2, min(most, len(v)))), -1, np.int64)
    medoid = int((v @ v.mean(0)).argmax())
    out[:, 0], out[:, 1] = medoid, np.where(itself == medoid, -1, itself)
    other = np.flatnonzero(itself < 0)
    for a in range(0, len(other), 500):
        rows = other[a : a + 500]
        k = min(most, len(v))
        out[rows, :2] = -1
        out[rows, :k] = np.argpartition(-(q[rows] @ v.T), k - 1, 1)[:, :k]
    return out


def search(v: np.ndarray, adjacent: np.ndarray, q: np.ndarray, start: np.ndarray, least: float, slack: float = 0.12, beam: int = 24, hops: int = 16):
    """Pairs (query, node) with cosine >= least, as they are found: a greedy search from the start nodes with a beam, and
    from all that it finds within `slack` of the range, over their neighbours again and again until none is new."""
    n = len(v)
    for a in range(0, len(q), 256):
        x = q[a : a + 256]
        m = len(x)
        ids, done = np.full((m, beam), -1, np.int64), np.zeros((m, beam), bool)
        ids[:, : start.shape[1]] = start[a : a + 256]
        sim = np.where(ids >= 0, np.einsum("qd,qkd->qk", x, v[np.maximum(ids, 0)]), -2.0)
        for _ in range(hops):
            open_sim = np.where(done | (ids < 0), -3, sim)
            pick = open_sim.argmax(1)
            live = np.flatnonzero(open_sim[np.arange(m), pick] > -3)
            if not len(live):
                break
            node = ids[live, pick[live]]
            done[live, pick[live]] = True
            nb = adjacent[node]
            nb_sim = np.where(nb >= 0, np.einsum("qd,qkd->qk", x[live], v[np.maximum(nb, 0)]), -2.0)
            all_ids, all_sim = np.concatenate([ids[live], nb], 1), np.concatenate([sim[live], nb_sim], 1)
            all_done = np.concatenate([done[live], np.zeros(nb.shape, bool)], 1)
            order = np.lexsort((~all_done, all_ids), axis=1)
            all_ids, all_sim, all_done = (np.take_along_axis(z, order, 1) for z in (all_ids, all_sim, all_done))
            again = np.zeros(all_ids.shape, bool)
            again[:, 1:] = all_ids[:, 1:] == all_ids[:, :-1]
            all_sim = np.where(again | (all_ids < 0), -2, all_sim)
            all_ids = np.where(again, -1, all_ids)
            top = np.argsort(-all_sim, 1, kind="stable")[:, :beam]
            ids[live], sim[live], done[live] = (np.take_along_axis(z, top, 1) for z in (all_ids, all_sim, all_done))
        r, c = np.nonzero((sim >= least - slack) & (ids >= 0))
        seen = np.unique(r * n + ids[r, c])
        front = seen
        while len(front):
            nb = adjacent[front % n]
            keys = ((front // n)[:, None] * n + nb)[nb >= 0]
            new = np.setdiff1d(keys, seen)
            near = np.concatenate([np.einsum("nd,nd->n", x[p // n], v[p % n]) >= least - slack for p in np.array_split(new, len(new) // 100_000 + 1)])
            front = new[near]
            seen = np.union1d(seen, front)
        r, c = seen // n, seen % n
        ok = np.concatenate([np.einsum("nd,nd->n", x[i], v[j]) >= least for i, j in zip(np.array_split(r, len(r) // 100_000 + 1), np.array_split(c, len(r) // 100_000 + 1))])
        yield r[ok] + a, c[ok]


@dataclass
class Cells:
    """Centres in two levels: the cells are those of the second, each under one of the first."""

    top: np.ndarray
    under: list[np.ndarray]
    centre: np.ndarray

    def nearest(self, x: np.ndarray, most: int, tops: int = 4) -> np.ndarray:
        """The `most` nearest cells of each unit vector, among those under its `tops` nearest first centres; -1 where there
        are fewer."""
        near = np.argsort(-(x @ self.top.T), 1, kind="stable")[:, :tops]
        out = np.full((len(x), most), -1, np.int64)
        for kind in np.unique(near, axis=0):
            rows = np.flatnonzero((near == kind).all(1))
            own = np.concatenate([self.under[k] for k in kind])
            best = np.argsort(-(x[rows] @ self.centre[own].T), 1, kind="stable")[:, :most]
            out[rows, : best.shape[1]] = own[best]
        return out


def k_means(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        some = np.bincount(near, minlength=len(centre)) > 0
        centre[some] = total[some]
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def fit_cells(x: np.ndarray, cells: int) -> Cells:
    """About `cells` centres, a fourth of the sample x at most: as many first ones as the square root, and others under each in
    proportion to what it holds."""
    cells = max(1, min(cells, len(x) // 4))
    top = k_means(x, max(1, round(cells**0.5)))
    own, under, centre = (x @ top.T).argmax(1), [], []
    for k in range(len(top)):
        some = x[own == k]
        found = k_means(some, max(1, round(cells * len(some) / len(x)))) if len(some) else top[k : k + 1]
        under.append(np.arange(len(found)) + sum(map(len, centre)))
        centre.append(found)
    return Cells(top, under, np.concatenate(centre))


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 1500, most_rows: int = 4000, index_shards: int = 2, query_shards: int = 3, sample_rows: int = 20_000, part_rows: int = 2500, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors; two rows link at a cosine of at least `least`.

    Equal vectors are one class, and vectors of each length are compared among themselves. Shards are cells of centres in two
    levels, fitted to a sample of at most about `sample_rows` vectors, a fourth as many cells at most; a length with less than
    `shard_rows` classes is one cell. Each class is indexed in its `index_shards` nearest cells and searched in its
    `query_shards` nearest. A cell of over `most_rows` classes is cut by a hash, and its queries go to every cut; queries of a
    cut go in parts of about `part_rows`, so that no task has those of a whole hot cell. Each shard builds a robust-pruned
    graph; the adjacency lists of a class's shards are united; a query that is itself a node starts from there and the
    shard's medoid, any other from its nearest nodes (`starts`), and both expand over everything in range. What is found
    is verified in double precision. Counts are not sent as pairs: of the shards where a pair meets, the first one counts it.

    The search may lose links (see `recall`). With exact=True none is lost: a class is compared with all classes of each
    cell that, by the triangle inequality of angles, may hold one in range. On vectors without structure these are most
    cells, so this is for audits and for tables where every link matters more than time.

    Null vectors, zero vectors and those with a null or non-finite component have no links and are components of their own;
    a null id takes no part; rows that repeat an id and a vector count as copies of each other. An empty table gives no rows;
    other columns are ignored.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    keyed = stored(own.withColumn("k", F.when(good, F.xxhash64("v"))))
    classes = stored(keyed.filter("k is not null").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v")))
    # Lengths with more classes than a shard has: fewer than there are shards.
    many = {r[0]: r[1] for r in classes.groupBy(F.size("v").alias("d")).count().filter(F.col("count") > shard_rows).collect()}
    total, fitted, first = sum(many.values()), {}, 0
    for d, m in sorted(many.items()):
        rate = min(1.0, sample_rows / total)
        sample = classes.filter((F.size("v") == d) & (F.pmod(F.col("k"), F.lit(1_000_003)) < rate * 1_000_003)).select("k", "v").toPandas().sort_values("k")
        if len(sample):
            fitted[d] = first, fit_cells(_unit(sample["v"]), -(-m // shard_rows))
            first += len(fitted[d][1].centre)
    radius: dict[int, float] = {}

    def place(batches, exact: bool = False):
        for b in batches:
            length = np.array([len(v) for v in b.column(2).to_pylist()])
            for d in np.unique(length):
                some = b.filter(pa.array(length == d))
                if d not in fitted:
                    order, angle = [[-int(d)]] * len(some), np.zeros(len(some))
                else:
                    begin, cells = fitted[d]
                    x = _unit(some.column(2).to_pylist())
                    near = cells.nearest(x, query_shards)
                    own = cells.centre[near[:, 0]]
                    angle = np.arccos(np.clip((x * own).sum(1), -1, 1))
                    if exact:
                        every = np.arccos(np.clip(x @ cells.centre.T, -1, 1)) <= np.array([radius.get(begin + k, -9.0) for k in range(len(cells.centre))]) + np.arccos(least) + 1e-6
                        order = [[begin + int(k), *(begin + np.flatnonzero(e & (np.arange(len(e)) != k))).tolist()] for k, e in zip(near[:, 0], every)]
                    else:
                        order = [(begin + r[r >= 0]).tolist() for r in near]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(order, pa.list_(pa.int64())), pa.array(angle)], ["k", "w", "v", "cells", "angle"])

    shape = "k long, w long, v array<double>, cells array<long>, angle double"
    placed = stored(classes.select("k", "w", "v").mapInArrow(place, shape))
    if exact:
        index_shards = 1
        radius |= {r[0]: r[1] for r in placed.filter(F.col("cells")[0] >= 0).groupBy(F.col("cells")[0]).agg(F.max("angle")).collect()}  # a row per cell, a fourth of sample_rows at most
        placed = stored(classes.select("k", "w", "v").mapInArrow(lambda batches: place(batches, True), shape))
    indexed = placed.select("k", "w", "v", "cells", F.explode(F.slice("cells", 1, index_shards)).alias("cell"))
    asked = placed.select("k", "w", "v", "cells", F.explode("cells").alias("cell"))
    cuts = stored(
        indexed.groupBy("cell").agg(F.ceil(F.count("*") / most_rows).alias("cuts"))
        .join(asked.groupBy("cell").agg(F.greatest(F.lit(1), F.round(F.count("*") / part_rows)).cast("long").alias("parts")), "cell")
    )
    # cuts has a row per cell, some bytes for every shard_rows vectors; Spark broadcasts it where that is small.
    nodes = indexed.join(cuts, "cell").withColumn("cut", F.pmod(F.xxhash64(F.lit(1), "k"), F.col("cuts")))

    def build(g: dict) -> dict:
        v = _unit(g["v"])
        adj = graph(v)
        return {"k": g["k"], "near": [g["k"][r[r >= 0]] for r in adj]}

    if exact:
        linked = nodes.withColumn("near", F.lit(None).cast("array<long>"))
    else:
        lists = by_key(nodes.select("cell", "cut", "k", "v"), ["cell", "cut"], build, "k long, near array<long>")
        united = stored(lists.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
        linked = nodes.join(united, "k")
    range_of = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    as_node = linked.select("cell", "cut", F.explode(range_of("parts")).alias("part"), "k", "w", "v", "cells", "near", F.lit(True).alias("node"))
    part = F.pmod(F.xxhash64(F.lit(2), "k"), F.col("parts"))
    queries = asked.join(cuts, "cell").select("cell", F.explode(range_of("cuts")).alias("cut"), part.alias("part"), "k", "w", "v", "cells", F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("node"))

    def find(g: dict) -> dict | None:
        nodes, ask = np.flatnonzero(g["node"]), np.flatnonzero(~g["node"].astype(bool))
        if not len(nodes) or not len(ask):
            return None
        nodes = nodes[np.argsort(g["k"][nodes])]
        v, keys, q = _unit(g["v"][nodes]), g["k"][nodes], _unit(g["v"][ask])
        if exact:
            pairs = ((r + a, c) for a in range(0, len(q), 256) for r, c in [np.nonzero(q[a : a + 256] @ v.T >= least)])
        else:
            width = max(max((len(x) for x in g["near"][nodes]), default=1), 1)
            adj = np.full((len(nodes), width), -1, np.int64)
            for i, x in enumerate(g["near"][nodes]):
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                adj[i, : len(x)] = np.where(keys[at] == x, at, -1)
            at = np.minimum(np.searchsorted(keys, g["k"][ask]), len(keys) - 1)
            pairs = search(v, adj, q, starts(v, q, np.where(keys[at] == g["k"][ask], at, -1)), least)
        total, forest, links = np.zeros(len(ask), np.int64), Forest(), []
        cell = int(g["cell"][0])

        def table(rows: np.ndarray, most: int) -> np.ndarray:
            out = np.full((len(rows), most), -1 << 62, np.int64)
            for i, x in enumerate(g["cells"][rows]):
                out[i, : min(most, len(x))] = x[:most]
            return out

        index_of, query_of = table(nodes, index_shards), table(ask, 1 if exact else query_shards)
        for r, c in pairs:
            other = keys[c] != g["k"][ask[r]]
            r, c = r[other], c[other]
            links += [(a, b) for a, b in zip(g["k"][ask[r]].tolist(), keys[c].tolist()) if forest.join(a, b)]
            if not exact:
                # The pair counts here if no earlier cell of the query's also indexes the node.
                meets = np.stack([(index_of[c] == query_of[r, k : k + 1]).any(1) for k in range(query_of.shape[1])], 1)
                mine = query_of[r, meets.argmax(1)] == cell
                r, c = r[mine], c[mine]
            np.add.at(total, r, g["w"][nodes[c]])
        some = np.flatnonzero(total)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        own = g["k"][ask[some]]
        return {"a": np.concatenate([own, a]), "b": np.concatenate([own, b]), "n": np.concatenate([total[some], np.zeros(len(a), np.int64)])}

    found = stored(by_key(as_node.unionByName(queries), ["cell", "cut", "part"], find, "a long, b long, n long"))
    label = components(found.filter("n = 0").select("a", "b"))
    per_class = (
        classes.select("k", "rep", "w")
        .join(found.filter("n > 0").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("n")), "k", "left")
        .join(label.withColumnRenamed("node", "k"), "k", "left")
        .select("k", "rep", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "k").alias("g"))
    )
    least_id = per_class.groupBy("g").agg(F.min("rep").alias("component_id"))
    result = per_class.join(least_id, "g").select("k", "n_links", "component_id")
    out = keyed.select("vec_id", F.coalesce("k", F.xxhash64("vec_id")).alias("_k"), F.col("k").isNull().alias("alone")).join(result, F.col("_k") == F.col("k"), "left")
    alone = F.col("alone") | F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def recall(vectors: DataFrame, found: DataFrame, least: float = 0.9, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2000) -> DataFrame:
    """links, found, recall of the rows whose id is divisible by `every`, against all rows by brute force, in blocks of
    `block` queries by `block` rows; links found beyond the true ones of a row don't count. Vectors that can't link are passed
    over."""
    kind = pa.schema([("d", pa.int64()), ("ids", pa.binary()), ("v", pa.binary())])

    def blocks(batches):
        held: dict[int, list] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
                    held.setdefault(len(v), []).append((i, v))
                    if len(held[len(v)]) == block:
                        yield made(len(v), held.pop(len(v)))
        for d, some in held.items():
            yield made(d, some)

    def made(d: int, some: list) -> pa.RecordBatch:
        ids, v = zip(*some)
        return pa.RecordBatch.from_arrays([pa.array([d]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([_unit(v).tobytes()])], schema=kind)

    def count(batches):
        for b in batches:
            for d, ids, v, own, w in zip(*(b.column(k).to_pylist() for k in range(5))):
                ids, own = np.frombuffer(ids, np.int64), np.frombuffer(own, np.int64)
                near = np.frombuffer(v).reshape(-1, d) @ np.frombuffer(w).reshape(-1, d).T >= least
                near &= ids[:, None] != own[None]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.sum(1))], ["vec_id", "n"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    cut = lambda df: df.mapInArrow(blocks, "d long, ids binary, v binary")
    asked, against = cut(rows.filter(F.col("vec_id") % every == 0).repartition(8)), cut(rows).select("d", F.col("ids").alias("own"), F.col("v").alias("w"))
    truth = asked.join(against, "d").select("d", "ids", "v", "own", "w").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    return truth.join(found, "vec_id").agg(F.sum("n").alias("links"), F.sum(F.least("n", "n_links")).alias("found")).withColumn("recall", F.when(F.col("links") > 0, F.col("found") / F.col("links")).otherwise(F.lit(1.0)))
