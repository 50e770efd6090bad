"""N-gram Jaccard join: signature trees over the sets of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, mix, pieces, shingles, stored, words
from .components import Forest, components
from .lm import Counter

_U = np.uint64
LEAF, FAN = 16, 8


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h, at = shingles(*words(column), n)
    for a, b in zip(at[:-1], at[1:]):
        yield np.unique(h[a:b])


def class_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(s: np.ndarray, room: int = 4) -> np.ndarray:
    """A bitmap of 256 bits or more, a power of two of at least `room` times the set's size."""
    m = max(256, 1 << (room * len(s) - 1).bit_length())
    bits = np.zeros(m, bool)
    bits[s & _U(m - 1)] = True
    return np.packbits(bits, bitorder="little")


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap over `size` bytes, where halves are OR-combined; a power of two of bits folds onto a smaller one."""
    v = np.frombuffer(bits, np.uint8)
    return np.bitwise_or.reduce(v.reshape(-1, size), axis=0)


class Tree:
    """A signature tree over sets: each node has the OR of its sets' bitmaps, the range of their sizes, and the most by
    which a set is larger than its bitmap."""

    def __init__(self, n: np.ndarray, bits: np.ndarray) -> None:
        over = n - np.bitwise_count(bits).sum(1)
        self.levels, self.steps = [(n, n, over, bits)], []
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            lo, hi, over, bits = self.levels[-1]
            cut = np.arange(0, len(lo), step)
            self.levels.append((np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(over, cut), np.bitwise_or.reduceat(bits, cut, axis=0)))
            self.steps.append(step)
            step = FAN

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level the label that all sets below a node have; -1 where they differ."""
        out = [label]
        for step in self.steps:
            cut = np.arange(0, len(out[-1]), step)
            lo, hi = np.minimum.reduceat(out[-1], cut), np.maximum.reduceat(out[-1], cut)
            out.append(np.where(lo == hi, lo, -1))
        return out


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some sets under nodes i of level a and nodes j of level b may reach the similarity."""
    ok = 100 * np.minimum(a[1][i], b[1][j]) >= percent * np.maximum(a[0][i], b[0][j])
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    most = np.bitwise_count(a[3][i] & b[3][j]).sum(1, dtype=np.int64) + np.minimum(a[2][i], b[2][j])
    ok[at] = most * (100 + percent) >= percent * (a[0][i] + b[0][j])
    return ok


def dual(a: Tree, b: Tree, percent: int, same: bool, labels: Callable[[], tuple[list, list]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that may be similar, from both trees' roots down, a few thousand at a time. Node pairs whose sets all
    have one label, by what labels() says at the time, are left out."""
    most = max(256, min(8192, (8 << 20) // (8 * a.levels[0][3].shape[1])))
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        own, other = (x[level][k] for x, level, k in zip(labels(), (la, lb), (i, j)))
        keep = (own < 0) | (own != other)
        if same:
            keep &= i < j if la == lb == 0 else i <= j
        i, j = i[keep], j[keep]
        ok = possible(a.levels[la], b.levels[lb], i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == lb == 0:
            yield i, j
            continue
        down_a, down_b = la >= lb, lb >= la
        if down_a:
            step, la = a.steps[la - 1], la - 1
            i, j = (i[:, None] * step + np.arange(step)).ravel(), np.repeat(j, step)
        if down_b:
            step, lb = b.steps[lb - 1], lb - 1
            i, j = np.repeat(i, step), (j[:, None] * step + np.arange(step)).ravel()
        keep = (i < len(a.levels[la][0])) & (j < len(b.levels[lb][0]))
        i, j = i[keep], j[keep]
        stack += [(la, lb, i[x : x + most], j[x : x + most]) for x in range(0, len(i), most)]


def connect(n: np.ndarray, bits: list, label: np.ndarray, percent: int, test: Callable | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The pairs that join sets to components, no more than there are sets, and the component of each.

    Two sets link where the dual traversal can't rule them out and test(i, j), if there is one, confirms it. Sets that
    share a label count as joined before. Sets whose bitmaps are of one width are in one tree, so that no bitmap is
    folded onto much fewer bits than it has; trees meet where their widths allow the similarity."""
    label = np.unique(label, return_inverse=True)[1].reshape(-1)
    wide, found, up = np.array([len(b) for b in bits]), [], np.arange(len(n))

    def tree(width: int, size: int) -> tuple[Tree, np.ndarray]:
        own = np.flatnonzero(wide == width)
        own = own[np.argsort(n[own], kind="stable")]
        return Tree(n[own].astype(np.int64), np.stack([folded(bits[k], size) for k in own]).view(_U)), own

    widths = np.unique(wide)
    for w in widths:
        for v in widths[(widths >= w) & (percent * widths <= 200 * w)]:
            t, p = tree(w, w)
            u, q = (t, p) if v == w else tree(v, w)
            now = [t.uniform(label[p]), u.uniform(label[q])]
            for i, j in dual(t, u, percent, v == w, lambda now=now: now):
                i, j = p[i], q[j]
                if test:
                    ok = test(i, j)
                    i, j = i[ok], j[ok]
                forest, edges = Forest(), []
                for a, b, x, y in zip(i.tolist(), j.tolist(), label[i].tolist(), label[j].tolist()):
                    if x != y and forest.join(x, y):
                        edges.append((a, b))
                if edges:
                    found += edges
                    up = np.arange(len(n))
                    for x in list(forest.up):
                        up[x] = forest.root(x)
                    label = up[label]
                    now[:] = t.uniform(label[p]), u.uniform(label[q])
    return found, label


class Exact:
    """Whether whole sets reach the similarity. Shingles that only one of the sets has don't count; the others are numbered
    and, where that takes less memory than a bound, kept as exact bitmaps."""

    def __init__(self, some: list[np.ndarray], percent: int, most_bytes: int = 64 << 20) -> None:
        self.n, self.percent, self.bits = np.array([len(s) for s in some]), percent, None
        _, inverse, count = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
        shared, width = (np.cumsum(count > 1) - 1), int((count > 1).sum())
        keep = count[inverse] > 1
        row = np.repeat(np.arange(len(some)), self.n)[keep]
        column = shared[inverse[keep]]
        at = np.searchsorted(row, np.arange(len(some) + 1))
        self.sets = [column[a:b] for a, b in zip(at[:-1], at[1:])]  # in order, as numbers follow the hashes
        size = -(-max(width, 1) // 64) * 8
        if size * len(some) <= most_bytes:
            self.bits = np.zeros((len(some), size), np.uint8)
            for k, s in enumerate(self.sets):
                line = np.zeros(size * 8, bool)
                line[s] = True
                self.bits[k] = np.packbits(line)
            self.bits = self.bits.view(_U)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.bits is None:
            both = np.array([len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
        else:
            step = max(1, (8 << 20) // (8 * self.bits.shape[1]))
            both = np.concatenate([np.bitwise_count(self.bits[i[x : x + step]] & self.bits[j[x : x + step]]).sum(1, dtype=np.int64) for x in range(0, len(i), step)])
        return 100 * both >= self.percent * (self.n[i] + self.n[j] - both)


def cut(sizes: np.ndarray, most_rows: int, most_shingles: int) -> list[tuple[int, int]]:
    """Runs of sets with at most most_rows of them and about most_shingles in all."""
    total, out, i = np.cumsum(sizes), [], 0
    while i < len(sizes):
        j = min(i + most_rows, max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most_shingles, "right"))))
        out.append((i, j))
        i = j
    return out


def united(lists: list[tuple[np.ndarray, np.ndarray]], most_rows: int, most_shingles: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lists of sets (keys, sizes) combined, the largest first, as long as their union keeps the bounds. Two sets that are in
    a list together are so in a combined one."""
    out, held, room = [], {}, 0
    for k, m in sorted(lists, key=lambda x: (-len(x[0]), x[0].tobytes())):
        new = {a: b for a, b in zip(k.tolist(), m.tolist()) if a not in held}
        if held and (len(held) + len(new) > most_rows or room + sum(new.values()) > most_shingles):
            out.append(held)
            held, room, new = {}, 0, dict(zip(k.tolist(), m.tolist()))
        held |= new
        room += sum(new.values())
    out += [held] if held else []
    order = [sorted(x) for x in out]
    return [(np.array(o, np.int64), np.array([x[a] for a in o], np.int32)) for o, x in zip(order, out)]


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 4096, most_shingles: int = 2_000_000, most_common: int = 1_000_000, split_rows: int = 200_000, shard_chars: int = 16_000_000, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: documents link when their sets of n-word shingles have
    100 * intersection >= percent * union; a component is named by its least doc_id.

    Documents with the same set are one class. By any fixed order of shingles, two similar sets share one among the
    first size - ceil(percent % of size) + 1 of each; the order here is common shingles last, and by hash within both, so
    classes meet in the lists of rare shingles. Equal lists are one, and lists with the same least class are combined up to
    `most_rows` classes and `most_shingles` shingles. Each list's bitmaps go into signature trees, and a dual traversal
    gives the groups of classes that may be similar; such groups, equal ones once, get the whole sets, traverse their trees
    again and compare the pairs that are left, exactly and in place. Pairs that are joined already are passed over, and
    a group gives only the links that join its classes, fewer than classes, so a large group costs no more rows than it has.

    A list beyond the bounds is cut into blocks, which are such lists. Of its classes outside the component that most of them
    are then in, each block of at most `most_rows` is compared with each block of the list; so none of its links is lost, and
    this grows with the square of such outsiders only. The list of a shingle that is common in more than `split_rows`
    classes is dealt over several tasks. Shingles have 64-bit hashes. The list of common shingles is bounded by `most_common`
    and only changes the order; ids of classes to verify are broadcast up to `most_broadcast`, beyond it joined by shuffle.

    Null and empty texts, or such without words, have size 0, link with nothing and are components of their own. Equal
    rows share a class; a null id is ignored where a group has another. Ids are integers; an empty table gives no rows;
    other columns are ignored; texts are read whole.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "k", "bits", "h", "c"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        held, seen = Counter(1_500_000), set()

        def common() -> pa.RecordBatch:
            h, c = held.take()
            seen.clear()
            keep = c >= 3
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([None], [None], [None], [None], [h[keep].tobytes()], [c[keep].tobytes()]), kinds)], names)

        for b in batches:
            for x in pieces(b, "text", 4 << 20):
                size, key, bits, new = [], [], [], []
                for s in sets(x.column(1), n):
                    size.append(len(s))
                    key.append(k := class_key(s))
                    bits.append(bitmap(s).tobytes() if len(s) else b"")
                    if k not in seen:
                        seen.add(k)
                        new.append(s)
                none = [None] * len(size)
                yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(v, t) for v, t in zip((size, key, bits, none, none), kinds[1:]))], names)
                if new and held.add(np.concatenate(new)):
                    yield common()
        yield common()

    described = stored(own.mapInArrow(describe, "doc_id long, n long, k long, bits binary, h binary, c binary"))
    own_class = described.filter("h is null").select("doc_id", "n", "k")
    chars = described.agg(F.sum("n")).first()[0] or 0

    # The common shingles, at most most_common of them: counted per value, the least count is set so that they fit.
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["h", "c"])

    found = described.filter("h is not null").select("h", "c").mapInArrow(unpack, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    by_size = found.groupBy(F.floor(F.log2("c") * 4).alias("q")).count().orderBy(F.desc("q")).collect()  # some hundred rows at most
    least, total = None, 0
    for q, m in by_size:
        total += m
        if total > most_common:
            break
        least = q
    common = found.filter(F.floor(F.log2("c") * 4) >= (least if least is not None else 1000)).select("h", "c").toPandas()
    h = common["h"].to_numpy(dtype=np.int64).view(_U)
    order = np.argsort(h)
    hot = spark.sparkContext.broadcast((h[order], -(-common["c"].to_numpy(dtype=np.int64)[order] // split_rows)))

    # The lists: the classes that have a shingle among their first, dealt by shingle.
    shards = max(1, -(-chars * 5 // shard_chars))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[int] = set()
        common, parts = hot.value

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, k, m, part = (np.concatenate(v) for v in zip(*held))
                held.clear()
                seen.clear()
                shard = (h >> _U(32)).astype(np.int64) * shards >> 32
                alone = part >= 0  # a part of a shingle's list that is dealt over several tasks has one for itself
                shard[alone] = -1 - (mix(h[alone] + part[alone].astype(_U)) >> _U(1)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                h, k, m, shard = h[order], k[order], m[order], shard[order]
                at = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
                rows = [(int(shard[a]), h[a:b].tobytes(), k[a:b].tobytes(), m[a:b].tobytes(), bool(shard[a] < 0)) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()))], ["shard", "h", "k", "m", "split"])

        total = 0
        for b in batches:
            for x in pieces(b, "text", 4 << 20):
                for s in sets(x.column(0), n):
                    if not len(s) or (k := class_key(s)) in seen:
                        continue
                    seen.add(k)
                    want = len(s) - -(-percent * len(s) // 100) + 1
                    i = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
                    is_hot = common[i] == s if len(common) else np.zeros(len(s), bool)
                    rare = s[~is_hot][:want]
                    part = np.full(len(rare), -1)
                    if len(rare) < want:
                        more = np.flatnonzero(is_hot)[: want - len(rare)]
                        many = parts[i[more]]
                        rare = np.concatenate([rare, s[more]])
                        part = np.concatenate([part, np.where(many > 1, np.int64(k & 0x7FFFFFFF) % many, -1)])
                    held.append((mix(rare * _U(0x9E3779B97F4A7C15)), np.full(len(rare), k), np.full(len(rare), len(s), np.int32), part))
                    total += len(rare)
                if total > 1_000_000:
                    yield from flush()
                    total = 0
        yield from flush()

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        """A shard's lists: least, the class by which they are combined; or, of one that is cut, big and the blocks."""
        h, k, m = (np.concatenate([np.frombuffer(v, t) for v in pdf[c]]) for c, t in (("h", _U), ("k", np.int64), ("m", np.int32)))
        order = np.lexsort((k, m, h))
        h, k, m = h[order], k[order], m[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
        h, k, m = h[new], k[new], m[new]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        split = bool(pdf["split"].iloc[0])
        many = np.flatnonzero(np.diff(at) > (0 if split else 1))
        by_least, out, seen = {}, [], set()
        for a, b in zip(at[many].tolist(), at[many + 1].tolist()):
            v, size = k[a:b], m[a:b]
            name = v.tobytes() if b - a < 9 else hashlib.blake2b(v.tobytes(), digest_size=16).digest()
            if name in seen and not split:
                continue
            seen.add(name)
            blocks = cut(size, most_rows, most_shingles)
            if len(blocks) > 1 or split:
                big = int(h[a].astype(np.int64))
                out += [(None, big, class_key(v[i:j]), v[i:j], size[i:j]) for i, j in blocks]
            else:
                by_least.setdefault(int(v.min()), []).append((v, size))
        out += [(x, None, None, *y) for x, some in by_least.items() for y in united(some, most_rows, most_shingles)]
        return pd.DataFrame(out, columns=["least", "big", "block", "members", "sizes"]).astype({"least": "Int64", "big": "Int64", "block": "Int64"})

    shuffled = own.select("text").mapInArrow(prefixes, "shard long, h binary, k binary, m binary, split boolean").groupBy("shard")
    found_lists = stored(shuffled.applyInPandas(lists, "least long, big long, block long, members array<long>, sizes array<int>"))

    def combine(g: dict) -> dict:
        out = united(list(zip(g["members"], g["sizes"])), most_rows, most_shingles)
        return {"list": np.repeat(np.array([class_key(k) for k, _ in out]), [len(k) for k, _ in out]), "k": np.concatenate([k for k, _ in out])}

    small = by_key(found_lists.filter("big is null").select("least", "members", "sizes"), ["least"], combine, "list long, k long")
    in_block = found_lists.filter("big is not null").select("big", "block", F.explode("members").alias("k"))
    placed = small.unionByName(in_block.select(F.xxhash64("big", "block").alias("list"), "k"))
    signs = described.filter("h is null and n > 0").groupBy("k").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))

    def candidates(g: dict) -> dict | None:
        if len(g["k"]) < 2:
            return None
        edges, label = connect(g["n"], list(g["bits"]), np.arange(len(g["k"])), percent)
        if not edges:
            return None
        order = np.lexsort((g["k"], label))
        label, k = label[order], g["k"][order]
        at = np.append(np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])), len(label))
        groups = [k[a:b] for a, b in zip(at[:-1], at[1:]) if b - a > 1]
        return {"g": np.repeat(np.array([class_key(x) for x in groups]), [len(x) for x in groups]), "k": np.concatenate(groups)}

    groups = stored(by_key(placed.join(signs, "k"), ["list"], candidates, "g long, k long").distinct())
    reps = own_class.groupBy("k").agg(F.min("doc_id").alias("rep"))

    def whole_sets(keys: DataFrame) -> DataFrame:
        """k, s: the whole sets of those classes, made anew from one text of each."""
        wanted = stored(keys.distinct().join(reps, "k").select("k", "rep"))
        small = wanted.count() <= most_broadcast

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in pieces(b, "text", 4 << 20):
                    some = list(sets(x.column(1), n))
                    keys = x.column(0).to_pylist()
                    keep = [i for i, s in enumerate(some) if class_key(s) == keys[i]]  # rows may share an id
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in keep], pa.int64()), pa.array([some[i].tobytes() for i in keep], pa.binary())], ["k", "s"])

        texts = own.join(F.broadcast(wanted) if small else wanted, own["doc_id"].eqNullSafe(wanted["rep"])).select("k", "text")
        return texts.mapInArrow(whole, "k long, s binary").dropDuplicates(["k"])

    def joined(g: dict) -> dict | None:
        some = [np.frombuffer(s, _U) for s in g["s"]]
        edges, _ = connect(np.array([len(s) for s in some]), [bitmap(s).tobytes() for s in some], g["c"], percent, Exact(some, percent))
        return {"a": g["k"][[a for a, _ in edges]], "b": g["k"][[b for _, b in edges]]} if edges else None

    def links_of(tasks: DataFrame) -> DataFrame:
        """The links a, b that join the classes k of each task g, but for those that share a component c."""
        full = stored(whole_sets(tasks.select("k")))
        return stored(by_key(tasks.join(full, "k"), ["g"], joined, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    links = links_of(groups.withColumn("c", F.col("k")))
    label = components(links)
    if not in_block.isEmpty():
        tasks = stored(outsiders(in_block, label, most_rows))
        if not tasks.isEmpty():
            label = components(links.unionByName(links_of(tasks)))
    named = reps.join(label, reps["k"] == label["node"], "left").select("k", "rep", F.coalesce("component", "k").alias("g"))
    least_id = named.groupBy("g").agg(F.min("rep").alias("component_id"))
    to_id = named.join(least_id, "g").select("k", "component_id")
    return own_class.join(to_id, "k").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def outsiders(in_block: DataFrame, label: DataFrame, most_rows: int) -> DataFrame:
    """g, k, c: tasks that compare the classes of a cut list (big, block, k) outside its largest component c with all of it:
    blocks of them, by a hash, against each block of the list."""
    every = stored(in_block.join(label.withColumnRenamed("node", "k"), "k", "left").select("big", "block", "k", F.coalesce("component", "k").alias("c")))
    sizes = every.groupBy("big", "c").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("big").agg(F.max_by("c", F.struct("m", "c")).alias("top"), (F.sum("m") - F.max("m")).alias("rest")).filter("rest > 0")
    out = every.join(largest, "big").filter("c <> top").select("big", F.pmod(F.xxhash64("k"), F.ceil(F.col("rest") / most_rows)).alias("part"), "k", "c")
    tasks = out.select("big", "part").distinct().join(every.select("big", "block").distinct(), "big")
    sides = tasks.join(out, ["big", "part"]).select("big", "part", "block", "k", "c").unionByName(tasks.join(every, ["big", "block"]).select("big", "part", "block", "k", "c"))
    return sides.distinct().select(F.xxhash64("big", "part", "block").alias("g"), "k", "c")
