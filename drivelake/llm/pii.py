"""Personal data: patterns, and a skip-chain conditional random field over what resembles them."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

KINDS = ("email", "ip", "card", "phone")
# A match of ip or card can't begin within a run of digits, as it would begin with the run; the look behind keeps long
# runs from being tried at each of their digits.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SIGN = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
SPACE = "\x20\t\n\x0b\x0c\r"
#: An address whose @ or dots are written out in brackets.
WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[\[({] ?(?:at|@) ?[\])}] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?:dot|\.) ?[\])}] ?)[A-Za-z0-9-]+)+", re.I)
#: An ip whose dots stand apart or in brackets.
SPACED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[({]?\.[\])}]? ?[0-9]{1,3}){3}(?![0-9])")
ANY = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.I)
TRIM = "\"'`.,;:!?|#$%&*<>[]{}="
LABELS = len(KINDS) + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind and end of what the patterns find, leftmost and without overlap within each kind."""
    out = []
    for kind, name in enumerate(KINDS):
        if name == "email":
            # A match holds an @: it is looked for around each, from the first place after the match before it.
            at, last = text.find("@"), 0
            while at >= 0:
                a = at
                while a > last and text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
                    a -= 1
                m = PATTERNS[name].match(text, a)
                if m:
                    out.append((m.start(), kind, m.end()))
                    last = m.end()
                at = text.find("@", max(at + 1, last))
        elif name == "phone" and "+" not in text:
            continue
        else:
            out += [(m.start(), kind, m.end()) for m in PATTERNS[name].finditer(text) if valid(name, m[0])]
    return sorted(out)


def nodes(text: str) -> np.ndarray:
    """Start and end of addresses that are written out, ips whose dots stand apart, and runs of tokens with a digit or an @, one
    space apart, without the marks around them. Each character is looked at a few times at most, however long a token is."""
    written = sorted(m.span() for p in (WRITTEN, SPACED) for m in p.finditer(text))
    written = [x for k, x in enumerate(written) if not k or x[0] >= written[k - 1][1]]
    out = array("q", (v for x in written for v in x))
    k, last, since, until = 0, 0, 0, -1

    def ended(a: int, b: int) -> None:
        while a < b and text[a] in TRIM:
            a += 1
        while a < b and text[b - 1] in TRIM:
            b -= 1
        if b > a:
            out.extend((a, b))

    for m in SIGN.finditer(text):
        a, b = max(text.rfind(c, last, m.start()) + 1 for c in SPACE), m.end()
        a, last = max(a, last), b
        while k < len(written) and written[k][1] <= a:
            k += 1
        if k < len(written) and written[k][0] < b:
            continue
        if a - until == 1 and text[until] == " ":
            until = b
        else:
            if until >= 0:
                ended(since, until)
            since, until = a, b
    if until >= 0:
        ended(since, until)
    spans = np.frombuffer(out, np.int64).reshape(-1, 2) if len(out) else np.zeros((0, 2), np.int64)
    return spans[np.lexsort((spans[:, 1], spans[:, 0]))]


def form(s: str) -> str:
    """What tokens must share to be similar: an address without the ways to write it; the four numbers of an ip; the last
    seven digits of longer numbers, so that a phone number is found without its prefix; fewer digits, or the text."""
    s = s.lower()
    if re.search(r"@|[\[({] ?at ?[\])}]", s):
        return re.sub(r" ?[\[({] ?dot ?[\])}] ?", ".", re.sub(r" ?[\[({] ?at ?[\])}] ?", "@", s)).strip(TRIM + " ")
    digits = re.findall("[0-9]+", s)
    if len(digits) == 4 and all(len(d) <= 3 for d in digits) and re.fullmatch(r"[0-9.\[\](){} dot]+", s):
        return ".".join(digits)
    return "".join(digits)[-7:] or s


def skips(text: str, spans: np.ndarray) -> np.ndarray:
    """Each node with the first one of a similar form, so that all that share a form are two steps apart at most."""
    hub: dict[str, int] = {}
    of = lru_cache(1 << 14)(form)
    first = np.fromiter((hub.setdefault(of(text[a:b]), k) for k, (a, b) in enumerate(zip(spans[:, 0].tolist(), spans[:, 1].tolist()))), np.int64, len(spans))
    again = np.flatnonzero(first != np.arange(len(spans)))
    return np.stack([first[again], again], 1)


def features(text: str, a: int, b: int) -> tuple[float, ...]:
    before = text[max(0, a - 12) : a].rstrip()[-1:] in ("=", '"')
    return (_known if b - a <= 64 else _features)(text[a:b], before)


def _features(s: str, after_sign: bool) -> tuple[float, ...]:
    digits = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isalpha() for c in s)
    n = len(s)
    dots, at = s.count("."), s.count("@")
    written = bool(WRITTEN.fullmatch(s))
    four = letters == 0 and SPACED.fullmatch(s) is not None
    return (1.0, digits / n, letters / n, min(digits, 24) / 8, at == 1, at > 1, s.startswith("+"), dots == 3 and letters == 0, at == 1 and "." in s.partition("@")[2], s.count("-") / 4, "(" in s, min(s.count(" "), 8) / 4, 10 <= digits <= 13, 14 <= digits <= 19, digits > 19, digits < 7, letters == 0, after_sign, min(n, 64) / 32, written, four, 7 <= digits <= 9, 14 <= digits <= 19 and letters == 0 and luhn("".join(c for c in s if "0" <= c <= "9")))


_known = lru_cache(1 << 14)(_features)


@dataclass
class Field:
    """Weights of the features per label, and log potentials between neighbours and across a skip."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self, text: str, spans: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
        """Each node's own potential of each label; features are made for some nodes at a time."""
        phi = np.empty((len(spans), LABELS), np.float32)
        for k in range(0, len(spans), at_once):
            phi[k : k + at_once] = np.array([features(text, a, b) for a, b in spans[k : k + at_once].tolist()], float) @ self.unary
        return phi

    def beliefs(self, phi: np.ndarray, links: np.ndarray, known: np.ndarray, rounds: int = 10) -> np.ndarray:
        """Label probabilities of each node by loopy belief propagation over the chain and the skip links. known has the
        labels that are certain, 0 elsewhere. All edges of a kind share its potential, and a node keeps some 400 bytes."""
        phi = phi.copy()
        certain = np.flatnonzero(known)
        phi[certain, known[certain]] += 20
        n = len(phi)
        chain, skip = np.exp(self.chain).astype(np.float32), np.exp(self.skip).astype(np.float32)
        # Messages along the chain to the next and the one before, and across skips to the later and the first.
        on, back = np.zeros((max(n - 1, 0), LABELS), np.float32), np.zeros((max(n - 1, 0), LABELS), np.float32)
        i, j = links[:, 0], links[:, 1]
        later, first = np.zeros((len(links), LABELS), np.float32), np.zeros((len(links), LABELS), np.float32)

        def summed() -> np.ndarray:
            b = phi.copy()
            b[1:] += on
            b[:-1] += back
            b[j] += later  # a node has one first
            for c in range(LABELS):
                b[:, c] += np.bincount(i, first[:, c], n).astype(np.float32)
            return b

        for _ in range(rounds):
            b = summed()
            new_on, new_back = _sent(b[:-1] - back, chain), _sent(b[1:] - on, chain.T)
            new_later, new_first = _sent(b[i] - first, skip), _sent(b[j] - later, skip.T)
            for old, new in ((on, new_on), (back, new_back), (later, new_later), (first, new_first)):
                old += new
                old *= 0.5
        b = summed()
        p = np.exp(b - b.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _sent(x: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Log messages through a potential, the greatest of each 0. x has the logs of what is sent, psi is no log."""
    if not len(x):
        return x
    most = lambda v: np.maximum.reduce([v[:, c] for c in range(LABELS)])[:, None]  # noqa: E731  (faster than along short rows)
    out = np.log(np.exp(x - most(x)) @ psi)
    return out - most(out)


def label_of(base: list[tuple[int, int, int]], a: int, b: int) -> int:
    """The kind that covers most of a node, by the patterns; 0 where none covers half of it."""
    most, kind = 0, 0
    for s, k, e in base:
        got = min(e, b) - max(s, a)
        if got > most:
            most, kind = got, k + 1
    return kind if 2 * most >= b - a else 0


def weaker(kind: int, s: str, rng: np.random.Generator) -> str:
    """A mention that the patterns miss: an address written out, an ip in brackets, a number with other marks or without
    its prefix."""
    pick = lambda *some: some[rng.integers(len(some))]
    digits = re.sub("[^0-9]", "", s)
    if KINDS[kind] == "email":
        name, _, host = s.partition("@")
        return name + pick(" (at) ", "[at]", " [at] ", "(at)") + (host if rng.random() < 0.5 else host.replace(".", pick(" (dot) ", "[dot]", " [dot] ")))
    if KINDS[kind] == "ip":
        return s.replace(".", pick("[.]", " . ", "(.)"))
    if KINDS[kind] == "card":
        return pick(".", "/", "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return pick(digits, digits[-10:], digits[-7:], f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}")


def practice(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A text to learn from, and its entities as start, kind, end: the text with weaker mentions of its base spans, and with
    other numbers of like shapes, once or again, put in between words."""
    own, more = base_spans(text), []
    for a, k, b in own:
        if rng.random() < 0.7:
            more += [(k, weaker(k, text[a:b], rng)) for _ in range(rng.integers(1, 3))]
    for _ in range(rng.integers(0, 3)):
        n = int(rng.choice([2, 4, 5, 7, 10, 11, 13, 16]))
        plain = "".join(map(str, rng.integers(0, 10, n)))
        if n >= 14 and luhn(plain):
            continue
        shape = rng.integers(4)
        plain = plain if shape < 2 or n < 7 else f"{plain[:-4]}-{plain[-4:]}" if shape == 2 else f"{plain[:-7]}.{plain[-7:-4]}.{plain[-4:]}".strip(".")
        more += [(-1, plain)] * int(rng.integers(1, 3))
    if not own or not more:
        return text, own
    out, spans = [text], own
    total = len(text)
    for j in rng.permutation(len(more)):
        k, s = more[j]
        out.append(f" word {s} other")
        if k >= 0:
            spans = [*spans, (total + 6, k, total + 6 + len(s))]
        total += len(out[-1])
    return "".join(out), spans


def labels_of(spans: np.ndarray, entities: list[tuple[int, int, int]]) -> np.ndarray:
    """Each node's label by entities in order of their start."""
    ends = np.maximum.accumulate(np.array([e for _, _, e in entities] or [0]))
    y = np.zeros(len(spans), np.int64)
    # Only nodes that end after an entity begins and begin before one ends can have a label.
    starts = np.sort([a for a, _, _ in entities] or [0])
    touched = np.searchsorted(starts, spans[:, 1], "left") > np.searchsorted(ends, spans[:, 0], "right") if entities else y
    for k in np.flatnonzero(touched).tolist():
        a, b = spans[k].tolist()
        i = j = int(np.searchsorted(ends, a, "right"))
        while j < len(entities) and entities[j][0] < b:
            j += 1
        y[k] = label_of(entities[i:j], a, b)
    return y


def examples(text: str, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows to learn from: a node's features and the labels of its neighbours before and after and across skips; and labels.
    Of more than `most` nodes as many are drawn evenly from the whole text."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    text, entities = practice(text, rng)
    spans = nodes(text)
    if not len(spans):
        return None
    y = labels_of(spans, sorted(entities))
    one = np.eye(LABELS)[y]
    around, across = np.zeros((len(spans), 2 * LABELS)), np.zeros((len(spans), LABELS))
    around[1:, :LABELS], around[:-1, LABELS:] = one[:-1], one[1:]
    for i, j in skips(text, spans).tolist():
        across[i] += one[j]
        across[j] += one[i]
    across /= np.maximum(across.sum(1, keepdims=True), 1)
    keep = np.sort(rng.choice(len(spans), min(most, len(spans)), replace=False))
    x = np.array([features(text, a, b) for a, b in spans[keep].tolist()], float)
    return np.concatenate([x, around[keep], across[keep]], 1), y[keep]


def fit(docs: DataFrame, sample_rows: int = 3000, sample_nodes: int = 200, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field learned from about `sample_rows` documents that hold a digit or an @, drawn by a hash of id and text, and at
    most `sample_nodes` nodes of each, drawn from the whole text.

    Labels come from the patterns; as the patterns can't teach what they miss, each drawn text also gets weaker mentions of
    its own entities and other numbers (practice). All potentials, those of chain and skip links too, are learned together by
    pseudo-likelihood: a node's label is predicted from its features and the labels that it is linked with. Only short rows
    of numbers reach the driver."""
    some = docs.filter(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col)).alias("h"))
    n = some.count()
    drawn = some.filter(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * min(1.0, sample_rows / max(n, 1)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, x, y = [], [], []
            for t, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = examples(t, sample_nodes)
                if got:
                    h.append(key)
                    x.append(got[0].astype(np.float32).tobytes())
                    y.append(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.list_(pa.int32()))], ["h", "x", "y"])

    got = drawn.mapInArrow(describe, "h long, x binary, y array<int>").toPandas().sort_values(["h", "x"], kind="stable")
    width = len(features("0", 0, 1))
    w = np.zeros((width + 3 * LABELS, LABELS))
    w[0, 0] = 3.0
    if len(got):
        x = np.concatenate([np.frombuffer(v, np.float32).reshape(-1, width + 3 * LABELS) for v in got["x"]]).astype(float)
        target = np.eye(LABELS)[np.concatenate([np.asarray(v) for v in got["y"]])]
        speed = np.zeros_like(w)
        for _ in range(600):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed + x.T @ (target - p) / len(x) - 1e-4 * w
            w += 0.5 * speed
    left, right, skip = (w[width + k * LABELS : width + (k + 1) * LABELS] for k in range(3))
    return Field(w[:width], (left + right.T) / 2, (skip + skip.T) / 2)


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, least: float = 0.8) -> list[tuple[int, int, int]]:
    """Spans of nodes that the field is sure of and that touch no base span. What the patterns find is certain to it."""
    spans = nodes(text)
    if not len(spans):
        return []
    p = field.beliefs(field.potentials(text, spans), skips(text, spans), labels_of(spans, base))
    starts = np.array([b[0] for b in base] or [len(text) + 1])
    ends = np.maximum.accumulate(np.array([b[2] for b in base] or [len(text) + 1]))
    kind = p[:, 1:].argmax(1)
    out = []
    for n in np.flatnonzero(p[np.arange(len(p)), kind + 1] >= least).tolist():
        a, b = spans[n].tolist()
        i = int(np.searchsorted(ends, a, "right"))
        if i >= len(base) or starts[i] >= b:
            out.append((a, int(kind[n]), b))
    return out


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, base, spans for each row of docs: arrays of structs kind, start, end (code points, end exclusive) of what
    the patterns find, and of that with what the field adds.

    A null text is empty and has no spans; rows do not depend on each other; texts are read whole, with about 700 bytes for each
    token with a digit or an @; an empty table gives
    no rows; other columns are ignored.
    """

    def find(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        shape = lambda v: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in v]
        for batch in batches:
            for x in pieces(batch, "text"):
                base, every = [], []
                for t in x.column(1).to_pylist():
                    some = bool(t) and ANY.search(t) is not None
                    own = base_spans(t) if some else []
                    base.append(shape(own))
                    every.append(shape(sorted(own + added_spans(t, own, field, least))) if some else [])
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(base, span), pa.array(every, span)], ["doc_id", "base", "spans"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, f"doc_id {kind}, base {span}, spans {span}")


def digested(found: DataFrame) -> DataFrame:
    """find_pii's rows as counts of the base spans, a digest of them, and a text and the number of all spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
