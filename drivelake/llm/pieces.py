"""SentencePiece encoding and decoding of merge-type vocabularies by an agenda of adjacent pairs."""

from __future__ import annotations

import codecs
import gc
import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces as batch_pieces

SPACE = "▁"
#: Chunks of more characters are not remembered.
LONG = 64
#: Above all ranks: what forms no piece.
NONE = (1 << 62, -1)
#: The places that a note can hold; texts in Arrow batches are shorter.
PLACE = (1 << 32) - 1
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5

codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def linked(texts: Iterable[str]) -> list[set[str]]:
    """The characters of texts, in sets of those that stand side by side somewhere, directly or through others; the largest
    set first."""
    group: dict[str, set[str]] = {}
    for t in texts:
        for c in t:
            group.setdefault(c, {c})
        for c, e in zip(t, t[1:]):
            a, b = sorted((group[c], group[e]), key=len)
            if a is not b:
                b |= a
                group.update(dict.fromkeys(a, b))
    return sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-len(g), min(g)))


class _Chars(dict):
    """The piece of a character, -1 where it has none."""

    def __missing__(self, c: str) -> int:
        return -1


class _Known(dict):
    """ids of chunks; what is asked for the first time is looked up in the older generation or merged."""

    def __init__(self, of: Pieces) -> None:
        self.of = of

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if not (found := self.of.older.get(chunk)):
            found = self.of.merging(chunk)
            if self.of.merged is not None:
                self.of.merged.append(chunk)
        if len(chunk) <= LONG:
            self[chunk] = found
        return found


class Pieces:
    """A merge-type vocabulary: encodes texts to ids and decodes them, as the file's own settings say.

    A text is cut where no piece can reach across. Characters that stand side by side in some piece, spaces apart, are of one
    kind, and so are those linked through others; a chunk is a run of one kind with the spaces before it, as no piece has
    a space inside. Each is merged on its own (agenda) and, if short, remembered in two generations of about `most`.

    Vocabularies of another type, with a table that rewrites characters, with pieces of the user's own or unused ones, or
    without a piece for every byte, or with a space inside a piece, raise ValueError: their rules aren't those written here."""

    def __init__(self, path: str, most: int = 800_000) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library, model = SentencePieceProcessor(model_file=path), pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or {USER, UNUSED} & kinds or sum(p.type == BYTE for p in model.pieces) != 256:
            raise ValueError(f"not a plain merge-type vocabulary with byte fallback: {path}")
        self.prefix = " " if rules.add_dummy_prefix else ""
        # Spaces stand for themselves here, as texts then stay short in memory.
        self.rank = {p.piece.replace(SPACE, " "): (-p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        order = {score: k << PLACE.bit_length() for k, score in enumerate(sorted({score for score, _ in self.rank.values()}), 1)}
        # For the id of a left piece, the rank and the id of what it forms with the ids of right ones; -1 are characters without one.
        self.merge: list[dict] = [{} for _ in range(len(model.pieces) + 1)]
        for piece, (score, i) in self.rank.items():
            for k in range(1, len(piece)):
                if (a := self.rank.get(piece[:k])) and (b := self.rank.get(piece[k:])):
                    self.merge[a[1]][b[1]] = order[score], i
        self.of_char = _Chars({c: i for c, (_, i) in self.rank.items() if len(c) == 1}).__getitem__
        self.of_byte = [0] * 256
        self.surface = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.of_byte[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.surface.append(b"" if p.type == CONTROL else (model.trainer_spec.unk_surface if p.type == UNKNOWN else p.piece.replace(SPACE, " ")).encode())
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.spaced = {i for p, (_, i) in self.rank.items() if p.startswith(" ")}
        long = [p for p in self.rank if len(p) > 1]
        if any(" " in p.lstrip(" ") for p in long):
            raise ValueError(f"a piece of {path} has a space inside")
        kinds = [f" *[{''.join(map(re.escape, sorted(k)))}]+" for k in linked(p.lstrip(" ") for p in long)]
        self.chunks = re.compile("|".join([*kinds, " *[^ ]| +"]), re.S).findall
        self.most, self.known, self.older = most, _Known(self), {}
        self.merged: list[str] | None = None  # since they were last compared with the library's, where they are

    def merging(self, chunk: str) -> tuple[int, ...]:
        """agenda, for short chunks by looking through all pairs for the best each time, which costs them less."""
        symbols = list(map(self.of_char, chunk))
        if len(symbols) > LONG or -1 in symbols:
            return self.agenda(chunk)
        merge = self.merge
        ranks = [merge[s].get(t, NONE)[0] for s, t in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < NONE[0]:
            i = ranks.index(least)
            s = symbols[i] = merge[symbols[i]][symbols[i + 1]][1]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merge[symbols[i - 1]].get(s, NONE)[0]
            if i < len(ranks):
                ranks[i] = merge[s].get(symbols[i + 1], NONE)[0]
        return tuple(symbols)

    def agenda(self, chunk: str) -> tuple[int, ...]:
        """ids of a chunk: of all adjacent pairs of symbols that form a piece, the one of the best score, of equal ones the
        leftmost, is merged, until none is left. The agenda holds the score's rank and the left symbol's place in one number; a
        note whose pair has another rank by now is passed over."""
        merge, n = self.merge, len(chunk)
        symbols = list(map(self.of_char, chunk))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        notes = [f[0] + i for i, (s, t) in enumerate(zip(symbols, symbols[1:])) if (f := merge[s].get(t))]
        heapify(notes)
        while notes:
            note = heappop(notes)
            i = note & PLACE
            j = after[i]
            if j >= n or (s := symbols[i]) is None or not (f := merge[s].get(symbols[j])) or f[0] + i != note:
                continue
            symbols[i] = s = f[1]
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if f := merge[s].get(symbols[k]):
                    heappush(notes, f[0] + i)
            if (h := before[i]) >= 0 and (f := merge[symbols[h]].get(s)):
                heappush(notes, f[0] + h)
        if -1 not in symbols:
            return tuple([s for s in symbols if s is not None])
        return tuple(chain.from_iterable([s] if s >= 0 else map(self.of_byte.__getitem__, c.encode()) for s, c in zip(symbols, chunk) if s is not None))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if len(self.known) > self.most:
            self.known, self.older = _Known(self), self.known
        return list(chain.from_iterable(map(self.known.__getitem__, self.chunks(self.prefix + text.replace(SPACE, " ")))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no character are U+FFFD each, and the space put before the text goes."""
        if not self.silent.isdisjoint(ids):
            # Bytes on both sides of a control piece form no character together.
            runs = [list(g) for silent, g in groupby(ids, self.silent.__contains__) if not silent]
            return "".join([self.decode(g) if not k else self.plain(g) for k, g in enumerate(runs)])
        return self.plain(ids)[1 if ids and self.prefix and ids[0] in self.spaced else 0 :]

    def differing(self, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[int]:
        """The places of texts whose ids, or the text that these give, aren't the sentencepiece library's."""
        return [k for k, (i, t, j, u) in enumerate(zip(ids, decoded, self.library.encode(texts, num_threads=1), self.library.decode(ids, num_threads=1))) if i != j or t != u]

    def suspect(self, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[int]:
        """The places of texts to be compared with the library: of all, if it encodes or decodes a chunk otherwise that was merged
        since self.merged was set to []; else of those that don't decode to themselves. Chunks are compared in runs, a line end between
        them; as no piece reaches from chunk to chunk, texts of equal chunks are equal."""
        merged, self.merged = self.merged, None
        runs = ["\n".join(merged[i : i + 5000]) for i in range(0, len(merged), 5000)]
        own = [self.encode(r) for r in runs]
        if self.differing(runs, own, [self.decode(i) for i in own]):
            return list(range(len(texts)))
        return [k for k, (t, u) in enumerate(zip(texts, decoded)) if t.replace(SPACE, " ") != u]

    def plain(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "each_byte")


_loaded: dict[str, Pieces] = {}


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """doc_id, ids array<int>, decoded for each row of docs: the ids of its whole text, and the text that they give.

    No begin or end ids, no sampling. With check, every chunk is also encoded and decoded by the sentencepiece library when it is
    merged, and every text is decoded to itself; what isn't as it should be is compared whole, and a row that differs raises
    RuntimeError with its id, as its vocabulary then has rules that aren't those of Pieces. A null text is empty and has no ids; rows don't depend on each
    other, so that repeated ones give equal results; an empty table gives no rows; other columns are ignored under any
    names. U+2581 in a text counts as a space, as it does for the library. A very long text is encoded whole, with memory of
    some hundred bytes a token."""

    def run(batches):
        if model not in _loaded:
            _loaded[model] = Pieces(model)
        own = _loaded[model]
        gc.disable()  # nothing here makes cycles, and collections would walk through all that is remembered
        try:
            for b in batches:
                for x in batch_pieces(b, "text", 4 << 20):
                    at: dict[str, int] = {}
                    where = pa.array([at.setdefault(t or "", len(at)) for t in x.column(1).to_pylist()])
                    texts = list(at)  # equal ones once
                    own.merged = [] if check else None
                    ids = [own.encode(t) for t in texts]
                    decoded = [own.decode(i) for i in ids]
                    if check:
                        some = own.suspect(texts, ids, decoded)
                        for k in own.differing(*([v[k] for k in some] for v in (texts, ids, decoded))):
                            raise RuntimeError(f"ids or text of {x.column(0)[where.index(some[k]).as_py()]} differ from the library's")
                    yield pa.RecordBatch.from_arrays([x.column(0), pa.array(ids, pa.list_(pa.int32())).take(where), pa.array(decoded, pa.string()).take(where)], ["doc_id", "ids", "decoded"])
        finally:
            gc.enable()
            own.older = {}  # the worker may live on with other tasks

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digested(encoded: DataFrame) -> DataFrame:
    """encode_texts' rows as the number of ids, a digest of them and one of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
