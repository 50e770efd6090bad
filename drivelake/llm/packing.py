"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored

ODD = "\x1c\x1d\x1e\x1f"
MARKS = ".,!|?;:#$%&*"
#: A Latin-1 word and the marks after it. These letters are in every normal form, and lower case takes each to one letter.
WORD = re.compile(f"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([{re.escape(MARKS)}]*)").fullmatch


def bare(tokenizer) -> tuple:
    """The tokenizer without its normal forms, whether these take words to lower case, and of each id whether it ends a word.
    None in place of the tokenizer where its normal forms do more to Latin-1 words than that, or ids don't tell ends: they do in
    a vocabulary with a mark of its own for the end of a word, in which every byte has a piece with the mark."""
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    rules = json.loads(tokenizer.to_str())
    forms, model, vocab = rules["normalizer"] or {"type": "Sequence", "normalizers": []}, rules["model"], tokenizer.get_vocab()
    forms = forms["normalizers"] if forms["type"] == "Sequence" else [forms]
    kinds = {f["type"] for f in forms if f != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}}
    mark = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not mark or not all(isinstance(m, list) for m in model["merges"]) or not kinds <= {"NFC", "Lowercase"} or not all(c + mark in vocab for c in ByteLevel.alphabet()):
        return None, False, None
    ends = np.zeros(1 + max(vocab.values()), bool)
    ends[[i for t, i in vocab.items() if t.endswith(mark)]] = True
    rules["normalizer"] = None
    out = Tokenizer.from_str(json.dumps(rules))
    asked = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    # Without its own memory of words, as each is asked for once.
    out.model = BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]], cache_capacity=0, **{k: model[k] for k in asked if model.get(k) is not None})
    return out, "Lowercase" in kinds, ends


class Ids:
    """Token ids, as little-endian 32-bit bytes, of the chunks between white space. The tokenizer treats those one by
    one, for none of its rules reaches across white space. Chunks are remembered in two generations of about `most`
    each: when the younger is full, the older is forgotten but for the chunks that came again."""

    def __init__(self, path: str, most: int = 800_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bare, self.lowers, self.ends = bare(self.tokenizer)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def unknown(self, chunks: set[str]) -> set[str]:
        """Those of neither generation; those of the older one alone are taken into the younger."""
        missed = chunks.difference(self.known)
        new = missed.difference(self.older)
        for c in missed.difference(new):
            self.known[c] = self.older[c]
        return new

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        split = []
        words, others = set(), set()
        for c in self.unknown(chunks):
            if not (m := WORD(c)):
                others.add(c)
                continue
            core, tail = m.groups()
            low = core.lower() if self.lowers else core
            words.add(low)
            if low != c:
                split.append((c, low, tail))
                if tail:
                    others.add(tail)
        self.learn_words(list(self.unknown(words)))
        self.learn_others(list(self.unknown(others)))
        known = self.known
        for c, low, tail in split:  # marks after letters are a token run of their own
            known[c] = known[low] + known[tail] if tail else known[low]

    def learn_others(self, chunks: list[str]) -> None:
        """ids of any chunks, many in one text with a bar between them; those with a bar of their own one by one."""
        alone = [c for c in chunks if "|" in c]
        plain = [c for c in chunks if "|" not in c]
        for i in range(0, len(plain), 5000):
            some = plain[i : i + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" | ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.bar[0]) if len(self.bar) == 1 else ()
            if len(at) != len(some) - 1:
                alone += some
                continue
            data = ids.tobytes()
            for c, a, b in zip(some, [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(data)]):
                self.known[c] = data[a:b]
        for i in range(0, len(alone), 5000):
            for c, x in zip(alone[i : i + 5000], self.tokenizer.encode_batch_fast(alone[i : i + 5000], add_special_tokens=False)):
                self.known[c] = np.array(x.ids, "<u4").tobytes()

    def learn_words(self, words: list[str]) -> None:
        """ids of Latin-1 words, many in one text: each is one word to the tokenizer. Where it can be told by the ids which end
        a word, neither normal forms nor places are asked of it."""
        for i in range(0, len(words), 5000):
            some = words[i : i + 5000]
            if self.bare:
                ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                cut = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            else:
                x = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
                ids, word = np.array(x.ids, "<u4"), np.array(x.word_ids)
                cut = (4 * np.flatnonzero(np.diff(word, prepend=-1, append=-1))).tolist()
            data = ids.tobytes()
            if len(cut) != len(some) + 1 or cut[-1] != len(data):  # not one word each to this tokenizer
                self.learn_others(some)
                continue
            for c, a, b in zip(some, cut[:-1], cut[1:]):
                self.known[c] = data[a:b]

    def __call__(self, texts: list[str]) -> list[bytes]:
        own = list(dict.fromkeys(texts))  # equal ones once
        chunks = [None if any(c in t for c in ODD) else t.split() for t in own]
        self.learn(set().union(*(c for c in chunks if c)))
        ids = {t: self.encode(t) if c is None else b"".join(map(self.known.__getitem__, c)) for t, c in zip(own, chunks)}
        return [ids[t] for t in texts]


_ids: dict[str, Ids] = {}


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy, piece, start, length, ids_crc32 of every piece: a document's ids, then end_id, cut after every
    `capacity` ids. copy tells rows apart that share an id and a text."""

    def tokenize(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _ids:
            _ids[tokenizer] = Ids(tokenizer)
        encode, end, step = _ids[tokenizer], np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            for x in pieces(b, "text", 4 << 20):
                out = []
                for doc, copy, ids in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), encode([t or "" for t in x.column(1).to_pylist()])):
                    ids += end
                    out += [(doc, copy, i // step, i // 4, len(p) // 4, zlib.crc32(p)) for i in range(0, len(ids), step) if (p := ids[i : i + step])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (x.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "copy", "piece", "start", "length", "ids_crc32"])
        encode.older = {}  # the worker may live on with other tasks

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("copy"))
    return own.mapInArrow(tokenize, f"doc_id {kind}, copy long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A bin and an offset for each length, and the number of bins. Each length, the longest first, goes where the sum of
    the squared counts of open bins over residual gaps becomes least; of equal choices, to the fullest bin that takes it."""
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, at, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # From gap g to g - s: 2 (n[g - s] - n[g]) + 2; a full bin leaves the sum; a new bin comes with gap capacity - s.
        gain = 2 * (n[: capacity - s] - n[s:capacity]) + 2
        gain[:1] = 1 - 2 * n[s]
        gain[n[s:capacity] == 0] = 1 << 60
        g = s + int(gain.argmin()) if len(gain) else 0
        if len(gain) and gain[g - s] <= (2 * n[capacity - s] + 1 if s < capacity else 0):
            k = open_bins[g].pop()
            n[g] -= 1
        else:
            k, g, used = used, capacity, used + 1
        where[i], at[i] = k, capacity - g
        if g > s:
            open_bins[g - s].append(k)
            n[g - s] += 1
    return where, at, used


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, group_tokens: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs.

    Sequences hold at most `capacity` tokens. Documents are tokenized where they lie; only the short rows of the pieces
    are shuffled, dealt by a hash into groups of about `group_tokens` tokens, each of which is packed by the
    sum-of-squares rule, so that a group's last, unfilled sequences are a small share. Pieces of full length fill a
    sequence of their own and need no packing. A null text is empty and gives one piece, the end id; rows that repeat
    an id are packed once each; an empty table gives no rows; other columns are ignored.
    """
    cut = stored(tokenized_pieces(docs, tokenizer, end_id, capacity, id_col, text_col))
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    by = F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "copy"], kind="stable", ascending=False, na_position="last")
        where, at, _ = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["g"].to_numpy() + where * groups, offset=at)[names]

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kinds = dict(cut.dtypes) | {"sequence_id": "bigint", "offset": "bigint"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    # One group's rows are bounded by group_tokens: no piece is empty.
    short = cut.filter(F.col("length") < capacity).withColumn("g", by).groupBy("g").applyInPandas(fill, schema)
    full = cut.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(*names)
    return short.unionByName(full)
