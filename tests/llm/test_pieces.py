"""SentencePiece encoding against the library: random texts, whole batches, and what other vocabularies are told."""

import hashlib
import random

import pytest
from drivelake.llm import pieces
from drivelake.llm.queries import PIECES, tokenizer_path

TEXTS = ["", None, " ", "  a  b ", "a\nb\t\r\nc", "\x00a", "▁a ▁▁b▁", "é̀ﬁ 日本語 한국어 العربية", "😀\U0010ffff", "<s> </s> <unk> <0x41>", "1234567890" * 30, "x" * 5000, "word " * 5000, " " * 700, "Straße, l'été; naïve… «ça»"]


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(tokenizer_path(PIECES))


def test_random_texts(own):
    r = random.Random(5)
    signs, some = " \n\tab▁eéß日本語1230x<>😀́\x00İ.,'\"thein\r　", sorted(own.rank)
    for n in range(4000):
        text = "".join(r.choice(signs if n % 2 else some) for _ in range(r.randrange(30)))
        ids = own.encode(text)
        assert ids == own.library.encode(text), repr(text)
        assert own.decode(ids) == own.library.decode(ids), repr(text)


def test_any_ids(own):
    """Ids that no text gives: control pieces, and bytes that form no character."""
    r = random.Random(6)
    for _ in range(4000):
        ids = [r.choice([0, 1, 2, 35, r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randrange(9))]
        assert own.decode(ids) == own.library.decode(ids), ids


def test_what_is_remembered_is_bounded():
    few, many = pieces.Pieces(tokenizer_path(PIECES), most=50), pieces.Pieces(tokenizer_path(PIECES))
    r = random.Random(7)
    for _ in range(300):
        text = " ".join("".join(r.choice("abcdef") for _ in range(r.randrange(1, 5))) for _ in range(20))
        assert few.encode(text) == many.encode(text)
    assert len(few.known) < 120 and len(few.older) < 120


def test_linked():
    assert pieces.linked(["ab", "bc", "xy", "z"]) == [{"a", "b", "c"}, {"x", "y"}, {"z"}]


def test_frame(spark, own):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)] * 2 + [(None, "a b", "y", 2)], "doc_id long, text string, ids string, decoded int")
    got = pieces.encode_texts(docs, tokenizer_path(PIECES)).collect()
    assert len(got) == 2 * len(TEXTS) + 1
    for r in got:
        text = "a b" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["ids"] == own.library.encode(text)
        assert r["decoded"] == own.library.decode(r["ids"])
    row = pieces.digested(pieces.encode_texts(docs.filter("doc_id is null"), tokenizer_path(PIECES))).first()
    ids = own.library.encode("a b")
    assert row.asDict() == {"doc_id": None, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(b"a b").hexdigest()}
    assert pieces.encode_texts(docs.limit(0), tokenizer_path(PIECES)).collect() == []


def test_other_vocabularies(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(tokenizer_path(PIECES), "rb") as f:
        model.ParseFromString(f.read())
    for change in (lambda m: setattr(m.trainer_spec, "model_type", pb.TrainerSpec.UNIGRAM), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[300], "type", 4), lambda m: setattr(m.pieces[300], "piece", "a▁b")):
        other = pb.ModelProto()
        other.CopyFrom(model)
        change(other)
        path = tmp_path / "other.model"
        path.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError):
            pieces.Pieces(str(path))


def test_rows_that_differ_are_found(own):
    texts = ["one two", "", "three of them"]
    ids = [own.encode(t) for t in texts]
    assert own.differing(texts, ids, texts) == []
    assert own.differing(texts, [ids[0], [5], ids[2][::-1]], texts) == [1, 2]
    assert own.differing(texts, ids, ["one two", "", "tree of them"]) == [2]


def test_chunks_are_compared_once():
    """Each chunk is compared with the library when it is merged; a wrong one, or a text that isn't its own, has texts compared whole."""
    own, seen = pieces.Pieces(tokenizer_path(PIECES)), []
    plain = own.differing
    own.differing = lambda texts, *rest: seen.extend(texts) or plain(texts, *rest)

    def some(texts, spoil=lambda text: text):
        own.merged = []
        seen.clear()
        ids = [own.encode(t) for t in texts]
        return own.suspect(texts, ids, [spoil(own.decode(i)) for i in ids])

    assert some([t or "" for t in TEXTS]) == [] and sum(map(len, seen)) < sum(len(t or "") for t in TEXTS)
    assert some(["word word", " a  b"]) == [] and seen == []
    assert some(["word", "", "a b"], str.upper) == [0, 2]
    own.merging = lambda chunk: own.agenda(chunk)[::-1]
    assert some(["word word", "unheard things"]) == [0, 1]


def test_short_chunks_merge_as_the_agenda_has_it(own):
    r = random.Random(8)
    signs, some = "abeéß日本x😀.,'thein\r　", sorted(own.rank)
    for n in range(4000):
        chunk = "".join(r.choice(signs if n % 2 else some) for _ in range(r.randrange(1, 90)))
        assert own.merging(chunk) == own.agenda(chunk), repr(chunk)
