import math

import pytest
import sentencepiece

from fareline.llm import pieces as P
from tests.llm.rows import documents, prose

TEXTS = [
    "", " ", "a", "  a b  ", "hello world", "日本語 テスト", "😀😀x", "a\nb\n\n c", "\t\x00z", "the the thes", "%%%%%% ***",
    "<s> </s> <unk> <0x41>", "a" * 300, " " * 50 + "x" + " " * 33, "Éç qui. Une de èêvi éaielleeau.", prose(200, 1),
]


def model():
    return P.read_model(P.MODEL)


def library(raw):
    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def as_unigram(raw):
    """The same pieces with logarithmic scores in steps of an eighth, whose sums are exact."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(raw)
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        if piece.type == 1:
            piece.score = -round(8 * (8 + math.log(2 - piece.score))) / 8
    return proto.SerializeToString()


@pytest.mark.parametrize("unigram", [False, True])
def test_ids_are_those_of_the_library(unigram):
    raw = as_unigram(model()) if unigram else model()
    codec, lib = P.Codec(raw, remembered=50), library(raw)
    assert codec.merges != unigram
    for text in TEXTS:
        assert codec.encode(text).tolist() == lib.encode(text), text
        assert codec.decode(lib.encode(text)) == text


def test_search_finds_the_best_sum():
    codec = P.Codec(model(), merges=False)
    word = P.MARK + "the"

    def best(text):
        if not text:
            return 0.0
        ends = [k for k in range(1, len(text) + 1) if text[:k] in codec.scores]
        return max(codec.scores[text[:k]][0] + best(text[k:]) for k in ends)

    for text in (word, word + "se", P.MARK + "nation", P.MARK + "xyz"):
        ids = codec.search(text)
        assert "".join(codec.texts[i] for i in ids) == text
        assert sum(codec.scores[codec.texts[i]][0] for i in ids) == best(text)


def test_columns(spark):
    raw = model()
    docs = documents(spark, [None, *TEXTS, TEXTS[-1]])
    both = P.decoded(P.encoded(docs, raw), raw)
    lib = library(raw)
    for r in both.collect():
        text = r["text"] or ""
        assert r["piece_ids"] == lib.encode(text) and r["decoded"] == text
    assert P.encoded(docs.limit(0), raw).count() == 0


def test_query(spark, tmp_path):
    documents(spark, [None, *TEXTS, prose(50_000, 2)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = P.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 2
    assert all(r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) for r in rows)
