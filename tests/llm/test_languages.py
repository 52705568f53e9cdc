import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fareline.llm import languages as L
from tests.llm.rows import documents

WORDS = {"de": "der die und nicht schön über ich", "en": "the and with that this have", "fr": "le les une était près avec"}


def corpus(n=90, seed=0):
    rng = np.random.default_rng(seed)
    langs = sorted(WORDS)
    return [(" ".join(rng.choice(WORDS[langs[i % 3]].split(), 12)), langs[i % 3]) for i in range(n)]


def test_bundle_against_a_plain_sum():
    space, text = L.Letters(64), "Über 3 ABBA, abba!"
    points = [ord(c) for c in " über abba abba "]
    want = sum(
        np.roll(space.letter(a), 2) * np.roll(space.letter(b), 1) * space.letter(c)
        for a, b, c in zip(points, points[1:], points[2:])
    )
    assert np.array_equal(space.bundle(text), want)
    assert L.Letters(64).bundle("1 2 ?") is None and L.Letters(64).bundle(None) is None
    assert L.Letters(64).bundle("x") is not None


@pytest.mark.parametrize("text", ["½ ²", "①②", "Ⅷ", "٣", "12 _ ?", "́", "", None])
def test_no_letter_is_no_language(text):
    assert len(L.letters(text)) == 0


def test_marks_belong_to_their_letters():
    assert L.letters("हिन्दी").tolist() == [32, *map(ord, "हिन्दी"), 32]
    assert L.letters("Ⅷa①b").tolist() == [32, ord("a"), 32, ord("b"), 32]


def test_texts_without_a_letter_and_a_clashing_name(spark):
    texts = ["und der", "½ ²", "①②", "Ⅷ", "٣"]
    docs = documents(spark, texts).withColumn("_language", F.lit("kept"))
    learned = {"de": L.Letters().bundle("der die und"), "en": L.Letters().bundle("the and with")}
    out = L.with_language(docs, learned)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["de", *[L.UNKNOWN] * 4]
    assert all(r["_language"] == "kept" for r in got.values())


def test_repeated_rows(spark):
    docs = documents(spark, ["und der", "und der", "the and"], ids=[1, 1, None])
    learned = {"de": L.Letters().bundle("der die und"), "en": L.Letters().bundle("the and with")}
    got = sorted((r["doc_id"] or -1, r["lang_pred"]) for r in L.with_language(docs, learned).collect())
    assert got == [(-1, "en"), (1, "de"), (1, "de")]


def test_pieces_of_long_texts_add_up(monkeypatch):
    text = "die schöne welt " * 50
    whole = L.Letters(64).bundle(text)
    monkeypatch.setattr(L, "PIECE", 7)
    assert np.allclose(whole, L.Letters(64).bundle(text))


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    texts = [t for t, _ in rows] + [None, "", "123 !?", "x", "und der " * 30_000]
    docs = documents(spark, texts)
    langs = spark.createDataFrame([(i, lang) for i, (_, lang) in enumerate(rows)], "doc_id long, lang string")
    docs.drop("lang").join(langs, "doc_id", "left").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in L.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    n = len(rows)
    assert np.mean([got[i]["lang_pred"] == lang for i, (_, lang) in enumerate(rows)]) == 1
    assert [got[n + j]["lang_pred"] for j in range(3)] == [L.UNKNOWN] * 3
    assert got[n + 3]["lang_pred"] in WORDS and got[n + 4]["lang_pred"] == "de"


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["abc", None])
    learned = L.prototypes(docs.limit(0))
    assert learned == {}
    assert {r["lang_pred"] for r in L.with_language(docs, learned).collect()} == {L.UNKNOWN}
    assert L.with_language(docs.limit(0), learned).count() == 0


def test_sample_is_bounded(spark):
    docs = documents(spark, [f"text {i}" for i in range(3000)])
    assert 600 < L.sampled(docs, 1000).count() < 1400
    assert L.sampled(docs, 5000).count() == 3000
