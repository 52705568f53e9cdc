import pytest

import corpus_pipeline

from fareline.llm import packing
from tests.llm.rows import documents, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    good = [prose(80, i) for i in range(40)]
    good[5] += " mail a@b.cd now"
    bad = [prose(80, 100 + i).replace(" ", "!! ") for i in range(20)]
    copies = [good[0], good[0].upper(), good[1], None, None, ""]
    near = [good[2].replace(good[2].split()[40], "other"), good[2].replace(good[2].split()[41], "thing")]
    texts = good + bad + copies + near
    documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(folder / "documents.parquet"))
    rows = [(i, int(i < 40), 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), texts


def test_stages_in_turn(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    after_quality = [i for i in range(len(texts)) if not 40 <= i < 60]
    assert sorted(left[0]) == after_quality
    # of equal texts the largest id stays; 60 and 61 are copies of 0, 62 of 1, 63 to 65 are empty
    assert sorted(left[1]) == sorted(set(after_quality) - {0, 60, 1, 63, 64})
    assert sorted(left[2]) == sorted(set(left[1]) - {66, 67})
    assert left[3][5] == texts[5].replace("a@b.cd", "<EMAIL>")
    assert {i: t for i, t in left[3].items() if i != 5} == {i: t for i, t in left[2].items() if i != 5}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == set(left[3])


def test_run(spark, corpus):
    folder, texts = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len({r["doc_id"] for r in rows}) == len(texts) - 20 - 5 - 2
    assert all(r["length"] == len(r["ids"]) for r in rows)
    # What is packed decodes to the kept texts, personal data replaced.
    encoder = packing.ByteVocabulary(packing.VOCABULARY).encoder()
    texts = [(t or "").replace("a@b.cd", "<EMAIL>") for t in texts]
    assert all(encoder.decode(r["ids"]) == texts[r["doc_id"]] for r in rows)


def test_empty_documents(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
