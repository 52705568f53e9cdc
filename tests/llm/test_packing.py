import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from fareline.llm import packing as P
from tests.llm.rows import documents, prose


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())


@pytest.mark.parametrize("seed", range(40))
def test_boundaries_are_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    histogram = Counter(rng.integers(0, 15, rng.integers(1, 40)).tolist())
    buckets = int(rng.integers(1, 5))
    got = P.boundaries(histogram, buckets)
    lengths = sorted(histogram)
    every = [
        (*c, lengths[-1]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k)
    ]
    least = min(padding(histogram, e) for e in every)
    assert len(got) <= buckets and padding(histogram, got) == least


def test_packed(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ROWS", 16)
    texts = [None, "", " ", *[prose(n, n) for n in range(1, 60)], *["same copy"] * 50, prose(9000, 1)]
    docs = documents(spark, texts)
    rows = P.packed(P.pieces(docs, P.word_count(), 1000), token_budget=2000, buckets=4).collect()
    whole = defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append(r)
        assert r["padding"] == r["boundary"] - r["length"] >= 0
    assert sorted(whole) == list(range(len(texts)))
    for i, parts in whole.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == [1000 * k for k in range(len(parts))]
        assert sum(r["length"] for r in parts) == len((texts[i] or "").split())
    batches = defaultdict(list)
    for r in rows:
        batches[r["batch"]].append(r)
    for batch in batches.values():
        assert len({r["boundary"] for r in batch}) == 1
        assert sum(r["boundary"] for r in batch) <= 2000
        assert sorted(r["place"] for r in batch) == list(range(len(batch)))
    assert sum(r["padding"] for r in rows) == padding(Counter(r["length"] for r in rows), {r["boundary"] for r in rows})


def test_batches_of_token_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ROWS", 16)
    texts = [None, "", " ", "<|endoftext|> é \U0001f600", *[prose(n, n) for n in range(1, 40)], *["same copy"] * 40, prose(4000, 1)]
    docs = documents(spark, texts)
    rows = P.packed(P.tokenised(docs, max_length=300), token_budget=2000, buckets=4)
    encoder = P.ByteVocabulary(P.VOCABULARY).encoder()
    parts = defaultdict(list)
    for r in rows.collect():
        assert r["length"] == len(r["ids"]) <= 300 and r["start"] == 300 * r["piece"]
        parts[r["doc_id"]].append((r["piece"], r["ids"]))
    for i, text in enumerate(texts):
        assert [p for p, _ in sorted(parts[i])] == list(range(len(parts[i])))
        assert encoder.decode([x for _, ids in sorted(parts[i]) for x in ids]) == (text or "")
    histogram = Counter(len(ids) for p in parts.values() for _, ids in p)
    again, added = defaultdict(dict), 0
    for b in P.batches(rows, pad_id=-1).collect():
        assert {len(x) for x in b["ids"]} == {b["boundary"]} and b["boundary"] * len(b["ids"]) <= 2000
        for doc, piece, n, ids in zip(b["doc_ids"], b["pieces"], b["lengths"], b["ids"], strict=True):
            again[doc][piece] = ids[:n]
            assert ids[n:] == [-1] * (b["boundary"] - n)
            added += b["boundary"] - n
    assert {d: sorted(p.items()) for d, p in again.items()} == {d: sorted(p) for d, p in parts.items()}
    assert added == padding(histogram, P.boundaries(histogram, 4))


def test_rows_that_repeat_are_dealt_to_several_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ROWS", 16)
    docs = documents(spark, ["one and the same"] * 400, [None] * 400)
    rows = P.pack(docs).select("batch", "place").collect()
    assert len(set(rows)) == 400 and len({r["batch"] for r in rows}) > 10


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b", "a b", None], [1, 1, None])
    assert P.pack(docs).count() == 3
    assert P.pack(docs.limit(0)).count() == 0
    assert P.boundaries({}) == []


def test_ids_are_stored_and_shuffled_as_bytes(spark, monkeypatch):
    stored = []
    kept = P.tables.kept
    monkeypatch.setattr(P.tables, "kept", lambda df, *a: stored.append(df.schema["ids"].dataType.simpleString()) or kept(df, *a))
    texts = [None, "", "é \U0001f600", *[prose(n, n) for n in range(1, 1500, 60)], prose(9000, 1)]
    docs = documents(spark, texts)
    rows = P.pack(docs)
    assert stored == ["binary"] and rows.schema["ids"].dataType.simpleString() == "array<int>"
    want = {(r["doc_id"], r["piece"]): r["ids"] for r in P.tokenised(docs).collect()}
    assert {(r["doc_id"], r["piece"]): r["ids"] for r in rows.collect()} == want
    encoder = P.ByteVocabulary(P.VOCABULARY).encoder()
    for i, text in enumerate(texts):
        assert encoder.decode([x for d, piece in sorted(want) if d == i for x in want[d, piece]]) == (text or "")


def test_ids_of_a_large_vocabulary_take_four_bytes(spark, monkeypatch):
    docs = documents(spark, [None, "a b", prose(300, 1)])
    want = sorted(map(str, P.tokenised(docs).collect()))
    monkeypatch.setattr(P, "_id_type", lambda vocabulary: "<i4")
    assert sorted(map(str, P.tokenised(docs).collect())) == want
