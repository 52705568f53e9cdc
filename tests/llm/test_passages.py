import hashlib

import numpy as np
import pytest

from fareline.llm import passages as P
from fareline.llm import words
from tests.llm.rows import documents, prose


def wanted(texts, ids):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in zip(ids, split, strict=True):
        for s in range(len(w) - P.WINDOW + 1):
            key = tuple(w[s : s + P.WINDOW])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in zip(ids, split, strict=True):
        gone = set()
        for s in range(len(w) - P.WINDOW + 1):
            if first[tuple(w[s : s + P.WINDOW])] < i:
                gone.update(range(s, s + P.WINDOW))
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def found(docs):
    out = {}
    for r in P.cleaned(docs).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(s["last"] - s["first"] for s in r["spans"]) == r["n_removed"]
        out.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    return {i: sorted(v) for i, v in out.items()}


def corpus():
    shared = prose(60, seed=1)
    texts = [None, "", "one two", shared, prose(12, 2), prose(12, 2), prose(13, 3), prose(13, 3)]
    texts += [f"{prose(30, 10 + i)} {shared} {prose(9, 40 + i)}" for i in range(12)]
    texts += [f"a {shared[:-9]} {prose(5000, 5)}", "x " * 400, "x y x\x1cz " * 30, "\n" + shared.replace(" ", "\t\n ")]
    few = np.random.default_rng(6)
    return texts + [" ".join("ab"[k] for k in few.integers(0, 2, 60)) for _ in range(25)]


@pytest.mark.parametrize("hot", [P.HOT_SEGMENTS, 3])
def test_words_that_go(spark, monkeypatch, hot):
    monkeypatch.setattr(P, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(P, "SHARD_SEGMENTS", 20)
    texts = corpus()
    ids = list(np.random.default_rng(0).permutation(len(texts)).tolist())
    assert found(documents(spark, texts, ids)) == wanted(texts, ids)


def test_equal_ids_and_null_ids(spark):
    text = prose(30, 9)
    docs = documents(spark, [text, text + " end", text, text], [5, 5, None, 7])
    got = found(docs)
    assert [n for _, n, _ in got[5]] == [0, 0] and got[None][0][1] == 0 and got[7][0][1] == 30


def test_empty_table(spark):
    assert P.cleaned(documents(spark, ["a"]).limit(0)).count() == 0


def test_automaton_knows_the_smallest_id():
    rng = np.random.default_rng(3)
    rows = [(["ab"[k] for k in rng.integers(0, 2, n)], int(rng.integers(0, 99))) for n in rng.integers(1, 20, 60)]
    automaton = P.SuffixAutomaton()
    for sequence, i in rows:
        automaton.add(sequence, i)
    automaton.finish()
    for sequence, _ in rows:
        want = [
            min(i for other, i in rows for a in range(len(other) - 3) if other[a : a + 4] == sequence[s : s + 4])
            for s in range(len(sequence) - 3)
        ]
        assert automaton.least_ids(sequence, 4) == want


def test_equal_windows_have_equal_anchors():
    shared = prose(20, 1).encode()
    one, two = (P.anchors(words.split([t])) for t in (shared, b"before this " + shared + b" and after"))
    assert set(one.hashes.tolist()) <= set(two.hashes.tolist())
    assert one.windows.sum() == 8
